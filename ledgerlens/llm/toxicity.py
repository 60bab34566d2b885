"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else is unlabelled, whatever its
label says, because a missing mark is no proof. With the class prior p, losses l(+) and
l(-), the risk of a scorer is

    p * mean_P l(+)  +  max(0, mean_U l(-) - p * mean_P l(-)),

where the second part estimates the risk on clean documents and is kept from going below
zero: when it does, the step climbs that part again instead of fitting noise. Features are
words of the whole text whose rate among positives differs significantly from the rate
among unlabelled texts; the model is linear and trained in numpy.

The fit reads a sample of at most ``POSITIVES`` and ``UNLABELLED`` documents, the first ones
by a hash of the doc_id; scoring reads every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bytewords import ALNUM, blocks, text_buffers, words
from ledgerlens.llm.scratch import Scratch

POSITIVES = 4_000
UNLABELLED = 8_000
# Standard errors by which a word's rate among positives must differ to become a feature.
SIGNIFICANT = 4.0
# The class prior is kept within these limits.
LEAST_PRIOR, MOST_PRIOR = 1e-3, 0.5
EPOCHS = 300
STEP = 0.1
DECAY = 1e-4


@dataclass
class Features:
    """Distinct words of each document: ``first[d]`` to ``first[d + 1]`` are those of d."""

    word: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def features(column: pa.Array) -> Features:
    """Hashes of the distinct words of whole texts; null and empty texts have none."""
    data, offsets = text_buffers(column)
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in blocks(offsets):
        w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
        doc = w.doc
        order = np.lexsort((w.hash, doc))
        h, doc = w.hash[order], doc[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        hashes.append(h[fresh])
        docs.append(doc[fresh] + i)
    return Features(np.concatenate(hashes), np.searchsorted(np.concatenate(docs), np.arange(len(column) + 1)))


@dataclass
class Model:
    """Weights of word hashes (sorted) and the bias."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        total = np.full(n, self.bias)
        if len(self.known):
            f = features(column)
            at = np.minimum(np.searchsorted(self.known, f.word), len(self.known) - 1)
            hit = self.known[at] == f.word
            total += np.bincount(f.doc[hit], self.weights[at[hit]], n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(positive: Features, unlabelled: Features, size: int, prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer under the non-negative risk; ``word`` numbers the features here."""
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    n_pos, n_un = len(positive.first) - 1, len(unlabelled.first) - 1
    if not n_pos or not n_un or not size:
        return weights, bias
    moment, square = np.zeros(size + 1), np.zeros(size + 1)
    for turn in range(1, epochs + 1):
        s_pos, s_un = (
            1 / (1 + np.exp(-np.clip(np.bincount(f.doc, weights[f.word], n) + bias, -30, 30)))
            for f, n in ((positive, n_pos), (unlabelled, n_un))
        )
        # Logistic losses l(+) = -log s and l(-) = -log(1 - s), by their slopes in the score.
        clean_risk = prior * np.log(1 - s_pos + 1e-12).mean() - np.log(1 - s_un + 1e-12).mean()
        if clean_risk >= 0:
            g_pos, g_un = -prior * np.ones(n_pos) / n_pos, s_un / n_un
        else:
            g_pos, g_un = prior * s_pos / n_pos, -s_un / n_un
        gradient = np.append(
            np.bincount(positive.word, g_pos[positive.doc], size) + np.bincount(unlabelled.word, g_un[unlabelled.doc], size),
            g_pos.sum() + g_un.sum(),
        )
        gradient[:-1] += DECAY * weights
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = STEP * (moment / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-6)
        weights = weights - move[:-1]
        bias -= move[-1]
    return weights, float(bias)


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5, is 0; such labels are never learned from. False without id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn from the documents that are not held out.

    A document is positive if any of its label rows says toxic = 1; null and other labels
    leave it unlabelled. The class prior is the share of positives among labelled
    documents, within ``LEAST_PRIOR`` and ``MOST_PRIOR``. Without positives every score is the
    least prior, without features the prior. Of a sampled id with several texts one is read,
    the least by hash.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IS NOT NULL"
    )
    marked = marked.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id", F.lit("sample"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")

    def sample(ids: DataFrame, most: int) -> DataFrame:
        return ids.select("doc_id").distinct().orderBy(rank, "doc_id").limit(most)

    n_all, n_pos = marked.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not n_pos:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(LEAST_PRIOR / (1 - LEAST_PRIOR))))
    prior = min(MOST_PRIOR, max(LEAST_PRIOR, n_pos / n_all))
    positives = sample(marked.filter("toxic = 1"), POSITIVES).withColumn("positive", F.lit(1))
    others = sample(texts.filter(~held_out(F.col("doc_id"))), UNLABELLED).withColumn("positive", F.lit(0))
    # The sampled ids number POSITIVES + UNLABELLED at most, so they may be sent to every task.
    chosen = (
        texts.join(F.broadcast(positives.union(others)), "doc_id")
        .groupBy("doc_id", "positive")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("positive", "text")
    )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(f.first.astype(np.int32)), pa.array(f.word.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["positive", "words"])

    scratch = Scratch(documents.sparkSession, "toxicity")
    rows = scratch.keep(chosen.mapInArrow(listed, "positive int, words array<bigint>"), "sample")
    n_rows, n_pos = rows.agg(F.count("*"), F.sum("positive")).first()
    if not n_pos or n_pos == n_rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    n_un = n_rows - n_pos
    counted = (
        rows.select("positive", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("positive").alias("p"), F.count("*").alias("n"))
    )
    rate = F.col("n") / n_rows
    error = F.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_un))
    lift = F.col("p") / n_pos - (F.col("n") - F.col("p")) / n_un
    chosen_words = counted.filter(F.abs(lift) >= SIGNIFICANT * error).filter(f"n < {n_rows}").select("word")
    known = np.sort(np.array([r["word"] for r in chosen_words.collect()], dtype=np.int64).view(np.uint64))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of = batch.column(1)
            h = words_of.flatten().to_numpy().view(np.uint64)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(words_of).to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            ends = np.searchsorted(doc[hit], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["positive", "numbers"])

    table = rows.mapInArrow(numbers, "positive int, numbers array<int>").toArrow()
    scratch.drop(rows)

    def of(side: int) -> Features:
        kept = table.filter(pc.equal(table["positive"], side))["numbers"]
        sizes = pc.list_value_length(kept).to_numpy().astype(np.int64)
        return Features(pc.list_flatten(kept).to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))

    return Model(known, *fit(of(1), of(0), len(known), prior))


def score_column(documents: DataFrame, model: Model):
    """A function from the text column to its score between 0 and 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(pa.array(texts, pa.large_string(), from_pandas=True)))

    return score


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents``.

    Scores depend on the text alone: equal texts have equal scores, null and empty texts
    have the score of the bias. Repeated rows and ids give one row each; other columns are
    ignored, and so are labels without a document.
    """
    model = train(documents, labels)
    score = score_column(documents, model)
    scored = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
