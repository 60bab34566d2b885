"""Benchmark decontamination by a prefix-filtered join of word shingles.

A *window* is ``size`` consecutive words of a benchmark item, or the whole item if it is
shorter. A window occurs in a document only where all its shingles (three words, or fewer
for windows of one or two) follow each other there. So:

1. One pass over the texts keeps, per document, the runs of consecutive positions whose
   shingle may belong to the benchmark. The test is a bitmap of fixed size, whatever the
   benchmark's; a run too short for any window is left out.
2. Shingles are ordered by rarity, counted over the runs of all documents. For full
   containment the necessary prefix of a window is its single rarest shingle.
3. Prefix shingles are joined to the runs; a candidate must fit into the run at its offset
   (the length and positional bounds).
4. The candidate's words are compared with the window's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.bytewords import ALNUM, Words, blocks, grams, text_buffers, words
from ledgerlens.llm.scratch import Scratch
from ledgerlens.llm.slots import has_slot, slots_of

WINDOW = 10
SHINGLE = 3


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, length, words, shingles): one row per window; items without words give none."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows: dict[str, list] = {"item_id": [], "length": [], "words": [], "shingles": []}
            for i, j in blocks(offsets):
                base = offsets[i]
                w = words(data[base : offsets[j]], offsets[i : j + 1] - base, ALNUM)
                for d in range(j - i):
                    own = w.hash[w.first[d] : w.first[d + 1]]
                    length = min(size, len(own))
                    if not length:
                        continue
                    one = Words(None, None, own, np.array([0, len(own)]))
                    shingles = _signed(grams(one, min(SHINGLE, length))[0])
                    n = length - min(SHINGLE, length) + 1
                    for at in range(len(own) - length + 1):
                        rows["item_id"].append(ids[i + d])
                        rows["length"].append(length)
                        rows["words"].append(_signed(own)[at : at + length].tolist())
                        rows["shingles"].append(shingles[at : at + n].tolist())
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = pa.schema(
        [("item_id", pa.string()), ("length", pa.int32()), ("words", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))]
    )
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(windows, "item_id string, length int, words array<bigint>, shingles array<bigint>")


def _runs(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """(row, doc_id, n_words, runs): runs of possible benchmark shingles that can hold a window."""
    sizes = sorted({min(SHINGLE, n) for n in lengths})
    least = {k: min(n for n in lengths if min(SHINGLE, n) == k) - k + 1 for k in sizes}
    bitmap = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            runs: list[list] = [[] for _ in range(batch.num_rows)]
            for i, j in blocks(offsets):
                base = offsets[i]
                w = words(data[base : offsets[j]], offsets[i : j + 1] - base, ALNUM)
                counts[i:j] = np.diff(w.first)
                for k in sizes:
                    h, at = grams(w, k)
                    kept = np.flatnonzero(has_slot(known, h))
                    if not len(kept):
                        continue
                    # Positions of one run follow each other; grams of another document never do.
                    pos = at[kept]
                    doc = np.searchsorted(w.first, pos, "right") - 1
                    new = np.flatnonzero(np.diff(pos, prepend=-2) + (np.diff(doc, prepend=-1) != 0) != 1)
                    ends = np.append(new[1:], len(pos))
                    for a, b in zip(new[ends - new >= least[k]], ends[ends - new >= least[k]]):
                        d = doc[a]
                        first, last = int(pos[a]), int(pos[b - 1]) + k
                        runs[i + d].append(
                            {
                                "k": k,
                                "start": first - int(w.first[d]),
                                "words": _signed(w.hash)[first:last].tolist(),
                                "shingles": _signed(h)[kept[a:b]].tolist(),
                            }
                        )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(runs, run_type)], names=names
            )

    run_type = pa.list_(
        pa.struct(
            [("k", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))]
        )
    )
    names = ["row", "doc_id", "n_words", "runs"]
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(
        find,
        "row bigint, doc_id bigint, n_words bigint, "
        "runs array<struct<k: int, start: bigint, words: array<bigint>, shingles: array<bigint>>>",
    )


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``documents``: words, words inside benchmark windows, and the items found.

    Columns: doc_id, n_words, n_hit, items (sorted array of strings), contaminated. Null and
    empty texts have no words; a null item text has no window, and words of an item without
    id count as hit but name no item. Repeated rows and repeated ids give one row each.
    Other columns of both tables are ignored. Without documents or items the result has no
    row, or no hit.
    """
    scratch = Scratch(documents.sparkSession, "decontamination")
    windows = scratch.keep(benchmark_windows(benchmark, size), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most ``size`` rows
    bits = slots_of(windows.select(F.explode("shingles").alias("shingle")), "shingle")
    found = scratch.keep(_runs(documents, bits, lengths or [size]), "runs")
    runs = found.select("row", F.inline("runs"))
    tokens = runs.select(
        "row", "start", F.size("words").alias("n"), F.posexplode("shingles").alias("offset", "shingle")
    )

    rarity = tokens.groupBy("shingle").agg(F.count("*").alias("seen"))
    shingles = windows.select(
        "item_id", "length", "words", F.posexplode("shingles").alias("offset", "shingle")
    ).join(rarity, "shingle", "left")
    prefixes = shingles.groupBy("item_id", "length", "words").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "offset")).alias("rarest")
    )
    prefixes = prefixes.filter("rarest.seen > 0").select(
        "item_id",
        "length",
        F.col("words").alias("window"),
        F.col("rarest.shingle").alias("shingle"),
        F.col("rarest.offset").alias("back"),
    )
    candidates = (
        tokens.join(prefixes, "shingle")
        .withColumn("place", F.col("offset") - F.col("back"))
        .filter("place >= 0 AND place + length <= n")
        .select("row", "start", "n", "place", "length", "item_id", "window")
    )
    whole = runs.select("row", "start", F.size("words").alias("n"), "words")
    hits = (
        candidates.join(whole, ["row", "start", "n"])
        .filter(F.slice("words", F.col("place") + 1, F.col("length")) == F.col("window"))
        .select("row", "item_id", (F.col("start") + F.col("place")).alias("at"), "length")
    )
    # Words covered: what each window adds beyond the furthest end before it.
    spans = hits.groupBy("row", "at").agg(
        (F.col("at") + F.max("length")).alias("till"), F.collect_set("item_id").alias("items")
    )
    earlier = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("till").over(earlier), F.lit(0))
    cover = (
        spans.withColumn("adds", F.greatest(F.lit(0), F.col("till") - F.greatest("at", reach)))
        .groupBy("row")
        .agg(F.sum("adds").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    return found.select("row", "doc_id", "n_words").join(cover, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
