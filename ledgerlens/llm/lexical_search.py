"""Ranked lexical search over bit-sliced Bloom signatures.

1. *Index.* One pass over the texts puts the terms of each document into a Bloom signature.
   A term that occurs at least ``LEVELS[l]`` times is put in once for each level up to l, so a
   signature bounds frequencies too. Documents of similar numbers of terms share a block, whose
   signatures are stored as slices: row r holds bit r of all its documents. The same pass counts
   documents, terms and, for the terms asked for, the documents that hold them.
2. *Bounds.* The conjunction of a term's rows is a bitmap of the documents that may hold it. Sums
   of these bitmaps, weighted by the terms' weights and by what a level adds to a score, are
   upper bounds of the scores of all documents, for all items at once.
3. *Threshold.* The ``TOP`` documents with the highest bounds are scored exactly. The score of
   rank ``TOP`` among them is a lower bound of what the result needs.
4. *Rescoring.* Every document whose bound reaches the threshold of any item is scored exactly.
   The others are provably outside; ties with the threshold stay.

Items are taken in blocks of about ``BLOCK_TERMS`` terms. What is broadcast is one such block
and bitmaps of a fixed size. Documents are told apart by a 64-bit hash of id and text, and
terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.bytewords import ALNUM, U64, blocks, mix, text_buffers, words
from ledgerlens.llm.scratch import Scratch
from ledgerlens.llm.slots import has_slot, may_hold, slots_of

TOP = 50
BLOCK_TERMS = 1 << 16
LEVELS = (1, 2, 3, 5, 9, 17, 33)
PROBES = 3
# Bits of a signature per entry, at least; twice as many at most.
SPARSE = 12
MAX_ROWS = 1 << 21
# Bits of a stored block, and documents whose bounds are computed together.
BLOCK_BITS = 1 << 19
TOGETHER = 1_024
ENTRIES = 1_024

_SEEDS = mix(np.arange(1, 2 * len(LEVELS) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(2, -1)


def frequencies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, tf, first, n): distinct terms per document with their frequencies, and its number of terms."""
    w = words(data, offsets, ALNUM)
    doc = w.doc
    order = np.lexsort((w.hash, doc))
    h, doc = w.hash[order], doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(doc[at], np.arange(len(offsets))), np.diff(w.first)


def rows_of(terms: np.ndarray, level: int, width: int) -> np.ndarray:
    """The ``PROBES`` signature rows of each term on a level."""
    g = mix(terms * U64(2) + _SEEDS[0, level] | U64(1)) ^ mix(terms ^ _SEEDS[1, level])
    parts = [(g >> U64(21 * i)) & U64((1 << 21) - 1) for i in range(PROBES)]
    return np.stack([((p * U64(width)) >> U64(21)).astype(np.int64) for p in parts], axis=1)


def factors(tf, m) -> np.ndarray:
    """What a term of weight 1 adds to a score."""
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The length figure m of documents with n terms."""
    return 100 - 50 + (50 * n * documents) // terms


class Query:
    """A block of items: entries (item, term, weight) sorted by item, terms as places in ``terms``."""

    def __init__(self, item: np.ndarray, term: np.ndarray, df: np.ndarray, documents: int, all_terms: int):
        order = np.lexsort((term, item))
        item, term, df = item[order], term[order].view(U64), df[order]
        self.ids, self.item = np.unique(item, return_inverse=True)
        self.terms, first, self.term = np.unique(term, return_index=True, return_inverse=True)
        weight = np.array([floor(1000 * log((2 * documents + 2) / (2 * n + 1))) for n in df[first].tolist()], dtype=np.int64)
        self.weight = weight[self.term]
        self.documents, self.all_terms = documents, all_terms
        # Entries by term, for exact scores.
        self.by_term = np.argsort(self.term, kind="stable")
        self.start = np.searchsorted(self.term[self.by_term], np.arange(len(self.terms) + 1))
        self._rows: dict[int, list[np.ndarray]] = {}

    def bounds(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bounds (item, document) of the scores of the documents of a block of slices."""
        width = len(bits)
        if width not in self._rows:
            self._rows[width] = [rows_of(self.terms, level, width) for level in range(len(LEVELS))]
        m = np.ones(8 * bits.shape[1], dtype=np.int64)
        m[: len(n)] = lengths(n, self.documents, self.all_terms)
        most = np.ones_like(m)
        most[: len(n)] = n
        total = np.zeros((len(self.ids), len(m)), dtype=np.int64)
        active, held, before = np.arange(len(self.terms)), None, 0
        for level, least in enumerate(LEVELS):
            rows = self._rows[width][level][active]
            found = bits[rows[:, 0]]
            for i in range(1, PROBES):
                found = found & bits[rows[:, i]]
            if held is not None:
                found = found & held
            some = found.any(axis=1)
            active, held = active[some], found[some]
            if not len(active):
                break
            # A term of this level only occurs less often than the next level asks for.
            now = factors(np.minimum(LEVELS[level + 1] - 1, most) if level + 1 < len(LEVELS) else most, m)
            place = np.full(len(self.terms), -1)
            place[active] = np.arange(len(active))
            entries = np.flatnonzero(place[self.term] >= 0)
            for i in range(0, len(entries), ENTRIES):
                part = entries[i : i + ENTRIES]
                slices = np.unpackbits(held[place[self.term[part]]], axis=1)
                starts = np.flatnonzero(np.append(True, np.diff(self.item[part]) > 0))
                sums = np.add.reduceat(slices * self.weight[part, None].astype(np.int32), starts, axis=0, dtype=np.int64)
                total[self.item[part][starts]] += sums * (now - before)
            before = now
        return total[:, : len(n)]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, score) of all exact scores above 0."""
        terms, tf, first, n = frequencies(data, offsets)
        doc = np.repeat(np.arange(len(n)), np.diff(first))
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        at, doc, tf = at[hit], doc[hit], tf[hit]
        gain = factors(tf, lengths(n, self.documents, self.all_terms)[doc])
        times = self.start[at + 1] - self.start[at]
        entry = self.by_term[np.repeat(self.start[at] + times - times.cumsum(), times) + np.arange(times.sum())]
        pair = np.repeat(doc, times) * len(self.ids) + self.item[entry]
        order = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(pair[order]) > 0)) if len(pair) else np.zeros(0, np.int64)
        score = np.add.reduceat((np.repeat(gain, times) * self.weight[entry])[order], starts) if len(pair) else starts
        pair = pair[order][starts]
        return (pair // len(self.ids))[score > 0], (pair % len(self.ids))[score > 0], score[score > 0]


class _Pending:
    """Documents of one signature width that wait for their block."""

    def __init__(self, width: int):
        self.width, self.room = width, max(8, BLOCK_BITS // width)
        self.rows: list[np.ndarray] = []
        self.keys: list[int] = []
        self.n: list[int] = []

    def take(self) -> list:
        bits = np.zeros((self.width, len(self.keys)), dtype=np.uint8)
        column = np.repeat(np.arange(len(self.keys)), [len(r) for r in self.rows])
        bits[np.concatenate(self.rows), column] = 1
        row = [
            self.width,
            np.array(self.keys, np.int64).tobytes(),
            np.array(self.n, np.int64).tobytes(),
            np.packbits(bits, axis=1).tobytes(),
        ]
        self.__init__(self.width)
        return row


_INDEX = "documents bigint, words bigint, term bigint, df bigint, width int, keys binary, n binary, bits binary"
_FIELDS = [
    *((c, pa.int64()) for c in ("documents", "words", "term", "df")),
    ("width", pa.int32()),
    *((c, pa.binary()) for c in ("keys", "n", "bits")),
]


def build_index(documents: DataFrame, asked: np.ndarray) -> DataFrame:
    """Signature blocks (width, keys, n, bits), counts (documents, words) and (term, df) of terms in the bitmap ``asked``.

    The counts and frequencies come in parts that are to be added up.
    """
    shared = documents.sparkSession.sparkContext.broadcast(asked)

    def row(**values) -> pa.RecordBatch:
        n = len(next(iter(values.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(values[c], kind) if c in values else pa.nulls(n, kind) for c, kind in _FIELDS], names=[c for c, _ in _FIELDS]
        )

    def block(pending: _Pending) -> pa.RecordBatch:
        width, keys, n, bits = pending.take()
        return row(width=[width], keys=[keys], n=[n], bits=[bits])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, _Pending] = {}
        n_documents = n_words = 0
        seen = [np.zeros(0, U64), np.zeros(0, np.int64)]
        fresh: list[np.ndarray] = []

        def count() -> None:
            terms, at = np.unique(np.concatenate([seen[0], *fresh]), return_inverse=True)
            df = np.bincount(at[len(seen[0]) :], minlength=len(terms)).astype(np.int64)
            df[at[: len(seen[0])]] += seen[1]
            seen[:] = [terms, df]
            fresh.clear()

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            keys = batch.column(0).to_numpy()
            for i, j in blocks(offsets):
                terms, tf, first, n = frequencies(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_documents, n_words = n_documents + int((n > 0).sum()), n_words + int(n.sum())
                fresh.append(terms[has_slot(shared.value, terms)])
                if sum(map(len, fresh)) > 1 << 20:
                    count()
                entries = np.add.reduceat(np.searchsorted(LEVELS, tf, "right"), first[:-1][n > 0]) if len(terms) else []
                for d, size in zip(np.flatnonzero(n), np.asarray(entries).tolist()):
                    width = min(MAX_ROWS, 1 << (SPARSE * size - 1).bit_length())
                    own, often = terms[first[d] : first[d + 1]], tf[first[d] : first[d + 1]]
                    rows = [rows_of(own, 0, width).ravel()]
                    for level, least in enumerate(LEVELS[1:], 1):
                        own, often = own[often >= least], often[often >= least]
                        if not len(own):
                            break
                        rows.append(rows_of(own, level, width).ravel())
                    pending = waiting.setdefault(width, _Pending(width))
                    pending.rows.append(np.unique(np.concatenate(rows)))
                    pending.keys.append(int(keys[i + d]))
                    pending.n.append(int(n[d]))
                    if len(pending.keys) == pending.room:
                        yield block(pending)
        for pending in waiting.values():
            if pending.keys:
                yield block(pending)
        count()
        yield row(documents=[n_documents], words=[n_words])
        yield row(term=seen[0].view(np.int64), df=seen[1])

    return documents.select("key", "text").mapInArrow(index, _INDEX)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bits, keys, n) of stored blocks, those of one width side by side."""
    for batch in batches:
        width, keys, n, bits = (c.to_pylist() for c in batch.columns)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(width):
            by_width.setdefault(w, []).append(i)
        for w, own in by_width.items():
            while own:
                some, size = [], 0
                while own and (not some or size + len(keys[own[-1]]) // 8 <= TOGETHER):
                    some.append(own.pop())
                    size += len(keys[some[-1]]) // 8
                slices, all_keys, all_n = [], [], []
                for i in some:
                    slices.append(np.frombuffer(bits[i], np.uint8).reshape(w, -1))
                    # A block's last byte may be half empty.
                    room = 8 * slices[-1].shape[1]
                    for values, out in ((keys[i], all_keys), (n[i], all_n)):
                        values = np.frombuffer(values, np.int64)
                        out.append(np.pad(values, (0, room - len(values))))
                yield np.concatenate(slices, axis=1), np.concatenate(all_keys), np.concatenate(all_n)


def _best(rows: DataFrame, order: list, top: int) -> DataFrame:
    """The ``top`` rows of each item with their rank; no task gets all rows of an item at once."""
    rank = F.row_number()
    some = Window.partitionBy("item", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*order)
    every = Window.partitionBy("item").orderBy(*order)
    rows = rows.withColumn("rank", rank.over(some)).filter(F.col("rank") <= top)
    return rows.withColumn("rank", rank.over(every)).filter(F.col("rank") <= top)


def highest_bounds(index: DataFrame, query, top: int) -> DataFrame:
    """(item, key, bound): per task and item, the documents with the ``top`` highest bounds above 0."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Query = query.value
        best = np.zeros((len(q.ids), top), dtype=np.int64)
        keys = np.zeros((len(q.ids), top), dtype=np.int64)
        for bits, own, n in _slices(batches):
            bound = np.concatenate([best, q.bounds(bits, n)], axis=1)
            ids = np.concatenate([keys, np.broadcast_to(own, (len(keys), len(own)))], axis=1)
            at = np.argpartition(-bound, top - 1, axis=1)[:, :top]
            best, keys = np.take_along_axis(bound, at, 1), np.take_along_axis(ids, at, 1)
        item, at = best.nonzero()
        yield pa.RecordBatch.from_pydict({"item": q.ids[item], "key": keys[item, at], "bound": best[item, at]})

    return index.mapInArrow(find, "item bigint, key bigint, bound bigint")


def reaching(index: DataFrame, query, least) -> DataFrame:
    """(key) of the documents whose bound for any item reaches that item's threshold."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bits, own, n in _slices(batches):
            found = (query.value.bounds(bits, n) >= least.value[:, None]).any(axis=0)
            yield pa.RecordBatch.from_pydict({"key": np.unique(own[found])})

    return index.mapInArrow(find, "key bigint")


def exact_scores(documents: DataFrame, keys: DataFrame, query, least, top: int) -> DataFrame:
    """(item, doc_id, key, score): per task and item, the ``top`` best of the documents named by ``keys``."""
    wanted = may_hold(keys, "key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Query = query.value
        best = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            key = batch.column(0).to_numpy()
            doc_id = batch.column(1).fill_null(np.iinfo(np.int64).max).to_numpy()
            found = [best]
            for i, j in blocks(offsets):
                doc, item, value = q.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                enough = value >= least.value[item]
                doc, item, value = doc[enough] + i, item[enough], value[enough]
                found.append([item, doc_id[doc], key[doc], value])
            best = [np.concatenate(c) for c in zip(*found)]
            order = np.lexsort((best[1], -best[3], best[0]))
            best = [c[order] for c in best]
            first = np.searchsorted(best[0], best[0], "left")
            best = [c[np.arange(len(first)) - first < top] for c in best]
        nameless = best[1] == np.iinfo(np.int64).max
        yield pa.RecordBatch.from_pydict(
            {"item": q.ids[best[0]], "doc_id": pa.array(best[1], mask=nameless), "key": best[2], "score": best[3]}
        )

    rows = documents.filter(wanted("key")).select("key", "doc_id", "text")
    return rows.mapInArrow(score, "item bigint, doc_id bigint, key bigint, score bigint")


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, term): the distinct terms of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in blocks(offsets):
                terms, _, first, _ = frequencies(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_pydict({"item": np.repeat(ids[i:j], np.diff(first)), "term": terms.view(np.int64)})

    return items.select("item", "text").mapInArrow(split, "item bigint, term bigint")


def _item_blocks(terms: DataFrame) -> int:
    """The number of blocks into which items are dealt by hash, so that none is much above ``BLOCK_TERMS``."""
    sizes = terms.groupBy("item").count()
    n = 1
    while True:
        by_block = sizes.groupBy(F.pmod(F.xxhash64("item"), F.lit(n)).alias("block")).agg(
            F.sum("count").alias("terms"), F.count("*").alias("items")
        )
        if by_block.filter((F.col("terms") > 2 * BLOCK_TERMS) & (F.col("items") > 1)).isEmpty():
            return n
        n *= 2


def ranked_search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): per row of ``items``, the ``top`` best documents with a score above 0.

    ``documents``: (doc_id, text); ``items``: (item_id, text). Terms are maximal runs of
    digits, letters and characters beyond ASCII, A-Z lower-cased. Null and empty texts have no
    terms: such a document is never found and counts nowhere, such an item finds nothing. Each
    row is a document, or an item, of its own, also where its id repeats or is null. Equal
    scores are ordered by doc_id, null last. Other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical-search")
    docs = documents.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.col("doc_id").cast("long"), "text")
    numbered = scratch.keep(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    terms = scratch.keep(_item_terms(numbered), "terms")
    built = scratch.keep(build_index(docs, slots_of(terms, "term")), "index")
    totals = built.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    df = built.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    weighted = scratch.keep(terms.join(df, "term"), "weighted")
    index = built.filter("width IS NOT NULL").select("width", "keys", "n", "bits")

    n_blocks = _item_blocks(terms)
    results = []
    for number in range(n_blocks):
        block = weighted.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == number).toArrow()
        if not block.num_rows:
            continue
        query = Query(*[block[c].to_numpy() for c in ("item", "term", "df")], totals["documents"], totals["words"])
        shared = spark.sparkContext.broadcast(query)
        any_score = spark.sparkContext.broadcast(np.ones(len(query.ids), np.int64))
        seeds = scratch.keep(_best(highest_bounds(index, shared, top), [F.desc("bound"), "key"], top), "seeds")
        sure = _best(exact_scores(docs, seeds.select("key"), shared, any_score, top), [F.desc("score"), "key"], top)
        least = np.ones(len(query.ids), np.int64)
        for row in sure.filter(F.col("rank") == top).select("item", "score").collect():
            least[np.searchsorted(query.ids, row["item"])] = row["score"]
        threshold = spark.sparkContext.broadcast(least)
        able = scratch.keep(reaching(index, shared, threshold).distinct(), "able")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        results.append(scratch.keep(_best(exact_scores(docs, able, shared, threshold, top), order, top), "result"))
    if not results:
        return numbered.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
