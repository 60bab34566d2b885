"""Removal of byte windows that occur earlier, by minimizers and hash grouping.

This replaces a depth-limited radix sort of suffixes: nothing is ordered. Each pass groups
blocks of windows by hash and drops groups of one, so after the last pass equal groups are
exactly the repeated windows. Two ideas keep the number of items far below that of bytes:

*Anchors.* Each window is charged to its least ``SEED``-byte piece by hash. Equal windows
are charged to equal pieces at equal offsets, so windows with the same piece can be compared
together, as offsets around it; runs of neighbouring windows share their anchor.

*Blocks.* A pass handles blocks of neighbouring windows around an anchor. A block's key is
its *core*, the bytes common to all its windows; its *span* is the bytes that any of them
covers. If the core occurs once, no window of the block repeats. If the span
occurred earlier, all its windows did. Only blocks in between are cut into smaller ones for
the next pass, once per distinct span. With blocks of one window core and span coincide.

Groups are compared by 64-bit hashes of bytes (in the last pass two of them), combined on
the map side, so a passage that stands in a third of all documents is no hot task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bytewords import U64, Rolling, blocks, mix, text_buffers
from ledgerlens.llm.scratch import Scratch
from ledgerlens.llm.slots import may_hold

WINDOW = 100
SEED = 32
# Windows per block in each pass; the first covers every offset of an anchor in its window.
PASSES = (WINDOW - SEED + 1, 12, 1)
SECOND_BASE = 0xC2B2AE3D27D4EB4F
# Positions inside one piece of a text fit into these bits.
PIECE_BITS = 20
# Stands for a missing doc_id.
LAST = (1 << 63) - 1

ROW = "core bigint, span bigint, doc_id bigint, tie bigint, place bigint"


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    least, reach = x, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[:n], least[width - reach : width - reach + n])


def charged(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, first window, last window) for runs of windows with one anchor.

    Of pieces that tie in a window the last counts, so the choice depends on the window's
    bytes alone. Longer data is taken in overlapping pieces; a run across a cut is one run.
    """
    found = [np.zeros((0, 4), np.int64)]
    mask = U64((1 << PIECE_BITS) - 1)
    step = (1 << PIECE_BITS) - WINDOW
    for at in range(0, max(len(data) - WINDOW + 1, 0), step):
        piece = data[at : at + step + WINDOW - 1]
        n = len(piece)
        seeds = Rolling(piece).ranges(np.arange(n - SEED + 1), np.arange(SEED, n + 1))
        seeds = (seeds & ~mask) | (mask - np.arange(n - SEED + 1).astype(U64))
        anchor = (mask - (_sliding_least(seeds, WINDOW - SEED + 1) & mask)).astype(np.int64)
        start = np.arange(n - WINDOW + 1)
        doc = np.searchsorted(offsets, start + at, "right") - 1
        whole = offsets[doc + 1] >= start + at + WINDOW
        start, doc, anchor = start[whole], doc[whole], anchor[whole]
        if not len(start):
            continue
        new = np.ones(len(start), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        found.append(np.stack([doc[first], anchor[first] + at, start[first] + at, start[last] + at], axis=1))
    every = np.concatenate(found)
    new = np.ones(len(every), dtype=bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1) | (every[1:, 2] != every[:-1, 3] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(every))[1:] - 1
    return every[first, 0], every[first, 1], every[first, 2], every[last, 3]


def _pack(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An anchor's byte position and the charged offsets around it as one long."""
    return (anchor << 14) | (low << 7) | high


def _hashed(data, begin, end, doc, anchor, low, high, least, most, second: bool):
    """Core and span hashes of blocks of windows that start at anchor - most .. anchor - least.

    ``begin`` and ``end`` are the document's bytes; a span that leaves them is marked invalid.
    """
    rolling = Rolling(data)
    core_from, core_to = anchor - least, anchor - most + WINDOW
    span_from, span_to = anchor - most, anchor - least + WINDOW
    valid = (span_from >= begin) & (span_to <= end)
    core = rolling.ranges(core_from, core_to) ^ mix(most.astype(U64) + U64(1000))
    if second:
        span = Rolling(data, SECOND_BASE).ranges(core_from, core_to)
    else:
        span = rolling.ranges(np.where(valid, span_from, begin), np.where(valid, span_to, begin))
    return core.view(np.int64), pa.array(span.view(np.int64), mask=~valid)


def _first_pass(texts: DataFrame) -> DataFrame:
    """One block per anchor: all windows that hold it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in blocks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                doc, anchor, first, last = charged(part, own)
                if not len(doc):
                    continue
                most = np.full(len(doc), PASSES[0] - 1)
                begin = own[doc]
                core, span = _hashed(
                    part, begin, own[doc + 1], doc, anchor, None, None, np.zeros(len(doc), np.int64), most, False
                )
                place = _pack(anchor - begin, anchor - last, anchor - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core), span, pa.array(ids[i + doc]), pa.array(ties[i + doc]), pa.array(place)],
                    names=["core", "span", "doc_id", "tie", "place"],
                )

    return texts.mapInArrow(emit, ROW)


def _key() -> Column:
    return F.xxhash64("doc_id", "tie")


def _later_pass(wanted: DataFrame, texts: DataFrame, before: int, size: int) -> DataFrame:
    """The blocks of ``wanted`` (doc_id, tie, place, least) cut into blocks of ``size`` windows."""
    lists = wanted.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("place", "least")).alias("cuts"))
    test = may_hold(lists.select(_key().alias("key")), "key")(_key())
    rows = texts.filter(test).join(lists, ["doc_id", "tie"]).select(
        "doc_id", "tie", "text", F.col("cuts.place").alias("place"), F.col("cuts.least").alias("least")
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in range(batch.num_rows):
                part = data[offsets[d] : offsets[d + 1]]
                place, least = batch.column(3)[d].values.to_numpy(), batch.column(4)[d].values.to_numpy()
                anchor, low, high = place >> 14, (place >> 7) & 127, place & 127
                steps = np.arange(0, before, size)
                n = len(steps)
                anchor, low, high = np.repeat(anchor, n), np.repeat(low, n), np.repeat(high, n)
                least_of = (least[:, None] + steps).ravel()
                most_of = np.minimum(least_of + size - 1, np.minimum(np.repeat(least, n) + before, PASSES[0]) - 1)
                kept = (least_of <= high) & (most_of >= low) & (least_of <= most_of)
                anchor, low, high, least_of, most_of = (x[kept] for x in (anchor, low, high, least_of, most_of))
                if not len(anchor):
                    continue
                zero = np.zeros(len(anchor), np.int64)
                core, span = _hashed(part, zero, zero + len(part), None, anchor, low, high, least_of, most_of, size == 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(core),
                        span,
                        pa.array(np.full(len(anchor), ids[d])),
                        pa.array(np.full(len(anchor), ties[d])),
                        pa.array(_pack(anchor, low, high)),
                        pa.array(least_of.astype(np.int32)),
                    ],
                    names=["core", "span", "doc_id", "tie", "place", "least"],
                )

    return rows.mapInArrow(emit, ROW + ", least int")


def repeated_spans(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, tie, start, end): byte ranges covered by windows that start earlier elsewhere.

    ``texts``: (doc_id, tie, text) without nulls; documents follow each other by (doc_id, tie).
    """
    spans = None
    blocks_now = _first_pass(texts).withColumn("least", F.lit(0))
    for turn, size in enumerate(PASSES):
        # A core that stands once holds no repeated window.
        several = blocks_now.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
        rows = scratch.keep(blocks_now.join(several, "core", "left_semi"), f"pass-{turn}")
        first = F.min(F.struct("doc_id", "tie", "place", "least")).alias("first")
        groups = scratch.keep(
            rows.filter("span IS NOT NULL").groupBy("core", "span").agg(first, F.count("*").alias("n")), f"groups-{turn}"
        )
        repeats = groups.filter("n > 1").select("core", "span", F.struct("first.doc_id", "first.tie", "first.place").alias("first"))
        most = F.least(F.col("least") + size, F.lit(PASSES[0])) - 1
        anchor = F.shiftright("place", 14)
        found = scratch.keep(
            rows.join(repeats, ["core", "span"])
            .filter(F.struct("doc_id", "tie", "place") != F.col("first"))
            .select("doc_id", "tie", (anchor - most).alias("start"), (anchor - F.col("least") + WINDOW).alias("end")),
            f"spans-{turn}",
        )
        spans = found if spans is None else spans.union(found)
        if turn + 1 == len(PASSES):
            break
        alone = rows.filter("span IS NULL").select("core", "doc_id", "tie", "place", "least")
        kinds = groups.select("core", "first.*").union(alone)
        mixed = kinds.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
        wanted = scratch.keep(
            kinds.join(mixed, "core", "left_semi").select("doc_id", "tie", "place", "least").distinct(), f"cut-{turn}"
        )
        scratch.drop(rows)
        blocks_now = scratch.keep(_later_pass(wanted, texts, size, PASSES[turn + 1]), f"blocks-{turn + 1}")
    return spans


def _documents(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, tie, text) without nulls; (doc_id, tie) tells documents apart and orders them.

    Rows with an id have a hash of the text as ``tie``. Each row without id is a document
    of its own, so these rows are numbered, by hash of text, and kept: a number that Spark
    gave anew in each pass might be another one.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tie"), "text")
    nameless = (
        rows.filter("doc_id IS NULL")
        .select(F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"), "text")
        # The number cuts a large group of equal texts.
        .repartitionByRange("hash", "number")
        .sortWithinPartitions("hash", "number")
        .select(F.lit(LAST).alias("doc_id"), F.monotonically_increasing_id().alias("tie"), "text")
    )
    return named.union(scratch.keep(nameless, "nameless"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Texts without the bytes of windows that start earlier, per row of ``documents``.

    A window of 100 bytes is removed if it also starts in a document of smaller doc_id or
    earlier in its own; all is judged on the input. Columns: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept (binary). Null texts are empty. Rows without id
    come after all others, by a hash of their text, each as a document of its own. Rows of
    equal doc_id and text count as one document and give equal results; different texts of
    one doc_id are documents that follow each other by the same hash. Other columns are
    ignored.
    """
    scratch = Scratch(documents.sparkSession, "repeats")
    texts = _documents(documents, scratch)
    spans = repeated_spans(texts, scratch)
    lists = scratch.keep(
        spans.distinct().groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "lists"
    )
    test = may_hold(lists.select(_key().alias("key")), "key")(_key())
    touched = texts.filter(test).join(lists, ["doc_id", "tie"], "left").select(
        "doc_id", "text", F.col("spans.start").alias("start"), F.col("spans.end").alias("end")
    )
    nothing = F.lit(None).cast("array<bigint>")
    clean = texts.filter(~test).select("doc_id", "text", nothing.alias("start"), nothing.alias("end"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            size, gone, runs, kept = [], [], [], []
            for d in range(batch.num_rows):
                part = data[offsets[d] : offsets[d + 1]]
                n = len(part)
                drop = np.zeros(n + 1, dtype=np.int32)
                if batch.column(2)[d].is_valid:
                    np.add.at(drop, np.clip(batch.column(2)[d].values.to_numpy(), 0, n), 1)
                    np.add.at(drop, np.clip(batch.column(3)[d].values.to_numpy(), 0, n), -1)
                out = np.cumsum(drop[:-1]) > 0
                size.append(n)
                gone.append(int(out.sum()))
                runs.append(int((out & ~np.concatenate([[False], out[:-1]])).sum()) if n else 0)
                kept.append(part[~out].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    result = touched.union(clean).mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return result.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))
