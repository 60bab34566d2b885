"""Near duplicates: banded MinHash candidates, Bayesian pruning, exact verification.

1. One pass over the texts gives each document its number of shingles, a key of its shingle
   set, a signature and band keys. Documents with equal sets are one class from here on;
   the class is represented by its smallest doc_id, so copies never meet in a bucket.
2. ``BANDS`` bands of ``ROWS`` hashes: a pair at the limit of 0.75 misses all bands with
   probability (1 - 0.75^5)^56, about 3e-7.
3. Components need connections, not all pairs. In the first round each bucket links its
   members to a centre drawn by hash. For buckets still apart, shingles that no other such
   document has bound what a document can share with any other. The second round takes the
   member with the least of its own as centre. What is then still apart is compared in blocks
   of ``BLOCK`` documents that travel with their sets: the documents of a group of buckets that
   are outside its main component against all others of the group. A block pair checks bands,
   bounds, signatures and full sets in one task, so no table of pairs comes into being.
4. Candidates compare signatures batch after batch. After n hashes with m matches and a
   uniform prior, P(similarity >= 0.75) is the probability of at most m successes in n + 1
   trials of 0.75; below ``MISS`` the pair is dropped.
5. Survivors are confirmed on their full shingle sets, read again from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bytewords import SPACED, U64, Words, blocks, grams, mix, text_buffers, words
from ledgerlens.llm.scratch import Scratch
from ledgerlens.llm.slots import may_hold
from ledgerlens.operators.components import connected_components
from ledgerlens.operators.spread import spread_join

SHINGLE = 5
# Similarity as a fraction of whole numbers, so that the limit itself is exact.
LIMIT = (75, 100)
ROWS = 5
BANDS = 56
SIGNATURE = 64
BATCH = 16
# Chance that one batch drops a pair of similarity 0.75.
MISS = 1e-6
# Centres per document group in the first round.
DRAWS = 4
# Members verified against one copy of their centre's text.
PIECE = 16
# Documents of one block in the last round, and blocks compared with one copy of another.
BLOCK = 256
PARTNERS = 8

_draw = np.random.default_rng(20240607)
_MULTIPLY = _draw.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _draw.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each document, sorted within it.

    A document with fewer than five words has its whole word sequence as one shingle.
    """
    w = words(data, offsets, SPACED)
    n_words = np.diff(w.first)
    hashes, at = grams(w, SHINGLE)
    doc = np.searchsorted(w.first, at, "right") - 1
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n_words == k)
        if len(short):
            own = w.hash[w.first[short][:, None] + np.arange(k)].ravel()
            h, _ = grams(Words(None, None, own, np.arange(len(short) + 1) * k), k)
            hashes, doc = np.concatenate([hashes, h]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    return hashes, np.searchsorted(doc, np.arange(len(offsets)))


def _sketches(documents: DataFrame, with_set: bool = False) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature, bands) per row; no signature without words.

    ``with_set`` adds the hashes of the shingles, ascending, as ``shingles``.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            n = batch.num_rows
            sizes = np.zeros(n, dtype=np.int64)
            sums = np.zeros((n, 2), dtype=U64)
            signature = np.zeros((n, SIGNATURE), dtype=np.uint32)
            bands = np.zeros((n, BANDS), dtype=U64)
            sets = []
            for i, j in blocks(offsets):
                h, first = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sizes[i:j] = np.diff(first)
                if with_set:
                    sets += [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                starts, rows = first[full], full + i
                sums[rows, 0] = np.add.reduceat(h, starts)
                sums[rows, 1] = np.add.reduceat(mix(h ^ U64(0xA0761D6478BD642F)), starts)
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, dtype=U64)
                    for r in range(b * ROWS, (b + 1) * ROWS):
                        least = np.minimum.reduceat(h * _MULTIPLY[r] + _ADD[r], starts)
                        if r < SIGNATURE:
                            signature[rows, r] = least >> U64(32)
                        key = mix(key * U64(0x9DDFEA08EB382D69) + least)
                    bands[rows, b] = key
            columns = [
                batch.column(0),
                pa.array(sizes),
                pa.array(sums[:, 0].view(np.int64) if n else np.zeros(0, np.int64)),
                pa.array(sums[:, 1].copy().view(np.int64)),
                pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(4 * SIGNATURE), n, [None, pa.py_buffer(signature.tobytes())]
                ).cast(pa.binary()),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64))
                ),
            ]
            names = ["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"]
            if with_set:
                columns, names = [*columns, pa.array(sets, pa.binary())], [*names, "shingles"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary, bands array<bigint>"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sketch, f"{schema}, shingles binary" if with_set else schema
    )


def needed_matches(compared: int) -> int:
    """The fewest matches of ``compared`` hashes that keep a pair."""
    t = LIMIT[0] / LIMIT[1]
    below, m = 0.0, -1
    while below < MISS:
        m += 1
        below += comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
    return m


def _prune(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The (doc_id, centre) pairs that the comparison of signatures does not rule out."""
    checks = [(n, needed_matches(n)) for n in range(BATCH, SIGNATURE + 1, BATCH)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, SIGNATURE)
                for c in (2, 3)
            )
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, dtype=np.int64)
            for n, least in checks:
                part = slice(n - BATCH, n)
                matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["doc_id", "centre"]
            )

    signatures = heads.select("doc_id", "signature")
    both = pairs.join(signatures, "doc_id").join(
        signatures.select(F.col("doc_id").alias("centre"), F.col("signature").alias("centre_signature")), "centre"
    )
    return both.select("doc_id", "centre", "signature", "centre_signature").mapInArrow(
        compare, "doc_id bigint, centre bigint"
    )


def _confirm(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The (doc_id, centre) pairs whose full shingle sets reach the limit.

    The members of a centre are dealt in pieces of about ``PIECE``, each with one copy of
    the centre's text; a task holds one centre and streams its members.
    """
    ids = pairs.select(F.explode(F.array("doc_id", "centre")).alias("doc_id"))
    wanted = may_hold(ids, "doc_id")
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).filter(
        wanted("doc_id")
    )
    pieces = pairs.groupBy("centre").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    members = spread_join(pairs, pieces, ["centre"], by=["doc_id"]).select(
        "centre", F.pmod(F.xxhash64("doc_id"), "pieces").cast("int").alias("piece"), "doc_id", F.lit(False).alias("own")
    )
    centres = pieces.select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("centre").alias("doc_id"), F.lit(True).alias("own")
    )
    rows = (
        members.union(centres)
        .join(texts, "doc_id")
        .repartition("centre", "piece")
        .sortWithinPartitions("centre", "piece", F.desc("own"))
        .select("centre", "piece", "own", "doc_id", "text")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            data, offsets = text_buffers(batch.column(4))
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            own = batch.column(2).to_pylist()
            ids = batch.column(3).to_pylist()
            found: list[tuple[int, int]] = []
            for i, j in blocks(offsets):
                h, first = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for d in range(i, j):
                    mine = h[first[d - i] : first[d - i + 1]]
                    if keys[d] != now:
                        now, sets = keys[d], []
                    if own[d]:
                        sets.append(mine.copy())
                        continue
                    for other in sets:
                        both = len(np.intersect1d(mine, other, assume_unique=True))
                        if LIMIT[1] * both >= LIMIT[0] * (len(mine) + len(other) - both) > 0:
                            found.append((ids[d], now[0]))
                            break
            yield pa.RecordBatch.from_pydict(
                {"doc_id": [a for a, _ in found], "centre": [b for _, b in found]}, schema=schema
            )

    schema = pa.schema([("doc_id", pa.int64()), ("centre", pa.int64())])
    return rows.mapInArrow(verify, "doc_id bigint, centre bigint")


def _alike_size(a: str, b: str):
    low, high = F.least(a, b), F.greatest(a, b)
    return LIMIT[1] * low >= LIMIT[0] * high


def _own_shingles(rows: DataFrame, documents: DataFrame, several: DataFrame) -> DataFrame:
    """(doc_id, own): how many shingles of a document in ``rows`` no other of them has.

    Documents with several texts are left out; they count as having none.
    """
    wanted = may_hold(rows, "doc_id")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in blocks(offsets):
                h, first = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[i:j], np.diff(first))), pa.array(h.view(np.int64))], names=["doc_id", "shingle"]
                )

    texts = documents.select(F.col("doc_id").cast("long"), "text").filter(wanted("doc_id"))
    return (
        texts.mapInArrow(explode, "doc_id bigint, shingle bigint")
        .groupBy("shingle")
        .agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
        .filter("doc_id = last")
        .groupBy("doc_id")
        .agg(F.count("*").alias("own"))
        .join(several, "doc_id", "left_anti")
    )


def _can_reach(size, other_size, own, other_own):
    """May two documents reach the limit, given how many shingles nobody shares with them?"""
    both = F.least(F.col(size) - F.col(own), F.col(other_size) - F.col(other_own))
    return LIMIT[1] * both >= LIMIT[0] * (F.col(size) + F.col(other_size) - both)


def _buckets(rows: DataFrame, draw) -> DataFrame:
    """Per bucket with more than one component, a centre drawn by the hash ``draw``."""
    centre = F.min(F.struct(draw.alias("draw"), "doc_id", "n", "component"))
    return (
        rows.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), centre.alias("c"))
        .filter("low < high")
        .select(
            "bucket",
            F.col("c.doc_id").alias("centre"),
            F.col("c.n").alias("centre_n"),
            F.col("c.component").alias("centre_component"),
        )
    )


class _Block:
    """Documents of one block with what their comparison needs."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        self.ids, self.component, self.own = (table[c].to_numpy() for c in ("doc_id", "component", "own"))
        n = table.num_rows
        self.signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(n, SIGNATURE)
        self.bands = table["bands"].combine_chunks().values.to_numpy().reshape(n, BANDS)
        self.sets = [np.frombuffer(x, U64) for x in table["shingles"].to_pylist()]
        self.size = np.array([len(x) for x in self.sets])

    def candidates(self, other: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different components that share a band and can reach the limit."""
        shared = np.zeros((len(self.ids), len(other.ids)), dtype=bool)
        for b in range(BANDS):
            shared |= self.bands[:, b, None] == other.bands[None, :, b]
        shared &= self.component[:, None] != other.component[None]
        both = np.minimum((self.size - self.own)[:, None], (other.size - other.own)[None])
        shared &= LIMIT[1] * both >= LIMIT[0] * (self.size[:, None] + other.size[None] - both)
        i, j = shared.nonzero()
        matches = np.zeros(len(i), dtype=np.int64)
        for n in range(BATCH, SIGNATURE + 1, BATCH):
            part = slice(n - BATCH, n)
            matches += (self.signature[i, part] == other.signature[j, part]).sum(axis=1)
            alive = matches >= needed_matches(n)
            i, j, matches = i[alive], j[alive], matches[alive]
        return i, j

    def links(self, other: _Block) -> Iterator[tuple[int, int]]:
        """Confirmed links; pairs that earlier ones have connected already are left out."""
        low: dict[int, int] = {}

        def find(x: int) -> int:
            while low.get(x, x) != x:
                low[x] = x = low.get(low[x], low[x])
            return x

        for a, b in zip(*self.candidates(other)):
            p, q = find(int(self.component[a])), find(int(other.component[b]))
            if p == q:
                continue
            x, y = self.sets[a], other.sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if LIMIT[1] * both >= LIMIT[0] * (len(x) + len(y) - both) > 0:
                low[max(p, q)] = min(p, q)
                yield int(self.ids[a]), int(other.ids[b])


def _compare_blocks(rows: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between documents of different components in the buckets of ``rows`` (bucket, doc_id, own, component).

    A group takes the buckets of one least component, so documents that meet in some bucket
    are together in a group. The component with most documents of a group is its main one;
    its documents are compared with the others only.
    """
    lows = (
        rows.groupBy("bucket")
        .agg(F.min("component").alias("group"), F.max("component").alias("high"))
        .filter("group < high")
        .drop("high")
    )
    placed = scratch.keep(rows.join(lows, "bucket").select("group", "doc_id", "own", "component").distinct(), "grouped")
    main = (
        placed.groupBy("group", "component")
        .agg(F.count("*").alias("rows"))
        .groupBy("group")
        .agg(F.max_by("component", F.struct("rows", "component")).alias("main"))
    )
    sided = spread_join(placed, main, ["group"], by=["doc_id"]).withColumn("beside", F.col("component") != F.col("main")).drop("main")
    sizes = sided.groupBy("group").agg(
        F.ceil(F.count_if("beside") / BLOCK).cast("int").alias("n_beside"),
        F.ceil(F.count_if(~F.col("beside")) / BLOCK).cast("int").alias("n_main"),
    )
    # Blocks 0 .. n_beside - 1 lie beside the main component.
    count = F.when(F.col("beside"), F.col("n_beside")).otherwise(F.col("n_main"))
    block = F.pmod(F.xxhash64("doc_id"), count) + F.when(F.col("beside"), 0).otherwise(F.col("n_beside"))
    sketches = _sketches(
        documents.withColumn("doc_id", F.col("doc_id").cast("long")).filter(may_hold(placed, "doc_id")("doc_id")), with_set=True
    ).select("doc_id", "signature", "bands", "shingles")
    blocks_of = scratch.keep(
        spread_join(sided, sizes, ["group"], by=["doc_id"])
        .select("group", block.cast("int").alias("q"), "doc_id", "own", "component")
        .join(sketches, "doc_id"),
        "blocks",
    )
    pairs = (
        sizes.filter("n_beside > 0")
        .select("group", F.explode(F.sequence(F.lit(0), F.col("n_beside") - 1)).alias("p"), (F.col("n_beside") + F.col("n_main")).alias("all"))
        .select("group", "p", F.explode(F.sequence(F.col("p"), F.col("all") - 1)).alias("q"))
        .withColumn("piece", F.floor((F.col("q") - F.col("p")) / PARTNERS).cast("int"))
    )
    own = pairs.groupBy("group", "p", "piece").agg(F.first("p").alias("q"))
    streamed = pairs.filter("p != q").withColumn("own", F.lit(False)).unionByName(own.withColumn("own", F.lit(True)))
    dealt = (
        streamed.withColumnRenamed("own", "mine")
        .join(blocks_of, ["group", "q"])
        .repartition("group", "p", "piece")
        .sortWithinPartitions("group", "p", "piece", F.desc("mine"), "q")
        .select("group", "p", "piece", "q", "doc_id", "own", "component", "signature", "bands", "shingles")
    )
    schema = pa.schema([("doc_id", pa.int64()), ("centre", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, mine = None, [], None

        def settle() -> list[tuple[int, int]]:
            nonlocal mine
            if not waiting:
                return []
            other = _Block(waiting)
            waiting.clear()
            if now[1] == now[3]:
                mine = other
                return list(mine.links(mine)) if now[2] == 0 else []
            return list(mine.links(other))

        def told(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"doc_id": [a for a, _ in found], "centre": [b for _, b in found]}, schema=schema)

        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)]))
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != now:
                    yield told(settle())
                    now = keys[start]
                waiting.append(batch.slice(start, end - start))
                start = end
        yield told(settle())

    return dealt.mapInArrow(compare, "doc_id bigint, centre bigint")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``documents``.

    ``component_id`` is the smallest doc_id reachable over links of similarity >= 0.75,
    ``kept`` says that it is the row's own. Null and empty texts and texts without words
    have no shingles and are linked with nothing. Rows of equal doc_id are one document:
    it is linked with whatever any of its texts is linked with. A row without doc_id is
    linked with nothing; its component is null and it is kept. Other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "near-duplicates")
    sketches = scratch.keep(_sketches(documents), "sketches")
    named = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("head"))
    members = scratch.keep(
        named.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "n_shingles", "head"),
        "members",
    )
    others = scratch.keep(sketches.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles"), "others")
    heads = scratch.keep(
        named.join(classes.withColumnRenamed("head", "doc_id"), ["set_a", "set_b", "doc_id"], "left_semi").select(
            "doc_id", F.col("n_shingles").alias("n"), "signature", "bands"
        ),
        "heads",
    )

    scratch.drop(sketches)
    banded = heads.select("doc_id", "n", F.posexplode("bands").alias("band", "bucket"), F.col("doc_id").alias("component"))
    first = _buckets(banded, F.xxhash64("doc_id", F.pmod("band", F.lit(DRAWS))))
    shared = scratch.keep(banded.drop("component").join(first, "bucket"), "shared")

    several = members.groupBy("doc_id").agg(F.collect_set("head").alias("heads")).filter("size(heads) > 1")
    links = scratch.keep(
        several.select(F.explode("heads").alias("doc_id"), F.array_min("heads").alias("centre")), "several"
    )
    def linked_by(pairs: DataFrame) -> DataFrame:
        survivors = scratch.keep(_prune(pairs.distinct(), heads), "survivors")
        confirmed = scratch.keep(_confirm(survivors, documents), "links")
        scratch.drop(survivors)
        return confirmed

    links = links.union(linked_by(shared.filter("doc_id != centre").filter(_alike_size("n", "centre_n")).select("doc_id", "centre")))
    components = scratch.keep(connected_components(links, "doc_id", "centre"), "components")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(components, rows["doc_id"] == components["node"], "left").select(
            *rows.columns, F.coalesce("component", "doc_id").alias("component")
        )

    # Rows of buckets that are still apart, and what no other document in them has.
    rows = labelled(shared.select("bucket", "band", "doc_id", "n"))
    apart = scratch.keep(
        rows.join(_buckets(rows, F.lit(0)).select("bucket"), "bucket", "left_semi").drop("component"), "apart"
    )
    scratch.drop(shared)
    own = _own_shingles(apart, documents, several)
    split = apart
    apart = scratch.keep(
        split.join(own, "doc_id", "left")
        .withColumn("own", F.coalesce("own", F.lit(0)))
        .filter(LIMIT[1] * (F.col("n") - F.col("own")) >= LIMIT[0] * F.col("n")),
        "open",
    )
    scratch.drop(split)
    # The member with the least of its own is the most typical one, such as a template.
    typical = F.struct(F.col("own") / F.col("n"), F.xxhash64("doc_id", "band"))
    rows = labelled(apart)
    rows = scratch.keep(rows.join(_buckets(rows, typical), "bucket"), "split")
    centres = rows.filter("doc_id = centre").select("bucket", F.col("n").alias("other_n"), F.col("own").alias("other_own"))
    pairs = (
        rows.filter("component != centre_component")
        .join(centres, "bucket")
        .filter(_can_reach("n", "other_n", "own", "other_own"))
        .select("doc_id", "centre")
    )
    links = links.union(linked_by(pairs))
    components = scratch.keep(connected_components(links, "doc_id", "centre"), "components")

    rows = scratch.keep(labelled(apart).select("bucket", "doc_id", "own", "component"), "left")
    links = links.union(scratch.keep(_compare_blocks(rows, documents, scratch), "links"))
    components = scratch.keep(connected_components(links, "doc_id", "centre"), "components")

    linked = members.join(components, members["head"] == components["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "head").alias("component_id")
    )
    alone = others.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
