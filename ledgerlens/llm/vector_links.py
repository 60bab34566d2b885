"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with a cosine of at least ``LIMIT`` lie within ``EPS`` of each other, also after
a rotation and in any subset of the rotated coordinates.

1. Equal vectors of one label are one class; copies never meet.
2. Vectors are rotated to principal dimensions (fitted on at most ``SAMPLE`` vectors; any
   rotation gives the same result) and sorted by label and by their cells of width ``EPS`` on
   the leading ``ORDERED`` dimensions. The sequence is cut into blocks of ``BLOCK``, and blocks
   into a tree of intervals of ``FAN`` parts each.
3. The join starts with the whole sequence against itself and goes down level by level. A pair
   of intervals whose bounding boxes are more than ``EPS`` apart, or which share no label, is
   skipped with all below it. No level holds more than ``FAN``^2 rows per pair kept above.
4. Pairs of blocks are compared in tasks that stream the partners of a block past it, once more
   by intervals of ``LEAF`` vectors. A busy block is dealt in pieces of ``PIECE`` partners.
5. A pair of blocks gives the number of links per vector and, for the components, all links or
   the same connections with fewer edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.scratch import Scratch
from ledgerlens.operators.components import connected_components
from ledgerlens.operators.spread import spread_join

LIMIT = 0.93
EPS = sqrt(2 - 2 * LIMIT) * (1 + 1e-9)
SAMPLE = 4_096
ORDERED = 6
BOXED = 16
BLOCK = 1_024
LEAF = 64
FAN_BITS = 3
PIECE = 32
# Links of a pair of blocks that are handed on one by one, per vector in it.
PLAIN = 4

_ORDER = ["label", "size", *(f"c{i}" for i in range(ORDERED)), "class"]
_LOW = [f"low{i}" for i in range(BOXED)]
_HIGH = [f"high{i}" for i in range(BOXED)]


def _usable(embedding: Column) -> Column:
    """Has components, all finite, and not only zeros."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = _scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a batch, one matrix for each number of components."""
    lists = batch.column(batch.schema.get_field_index(column))
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[offsets[rows][:, None] + np.arange(size)]


def principal_bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per number of components, the principal directions of a sample of unit vectors as columns."""
    sample = classes.orderBy(F.xxhash64("a"), "b").limit(SAMPLE).select("embedding").toArrow()
    bases = {}
    for batch in sample.combine_chunks().to_batches():
        for _, vectors in _matrices(batch, "embedding"):
            bases[vectors.shape[1]] = np.linalg.eigh(np.cov(_unit(vectors).T, ddof=0).reshape((vectors.shape[1],) * 2))[1][:, ::-1]
    return bases


def _turned(vectors: np.ndarray, bases: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The leading ``n`` rotated coordinates of unit vectors, filled up with zeros."""
    unit = _unit(vectors)
    basis = bases.get(vectors.shape[1])
    x = unit[:, :n] if basis is None else unit @ basis[:, :n]
    return np.pad(x, ((0, 0), (0, n - x.shape[1])))


def grid_sequence(classes: DataFrame, bases: dict[int, np.ndarray]) -> DataFrame:
    """Classes in grid order: (part, place, number, class, node, copies, label, size, embedding, low)."""
    shared = classes.sparkSession.sparkContext.broadcast(bases)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, ORDERED), dtype=np.int64)
            for rows, vectors in _matrices(batch, "embedding"):
                found[rows] = np.floor(_turned(vectors, shared.value, ORDERED) / EPS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(found[:, i].astype(np.int32)) for i in range(ORDERED)]],
                names=[*batch.schema.names, *(f"c{i}" for i in range(ORDERED))],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        place, number, now = -1, 0, None
        for batch in batches:
            places, numbers = [], []
            for key in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if key != now or number == BLOCK:
                    place, number, now = place + 1, 0, key
                places.append(place)
                numbers.append(number)
                number += 1
            box = np.zeros((batch.num_rows, BOXED))
            for rows, vectors in _matrices(batch, "embedding"):
                box[rows] = _turned(vectors, shared.value, BOXED)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * batch.num_rows, pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array(numbers, pa.int64()),
                    *batch.columns,
                    *[pa.array(box[:, i]) for i in range(BOXED)],
                ],
                names=["part", "place", "number", *batch.schema.names, *_LOW],
            )

    columns = "class bigint, node bigint, copies bigint, label string, size int, embedding array<double>"
    placed = classes.select(
        "class", "node", "copies", "label", F.size("embedding").alias("size"), "embedding"
    ).mapInArrow(cells, f"{columns}, {', '.join(f'c{i} int' for i in range(ORDERED))}")
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(partitions, *_ORDER).sortWithinPartitions(*_ORDER)
    return ordered.select("class", "node", "copies", "label", "size", "embedding").mapInArrow(
        cut, f"part bigint, place bigint, number bigint, {columns}, {', '.join(f'{c} double' for c in _LOW)}"
    )


def _level(part: str, place: str, level: int, inner: int) -> Column:
    """The number of the interval on ``level`` that holds a block; ``inner`` levels lie within a part."""
    if level <= inner:
        return F.shiftleft(F.col(part), 32) + F.shiftright(F.col(place), FAN_BITS * level)
    return F.shiftleft(F.shiftright(F.col(part), FAN_BITS * (level - inner)), 32)


def _near(a: str, b: str) -> Column:
    """May two intervals hold a link? Boxes count only where both hold one number of components."""
    zero = F.lit(0.0)
    squares = [
        F.pow(F.greatest(F.col(f"{a}.{low}") - F.col(f"{b}.{high}"), F.col(f"{b}.{low}") - F.col(f"{a}.{high}"), zero), 2)
        for low, high in zip(_LOW, _HIGH)
    ]
    total = squares[0]
    for square in squares[1:]:
        total = total + square
    one_size = (
        (F.col(f"{a}.low_size") == F.col(f"{a}.high_size"))
        & (F.col(f"{b}.low_size") == F.col(f"{b}.high_size"))
        & (F.col(f"{a}.low_size") == F.col(f"{b}.low_size"))
    )
    overlap = (
        (F.col(f"{a}.low_label") <= F.col(f"{b}.high_label"))
        & (F.col(f"{b}.low_label") <= F.col(f"{a}.high_label"))
        & (F.col(f"{a}.low_size") <= F.col(f"{b}.high_size"))
        & (F.col(f"{b}.low_size") <= F.col(f"{a}.high_size"))
    )
    return overlap & (~one_size | (total <= EPS * EPS))


def block_pairs(sequence: DataFrame, scratch: Scratch) -> DataFrame:
    """(p, q), p <= q: the blocks, as numbers of level 0, that may hold links with each other."""
    box = [F.min(c).alias(c) for c in _LOW] + [F.max(c).alias(h) for c, h in zip(_LOW, _HIGH)]
    boxes = scratch.keep(
        sequence.groupBy("part", "place").agg(
            F.min("label").alias("low_label"),
            F.max("label").alias("high_label"),
            F.min("size").alias("low_size"),
            F.max("size").alias("high_size"),
            *box,
        ),
        "boxes",
    )
    last = boxes.agg(F.max("part").alias("part"), F.max("place").alias("place")).first()
    if last["part"] is None:
        return boxes.select(F.col("part").alias("p"), F.col("place").alias("q"))
    inner = -(-last["place"].bit_length() // FAN_BITS)
    top = inner + -(-last["part"].bit_length() // FAN_BITS)
    ends = ["label", "size", *range(BOXED)]
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "p bigint, q bigint")
    for level in range(top - 1, -1, -1):
        nodes = scratch.keep(
            boxes.groupBy(_level("part", "place", level + 1, inner).alias("above"), _level("part", "place", level, inner).alias("id")).agg(
                *[f(f"{name}{'_' if isinstance(e, str) else ''}{e}").alias(f"{name}{'_' if isinstance(e, str) else ''}{e}") for e in ends for name, f in (("low", F.min), ("high", F.max))]
            ),
            "intervals",
        )
        a, b = nodes.alias("a"), nodes.alias("b")
        pairs = scratch.keep(
            pairs.join(a, F.col("p") == F.col("a.above"))
            .join(b, (F.col("q") == F.col("b.above")) & (F.col("a.id") <= F.col("b.id")) & _near("a", "b"))
            .select(F.col("a.id").alias("p"), F.col("b.id").alias("q")),
            "pairs",
        )
    return pairs


class _Block:
    """Vectors of one block and the boxes of its intervals of ``LEAF`` vectors."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        self.ids = table["class"].to_numpy()
        self.nodes = table["node"].to_numpy()
        self.copies = table["copies"].to_numpy()
        n = len(self.ids)
        self.x = _scaled(table["embedding"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(n, -1))
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        turned = np.stack([table[c].to_numpy() for c in _LOW], axis=1)
        starts = np.arange(0, n, LEAF)
        self.low, self.high = np.minimum.reduceat(turned, starts), np.maximum.reduceat(turned, starts)

    def links(self, other: _Block) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low[:, None] - other.high[None], other.low[None] - self.high[:, None]), 0)
        near = (gap * gap).sum(axis=2) <= EPS * EPS
        found = np.zeros((len(self.ids), len(other.ids)), dtype=bool)
        for i in np.flatnonzero(near.any(axis=1)):
            mine = slice(i * LEAF, (i + 1) * LEAF)
            for j in np.flatnonzero(near[i]):
                its = slice(j * LEAF, (j + 1) * LEAF)
                dots = self.x[mine] @ other.x[its].T
                found[mine, its] = dots / (self.norm[mine, None] * other.norm[None, its]) >= LIMIT
        return found


def _connections(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links of a pair of blocks, or stars with the same connections where links are many."""
    rows, columns = found.nonzero()
    if len(rows) <= PLAIN * sum(found.shape):
        return rows, columns
    left, right = [], []
    open_rows = found.any(axis=1)
    while open_rows.any():
        first = int(open_rows.argmax())
        own = np.zeros(len(open_rows), dtype=bool)
        own[first] = True
        before = 0
        while own.sum() > before:
            before = own.sum()
            reached = found[own].any(axis=0)
            own = own | found[:, reached].any(axis=1)
        # A spanning tree of the component: each row to its first column, each column to its first row, ...
        members, reached = np.flatnonzero(own), np.flatnonzero(reached)
        seen_r, seen_c = np.zeros(len(open_rows), bool), np.zeros(found.shape[1], bool)
        edge = np.array([first])
        seen_r[first] = True
        while len(edge):
            fresh = np.flatnonzero(found[edge].any(axis=0) & ~seen_c)
            left.append(edge[found[np.ix_(edge, fresh)].argmax(axis=0)])
            right.append(fresh)
            seen_c[fresh] = True
            rows_next = np.flatnonzero(found[:, fresh].any(axis=1) & ~seen_r) if len(fresh) else fresh
            if len(rows_next):
                right.append(fresh[found[np.ix_(rows_next, fresh)].argmax(axis=1)])
                left.append(rows_next)
                seen_r[rows_next] = True
            edge = rows_next
        open_rows &= ~own
    return np.concatenate(left), np.concatenate(right)


def block_links(sequence: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, linked, node, other): rows linked per class in parts, and connections of nodes (linked 0)."""
    block = _level("part", "place", 0, 0)
    vectors = sequence.select(block.alias("q"), "number", "class", "node", "copies", "embedding", *_LOW)
    busy = pairs.groupBy("p").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    partners = spread_join(pairs.filter("p != q"), busy, ["p"], by=["q"]).select(
        "p", F.pmod(F.xxhash64("q"), "pieces").cast("int").alias("piece"), "q"
    )
    own = busy.select("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("p").alias("q"))
    rows = (
        partners.union(own)
        .join(vectors, "q")
        .select("p", "piece", (F.col("p") == F.col("q")).alias("own"), "q", "number", "class", "node", "copies", "embedding", *_LOW)
        .repartition("p", "piece")
        .sortWithinPartitions("p", "piece", F.desc("own"), "q", "number")
    )
    schema = pa.schema([(c, pa.int64()) for c in ("class", "linked", "node", "other")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, mine, total = None, [], None, None

        def told(ids, linked):
            full = linked.nonzero()[0]
            empty = pa.nulls(len(full), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids[full]), pa.array(linked[full]), empty, empty], schema=schema)

        def joined(a: _Block, b: _Block, found: np.ndarray) -> pa.RecordBatch:
            i, j = _connections(found)
            empty = pa.nulls(len(i), pa.int64())
            return pa.RecordBatch.from_arrays([empty, pa.array(np.zeros(len(i), np.int64)), pa.array(a.nodes[i]), pa.array(b.nodes[j])], schema=schema)

        def settle() -> Iterator[pa.RecordBatch]:
            """Compares the block that has come in with the block of its group."""
            nonlocal mine, total
            if not waiting:
                return
            other = _Block(waiting)
            waiting.clear()
            if now[2]:
                mine, total = other, np.zeros(len(other.ids), dtype=np.int64)
                if now[1] > 0:  # the first piece alone compares the block with itself
                    return
                found = mine.links(mine)
                np.fill_diagonal(found, False)
            else:
                found = mine.links(other)
            if found.any():
                total += found @ other.copies
                if not now[2]:
                    yield told(other.ids, found.T @ mine.copies)
                yield joined(mine, other, np.triu(found) if now[2] else found)

        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)]))
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != now:
                    yield from settle()
                    if now is not None and keys[start][:2] != now[:2]:
                        yield told(mine.ids, total)
                    now = keys[start]
                waiting.append(batch.slice(start, end - start))
                start = end
        yield from settle()
        if mine is not None:
            yield told(mine.ids, total)

    return rows.mapInArrow(compare, "class bigint, linked bigint, node bigint, other bigint")


def vector_links(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, label, embedding).

    Rows are compared where their labels are equal and not null; two are linked if their
    cosine, in double precision, is at least ``LIMIT``. Null and empty vectors, vectors of
    zeros and those with a null or non-finite component link with nothing, and so do rows
    without vec_id or label and vectors with another number of components. ``n_links`` counts
    the other rows linked, copies included. ``component_id`` is the smallest vec_id reachable;
    rows of equal vec_id are one node. A row without vec_id has no component and is kept. An
    empty table gives an empty result. Other columns are ignored. Equal vectors are told by
    128 bits of hash.
    """
    scratch = Scratch(vectors.sparkSession, "vector-links")
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")
    )
    keyed = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding"))).select(
        "*", F.xxhash64("label", "embedding").alias("a"), F.xxhash64(F.lit(1), "embedding", "label").alias("b")
    )
    classes = scratch.keep(
        keyed.groupBy("a", "b")
        .agg(
            F.min("vec_id").alias("node"),
            F.count("*").alias("copies"),
            F.any_value("label").alias("label"),
            F.any_value("embedding").alias("embedding"),
        )
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    sequence = scratch.keep(grid_sequence(classes, principal_bases(classes)), "sequence")
    found = scratch.keep(block_links(sequence, block_pairs(sequence, scratch)), "links")

    members = scratch.keep(
        spread_join(keyed.select("vec_id", "a", "b"), classes.select("a", "b", "class", "node", "copies"), ["a", "b"], by=["vec_id"]),
        "members",
    )
    several = members.groupBy("vec_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    edges = found.filter("node IS NOT NULL").select("node", "other")
    edges = edges.union(members.join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("node"), F.col("node").alias("other")))
    components = connected_components(edges, "node", "other")
    counts = found.filter("class IS NOT NULL").groupBy("class").agg(F.sum("linked").alias("linked"))
    classed = (
        classes.select("class", "node", "copies")
        .join(counts, "class", "left")
        .join(components, "node", "left")
        .select(
            "class",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = spread_join(members.select("vec_id", "class"), classed, ["class"], by=["vec_id"]).select("vec_id", "n_links", "component_id")
    # A node that stands for copies only is reached through its class.
    alone = rows.filter(
        ~F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding")), F.lit(False))
    ).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
