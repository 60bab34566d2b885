"""Links between embeddings against brute force."""

import numpy as np
import pytest

from ledgerlens.llm import vector_links as V


def usable(row):
    v, label, e = row
    return v is not None and label is not None and bool(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)


def expected(rows):
    linked = [set() for _ in rows]
    unit = [np.array(r[2]) / max(map(abs, r[2])) if usable(r) else None for r in rows]
    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a is None or b is None or rows[i][1] != rows[j][1] or len(a) != len(b):
                continue
            if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                linked[i].add(j)
                linked[j].add(i)
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for i, others in enumerate(linked):
        for j in others:
            a, b = sorted((find(rows[i][0]), find(rows[j][0])))
            low[b] = a
    return [
        (v, len(linked[i]), None if v is None else find(v), v is None or find(v) == v) for i, (v, _, _) in enumerate(rows)
    ]


@pytest.mark.parametrize("block", [16, 1024])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "LEAF", min(block, 64))
    monkeypatch.setattr(V, "PIECE", 3)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 8))
    rows = []
    for i in range(600):
        near = base[rng.integers(20)] if i % 3 else base[0]
        rows.append((i, int(rng.integers(3)), (near + rng.normal(size=8) * 0.25 * rng.random()).tolist()))
    rows += [(2000 + i, 1, base[0].tolist()) for i in range(30)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None], [float("inf"), 1.0], [1e300] * 8, [1e-300] * 8, [1.0] * 8, [1.0] * 3]
    rows += [(3000 + i, 1, e) for i, e in enumerate(odd)]
    rows += [(None, 1, base[0].tolist()), (3100, None, base[0].tolist()), (5, 2, base[3].tolist()), (5, 2, base[4].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").selectExpr("*", "1 AS class", "2 AS node")
    got = [tuple(r) for r in V.vector_links(df).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    assert V.vector_links(empty).count() == 0


def test_many_links_keep_their_connections():
    rng = np.random.default_rng(3)
    found = rng.random((60, 50)) < 0.3
    found[:20, 25:] = found[20:, :25] = False
    i, j = V._connections(found)
    assert len(i) < 2 * sum(found.shape)
    assert found[i, j].all()

    def parts(rows, columns):
        label = np.arange(110)
        for _ in range(110):
            for a, b in zip(rows, columns):
                label[a] = label[60 + b] = min(label[a], label[60 + b])
        return label.tolist()

    assert parts(i, j) == parts(*found.nonzero())
