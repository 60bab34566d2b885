"""Ranked search against plain scoring."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from ledgerlens.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def expected(docs, items, top):
    terms = [(i, split(t)) for i, t in docs]
    held = [Counter(t) for _, t in terms]
    n_docs, n_words = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(w for own in held for w in own)
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, own), tf in zip(terms, held):
            m = 100 - 50 + (50 * len(own) * n_docs) // n_words if own else 0
            score = sum(
                floor(1000 * log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m))
                for w in set(split(text)) & tf.keys()
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:top], 1)]
    return out


@pytest.mark.parametrize("top, block", [(50, 1 << 16), (3, 40)])
def test_matches_plain_scoring(spark, monkeypatch, top, block):
    monkeypatch.setattr(S, "BLOCK_TERMS", block)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "日本", "The", "x1"]
    share = 1 / np.arange(1, len(vocabulary) + 1)

    def text(n):
        return " ".join(rng.choice(vocabulary, n, p=share / share.sum()))

    docs = [(i, text(int(rng.integers(1, 200)))) for i in range(400)]
    docs += [(i + 1000, docs[7][1]) for i in range(70)]  # ties beyond the limit
    docs += [(7, docs[7][1]), (7, "w1 other"), (None, "w2 w3 nameless"), (None, docs[7][1]), (2000, None), (2001, ""), (2002, "-- !!")]
    docs += [(2003, "w5 " * 30_000 + "rare"), (2004, "The THE the é É")]
    items = [(f"i{i}", text(int(rng.integers(1, 60)))) for i in range(12)]
    items += [("none", None), ("empty", ""), ("unknown", "zzz qqq"), ("same", "rare w5"), ("same", "the"), (None, "é rare")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'a' AS key", "1 AS item").repartition(5)
    wanted = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "'b' AS term")
    got = [tuple(r) for r in S.ranked_search(df, wanted, top).collect()]
    assert sorted(got, key=repr) == sorted(expected(docs, items, top), key=repr)


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, rng.integers(1, 120))) for _ in range(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    terms, tf, first, n = S.frequencies(data, offsets)
    item = np.repeat(np.arange(6), 5)
    asked = np.concatenate([rng.choice(np.unique(terms), 5, replace=False) for _ in range(6)])
    q = S.Query(item, asked.view(np.int64), np.full(30, 7), 40, int(n.sum()))
    pending = S._Pending(512)
    for d in range(40):
        own, often = terms[first[d] : first[d + 1]], tf[first[d] : first[d + 1]]
        rows = [S.rows_of(own[often >= least], level, 512).ravel() for level, least in enumerate(S.LEVELS)]
        pending.rows.append(np.unique(np.concatenate(rows)))
        pending.keys.append(d)
        pending.n.append(int(n[d]))
    width, _, _, bits = pending.take()
    bounds = q.bounds(np.frombuffer(bits, np.uint8).reshape(width, -1), n)
    exact = np.zeros_like(bounds)
    doc, item, score = q.scores(data, offsets)
    exact[item, doc] = score
    assert (bounds >= exact).all() and score.size
    assert np.median(bounds[exact > 0] / exact[exact > 0]) < 1.7


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert S.ranked_search(docs.limit(0), items).count() == 0
    assert S.ranked_search(docs, items.limit(0)).count() == 0
