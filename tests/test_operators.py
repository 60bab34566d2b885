"""Graph, components, metrics, cases and stores on small fixtures."""

import hashlib
import json
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.canonical import canonical_json, content_hash, name_uuid
from ledgerlens.functions.scalars import label_is_eligible, risk_band
from ledgerlens.operators import bootstrap as B
from ledgerlens.operators import cases as K
from ledgerlens.operators import components as C
from ledgerlens.operators import entity_risk as ER
from ledgerlens.operators import evidence as E
from ledgerlens.operators import graph as G
from ledgerlens.operators import metrics as X
from ledgerlens.operators import modeling as M
from ledgerlens.operators import profile as P
from ledgerlens.operators import review as R
from ledgerlens.operators import running as N
from ledgerlens.operators.spread import spread_join
from ledgerlens.schemas import LINKS
from ledgerlens.sources import tables as T
from ledgerlens.streaming.case_status import next_status, refusal


def members(spark, links, seed, ts, **kw):
    df = spark.createDataFrame(links, LINKS)
    seeds = spark.createDataFrame([(seed, ts)], "transaction_id long, ts long")
    return {r["member_id"] for r in G.expand(df, seeds, G.ExpansionParams(**kw)).collect()}


def test_expand_window_is_half_open(spark):
    links = [("CARD", "c1", i, t) for i, t in enumerate((1000, 2000, 3000, 4000))]
    assert members(spark, links, 2, 3000, back_s=1000, fwd_s=1000) == {1, 2}


def test_expand_cap_takes_latest_and_keeps_seed(spark):
    links = [("CARD", "c1", i, 1000 + i) for i in range(6)]
    assert members(spark, links, 2, 1002, back_s=100, fwd_s=100, neighbor_cap=2) == {2, 4, 5}


def test_hub_is_pruned_and_reported(spark):
    links = [("CARD", "hub", i, 1000 + i) for i in range(4)]
    assert members(spark, links, 1, 1001, hub_degree_max=2) == {1}
    df = spark.createDataFrame(links, LINKS)
    seeds = spark.createDataFrame([(1, 1001)], "transaction_id long, ts long")
    row = G.expand_detailed(df, seeds, G.ExpansionParams(hub_degree_max=2)).first()
    assert row["pruned"] and row["degree"] == 4 and row["retained_neighbors"] == 0


def test_expansion_shuffles_lists_not_pairs(spark):
    """Ranges are cut from lists: no join on a position, and every exchange comes before the pairs are made."""
    links = [(k, f"e{i % 3}", i, 1000 + 7 * i) for i in range(30) for k in ("CARD", "DEVICE")]
    df = spark.createDataFrame(links, LINKS)
    seeds = df.select("transaction_id", "ts").distinct()
    params = G.ExpansionParams(back_s=80, fwd_s=50, neighbor_cap=4)
    got = G.expand(df, seeds, params)
    assert "Join Inner" in (plan := got._jdf.queryExecution().optimizedPlan().toString())
    assert not any("Join Inner" in line and "place" in line for line in plan.splitlines())
    assert plan.index("Generate inline(zip_with") < plan.index("RepartitionByExpression")
    want = set()
    for s in range(30):
        t = 1000 + 7 * s
        near = [m for m in range(s % 3, 30, 3) if t - 80 <= 1000 + 7 * m < t + 50]
        want |= {(s, m, 1000 + 7 * m) for m in near[-4:] + [s]}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_default_parameters_hash():
    assert G.ExpansionParams().digest() == "3acd0e8f924f9e20"
    with pytest.raises(ValueError):
        G.ExpansionParams(depth=2)


def test_spread_join_equals_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)] + [(None, 99)], "k string, i long")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, spread_join(left, right, ["k"], how, hot_rows=7).collect()))
        b = sorted(map(str, left.join(right, "k", how).collect()))
        assert a == b, how


def test_hot_missing_keys_are_spread(spark):
    left = spark.createDataFrame([(None if i % 2 else f"k{i % 6}", i) for i in range(80)], "k string, i long")
    right = spark.createDataFrame([("k0", 2), (None, 3)], "k string, v long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, spread_join(left, right, ["k"], how, hot_rows=5).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect())), how


def test_encoding_many_columns_is_one_join(spark):
    names = [f"c{i}" for i in range(30)]
    rows = spark.range(40).select(
        F.col("id").alias("transaction_id"), *[F.pmod(F.col("id"), F.lit(i + 2)).cast("string").alias(n) for i, n in enumerate(names)]
    )

    def encoded(columns):
        return M.lookup_frequency(rows, M.fit_frequency(rows.filter("transaction_id < 30"), columns), columns)

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Range (")

    assert scans(encoded(names)) == scans(encoded(names[:1]))
    got = {r["transaction_id"]: r["freq_c29"] for r in encoded(names).collect()}
    assert got[0] == pytest.approx(1 / 30) and got[30] == -1.0 and len(got) == 40


def test_components_with_hot_node(spark):
    rnd = random.Random(1)
    edges = [(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for _ in range(45)]
    edges += [("hub", f"n{i:02d}") for i in range(0, 60, 3)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["node"]: r["component"] for r in C.connected_components(df, "a", "b", hot_rows=5).collect()}
    assert got == {n: find(n) for n in parent}


def test_metrics_with_ties(spark):
    rows = [(i, int(i % 4 == 0), round((i * 7 % 20) / 20, 2), "g") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, y int, s double, g string")
    r = X.ranking_metrics(df, "y", "s", ["g"]).first()
    pairs = [(a[2] > b[2]) + 0.5 * (a[2] == b[2]) for a in rows if a[1] for b in rows if not b[1]]
    assert r["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    top = X.top_fraction_metrics(df, "y", "s", "id", ["g"], [0.13]).first()
    best = sorted(rows, key=lambda x: (-x[2], x[0]))[:13]
    assert top["precision_at"] == pytest.approx(sum(x[1] for x in best) / 13, abs=1e-5)


def test_exact_quantiles(spark):
    df = spark.range(1000).withColumnRenamed("id", "ts")
    assert M.fit_boundaries(df, "ts") == pytest.approx((699.3, 849.15))
    assert P.exact_quantiles(df, "ts", [0.0, 1.0], levels=[F.floor(F.col("ts") / 10)]).count() == 2


def test_split_bounds(spark):
    df = spark.createDataFrame([(t,) for t in (1, 2, 3, 10, 11, 20, 21, 30)], "ts long")
    got = {r["ts"]: r["split"] for r in M.chronological_split(df, "ts", 10, 20).collect()}
    assert got[3] == "train" and got[10] == "valid" and got[20] == "test"
    with pytest.raises(ValueError):
        M.chronological_split(df, "ts", 5, 5)


def test_shuffle_is_a_permutation(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i), i) for i in range(60)], "transaction_id long, s string, f double, y int")
    got = M.shuffle_features(df, ["f"], ["s"]).collect()
    for split in "ab":
        have = sorted(r["f"] for r in got if r["s"] == split)
        assert have == sorted(float(i) for i in range(60) if ("a" if i % 3 else "b") == split)
    assert any(r["f"] != r["transaction_id"] for r in got) and len(got) == 60


def test_poisson_weights_have_mean_one(spark):
    u = spark.range(10_000).select((F.col("id") / 10_000).alias("u"))
    assert u.agg(F.avg(X.poisson_weight(F.col("u")))).first()[0] == pytest.approx(1.0, abs=1e-2)


def test_entity_risk_boundary(spark):
    links = spark.createDataFrame([("CARD", "c", 1, 0)], LINKS)
    labels = spark.createDataFrame([(1, 1, 42 * 86_400)], "transaction_id long, value int, arrival long")
    asked = [(40, 0), (50, 0), (49, 0), (49, -1)]
    queries = spark.createDataFrame([("CARD", "c", d * 86_400 + s) for d, s in asked], "entity_type string, entity_key string, as_of long")
    got = {r["as_of"]: (r["label_count"], r["fraud_rate"]) for r in ER.entity_risk_asof(links, labels, queries, 7).collect()}
    assert [got[d * 86_400 + s][0] for d, s in asked] == [0, 1, 1, 0]
    assert got[40 * 86_400][1] is None and got[50 * 86_400][1] == 1.0


def test_replay_of_sparse_numbers_in_short_lists(spark, monkeypatch):
    """Microseconds as numbers: lists hold at most BLOCK items, and the outcome is that of a plain loop."""
    monkeypatch.setattr(K, "BLOCK", 7)
    draw = random.Random(3)
    targets = [*K.STATUSES, "BOGUS"]
    rows, want = [], {}
    for case, n in ((1, 400), (2, 1), (3, 49), (4, 50)):
        status, seq = "NEW", 1_704_067_200_000_000
        for _ in range(n):
            seq += draw.randrange(1, 10**9)
            row = (case, seq, draw.choice(["STATUS", "DECISION", "NOTE"]), draw.choice(targets), draw.random() < 0.9)
            reason = refusal(status, *row[2:])
            status = row[3] if reason is None and row[2] != "NOTE" else status
            rows.append(row)
            want[case, seq] = (reason, status)
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "case_id long, seq long, action string, target string, acceptable boolean")
    got = {(r["case_id"], r["seq"]): (r["reason"], r["status_after"]) for r in K.replay_actions(df).collect()}
    assert got == want
    acts = K.action_ranks(df).withColumn("effect", F.array(*[F.lit(i) for i in range(len(K.STATUSES))]))
    tree = K.fold_tree(acts, 400)
    assert [t.agg(F.max(F.size("items"))).first()[0] for t in tree] == [7, 7, 7, 2]
    assert tree[-1].count() == 4


def test_replay_of_a_long_case(spark):
    """A case over several blocks equals a plain loop."""
    rnd = random.Random(2)
    names = [*K.STATUSES, "BOGUS"]
    rows = []
    for case in (1, 2):
        for seq in sorted(rnd.sample(range(5_000), 300) + [2_500_000, 2_500_007]):
            action = rnd.choice(["STATUS", "STATUS", "STATUS", "DECISION", "NOTE"])
            # Decisions are rare, so that the case stays open for long.
            target = rnd.choice(names[:3]) if seq < 4_900 else rnd.choice(names)
            rows.append((case, seq, action, target, rnd.random() > 0.1))
    df = spark.createDataFrame(rows, "case_id long, seq long, action string, target string, acceptable boolean")
    got = {(r["case_id"], r["seq"]): (r["accepted"], r["status_after"]) for r in K.replay_actions(df).collect()}
    for case in (1, 2):
        status = "NEW"
        for r in [x for x in rows if x[0] == case]:
            accepted, status = next_status(status, *r[2:])
            assert got[(case, r[1])] == (accepted, status)


def test_hash_and_uuid_match_the_standard_library(spark):
    payload = {"a": 1, "b": "é/x", "c": None}
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    col = canonical_json({"b": F.lit("é/x"), "a": F.lit(1), "c": F.lit(None).cast("string")})
    r = spark.range(1).select(col.alias("t"), content_hash(col).alias("h"), name_uuid(col).alias("u")).first()
    assert r["t"] == text
    assert r["h"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, text))


def test_scalars(spark):
    df = spark.createDataFrame([(0.85,), (0.6,), (0.3,), (0.29,)], "s double")
    assert [r[0] for r in df.select(risk_band(F.col("s"))).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    r = spark.range(1).select(label_is_eligible(F.lit(0), F.lit(7 * 86_400), 7), label_is_eligible(F.lit(1), F.lit(7 * 86_400), 7)).first()
    assert r[0] is True and r[1] is False


def test_queue_limits_and_flags(spark):
    scores = spark.createDataFrame(
        [(101, 0.97, "CRITICAL"), (102, 0.88, "HIGH"), (103, 0.65, "MEDIUM"), (104, 0.10, "LOW")],
        "transaction_id long, risk_score double, risk_band string",
    )
    evidence = spark.createDataFrame([(101,), (102,), (102,)], "transaction_id long")
    assert [r[0] for r in R.risk_queue(scores, evidence, 2).collect()] == [101, 102]
    assert [r[0] for r in R.risk_queue(scores, evidence, band="high").collect()] == [102]
    assert [r[0] for r in R.risk_queue(scores, evidence, has_evidence=False).collect()] == [103, 104]
    with pytest.raises(ValueError):
        R.risk_queue(scores, evidence, 201)


def test_csv_and_versions(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,amount,key\n1,2.5,a\n2,,b\n")
    schema = spark.createDataFrame([], "id long, amount double, key string").schema
    out = T.csv_to_parquet(spark, str(tmp_path / "in.csv"), schema, str(tmp_path / "out"))
    assert out.count() == 2 and out.filter("amount IS NULL").count() == 1
    path = str(tmp_path / "scores")
    def version(name, value):
        return spark.createDataFrame([(1, value, name)], "transaction_id long, risk_score double, model_version string")
    T.replace_version(version("a", 0.1).union(version("b", 0.2)), path)
    T.replace_version(version("b", 0.3), path)
    got = {r["model_version"]: r["risk_score"] for r in spark.read.parquet(path).collect()}
    assert got == {"a": 0.1, "b": 0.3}
    df = spark.range(100)
    assert T.table_fingerprint(df).first() == T.table_fingerprint(df.orderBy(F.desc("id"))).first()


def test_rings_from_mapping(spark):
    truth = spark.createDataFrame([({"A": [1, 2, 3], "B": [7]},)], "rings map<string,array<long>>")
    rings = C.rings_from_mapping(truth)
    comps = spark.createDataFrame([(str(i), "1") for i in (1, 2, 3, 4)] + [("7", "7")], "node string, component string")
    got = {r["ring"]: r["recovered"] for r in C.ring_recovery(C.component_purity(comps, rings), rings).collect()}
    assert got == {"A": True, "B": False}


def test_evidence_tampering_is_found(spark):
    rows = spark.createDataFrame([(1, 10.0, "c", None, 2.5, None)], "transaction_id long, amount double, card_key string, device_key string, amt_z_card double, amt_z_device double")
    done = E.finalize(E.ev_amount_deviation(rows))
    assert E.verify_evidence(done).count() == 0
    assert E.verify_evidence(done.withColumn("details", F.lit("{}"))).count() == 1


def test_bootstrap_draws_depend_on_id_and_replicate_alone(spark):
    rows = spark.createDataFrame([(i, int(i % 3 == 0), i % 7 / 7, i % 5 / 5, "g") for i in range(60)], "id int, y int, a double, b double, g string")
    run = lambda df: X.paired_bootstrap(df, "y", "a", "b", "id", ["g"], replicates=6).first()
    first, again = run(rows), run(rows.orderBy(F.desc("id")).repartition(3))
    assert first["replicates"] == 6
    assert first["mean_gain"] == pytest.approx(again["mean_gain"])


def test_top_fraction_ties_with_sparse_ids(spark):
    """Tied rows are taken by id, however far apart the ids lie."""
    ids = [-(1 << 62), -5, 3, 1 << 21, 1 << 42, (1 << 62) + 7]
    rows = spark.createDataFrame([(i, int(i in ids[:2]), 0.5, "g") for i in ids], "id long, y int, s double, g string")
    got = X.top_fraction_metrics(rows, "y", "s", "id", ["g"], fractions=(0.34, 0.67)).orderBy("fraction").collect()
    assert [(r["k"], r["precision_at"], r["recall_at"]) for r in got] == [(2, 1.0, 1.0), (4, 0.5, 1.0)]


def test_scores_of_several_versions_need_their_time(spark):
    from ledgerlens.operators import evidence as E

    scores = spark.createDataFrame([(1, 0.9, "v1")], "transaction_id long, risk_score double, model_version string")
    with pytest.raises(ValueError):
        E.generate_evidence(None, None, scores)


def test_levels_of_doubles_keep_their_order(spark):
    rng = random.Random(5)
    values = [0.0, 1.0, 0.5, 2.0**-1022, 5e-324, 2.0**-1060, 0.1, 1e-4, 1 - 2.0**-53, 8.0, 2.0**1000, 1.7e308]
    values += [rng.random() * 10.0 ** -rng.randrange(12) for _ in range(500)]
    values += [2.0**-k for k in range(60)] + [2.0**-k * (1 - 2.0**-53) for k in range(60)]
    values += [-v for v in values]
    coarse, fine = N.double_levels(F.col("v"))
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", coarse.alias("c"), fine.alias("f")).collect()
    ordered = [(r["c"], r["f"]) for r in sorted(got, key=lambda r: r["v"])]
    assert ordered == sorted(ordered) and len({*ordered}) > 1000
    assert all(r["c"] == r["f"] >> 21 or r["v"] < 0 for r in got)


def test_metrics_do_not_depend_on_the_scale_of_scores(spark):
    rows = spark.range(3000).select(
        F.col("id"), F.lit("a").alias("grp"), (F.pmod(F.xxhash64("id"), F.lit(500)) / 500.0).alias("s"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) == 0).cast("int").alias("y")
    )
    tiny = rows.withColumn("s", F.col("s") / 1e7)
    assert X.ranking_metrics(rows, "y", "s", ["grp"]).collect() == X.ranking_metrics(tiny, "y", "s", ["grp"]).collect()
    tops = [sorted(map(tuple, X.top_fraction_metrics(d, "y", "s", "id", ["grp"]).collect())) for d in (rows, tiny)]
    assert tops[0] == tops[1]
    best = [X.best_f1_threshold(d, "y", "s", ["grp"]).first() for d in (rows, tiny)]
    assert abs(best[0]["threshold"] / 1e7 - best[1]["threshold"]) < 1e-15 and abs(best[0]["f1"] - best[1]["f1"]) < 1e-12
    # Scores below 1e-7 still spread over many windows.
    level = N.double_levels(F.col("s"))[0]
    assert tiny.filter("s > 0").groupBy(level.alias("l")).agg(F.count_distinct("s").alias("n")).agg(F.max("n")).first()[0] <= 4


def _tangled(spark):
    """Links of three kinds that share many members; some come twice, some lack a time, one id has two times."""
    rnd = random.Random(21)
    links = [
        (kind, f"{kind[0]}{rnd.randrange(4)}", i, 1000 + 5 * (i // 2)) for i in range(40) for kind in ("CARD", "ADDRESS", "DEVICE") if rnd.random() < 0.9
    ]
    links += links[:7] + [("CARD", "C1", 3, 1100), ("CARD", "C2", 50, None), ("DEVICE", "D1", None, 1030), ("CARD", "C1", None, 1030)]
    df = spark.createDataFrame(links, LINKS)
    seeds = [(i, 1000 + 5 * (i // 2)) for i in range(0, 40, 3)] + [(3, 1005), (50, None), (None, 1030), (77, 1), (6, 1090)]
    return df, spark.createDataFrame(seeds, "transaction_id long, ts long")


@pytest.mark.parametrize("limits", [{}, {"hub_degree_max": 11, "neighbor_cap": 3}])
def test_members_made_at_their_entity_are_those_of_the_lists(spark, limits):
    links, seeds = _tangled(spark)
    params = G.ExpansionParams(**{"back_s": 60, "fwd_s": 30, "neighbor_cap": 5, **limits})
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    plain = G.expand(links, seeds, params)
    held = G.expand(links, seeds, params, G.held_entities(links, params), ["entities"])
    assert rows(held.select(*plain.columns)) == rows(plain)
    assert rows(G.incidence(links, held, seeds, params)) == rows(G.incidence(links, plain, seeds, params))


def test_pairs_of_seed_and_member_are_never_shuffled(spark):
    """Below the row where pairs are made there are exchanges, above it none."""
    links, seeds = _tangled(spark)
    members = G.expand(links, seeds, G.ExpansionParams(), G.held_entities(links), ["entities"])
    plan = G.incidence(links, members, seeds)._jdf.queryExecution().executedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(plan) if "Generate inline(slice" in line)
    assert not any("Exchange" in line for line in plan[:made])


def test_rules_on_members_with_attributes_give_the_same_records(spark):
    links, seeds = _tangled(spark)
    params = G.ExpansionParams(back_s=60, fwd_s=30, neighbor_cap=5)
    scores = spark.createDataFrame([(i, i % 10 / 9) for i in range(40)] + [(4, 0.7), (9, None), (None, 0.9)], "transaction_id long, risk_score double")
    plain = G.expand(links, seeds, params)
    held = G.expand(links, seeds, params, E._about(links, scores, params), ["devices"], settle=True)
    rows = lambda df: sorted(map(str, df.collect()))
    for rule in (
        lambda m: G.community_summary(links, seeds, scores, params, m),
        lambda m: E.ev_connected_high_risk(m, scores),
        lambda m: E.ev_shared_device(links, m, seeds, params),
    ):
        assert rows(rule(held)) == rows(rule(plain))


def _resampled(rows, replicates, seed=42):
    """Gains per replicate straight from the definition; rows are (id, y, base, other)."""
    steps = X.poisson_steps()
    gains = []
    for r in range(replicates):
        weights = []
        for i, *_ in rows:
            digits = hashlib.sha256(f"{i}:{r // 4}:{seed}".encode()).hexdigest()[13 * (r % 4):][:13]
            weights.append(sum(int(digits, 16) / (1 << 52) >= s for s in steps))
        scored = []
        for side in (2, 3):
            n = pos = ap = 0.0
            for score in sorted({row[side] for row in rows}, reverse=True):
                own = [(w, row[1]) for w, row in zip(weights, rows) if row[side] == score]
                n, hits = n + sum(w for w, _ in own), sum(w * y for w, y in own)
                pos += hits
                ap += hits * pos / n if n else 0.0
            scored.append(ap / pos if pos else None)
        gains.append(None if None in scored else scored[1] - scored[0])
    return gains


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 12, 16), (20, 3, 2), (16, 8, 1000)])
def test_bootstrap_by_cells_is_the_definition(spark, monkeypatch, sizes):
    """Small cells and pieces, scores that many rows share, and sums in place of equal scores."""
    for name, value in zip(("CELL_ROWS", "PIECE", "SUMMED"), sizes):
        monkeypatch.setattr(B, name, value)
    rows = [(i * 7, int(i % 4 == 0), (i * 13 % 40) / 40 if i % 3 else 0.5, (i * 5 % 17) / 17) for i in range(90)]
    df = spark.createDataFrame([(*r, "g") for r in rows], "id long, y int, a double, b double, g string").repartition(3)
    got = X.paired_bootstrap(df, "y", "a", "b", "id", ["g"], replicates=10).collect()
    want = _resampled(rows, 10)
    assert len(got) == 1 and got[0]["replicates"] == 10
    assert got[0]["mean_gain"] == pytest.approx(sum(want) / 10, abs=1e-12)
    assert got[0]["share_positive"] == pytest.approx(sum(g > 0 for g in want) / 10)


def test_bootstrap_keeps_rows_as_rows(spark):
    """No row is multiplied by the replicates before it is shuffled: the weights travel as one value."""
    df = spark.createDataFrame([(1, 1, 0.5, 0.6, "g")], "id long, y int, a double, b double, g string")
    plan = X.paired_bootstrap(df, "y", "a", "b", "id", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("CoGroup" if "CoGroup" in plan else "FlatMapCoGroups"):]
    assert "explode" not in below and "weights" in below


def test_steps_that_go_on_in_the_next_piece(monkeypatch):
    """Pieces of any size give the same average precision, summed rows among them."""
    rnd = random.Random(4)
    rows = [(rnd.randrange(5) / 4, rnd.randrange(2), [rnd.randrange(3) for _ in range(3)]) for _ in range(60)]
    weights = [bytes(w) for *_, w in rows]
    n = np.array(rows[0][2], float)
    weights[0] = n.tobytes() + (n * rows[0][1]).tobytes()
    cell = pa.table({"at": [-r[0] for r in rows], "tie": [1] * 60, "y": [float(r[1]) for r in rows], "weights": pa.array(weights, pa.binary())})
    found = []
    for size in (1000, 7, 1):
        monkeypatch.setattr(B, "PIECE", size)
        found.append(B._partial(cell, np.ones(3), np.ones(3), 3))
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2]) and found[0].min() > 0
