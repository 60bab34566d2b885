"""The corpus operators against brute force on small tables with nulls, ties and copies."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import (
    chats,
    decontamination,
    fingerprints,
    licenses,
    mixing,
    near_duplicates,
    private_data,
    repeated_windows,
    token_counts,
    toxicity,
)

from ledgerlens.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(3_000))
DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau phi"),
    (4, None),
    (5, ""),
    (6, "  \t\n "),
    (7, "one two"),
    (8, "one two"),
    (9, LONG),
    (9, LONG),
    (10, LONG + " tail of another kind"),
    (None, "alpha beta gamma"),
    (11, "é" * 150 + " naïve Straße 日本語"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "a", 0, "clash", 1.0) for i, t in DOCS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double"
    )


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def words_of(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_near_duplicates_on_edges(docs, empty):
    got = {}
    for r in near_duplicates.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))

    def shingles(text):
        w = words_of(text, r"[^\x20\x09-\x0D]+")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    parts = {i: shingles(t) for i, t in DOCS if i is not None}
    low = {i: i for i in parts}
    for _ in parts:
        for a, b in itertools.combinations(parts, 2):
            both = len(parts[a] & parts[b])
            if parts[a] and parts[b] and 100 * both >= 75 * (len(parts[a] | parts[b])):
                low[a] = low[b] = min(low[a], low[b])
    for i, s in parts.items():
        assert all(r == (len(s), low[i], low[i] == i) for r in got[i])
    assert got[None] == [(1, None, True)]
    assert len(got[9]) == 2
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_needed_matches_keep_pairs_at_the_limit():
    for n in (16, 32, 64):
        assert 0 < near_duplicates.needed_matches(n) < 0.75 * n


def test_many_separate_edits_of_one_text(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for at in rng.sample(range(150), 1 + i % 7):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    got = {r[0]: r[2] for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows}
    low = {i: i for i in sets}
    for _ in range(6):
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low[a] = low[b] = min(low[a], low[b])
    assert got == low


def test_contamination_on_edges(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, DOCS[0][1]), (2, "ONE two"), (3, None), (4, ""), (None, "iota kappa lambda mu nu xi omicron pi rho sigma tau"), (5, "nowhere to be found")],
        "item_id long, text string",
    )
    found = {}
    for r in decontamination.contamination(docs, items).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert found[1] == [(20, 20, ["1"], True)] and found[2] == found[1]
    assert found[3] == [(20, 19, ["1"], True)]
    assert found[7] == [(2, 2, ["2"], True)]
    assert found[4] == [(0, 0, [], False)] and len(found[9]) == 2
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, items.filter("false")).collect())
    assert decontamination.contamination(empty, items).count() == 0


def test_repeated_windows_on_edges(spark, docs, empty):
    rng = random.Random(5)
    text = "".join(rng.choices("abc é", k=900))
    rows = [(20, text), (21, "x" * 400), (22, text[:150] + "Q" + text[151:500]), (23, "y" + "x" * 120), (24, None), (25, text)]
    rows += [(30 + i, "".join(rng.choices("ab", k=20)) + text[i * 7 : i * 7 + 130]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), kept)
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in repeated_windows.remove_repeats(df).collect()}
    assert got == want
    assert repeated_windows.remove_repeats(docs).count() == len(DOCS)
    assert repeated_windows.remove_repeats(empty).count() == 0


def test_repeated_windows_of_long_and_nameless_texts(spark):
    rng = random.Random(6)
    long = rng.randbytes(5 << 18).hex()
    step = (1 << repeated_windows.PIECE_BITS) - repeated_windows.WINDOW
    rows = [(1, long), (2, long[step - 300 : step + 300])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in repeated_windows.remove_repeats(df).collect()}
    assert got == {1: (len(long), 0, 0, long.encode()), 2: (600, 600, 1, b"")}

    a, b, shared = (rng.randbytes(150).hex() for _ in range(3))
    texts = [a + shared, a[:120] + shared + b, shared, a + shared, shared + b[:150]]
    possible = []
    for order in itertools.permutations(texts):
        seen, out = set(), []
        for t in order:
            gone = np.zeros(len(t), bool)
            for s in range(len(t) - 99):
                gone[s : s + 100] |= t[s : s + 100] in seen
                seen.add(t[s : s + 100])
            out.append((len(t), int(gone.sum()), "".join(c for c, g in zip(t, gone) if not g)))
        possible.append(sorted(out))
    for ids in ([None] * 5, [None, None, 7, None, 7]):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
        got = repeated_windows.remove_repeats(df).collect()
        assert sorted((r[1], r[2], bytes(r[4]).decode()) for r in got) in possible


def test_token_counts_match_the_library(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["a", " ", "\n", "'s", "'LL", "é", "中", "<|endoftext|>", "12", "!?", "\t", "😀", "the", " ing", "\x85", " ", "ՠ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(500)] + ["ab" * 900, " " * 500 + "x"]
    counter = token_counts.Counter(path)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want
    whole = token_counts.CHUNK
    try:
        for token_counts.CHUNK in (3, 11):
            assert [counter.count(t) for t in texts] == want
    finally:
        token_counts.CHUNK = whole
    for r in token_counts.token_counts(docs, path).collect():
        if r["doc_id"] == 4:
            assert tuple(r)[1:] == (0, 0)
    assert token_counts.token_counts(docs, path).count() == len(DOCS)
    assert token_counts.token_counts(empty, path).count() == 0


def test_private_data_base_spans_are_the_plain_patterns():
    def plain(text):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(p) <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m.group())
            if 13 <= len(d) <= 19 and private_data.luhn(d):
                out.append((2, *m.span()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append((3, *m.span()))
        return out

    rng = random.Random(2)
    parts = ["a", "b.c", "@", "x@y.z", ".", "1", "23", "255", "4111 1111 1111 1111", "-", " ", "+1 (212) 555-0100", "%", "é", "(", ")", "256"]
    for _ in range(4_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert private_data.base_spans(text) == plain(text), text
    assert private_data.base_spans("a" * 300_000 + "1" * 300_000) == []


def test_private_data_learns_contexts(spark, docs, empty):
    rows = [(i, f"some words reach me at +1 (212) 555-01{i:02d} now") for i in range(30)]
    rows += [(100, "please reach me at 212/555/0199 now"), (101, "in the year 2019/2020 nothing"), (102, None)]
    found, patterns = private_data.private_data(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    assert spans[100] == [(3, 19, 31)] and patterns["me at"][0] == 3
    assert spans[101] == [] and spans[102] == []
    clean = private_data.redact(spark.createDataFrame(rows, "doc_id long, text string"))
    assert clean.filter("doc_id = 100").first()["text"] == "please reach me at [PHONE] now"
    assert private_data.private_data(docs)[0].count() == len(DOCS)
    assert private_data.private_data(empty)[0].count() == 0


def test_license_scan(spark, docs, empty):
    texts = [
        "Under the MIT License. again under the mit license",
        "Apache License, Version 2.0",
        "CC-BY-NC and under the mit  license",
        "This work is licensed under the GNU General Public License, version 3.",
        "we talked about a gnu in general",
        None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(rows).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 0, 5, ["mit"])
    assert got[1]["base_labels"] == ["apache-2"] and got[2]["base_labels"] == ["cc-by-nc", "mit"]
    assert got[3]["base_labels"] == [] and got[3]["labels"] == ["gpl-3"] and got[3]["score"] > 0.5
    assert got[4]["labels"] == [] and got[5]["n_words"] == 0 and got[5]["first_word"] is None
    for r in licenses.license_scan(docs).filter("doc_id IS NOT NULL").collect():
        assert r["n_words"] == len(words_of(dict(DOCS)[r["doc_id"]], ALNUM))
    assert licenses.license_scan(empty).count() == 0


def test_license_scan_of_files_with_many_licences(spark):
    rng = random.Random(8)
    texts = {name: text for name, (text, _) in licenses.TEMPLATES.items()}
    whole = [" filler ".join(t for n, t in sorted(texts.items(), key=lambda _: rng.random())) for _ in range(3)]
    notice = " and ".join(texts[n] for n in ("mit-text", "bsd", "isc", "zlib", "apache-2-text"))
    plain = [f"nothing of interest {i}" for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*whole, notice, *texts.values(), *plain])], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"]) for r in licenses.license_scan(rows).collect()}
    assert all(got[i] >= set(texts) for i in range(3))
    assert got[3] >= {"mit-text", "bsd", "isc", "zlib", "apache-2-text"}
    assert all(name in got[4 + i] for i, name in enumerate(texts))


def test_license_candidates_are_those_of_all_words():
    rng = random.Random(9)
    idf = {w: rng.choice([0.01, 1.0, 2.0, 5.0]) for w in licenses._VOCABULARY if w not in licenses.COMMON}
    index = licenses.template_index(idf)
    pool = [w for text, _ in licenses.TEMPLATES.values() for w in text.split()]
    for _ in range(150):
        w = []
        for text, _ in rng.choices(list(licenses.TEMPLATES.values()), k=rng.randint(1, 8)):
            w += [rng.choice(pool) if rng.random() < 0.15 else x for x in text.split() if rng.random() > 0.05]
        hits = [(p, licenses._WORD_NO[x]) for p, x in enumerate(w) if x in idf]
        seen = sorted(
            (p, n) for n, phrase in enumerate(licenses._PHRASES) for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()
        )
        want = []
        for name, (text, must) in licenses.TEMPLATES.items():
            t = text.split()
            total = sum(idf.get(x, 0) for x in t)
            best = None
            for start in range(-len(t), len(w)):
                if not any(0 <= start + o < len(w) and w[start + o] == x for o, x in enumerate(t) if x in idf):
                    continue
                agree = [x for o, x in enumerate(t) if x in idf and x in w[max(0, start + o - 3) : max(0, start + o + 4)]]
                share = min(1.0, sum(idf[x] for x in agree) / total)
                inside = any(licenses._PHRASES[n] in must and start - 3 <= p <= start + len(t) + 3 for p, n in seen)
                if share >= 0.5 and inside and (best is None or share > best + 1e-12):
                    best = share
            if best is not None:
                want.append((name, round(best, 9)))
        got = licenses.match(np.array([p for p, _ in hits]), np.array([x for _, x in hits]), [p for p, _ in seen], [n for _, n in seen], idf, index)
        assert [(n, round(s, 9)) for n, _, s in got] == sorted(want)


def test_edited_fingerprints(docs, empty):
    rows = fingerprints.edited_fingerprints(docs).collect()
    order = sorted(((-(i if i is not None else -1), t or "") for i, t in DOCS))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.append((-i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows]
    assert sorted(got) == sorted(want)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] != by_id[3]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert by_id[2]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_order_matters_for_fingerprints(spark):
    w = [f"v{i}" for i in range(400)]
    blocks = [" ".join(w[i : i + 20]) for i in range(0, 400, 20)]
    rows = spark.createDataFrame([(" ".join(blocks), " ".join(blocks[::-1]), " ".join(w[:-4]))], "a string, b string, c string")
    print_of = {c: fingerprints.fingerprint(F.col(c)) for c in "abc"}
    shuffled, shortened = rows.select(
        fingerprints.likeness(print_of["a"], print_of["b"]), fingerprints.likeness(print_of["a"], print_of["c"])
    ).first()
    assert shuffled < 0.65 < shortened


def test_toxicity_held_out(spark, empty):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.toxicity(documents, labels).cache()
    assert scored.count() == documents.count()
    for r in scored.select("doc_id", "held_out").limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    right = scored.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.9
    assert scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    # The held-out labels are not read.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.toxicity(documents, flipped).join(scored.withColumnRenamed("score", "s"), "doc_id").filter("abs(score - s) > 1e-9")
    assert same.count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len({r["score"] for r in rows}) == 1 and all(r["score"] < 0.5 and r["predicted"] == 0 for r in rows)


def test_pipeline_keeps_a_corpus_without_positives(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 20


def test_toxicity_reads_one_text_per_sampled_id(spark):
    docs = spark.createDataFrame([(1, f"bad words {i}") for i in range(200)] + [(i, f"fine {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 258


def test_fit_descends_the_non_negative_risk():
    """The learned scorer has a lower risk than the start, and than any one of its weights taken back."""
    rng = np.random.default_rng(4)

    def sample(n, rate):
        held = rng.random((n, 6)) < rate
        doc, word = held.nonzero()
        return toxicity.Features(word, np.searchsorted(doc, np.arange(n + 1))), held

    (pos, x_pos), (un, x_un) = sample(200, [0.8, 0.7, 0.1, 0.3, 0.3, 0.2]), sample(400, [0.2, 0.1, 0.6, 0.3, 0.3, 0.2])
    prior = 0.1

    def risk(weights, bias):
        p, u = (1 / (1 + np.exp(-(x @ weights + bias))) for x in (x_pos, x_un))
        clean = -np.log(1 - u).mean() + prior * np.log(1 - p).mean()
        return -prior * np.log(p).mean() + max(0.0, clean) + toxicity.DECAY / 2 * (weights @ weights)

    weights, bias = toxicity.fit(pos, un, 6, prior)
    least = risk(weights, bias)
    assert least < risk(np.zeros(6), np.log(prior / (1 - prior)))
    assert weights[0] > 0 and weights[1] > 0 and weights[2] < 0
    for k in (0, 1, 2):
        without = weights.copy()
        without[k] = 0
        assert least < risk(without, bias)


def best_cost(roles, state="start"):
    if not roles:
        return 0.0
    return min(c + best_cost(roles[1:], new) for c, new, _, _ in chats.moves(state, roles[0]))


def test_chat_repair_is_cheapest():
    rng = random.Random(4)
    for _ in range(150):
        roles = rng.choices(["system", "user", "assistant", None], k=rng.randint(0, 6))
        state, total = "start", 0.0
        for (action, role, put), given in zip(chats.repair(roles), roles):
            total += next(c for c, new, a, p in chats.moves(state, given) if (new, a, p) == (role, action, put))
            state = role
        assert abs(total - best_cost(roles)) < 1e-9
        assert abs(chats.costs(roles)[0].min() - total) < 1e-9


def test_chat_rows_and_chunks(spark):
    rows = [(1, t, r, f"t{t}") for t, r in enumerate(["user", "user", "assistant", "system", None])]
    rows += [(2, t, ["user", "assistant"][(t // 2) % 2], "x") for t in range(1_200)]
    rows += [(None, None, "user", None), (3, 0, "user", "a"), (3, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chats.repair_chats(table).orderBy("conv_id", "chunk", "place").collect()
    assert len(got) == len(rows)
    legal = {("start", r) for r in chats.LEGAL["start"]} | {(s, r) for s in chats.LEGAL for r in chats.LEGAL[s]}
    state = {}
    for r in got:
        if r["action"] != "merge":
            for step in filter(None, (r["inserted"], r["role"])):
                assert (state.get(r["conv_id"], "start"), step) in legal
                state[r["conv_id"]] = step
    # Pairs of equal roles merge at 0.4 each, also across chunks.
    assert sum(r["action"] == "merge" for r in got if r["conv_id"] == 2) == 600
    assert chats.repair_chats(table.filter("false")).count() == 0


def test_chat_chunks_are_bounded_by_rank(spark, monkeypatch):
    rng = random.Random(10)
    roles = ["system", "user", "assistant", "assistant", None]
    rows = [(1, 0, rng.choice(roles), f"t{i % 50}") for i in range(900)]
    rows += [(2, None, rng.choice(roles), f"t{i}") for i in range(700)]
    rows += [(None, i % 3, rng.choice(roles), "same") for i in range(1_300)]
    rows += [(3, 5_000 * i, rng.choice(roles), "x" * 70 + str(i)) for i in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    # The small size needs several levels of composed chunks.
    for size in (512, 7):
        monkeypatch.setattr(chats, "CHUNK", size)
        got = chats.repair_chats(table).orderBy("conv_id", "chunk", "place").collect()
        for conv in (None, 1, 2, 3):
            own = [r for r in got if r["conv_id"] == conv]
            given = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3]))
            assert [(r["chunk"], r["place"]) for r in own] == [divmod(i, size) for i in range(len(given))]
            assert [r["turn"] for r in own] == [r[1] for r in given]
            total, state = 0.0, "start"
            for r, (_, _, role, text) in zip(own, given):
                total += next(c for c, new, a, p in chats.moves(state, role) if (new, a, p) == (r["role"], r["action"], r["inserted"]))
                assert r["piece"] == chats.piece(r["action"], r["role"], r["inserted"], text)
                state = r["role"]
            assert abs(total - chats.costs([r[2] for r in given])[0].min()) < 1e-6


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "big" if i < 900 else "mid" if i < 990 else "small") for i in range(1_000)]
    rows += [(2_000, None, None), (2_001, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_key", F.lit("clash"))
    tokens = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    total = sum(tokens.values())
    mixed = mixing.mix_sources(docs, repeats=2.0).collect()
    amount = {}
    for r in mixed:
        amount[r["source"]] = amount.get(r["source"], 0) + tokens[r["doc_id"]]
    own = {s: sum(tokens[i] for i, _, x in rows if x == s) for s in ("big", "mid", "small")}
    assert amount["small"] / own["small"] <= 2.0 and amount["small"] >= 1.8 * own["small"]
    assert total - 40 <= sum(amount.values()) <= total
    assert len({(r["doc_id"], r["mix_block"]) for r in mixed}) == len(mixed)
    even = mixing.mixing_plan(docs, None, 1.0, 4.0, 8).filter("weight > 0").collect()
    assert abs(-sum(r["weight"] * np.log(r["weight"]) for r in even) - 1.0) < 1e-3
    assert mixing.mix_sources(docs.filter("false")).count() == 0


def test_mixing_of_rows_without_id(spark):
    rows = [(i, f"w{i} b c d e", "big") for i in range(300)] + [(None, f"n{i} b c d e", "nameless") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_mix_source": F.lit(1), "_": F.lit(2)})
    mixed = mixing.mix_sources(docs, budget=2000.0, repeats=1.0)
    assert mixed.columns == [*docs.columns, "mix_block", "mix_key"]
    plan = {r["source"]: r["weight"] * 2000 for r in mixing.mixing_plan(docs, 2000.0, None, 1.0, 8).collect()}
    for source, n in mixed.groupBy("source").count().collect():
        assert 0 <= plan[source] - 5 * n < 5
    half = mixing.mix_sources(docs, budget=1000.0, repeats=0.5).filter("source = 'nameless'").count()
    assert half == 50
    assert {(r["_mix_source"], r["_"]) for r in mixed.collect()} == {(1, 2)}


def test_near_duplicate_stage_keeps_one_of_equal_rows(spark):
    import corpus_pipeline

    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "a"), (None, text, "b"), (None, "other words", "a"), (None, "other words", "b"), (2, "x", None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, _ int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == [(1, text), (2, "x"), (None, "other words")]


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "q1 q2 q3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "q1 q2 q3", 7), (1, "other", 8), (2, None, 9)], "doc_id long, text string, _key int")
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=repr) == [(1, "other", 8), (2, None, 9)]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "private_data", "mixing"]
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("predicted = 1").collect()}
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            docs = cut_lineage(docs)
        counts.append(docs.count())
        if k == 0:
            assert not toxic & {r["doc_id"] for r in docs.collect()} and counts[1] == counts[0] - len(toxic)
        if k == 3:
            assert not any(private_data.base_spans(r["text"]) for r in docs.collect())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0


def test_contaminated_rows_without_id_are_dropped(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"q{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before {item} after"), (None, "of no interest"), (None, None), (1, item), (2, "also kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert kept == {rows[1], rows[2], rows[4]}


def test_pipeline_writes_each_stage(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def stage(spark, docs, folder):
        seen.append(docs.inputFiles())
        return docs.withColumn("text", F.concat("text", F.lit("b")))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [r["text"] for r in out.collect()] == ["abb"]
    assert "/pipeline-" in seen[1][0] and "/pipeline-" in out.inputFiles()[0]


def test_private_data_candidates():
    def found(text):
        return [(k, text[a:b]) for k, a, b in private_data.candidates(text, private_data.base_spans(text))]

    assert found("reach me at 0171 123 4567") == [(-1, "0171 123 4567")]
    assert found("dial (212) 555-0100, or 1234567.") == [(-1, "(212) 555-0100"), (-1, "1234567")]
    assert found("pay 4111 1111 1111 1112 now") == [(-1, "4111 1111 1111 1112")]  # fails the check sum
    for address in ("anna(at)firma.de", "anna [at] firma [dot] de", "anna at firma dot de", "a.b {AT} c-d.org"):
        assert found(f"please mail {address} today") == [(-2, address)]
    assert found("we met at noon. Then (at) x at") == found("") == found("12 34") == []
    assert private_data._context("me at 212", 6) == "me at" and private_data._context("at 212", 3) == ""
    assert private_data._context("Me" + " " * 300 + "AT" + "-" * 300 + "1", 604) == "me at"
    assert private_data._context("x" * 300 + " at 1", 304) == "x" * 300 + " at"
    long = "1234567 a(at)b.c " * 20_000
    assert len(found(long)) == 40_000


def test_private_data_finds_numbers_with_spaces_and_written_out_addresses(spark):
    rows = [(i, f"some words reach me at +1 (212) 555-01{i:02d} now") for i in range(30)]
    rows += [(i, f"or send mail to user{i}@host{i}.org please") for i in range(30, 60)]
    probes = {
        100: ("me at 212/555/0199 is fine", (3, 6, 18), "me at [PHONE] is fine"),
        101: ("reach me at 0171 123 4567", (3, 12, 25), "reach me at [PHONE]"),
        102: ("and mail to anna(at)firma.de", (0, 12, 28), "and mail to [EMAIL]"),
    }
    rows += [(i, t) for i, (t, _, _) in probes.items()] * 2  # repeated rows
    rows += [(103, "meet me at anna(at)firma.de"), (104, None), (None, "me at 0171 123 4567"), (105, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "added": F.lit(1), "kind": F.lit(2)})
    found, patterns = private_data.private_data(docs)
    assert found.count() == len(rows)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    clean = private_data.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    for i, (_, span, wanted) in probes.items():
        assert spans[i] == [span] and text[i] == wanted
    # An address-like stretch behind a phone pattern is none.
    assert spans[103] == spans[104] == spans[105] == [] and spans[None] == [(3, 6, 19)]
    assert text[104] is None and text[105] == "" and text[None] == "me at [PHONE]"
    assert patterns["mail to"][0] == 0
    with pytest.raises(KeyError):
        patterns["no such"]
