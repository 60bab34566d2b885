"""Tokenizer alignment against plain counting."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from ledgerlens.llm import alignment as A
from ledgerlens.llm.token_counts import byte_letters

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """Per text, (id, end) of both sides; none if the bytes are not those of the text."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = byte_letters()

    def ends(ids, parts):
        at, out = 0, []
        for i, part in zip(ids, parts):
            at += len(part)
            out.append((i, at))
        return out

    def encode(text):
        whole = b" " + (text or "").encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        parts_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text or "")
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return [], []
        return ends(ids_a, parts_a), ends(ids_b, parts_b)

    return encode


def expected(rows, encode):
    coded = [(doc_id, *encode(text)) for doc_id, text in rows]
    links = []
    for _, a, b in coded:
        at = defaultdict(list)
        for j, end in b:
            at[end].append(j)
        links.append([(i, j) for i, end in a for j in at[end]])
    count = Counter(pair for own in links for pair in own)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for (doc_id, a, b), own in zip(coded, links):
        common = sorted({e for _, e in a} & {e for _, e in b})
        groups = [
            ",".join(str(i) for i, e in a if low < e <= high) + "|" + ",".join(str(j) for j, e in b if low < e <= high)
            for low, high in zip([0, *common], common)
        ]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(count[p] == most[p[1]] for p in own)
        out.append((doc_id, len(a), len(b), len(groups), len(own), n_best, sum(count[p] for p in own), digest))
    return out


ODD = [
    (None, "no id"), (1, None), (1, ""), (2, " "), (3, "▁ is a piece sign"), (4, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (5, "日本語 рус \U0001f600͸\U00016ec0 ᠎ "), (6, "two  spaces\n\n\ttab\x00 ﬁ é é"),
    (7, "word " * 3_000), (8, "x" * 5_000), (2, "same id"), (9, "a\r\nb"), (9, "a\r\nb"), (10, " 　end "),
]


def test_matches_plain_counting(spark, tokens, monkeypatch):
    monkeypatch.setattr(A, "RUN_RECORDS", 500)
    monkeypatch.setattr(A, "FAN", 3)
    monkeypatch.setattr(A, "BLOCK", 7)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in table if len(r["text"] or "") < 2_000] + ODD
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS row", "2 AS part").repartition(7)
    got = [tuple(r) for r in A.align_tokenizers(df, *FILES).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows, tokens), key=repr)


def test_empty_table_and_texts_without_tokens(spark):
    rows = spark.createDataFrame([], "doc_id bigint, text string")
    assert A.align_tokenizers(rows, *FILES).count() == 0
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, A.align_tokenizers(rows, *FILES).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_both_libraries_split_settled_characters_alike():
    both = A.Encoders(*FILES)
    known = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and A._SETTLED.fullmatch(chr(c))]
    for form in ("a{0}a", "1{0}1", " {0} ", "!{0}!", "{0}{0}"):
        texts = [" " + form.format(c) for c in known]
        slow = [e.ids for e in both.a.encode_batch(texts, add_special_tokens=False)]
        assert slow == [both.quick_a.encode_ordinary(t) for t in texts]


def test_linked_pairs_are_within_the_bound():
    both = A.Encoders(*FILES)
    assert A.pair_bound(both) <= A.BROADCAST_PAIRS
