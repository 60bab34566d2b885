"""Alignment of two tokenizers by external spill counting.

Byte offsets at which a token of A and a token of B both end cut a text into groups, and
the two tokens that end there are linked. How often an id pair is linked in the corpus says
which A id fits a B id best.

1. *Runs.* A task encodes its texts and keeps records (B id, A id, document, links). Whenever
   ``RUN_RECORDS`` are pending it radix-partitions them by the low bits of the B id, sorts each
   partition side-major (B id, then A id, then document) and writes it as one run: zstd blocks
   with the pairs and their counts, and zstd columns with the documents.
2. *Counts.* The pair blocks of the runs of a partition are merged by a k-way heap, ``FAN``
   runs at a time and level by level, until there is one list for each partition. Equal pairs
   arrive together and are summed. In the last merge the end of a B id's stretch gives its
   largest count. Only pairs travel, never their documents, so a frequent id costs no more than
   a rare one.
3. *Contributions.* The runs are read once more where they lie, next to the merged counts of
   their partition, and stream sums per document back.

Tokens that end together are suffixes of each other, so the vocabularies alone bound the number
of different pairs (``pair_bound``, under half a million here), whatever the corpus. That bounds
the merged counts, which are broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm.scratch import Scratch
from ledgerlens.llm.token_counts import PIECES, byte_letters

RADIX_BITS = 5
# Records a task holds before it writes runs; a record takes 24 bytes.
RUN_RECORDS = 1 << 21
FAN = 64
# Pairs in a compressed block.
BLOCK = 1 << 12
# Largest number of different pairs whose counts may be broadcast.
BROADCAST_PAIRS = 1 << 22
# Texts of these characters alone are split alike by both libraries for A (their Unicode tables differ in newer ones).
_SETTLED = re.compile("[\x00-Ƞɐ-ʭΑ-ΡΣ-ωЀ-ҁא-תぁ-ゔァ-ヺ一-龥가-힣 -⁆]*")
_SPACE = "▁"

_RECORDS = np.dtype([("part", "<i8"), ("pair", "<i8"), ("doc", "<i4"), ("links", "<i4")])


class Encoders:
    """Both tokenizers and, per id, the bytes its token stands for."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.a_bytes[i] = word.encode() if word in special else bytes(letters[c] for c in word)
        # The same merges in a faster library.
        self.quick_a = tiktoken.Encoding(
            "a",
            pat_str=PIECES.pattern.removeprefix("(?V1)"),
            mergeable_ranks={self.a_bytes[i]: i for word, i in vocabulary.items() if word not in special},
            special_tokens={},
        )
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else b"" if self.b.is_control(i)
            else self.b.id_to_piece(i).replace(_SPACE, " ").encode()
            for i in range(self.b.vocab_size())
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # The text of an id and the sign after it: in a group, at the end of its A or B side, at the end of all.
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.signed = np.array([f"{i}{sign}" for i in ids for sign in (",", "|", ";", "")], dtype=object)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B per text; no ids where the tokens' bytes are not those of the text."""
        settled = [_SETTLED.fullmatch(t) is not None for t in texts]
        rest = iter(self.a.encode_batch([" " + t for t, quick in zip(texts, settled) if not quick], add_special_tokens=False))
        a = [self.quick_a.encode_ordinary(" " + t) if quick else next(rest).ids for t, quick in zip(texts, settled)]
        b = self.b.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or b"".join(map(self.a_bytes.__getitem__, a[i])) != whole or b"".join(map(self.b_bytes.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, str]:
        """(groups, linked pairs as B id * 2^32 + A id, digest) of one text's ids."""
        a_end, b_end = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        first, after = np.searchsorted(b_end, a_end, "left"), np.searchsorted(b_end, a_end, "right")
        partners = after - first
        # The last token of a group; a token without bytes would end where the one before it does.
        a_closes = (partners > 0) & np.append(a_end[1:] > a_end[:-1], True)
        b_closes = np.zeros(len(b), dtype=bool)
        b_closes[after[a_closes] - 1] = True
        groups = int(a_closes.sum())
        linked = partners.nonzero()[0]
        n = partners[linked]
        left = np.repeat(linked, n)
        right = np.repeat(first[linked] + n - n.cumsum(), n) + np.arange(len(left))
        # Groups of A and of B take turns, so each token's place is known without sorting.
        a_until, b_until = a_closes.nonzero()[0] + 1, np.append(0, b_closes.nonzero()[0] + 1)
        parts = np.empty(len(a) + len(b), dtype=object)
        parts[np.arange(len(a)) + b_until[a_closes.cumsum() - a_closes]] = self.signed[4 * a + a_closes]
        b_sign = 2 * b_closes
        b_sign[-1] = 3
        parts[np.arange(len(b)) + a_until[b_closes.cumsum() - b_closes]] = self.signed[4 * b + b_sign]
        digest = hashlib.sha256("".join(parts.tolist()).encode()).hexdigest()
        return groups, (b[right].astype(np.int64) << 32) | a[left], digest


def pair_bound(encoders: Encoders) -> int:
    """How many id pairs can end together at all: one token is a suffix of the other."""

    def found(tokens: list[bytes], others: list[bytes]) -> int:
        n: dict[bytes, int] = {}
        for x in others:
            n[x] = n.get(x, 0) + 1
        return sum(n.get(x[i:], 0) for x in tokens for i in range(len(x) + 1))

    return found(encoders.a_bytes, encoders.b_bytes) + found(encoders.b_bytes, encoders.a_bytes)


def _packed_pairs(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs and counts in blocks, each (size, pairs, counts), as one zstd frame."""
    parts = []
    for i in range(0, len(pairs), BLOCK):
        block = pairs[i : i + BLOCK]
        parts += [np.array([len(block)], "<i8"), block.astype("<i8"), counts[i : i + BLOCK].astype("<i8")]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def _pair_blocks(frame: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    with zstandard.ZstdDecompressor().stream_reader(frame) as reader:
        while head := reader.read(8):
            n = int(np.frombuffer(head, "<i8")[0])
            yield tuple(np.frombuffer(reader.read(8 * n), "<i8") for _ in range(2))


def _entries(frame: bytes) -> Iterator[tuple[int, int]]:
    for pairs, counts in _pair_blocks(frame):
        yield from zip(pairs.tolist(), counts.tolist())


def merged(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, counts, best) of runs by a k-way heap merge; best: no pair of the same B id has more."""
    pairs, counts, best = [], [], []
    for _, stretch in groupby(heapq.merge(*map(_entries, frames)), key=lambda e: e[0] >> 32):
        start, last = len(pairs), -1
        for pair, n in stretch:
            if pair == last:
                counts[-1] += n
            else:
                pairs.append(pair)
                counts.append(n)
                last = pair
        most = max(counts[start:])
        best += [n == most for n in counts[start:]]
    return np.array(pairs, np.int64), np.array(counts, np.int64), np.array(best, bool)


def _compress(values: np.ndarray, kind: str) -> bytes:
    """A column with its bytes grouped by significance."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _restore(frame: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_RUN = "part int, run bigint, rows binary, pairs binary, holders binary, docs binary, links binary"
_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_RUN_FIELDS = [("part", pa.int32()), ("run", pa.int64()), *((c, pa.binary()) for c in ("rows", "pairs", "holders", "docs", "links"))]
_DOC_FIELDS = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]
_SCHEMA = pa.schema([("row", pa.int64()), *_DOC_FIELDS, *_RUN_FIELDS])


class _Pending:
    """Records of a task that are not yet in a run."""

    def __init__(self):
        self.records: list[np.ndarray] = []
        self.rows: list[int] = []
        self.n = self.runs = 0

    def add(self, row: int, pairs: np.ndarray) -> None:
        unique, links = np.unique(pairs, return_counts=True)
        record = np.empty(len(unique), _RECORDS)
        record["part"] = (unique >> 32) & ((1 << RADIX_BITS) - 1)
        record["pair"], record["doc"], record["links"] = unique, len(self.rows), links
        self.rows.append(row)
        self.records.append(record)
        self.n += len(record)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        every = np.concatenate(self.records)
        rows = np.array(self.rows, np.int64)
        order = np.lexsort((every["doc"], every["pair"], every["part"]))
        every = every[order]
        run = (TaskContext.get().partitionId() << 24) + self.runs
        cuts = np.searchsorted(every["part"], np.arange((1 << RADIX_BITS) + 1))
        for part in np.flatnonzero(np.diff(cuts)):
            own = every[cuts[part] : cuts[part + 1]]
            starts = np.flatnonzero(np.append(True, own["pair"][1:] != own["pair"][:-1]))
            # Documents are numbered anew within the run, and ascend within a pair.
            held, docs = np.unique(own["doc"], return_inverse=True)
            packed = [
                _compress(rows[held], "<i8"),
                _packed_pairs(own["pair"][starts], np.add.reduceat(own["links"].astype(np.int64), starts)),
                _compress(np.diff(np.append(starts, len(own))), "<i4"),
                _compress(docs, "<i4"),
                _compress(own["links"], "<i4"),
            ]
            values = [None] * (1 + len(_DOC_FIELDS)) + [int(part), run, *packed]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SCHEMA)], schema=_SCHEMA)
        self.records, self.rows, self.n, self.runs = [], [], 0, self.runs + 1


def spill(documents: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """Rows of documents (``row`` set) with their own figures, and runs (``part`` set)."""
    kept: dict[str, Encoders] = {}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = kept.setdefault("", Encoders(byte_bpe, pieces)) if not kept else kept[""]
        pending = _Pending()
        for batch in batches:
            rows = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(2).to_pylist()]
            figures = []
            for start in range(0, len(texts), 64):
                for row, a, b in zip(rows[start : start + 64], *both.encode(texts[start : start + 64])):
                    if not a:
                        figures.append((0, 0, 0, 0, ""))
                        continue
                    groups, pairs, digest = both.align(np.array(a), np.array(b))
                    figures.append((len(a), len(b), groups, len(pairs), digest))
                    pending.add(row, pairs)
                    if pending.n >= RUN_RECORDS:
                        yield from pending.flush()
            columns = list(zip(*figures)) if figures else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *[pa.array(c, f.type) for c, f in zip(columns, [*_SCHEMA][2:7])],
                    *[pa.nulls(batch.num_rows, kind) for _, kind in _RUN_FIELDS],
                ],
                schema=_SCHEMA,
            )
        yield from pending.flush()

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return numbered.mapInArrow(encode, f"row bigint, {_DOC}, {_RUN}")


def merge_counts(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, pairs, counts, best) with one row per radix partition, in zstd frames."""
    level = runs.select("part", "run", "pairs")
    final = False
    while not final:
        most = level.groupBy("part").count().agg(F.max("count")).first()[0] or 0
        final = most <= FAN
        pieces = F.lit(-(-most // FAN) if most else 1)
        dealt = level.withColumn("piece", F.pmod(F.xxhash64("run"), pieces).cast("int"))

        def merge(batches: Iterator[pa.RecordBatch], last: bool = final) -> Iterator[pa.RecordBatch]:
            def settle():
                pairs, counts, best = merged(frames)
                packed = [_compress(pairs, "<i8"), _compress(counts, "<i8"), _compress(best, "u1")] if last else [_packed_pairs(pairs, counts), None, None]
                return pa.RecordBatch.from_arrays(
                    [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]],
                    names=["part", "run", "pairs", "counts", "best"],
                )

            now, frames = None, []
            for batch in batches:
                for part, piece, frame in zip(*[c.to_pylist() for c in batch.columns]):
                    if (part, piece) != now:
                        if frames:
                            yield settle()
                        now, frames = (part, piece), []
                    frames.append(frame)
            if frames:
                yield settle()

        level = scratch.keep(
            dealt.repartition("part", "piece")
            .sortWithinPartitions("part", "piece", "run")
            .select("part", "piece", "pairs")
            .mapInArrow(merge, "part int, run bigint, pairs binary, counts binary, best binary"),
            "merged",
        )
    return level.select("part", F.col("pairs").alias("all_pairs"), "counts", "best")


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) in parts, from every run and the counts of its partition."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, count, best = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part, rows, frame, holders, docs, links, *whole = [c[i].as_py() for c in batch.columns]
                if part != now:
                    now = part
                    pairs, count, best = (_restore(x, kind) for x, kind in zip(whole, ("<i8", "<i8", "u1")))
                own = np.concatenate([p for p, _ in _pair_blocks(frame)])
                at = np.repeat(np.searchsorted(pairs, own), _restore(holders, "<i4"))
                n = _restore(links, "<i4").astype(np.int64)
                docs = _restore(docs, "<i4")
                order = np.argsort(docs, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(docs[order]) > 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_restore(rows, "<i8")),
                        pa.array(np.add.reduceat((n * best[at])[order], starts)),
                        pa.array(np.add.reduceat((n * count[at])[order], starts)),
                    ],
                    names=["row", "n_best", "count_sum"],
                )

    return (
        runs.join(F.broadcast(counts), "part")
        .select("part", "rows", "pairs", "holders", "docs", "links", "all_pairs", "counts", "best")
        .mapInArrow(give, "row bigint, n_best bigint, count_sum bigint")
    )


def align_tokenizers(documents: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``documents``.

    A is a byte-level BPE file of ``tokenizers`` and sees the text after a space, B a
    ``sentencepiece`` model that adds the space itself. Null and empty texts, and texts that
    either of them does not give back byte by byte, have no tokens: zeros and an empty digest.
    ``n_best`` counts the links of a document whose pair is among the most frequent of its B
    id, ``count_sum`` adds up the corpus-wide counts of its links. Each row is a document of
    its own, also where doc_id repeats or is null. An empty table gives an empty result.
    Other columns are ignored.
    """
    bound = pair_bound(Encoders(byte_bpe, pieces))
    if bound > BROADCAST_PAIRS:
        raise ValueError(f"{bound} pairs can be linked; counts of more than {BROADCAST_PAIRS} are not broadcast")
    scratch = Scratch(documents.sparkSession, "alignment")
    spilled = scratch.keep(spill(documents, byte_bpe, pieces), "spilled")
    runs = spilled.filter("part IS NOT NULL").select(*[name for name, _ in _RUN_FIELDS])
    given = contributions(runs, merge_counts(runs, scratch))
    sums = given.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = spilled.filter("row IS NOT NULL").select("row", *[name for name, _ in _DOC_FIELDS])
    return own.join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )
