"""Token counts of a byte-level BPE vocabulary by compiled finite-state transducers.

*Inside a pre-token.* A sequence of tokens is what the merges give for its string exactly
if it does so for every two neighbours. So the merges' answer for each prefix of a
pre-token has one last token, and its count is one more than that of the prefix before
that token. ``Transducer`` compiles this on demand into a deterministic machine over bytes.
A state stands for the open partial tokens (trie nodes), each with the last token before it
and its count relative to the present one; nothing else of the past matters. Each
transition carries the change of the count. A pre-token's count is the sum along its path.

*Across a text.* A text is cut into chunks at any place. A chunk's map is (head, count,
tail): the characters before its first and after its last certain cut, and the tokens in
between; a chunk without a certain cut is a head alone. A cut is certain between a
non-space character and white space that follows it, whatever stood before. Maps compose
associatively, so they are combined pairwise in a parallel prefix scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# White space in the sense of the vocabulary's pre-tokenizer.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"




def pieces_pattern(not_yet: str = "") -> regex.Pattern:
    """Pre-tokens, with the characters of the class ``not_yet`` taken as neither letters nor numbers."""
    less, other = (f"--{not_yet}", f"|{not_yet}") if not_yet else ("", "")
    # Fixed value: the vocabulary's pattern.
    return regex.compile(
        rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}{less}]+| ?[\p{{N}}{less}]+| ?(?:[^{SPACE}\p{{L}}\p{{N}}]{other})+"
        rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


def newer_characters(vocabulary: str) -> frozenset[str]:
    """Letters and numbers of this pattern library that the vocabulary's own one does not know yet."""
    split = Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    new = set()
    for kind, like in (("L", "a"), ("N", "1")):
        found = regex.findall(rf"\p{{{kind}}}", every)
        # One piece per pair if both are of a kind, else two.
        ends = {end for _, (_, end) in split("\n".join(like + c for c in found))}
        new |= {c for i, c in enumerate(found) if 3 * i + 1 in ends}
    return frozenset(new)


PIECES = pieces_pattern()
CUT = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
CHUNK = 1 << 16
# Pre-tokens whose counts a worker remembers, and states it keeps compiled; beyond, it starts anew.
REMEMBERED = 1 << 18
COMPILED = 1 << 17


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """A deterministic machine over the bytes of a pre-token whose transitions carry token counts."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"] for t in spec["added_tokens"]}
        encode = lambda word: bytes(letters[c] for c in word)
        self.tokens = [encode(w) for w in spec["model"]["vocab"] if w not in self.special]
        number = {t: i for i, t in enumerate(self.tokens)}
        #: Rank, left and right part of the merge that makes a token; single bytes have none.
        self.made: dict[int, tuple[int, int, int]] = {}
        #: Rank and product of the merge of two tokens.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = number[encode(left)], number[encode(right)]
            product = number[self.tokens[a] + self.tokens[b]]
            self.merge[a, b] = (rank, product)
            self.made.setdefault(product, (rank, a, b))
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for i, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                if byte not in self.child[node]:
                    self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = self.child[node][byte]
            self.token_at[node] = i
        self._fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.states = {start: 0}
        self.open = [start]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def fits(self, left: int, right: int) -> bool:
        """Do the merges give exactly these two tokens for their joint string?"""
        if left < 0:
            return True
        key = (left, right)
        if key not in self._fits:
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            self._fits[key] = self._apply(self.tokens[left] + self.tokens[right]) == [left, right]
        return self._fits[key]

    def _apply(self, text: bytes) -> list[int]:
        """The merges applied to a short string."""
        single = self.child[0]
        parts = [self.token_at[single[b]] for b in text]
        while len(parts) > 1:
            options = [(self.merge.get((a, b), (1 << 60, -1)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            (rank, product), at = min(options)
            if product < 0:
                break
            parts[at : at + 2] = [product]
        return parts

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count) for one byte; compiled at its first use.

        ``open`` holds (trie node, last token before it, count there relative to now).
        """
        known = self.moves[state].get(byte)
        if known is not None:
            return known
        partial, ends = [], []
        for node, last, count in self.open[state]:
            at = self.child[node].get(byte)
            if at is None:
                continue
            partial.append((at, last, count))
            token = self.token_at[at]
            if token >= 0 and self.fits(last, token):
                ends.append((token, count + 1))
        token, change = ends[0]
        longer = [(node, last, count - change) for node, last, count in partial if self.child[node]]
        target = (*longer, (0, token, 0))
        if target not in self.states:
            self.states[target] = len(self.open)
            self.open.append(target)
            self.moves.append({})
        move = (self.states[target], change)
        self.moves[state][byte] = move
        return move

    def count(self, text: bytes) -> int:
        if len(self.open) > COMPILED:
            self._reset()
        state = total = 0
        for byte in text:
            state, change = self.step(state, byte)
            total += change
        return total


class Counter:
    """Token counts of whole texts."""

    def __init__(self, vocabulary: str):
        self.machine = Transducer(vocabulary)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.machine.special)))) if self.machine.special else None
        self.seen: dict[str, int] = {}
        self.newer = newer_characters(vocabulary)
        less = regex.escape("".join(sorted(self.newer)), special_only=True)
        self.exact = pieces_pattern(f"[{less}]") if self.newer else PIECES

    def pieces(self, text: str) -> int:
        """Tokens of a text that starts and ends at a cut."""
        seen, total = self.seen, 0
        plain = text.isascii() or self.newer.isdisjoint(text)
        for piece in (PIECES if plain else self.exact).findall(text):
            n = seen.get(piece)
            if n is None:
                n = self.machine.count(piece.encode())
                if len(piece) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = n
            total += n
        return total

    def chunk(self, text: str) -> tuple[str, int, str | None]:
        """The map of one chunk; without a certain cut it is a head alone."""
        first = CUT.search(text)
        if first is None:
            return text, 0, None
        # The last cut is found from the end: a cut before it is as good, only the tail gets longer.
        at = len(text)
        while True:
            low = max(first.start(), at - 256)
            last = None
            for last in CUT.finditer(text, low, len(text)):
                pass
            if last is not None:
                break
            at = low
        return text[: first.start()], self.pieces(text[first.start() : last.start()]), text[last.start() :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        (head, n, tail), (head_b, m, tail_b) = a, b
        if tail is None and tail_b is None:
            return self.chunk(head + head_b) if self._meets(head, head_b) else (head + head_b, 0, None)
        if tail is None:
            joint = head + head_b
            if not self._meets(head, head_b):
                return joint, m, tail_b
            return head, m + self.pieces(head_b), tail_b
        if tail_b is None:
            if not self._meets(tail, head_b):
                return head, n, tail + head_b
            return head, n + self.pieces(tail), head_b
        return head, n + m + self.pieces(tail + head_b), tail_b

    def _meets(self, left: str, right: str) -> bool:
        """Is there a certain cut just between the two?"""
        return bool(left and right and CUT.search(left[-1] + right[0]))

    def segment(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.pieces(text)
        maps = [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.pieces(head) + n + (self.pieces(tail) if tail else 0)

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string inside it is one token."""
        if self.special is None or not self.special.search(text):
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


_counters: dict[str, Counter] = {}


def counter_of(vocabulary: str) -> Counter:
    """The worker's own machine, compiled once and reused by its later tasks."""
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row of ``documents``.

    ``vocabulary`` is the path of a byte-level BPE file that every machine can read. Null
    and empty texts have no tokens; repeated rows and ids give one row each; other columns
    are ignored. Each worker compiles its own machine; what it remembers is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([counter.count(t) for t in texts], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        count, "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )
