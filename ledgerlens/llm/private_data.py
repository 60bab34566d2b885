"""Personal data by base patterns and bootstrapped contextual extraction.

1. One pass over the texts finds the base spans, and *candidates*: runs of numbers that may
   hold spaces, other tokens with at least four digits, and address-like stretches such as
   ``name (at) host.org``. Each keeps its context, the two words before it, and a hash of
   its text, the instance.
2. Contexts that stand before at least ``SEEDS`` different seeds of a kind become patterns,
   whatever the size of the corpus. They stay a table.
3. A second pass counts every place where a pattern's words stand, whatever follows: what
   stands before ordinary words is no evidence.
4. Spark scores the graph of patterns and instances for ``ROUNDS`` rounds. A pattern's
   confidence is the confidence of the instances it introduces over all its places; an
   unknown instance's is the noisy-or of its patterns; seeds stay at one.
5. Candidates behind a pattern of confidence ``CONFIDENT`` become spans of its kind; address-like
   ones only behind patterns of addresses. Of two kinds of equal confidence for one context the
   first in ``KINDS`` is taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ledgerlens.llm.bytewords import ALNUM, blocks, grams, text_buffers, words
from ledgerlens.llm.scratch import Scratch
from ledgerlens.llm.slots import has_slot, may_hold, slots_of
from ledgerlens.operators.spread import spread_join

KINDS = ("email", "ip", "card", "phone")
SEEDS = 3
ROUNDS = 3
CONFIDENT = 0.5

# The base patterns. Possessive repeats keep them linear on any text.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CANDIDATE = re.compile(r"(?<!\S)\S*?[0-9]\S*")
NUMERIC = re.compile(r"[0-9()+./-]++")
AT = re.compile(r"[(\[{<](?:at|@)[)\]}>]| at ", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[(\[{<]dot[)\]}>] ?| dot )[A-Za-z0-9-]++)++", re.IGNORECASE)
ANY, ADDRESS = -1, -2  # kinds of candidates
DIGITS = frozenset("0123456789")
RUN_DIGITS = 19
ENDS = ".,;:!?\"'"
BEFORE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
EDGES = "\"'`()[]{}<>,;:.!?#$&*=-"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: for each @ the longest local part that is still free."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            found.append((at - local, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    spans = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append((3, *m.span()))
    return spans


def _context(text: str, start: int) -> str:
    """The two words before a position; empty if there are fewer."""
    width = 64
    while True:
        near = BEFORE.findall(text[max(0, start - width) : start])
        # The first word of a window that begins inside the text may be cut.
        if len(near) > 2 or start <= width:
            return " ".join(w.translate(_LOWER) for w in near[-2:]) if len(near) > 1 else ""
        width *= 2


_LOWER = {i: i + 32 for i in range(65, 91)}


def _instance(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def _addresses(text: str) -> list[tuple[int, int]]:
    """Stretches that read as an address without being one: a local part, an "at", a host with a dot."""
    found, free = [], 0
    for m in AT.finditer(text):
        at, after = m.span()
        if text[at] != " ":
            at -= text[free:at].endswith(" ")
            after += text.startswith(" ", after)
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL))
        host = HOST.match(text, after) if local else None
        if host:
            found.append((at - local, host.end()))
        free = host.end() if host else m.end()
    return found


def _touching(places: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each place meets one of the spans; both in order of their start."""
    out, k, reach = [], 0, 0
    for a, b in places:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        out.append(reach > a)
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of stretches that touch no span: addresses, then runs and tokens with four digits.

    Tokens of digits and ``()+-./`` one space apart are one run, of at most ``RUN_DIGITS`` digits.
    """
    taken = sorted((a, b) for _, a, b in spans)
    places = _addresses(text)
    places = [p for p, met in zip(places, _touching(places, taken)) if not met]
    found = [(ADDRESS, a, b) for a, b in places]
    taken = sorted([*taken, *places])
    tokens = [m.span() for m in CANDIDATE.finditer(text)]
    runs: list[list[int]] = []  # start, end, digits, whether more may follow
    for (a, b), met in zip(tokens, _touching(tokens, taken)):
        token = text[a:b]
        if met:
            # A token may hold a span and more, as "12.34.56.78:8080" does; what is left is no candidate.
            continue
        digits = sum(c in DIGITS for c in token)
        whole = token.rstrip(ENDS)
        numeric = NUMERIC.fullmatch(whole) is not None
        more = numeric and whole == token and token[-1] not in "(+-/"
        last = runs[-1] if runs else None
        if (
            last and numeric and last[3] and last[1] + 1 == a and text[a - 1] == " "
            and token[0] not in "+-./)" and last[2] + digits <= RUN_DIGITS
        ):
            last[1], last[2], last[3] = b, last[2] + digits, more
        else:
            runs.append([a, b, digits, more])
    for a, b, digits, _ in runs:
        stretch = text[a:b]
        a += len(stretch) - len(stretch.lstrip(EDGES))
        b -= len(stretch) - len(stretch.rstrip(EDGES))
        if a > 0 and text[a - 1] == "(" and ")" in text[a:b]:
            a -= 1
        if b - a >= 6 and digits >= 4:
            found.append((ANY, a, b))
    return found


FOUND = (
    "doc_id bigint, key string, base array<struct<kind: int, start: int, end: int>>, "
    "items array<struct<kind: int, start: int, end: int, context: string, instance: bigint>>"
)


def _find(documents: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, items = [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                marked = [*spans, *candidates(text, spans)]
                items.append(
                    [
                        {"kind": k, "start": a, "end": b, "context": c, "instance": _instance(text[a:b])}
                        for k, a, b in marked
                        if (c := _context(text, a))
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(base, schema.field("base").type), pa.array(items, schema.field("items").type)],
                schema=schema,
            )

    span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("key", pa.string()),
            ("base", pa.list_(pa.struct(span))),
            ("items", pa.list_(pa.struct([*span, ("context", pa.string()), ("instance", pa.int64())]))),
        ]
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("key"), "text")
    return texts.mapInArrow(find, FOUND)


@F.pandas_udf(LongType())
def _pair_hash(contexts: pd.Series) -> pd.Series:
    """The hash that ``grams`` gives to the two words of each context."""
    data, offsets = text_buffers(pa.array(contexts, pa.large_string()))
    data = data[offsets[0] : offsets[-1]]
    return pd.Series(grams(words(data, offsets - offsets[0], ALNUM), 2)[0].view(np.int64))


def _places(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, places): in how many places the word pairs of a table stand, without rare others being told apart first."""
    shared = documents.sparkSession.sparkContext.broadcast(slots_of(pairs, "pair"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in blocks(offsets):
                h, _ = grams(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM), 2)
                pair, n = np.unique(h[has_slot(shared.value, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n, pa.int64())], names=["pair", "n"])

    counts = documents.select("text").mapInArrow(count, "pair bigint, n bigint")
    return counts.groupBy("pair").agg(F.sum("n").alias("places"))


@dataclass
class Patterns:
    """The learned patterns, a table (context, kind, confidence); ``[context]`` looks one up."""

    table: DataFrame

    def __getitem__(self, context: str) -> tuple[int, float]:
        row = self.table.filter(F.col("context") == context).first()
        if row is None:
            raise KeyError(context)
        return row["kind"], row["confidence"]


def learn_patterns(found: DataFrame, documents: DataFrame) -> Patterns:
    """The patterns that reach ``CONFIDENT``."""
    scratch = Scratch(documents.sparkSession, "private-data")
    edges = scratch.keep(
        found.select(F.inline("items")).groupBy("context", "instance", "kind").agg(F.count("*").alias("n")), "edges"
    )
    chosen = scratch.keep(
        edges.filter("kind >= 0")
        .groupBy("context", F.col("kind").alias("pattern_kind"))
        .agg(F.count("*").alias("own"))
        .filter(F.col("own") >= SEEDS)
        .select("context", "pattern_kind", _pair_hash("context").alias("pair")),
        "chosen",
    )
    places = _places(documents, chosen)
    patterns = chosen.join(places, "pair", "left").select("context", "pattern_kind", F.coalesce("places", F.lit(0)).alias("places"))
    patterns = scratch.keep(patterns, "patterns")
    # Contexts of many instances are split; a pattern has one row per kind.
    reachable = (F.col("kind") != ADDRESS) | (F.col("pattern_kind") == 0)
    known_contexts = may_hold(patterns, "context")
    graph = scratch.keep(
        spread_join(edges.filter(known_contexts("context")), patterns, ["context"], by=["instance"]).filter(reachable), "graph"
    )
    known = F.when(F.col("kind") == F.col("pattern_kind"), 1.0)
    scored = graph.withColumn("trust", F.coalesce(known, F.lit(0.0)))
    for turn in range(ROUNDS):
        confidence = scratch.keep(
            scored.groupBy("context", "pattern_kind").agg(
                (F.sum(F.col("trust") * F.col("n")) / F.greatest(F.max("places"), F.sum("n"))).alias("confidence")
            ),
            "confidence",
        )
        if turn + 1 < ROUNDS:
            doubt = F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))
            unknown = (
                spread_join(graph.filter("kind < 0"), confidence, ["context", "pattern_kind"], by=["instance"])
                .groupBy("instance", "pattern_kind")
                .agg((1 - F.exp(F.sum(doubt))).alias("belief"))
            )
            scored = spread_join(graph, unknown, ["instance", "pattern_kind"], "left", by=["context"]).withColumn(
                "trust", F.coalesce(known, F.when(F.col("kind") < 0, F.col("belief")), F.lit(0.0))
            )
    rank = F.struct("confidence", -F.col("pattern_kind"))
    best = confidence.filter(F.col("confidence") >= CONFIDENT).groupBy("context").agg(
        F.max_by("pattern_kind", rank).alias("kind"), F.max("confidence").alias("confidence")
    )
    best = scratch.keep(best, "best")
    scratch.drop(edges, chosen, patterns, graph)
    return Patterns(best)


def _added(found: DataFrame, patterns: Patterns) -> DataFrame:
    """(key, added): what the patterns find in each different text, as (kind, start, end)."""
    items = found.select("key", F.inline("items")).filter("kind < 0").withColumnRenamed("kind", "form")
    likely = may_hold(patterns.table, "context")
    items = items.filter(likely("context")).select("key", "context", "form", "start", "end").distinct()
    met = spread_join(items, patterns.table.select("context", "kind"), ["context"], by=["key", "start"])
    span = F.struct("kind", "start", "end")
    return met.filter((F.col("form") != ADDRESS) | (F.col("kind") == 0)).groupBy("key").agg(F.collect_set(span).alias("added"))


def _with_added(rows: DataFrame, added: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with their added spans; only rows that may have some are shuffled, hot texts in pieces."""
    added = added.select(F.col("key").alias(key), F.col("added").alias(name))
    likely = may_hold(added, key)
    fresh = F.coalesce(likely(key), F.lit(False))
    some = spread_join(rows.filter(fresh), added, [key], "left")
    none = rows.filter(~fresh).withColumn(name, F.lit(None).cast(added.schema[name].dataType))
    return some.unionByName(none)


def private_data(documents: DataFrame) -> tuple[DataFrame, Patterns]:
    """(doc_id, base, spans) per row of ``documents``, and the patterns learned.

    ``base`` and ``spans`` are arrays of (kind number, start, end) in code points, by kind
    and start; ``spans`` adds what the patterns find. Null and empty texts have none; other
    columns are ignored; repeated rows and ids give one row each. Equal texts have equal spans.
    """
    found, patterns, added = _extract(documents)
    both = _with_added(found.select("doc_id", "key", "base"), added, "key", "added")
    extra = F.coalesce("added", F.array().cast(found.schema["base"].dataType))
    return both.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans")), patterns


def _extract(documents: DataFrame) -> tuple[DataFrame, Patterns, DataFrame]:
    scratch = Scratch(documents.sparkSession, "private-spans")
    found = scratch.keep(_find(documents), "found")
    patterns = learn_patterns(found, documents)
    return found, patterns, scratch.keep(_added(found, patterns), "added")


@F.udf(StringType(), useArrow=True)
def _clean(text: str, numbers: list[int]) -> str:
    if text is None:
        return None
    spans = base_spans(text)
    if numbers is not None:
        spans += [tuple(numbers[i : i + 3]) for i in range(0, len(numbers), 3)]
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, column: str = "text") -> DataFrame:
    """``documents`` with every span in ``column`` replaced by its kind in brackets; null texts stay null."""
    texts = documents.select(F.lit(None).cast("long").alias("doc_id"), F.col(column).alias("text"))
    _, _, added = _extract(texts)
    key = "_" * (1 + max(map(len, documents.columns)))
    rows = _with_added(documents.withColumn(key, F.md5(column)), added, key, key + "_")
    numbers = F.flatten(F.transform(key + "_", lambda s: F.array(s["kind"], s["start"], s["end"])))
    return rows.withColumn(column, _clean(F.col(column), numbers)).select(*documents.columns)
