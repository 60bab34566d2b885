"""Licence scan with a positional index of rare licence words.

1. One pass over the texts finds the words of the licence vocabulary with their positions,
   and the places of whole phrases.
2. The document frequency of each licence word, counted over all documents, gives its IDF.
3. Each template is looked up by its highest-IDF words, as few as hold more than
   1 - ``SHARE`` of its weight: what lacks them all cannot reach the share. An occurrence at
   word p of a word at offset o stands for the template starting at p - o. At the starts so
   found (within ``SLACK`` words) the postings of all indexed words are intersected by
   relative position. A template's share is the IDF weight of its words that agree on one
   start (within ``SLACK`` words), over all its weight.
4. A template with a share of ``SHARE`` is reported if one of its mandatory phrases stands
   where the agreed start puts the template.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bytewords import ALNUM, blocks, text_buffers, word_hash, words
from ledgerlens.llm.scratch import Scratch

SLACK = 3
SHARE = 0.5

# The phrases every scan reports, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Sentences of well-known licences and the phrases that must stand in them.
TEMPLATES = {
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted",),
    ),
    "apache-2-text": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at",
        ("in compliance with the license",),
    ),
    "gpl-2": (
        "licensed under the gnu general public license version 2",
        ("gnu general public license version 2",),
    ),
    "gpl-3": (
        "licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("terms of the gnu general public license",),
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license",
        ("gnu lesser general public license",),
    ),
    "agpl": (
        "licensed under the gnu affero general public license",
        ("gnu affero general public license",),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2", "mozilla public license version 2"),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
        ("distribute this software for any purpose",),
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software",
        ("in no event will the authors be held liable",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
    "cc-by": (
        "licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4", "cc by 4"),
    ),
    "cc-by-sa": (
        "licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike", "cc by sa"),
    ),
}

# Words of any prose: they take part in phrases, never in the index.
COMMON = frozenset(
    "a an and any are as at be by can copy for form free in is it may not of or other person that the this to use with "
    "you will no from".split()
)

_PHRASES = [*BASE_PHRASES, *sorted({p for _, must in TEMPLATES.values() for p in must})]
_PHRASE_NO = {p: i for i, p in enumerate(_PHRASES)}
_VOCABULARY = sorted({w for t, _ in TEMPLATES.values() for w in t.split()} | {w for p in _PHRASES for w in p.split()})
_WORD_NO = {w: i for i, w in enumerate(_VOCABULARY)}
_INDEXED = np.array([w not in COMMON for w in _VOCABULARY])

SCAN_SCHEMA = (
    "row bigint, doc_id bigint, n_words bigint, places array<bigint>, found array<smallint>, "
    "phrase_places array<bigint>, phrases array<smallint>"
)


def _lists(values: np.ndarray, doc: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list per document; ``doc`` is ascending."""
    ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _scan(documents: DataFrame) -> DataFrame:
    """Per row: its words, the indexed licence words and the phrases with their positions."""
    known = np.array([word_hash(w) for w in _VOCABULARY], dtype=np.uint64)
    order = np.argsort(known)
    table = known[order]
    # Most words of a text are ruled out by 16 bits of their hash.
    gate = np.zeros(1 << 16, dtype=bool)
    gate[(known >> np.uint64(48)).astype(np.int64)] = True
    phrases = [np.array([_WORD_NO[w] for w in p.split()]) for p in _PHRASES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            n = batch.num_rows
            counts = np.zeros(n, dtype=np.int64)
            hits: list[tuple] = []
            seen: list[tuple] = []
            for i, j in blocks(offsets):
                w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                counts[i:j] = np.diff(w.first)
                maybe = np.flatnonzero(gate[(w.hash >> np.uint64(48)).astype(np.int64)])
                near = np.minimum(np.searchsorted(table, w.hash[maybe]), len(table) - 1)
                sure = table[near] == w.hash[maybe]
                pos, word = maybe[sure], order[near[sure]]
                doc = np.searchsorted(w.first, pos, "right") - 1
                place = pos - w.first[doc]
                listed = _INDEXED[word]
                hits.append((doc[listed] + i, place[listed], word[listed]))
                for number, phrase in enumerate(phrases):
                    # Positions in ``pos`` of a phrase's words follow each other without a gap.
                    m = len(pos) - len(phrase) + 1
                    if m <= 0:
                        continue
                    at = np.flatnonzero(word[:m] == phrase[0])
                    for step in range(1, len(phrase)):
                        at = at[(word[at + step] == phrase[step]) & (pos[at + step] == pos[at] + step)]
                    at = at[doc[at + len(phrase) - 1] == doc[at]]
                    seen.append((doc[at] + i, place[at], np.full(len(at), number)))
            hit_doc, places, found = (np.concatenate([h[c] for h in hits] or [np.zeros(0, int)]) for c in range(3))
            doc, where, which = (np.concatenate([s[c] for s in seen] or [np.zeros(0, int)]) for c in range(3))
            by = np.lexsort((which, where, doc))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts),
                    _lists(places, hit_doc, n, pa.int64()),
                    _lists(found.astype(np.int16), hit_doc, n, pa.int16()),
                    _lists(where[by], doc[by], n, pa.int64()),
                    _lists(which[by].astype(np.int16), doc[by], n, pa.int16()),
                ],
                names=["row", "doc_id", "n_words", "places", "found", "phrase_places", "phrases"],
            )

    return documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text"
    ).mapInArrow(scan, SCAN_SCHEMA)


def word_idf(scanned: DataFrame) -> dict[str, float]:
    """IDF of every indexed licence word over all documents; at most one row per licence word."""
    counts = scanned.select(F.explode(F.array_distinct("found")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}
    total = scanned.count()
    return {w: log((total + 1) / (seen.get(i, 0) + 1)) + 0.01 for i, w in enumerate(_VOCABULARY) if _INDEXED[i]}


def template_index(
    idf: dict[str, float],
) -> tuple[dict[int, list[tuple[str, int]]], dict[str, float], dict[str, set[int]]]:
    """(postings by word, whole weight by template, offsets of its rarest words) over the indexed words."""
    postings: dict[int, list[tuple[str, int]]] = defaultdict(list)
    weight: dict[str, float] = defaultdict(float)
    for name, (text, _) in TEMPLATES.items():
        for offset, word in enumerate(text.split()):
            if word in idf:
                postings[_WORD_NO[word]].append((name, offset))
                weight[name] += idf[word]
    rare: dict[str, set[int]] = {}
    for name, (text, _) in TEMPLATES.items():
        listed = sorted((-idf[w], o) for o, w in enumerate(text.split()) if w in idf)
        rare[name], left = set(), weight[name]
        for value, offset in listed:
            # A little less than SHARE, so that rounding loses no start.
            if left < (SHARE - 1e-9) * weight[name]:
                break
            rare[name].add(offset)
            left += value
    return dict(postings), dict(weight), rare


def match(
    places: np.ndarray, found: np.ndarray, phrase_places: list[int], phrases: list[int], idf: dict[str, float], index
) -> list[tuple[str, int, float]]:
    """(template, start, share) of the verified templates of one document."""
    postings, weight, rare = index
    weight_of = {_WORD_NO[w]: v for w, v in idf.items()}
    stands = defaultdict(list)
    for place, number in zip(phrase_places, phrases):
        stands[number].append(place)
    # Without one of its phrases a template is never reported.
    phrased = {
        name: sorted({place for p in must for place in stands.get(_PHRASE_NO[p], ())}) for name, (_, must) in TEMPLATES.items()
    }
    votes: dict[str, dict[int, dict[int, float]]] = defaultdict(lambda: defaultdict(dict))
    for place, word in zip(places.tolist(), found.tolist()):
        for name, offset in postings.get(word, ()):
            if phrased[name]:
                votes[name][place - offset][offset] = weight_of[word]
    result = []
    for name, starts in votes.items():
        size = len(TEMPLATES[name][0].split())
        best = (0.0, 0)
        near_rare = {
            near
            for start, own in starts.items()
            if not rare[name].isdisjoint(own)
            for near in range(start - SLACK, start + SLACK + 1)
        }
        for start in sorted(near_rare & starts.keys()):
            at = bisect_left(phrased[name], start - SLACK)
            if at == len(phrased[name]) or phrased[name][at] > start + size + SLACK:
                continue
            together: dict[int, float] = {}
            for near in range(start - SLACK, start + SLACK + 1):
                together.update(starts.get(near, {}))
            share = min(1.0, sum(together.values()) / weight[name])
            if share >= SHARE and (share > best[0] + 1e-12 or (share > best[0] - 1e-12 and start < best[1])):
                best = (share, start)
        if best[0] > 0:
            result.append((name, best[1], best[0]))
    return sorted(result)


def license_scan(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: base phrases, licence labels and a score.

    Columns: doc_id, n_words, n_base (all places of base phrases), first_word and last_word
    (smallest and largest start of one, else null), base_labels and labels (distinct,
    sorted arrays; labels also holds the verified templates), score (1 with a base phrase,
    else the best share of a verified template, else 0). Null and empty texts have no
    words; repeated rows and ids give one row each; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "licenses")
    scanned = scratch.keep(_scan(documents), "scan")
    idf = word_idf(scanned)
    index = template_index(idf)
    labels_of = dict(enumerate(BASE_PHRASES.values()))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            where, which = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            for d in range(batch.num_rows):
                base = [(p, labels_of[n]) for p, n in zip(where[d], which[d]) if n in labels_of]
                found = []
                if which[d]:
                    found = match(
                        batch.column(3)[d].values.to_numpy(),
                        batch.column(4)[d].values.to_numpy(),
                        where[d],
                        which[d],
                        idf,
                        index,
                    )
                plain = {name for _, name in base}
                rows["n_base"].append(len(base))
                rows["first_word"].append(min((p for p, _ in base), default=None))
                rows["last_word"].append(max((p for p, _ in base), default=None))
                rows["base_labels"].append(sorted(plain))
                rows["labels"].append(sorted(plain | {name for name, _, _ in found}))
                rows["score"].append(1.0 if base else max((s for _, _, s in found), default=0.0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    pa.array(rows["n_base"], pa.int64()),
                    pa.array(rows["first_word"], pa.int64()),
                    pa.array(rows["last_word"], pa.int64()),
                    pa.array(rows["base_labels"], pa.list_(pa.string())),
                    pa.array(rows["labels"], pa.list_(pa.string())),
                    pa.array(rows["score"], pa.float64()),
                ],
                names=["doc_id", "n_words", *rows],
            )

    return scanned.mapInArrow(
        label,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels array<string>, labels array<string>, score double",
    )
