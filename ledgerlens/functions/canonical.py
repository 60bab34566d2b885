"""Canonical JSON text, content hashes and name-based identifiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The URL name space of RFC 4122.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"

# Run-dependent fields that never enter a hash.
RUNTIME_FIELDS = ("generated_at", "request_id", "host", "latency", "evidence_hash")

_KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical_json(fields: Mapping[str, Column], drop: tuple[str, ...] = RUNTIME_FIELDS) -> Column:
    """Compact JSON object with keys in sorted order; NULL fields stay as ``null``."""
    kept = [fields[name].alias(name) for name in sorted(fields) if name not in drop]
    return F.to_json(F.struct(*kept), _KEEP_NULLS)


def nested_json(fields: Mapping[str, Column], embedded: Mapping[str, Column]) -> Column:
    """Like ``canonical_json``; ``embedded`` fields already are JSON text and stay objects."""
    parts = []
    for name in sorted({*fields, *embedded}):
        if name in embedded:
            text = F.concat(F.lit(f'"{name}":'), F.coalesce(embedded[name], F.lit("null")))
        else:
            one = F.to_json(F.struct(fields[name].alias(name)), _KEEP_NULLS)
            text = F.substring(one, F.lit(2), F.length(one) - 2)
        parts.append(text)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def name_uuid(text: Column) -> Column:
    """Name-based UUID (version 5) of ``text`` in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(text, "UTF-8")))
    # The variant takes the two high bits of the 17th hex digit.
    variant = F.element_at(
        F.array(*[F.lit(d) for d in "89ab"]),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1,
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
