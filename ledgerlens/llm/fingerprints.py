"""Order MinHash fingerprints of texts, with DataFrame functions only.

A text's words are its k-mers' letters here: a k-mer is ``K`` consecutive words, numbered by
its occurrence within the text, so that repetitions count. Every numbered k-mer has one
hash; its top bits deal it to one of 2^``GROUP_BITS`` groups (one-permutation form). Of
each group the ``TUPLE`` k-mers of least hash are taken, put back in text order, and the
tuple is hashed. Two texts agree on a group only if the same k-mers stand there in the same
order, so likeness falls with edit distance and not only with the shared vocabulary.

Everything inside a row works on sorted arrays of longs: hash bits above position bits. The
cost is linear but for two sorts, and no words leave their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 2
TUPLE = 2
GROUP_BITS = 6
# A string holds less than 2^31 bytes, so at most 2^30 words.
POSITION_BITS = 30
HASH_BITS = 63 - POSITION_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _key(x: Column) -> Column:
    return F.shiftrightunsigned(x, POSITION_BITS)


def _position(x: Column) -> Column:
    return x.bitwiseAND((1 << POSITION_BITS) - 1)


def _placed(hashed: Column, position: Column) -> Column:
    """Top hash bits above the position, never negative."""
    bits = F.shiftrightunsigned(hashed, 64 - HASH_BITS)
    return F.shiftleft(bits, POSITION_BITS).bitwiseOR(position.cast("long"))


def fingerprint(text: Column) -> Column:
    """Array of 2^GROUP_BITS longs; null in groups without k-mers.

    A text with fewer than K words has its whole word sequence as one k-mer; a text
    without words has none.
    """
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))
    shift = POSITION_BITS + HASH_BITS - GROUP_BITS

    def kmers(w: Column) -> Column:
        """Hash and position of every k-mer, sorted."""
        n = F.greatest(F.size(w) - F.lit(K - 1), F.lit(1))
        return F.sort_array(
            F.transform(
                F.slice(w, 1, n), lambda first, i: _placed(F.xxhash64(first, *[F.get(w, i + j) for j in range(1, K)]), i)
            )
        )

    def least(h: Column) -> Column:
        """The first ``TUPLE`` of each group of a sorted array."""
        return F.filter(
            h, lambda x, i: ~F.shiftright(x, shift).eqNullSafe(F.shiftright(F.get(h, i - TUPLE), shift))
        )

    def numbered(s: Column) -> Column:
        """The least of each group, with the occurrence number hashed in from the second occurrence on."""
        fresh = lambda a: lambda x, i: ~_key(x).eqNullSafe(_key(F.get(a, i - 1)))
        again = F.filter(s, lambda x, i: _key(x).eqNullSafe(_key(F.get(s, i - 1))))

        def by_runs(r: Column) -> Column:
            starts = F.filter(F.transform(r, lambda x, i: F.when(fresh(r)(x, i), i).otherwise(-1)), lambda i: i >= 0)

            def renumber(b: Column) -> Column:
                ends = F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(r)))
                runs = F.zip_with(b, ends, lambda a, e: F.slice(r, a + 1, e - a))
                return F.flatten(
                    F.transform(
                        runs, lambda run: F.transform(run, lambda x, j: _placed(F.xxhash64(_key(x), j), _position(x)))
                    )
                )

            return let(F.sort_array(let(starts, renumber)), least)

        first = let(F.filter(s, fresh(s)), least)
        return let(
            again, lambda r: F.when(F.size(r) == 0, first).otherwise(let(F.sort_array(F.concat(first, by_runs(r))), least))
        )

    def tuples(chosen: Column) -> Column:
        def of(group: Column) -> Column:
            own = F.filter(chosen, lambda x: F.shiftright(x, shift) == group)
            ordered = F.transform(F.array_sort(F.transform(own, lambda x: F.struct(_position(x), _key(x).alias("k")))), lambda p: p["k"])
            return let(ordered, lambda o: F.when(F.size(o) > 0, F.xxhash64(o)))

        return F.transform(F.sequence(F.lit(0), F.lit((1 << GROUP_BITS) - 1)), of)

    empty = F.array_repeat(F.lit(None).cast("long"), 1 << GROUP_BITS)
    words = F.split(trimmed, r"[\x00-\x20]+")
    print_ = let(let(let(words, kmers), numbered), tuples)
    return F.when(trimmed == "", empty).otherwise(print_)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal elements among the groups that either text fills; 1 if both are empty."""
    return let(
        F.zip_with(a, b, lambda x, y: F.struct(x.isNotNull() | y.isNotNull(), x == y)),
        lambda z: F.coalesce(
            F.size(F.filter(z, lambda p: p["col2"])) / F.nullif(F.size(F.filter(z, lambda p: p["col1"])), F.lit(0)), F.lit(1.0)
        ),
    )


def as_text(prints: Column) -> Column:
    """The fingerprint as hexadecimal groups."""
    return F.array_join(F.transform(prints, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit("-"))), ".")


def with_next(documents: DataFrame, columns: list[str]) -> DataFrame:
    """``documents`` plus ``next_<c>`` for each of ``columns``: the values of the next row.

    ``documents`` has doc_id and text. Rows follow each other by descending doc_id, rows
    without id last, equal ids by text; after the last row comes the first. The ids are cut
    into ranges of about equal size, and one window runs within each range. The first rows
    of a range are copied to the end of the range before it, so no range needs another.
    """
    spark = documents.sparkSession
    keyed = documents.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = keyed.agg(F.percentile_approx("_key", [i / pieces for i in range(1, pieces)], 10_000)).first()[0]
    cuts = F.lit(sorted(set(bounds or [])))
    part = F.size(F.filter(cuts, lambda b: b <= F.col("_key")))
    # One row per range comes to the driver: its largest id.
    tops = dict(sorted((r["part"], r["top"]) for r in keyed.groupBy(part.alias("part")).agg(F.max("_key").alias("top")).collect()))
    order = list(tops)
    heads = [(tops[p], order[(i + 1) % len(order)]) for i, p in enumerate(order)]
    listed = [F.struct(F.lit(k).cast("long").alias("_key"), F.lit(p).cast("int").alias("_part")) for k, p in heads or [(0, 0)]]
    firsts = spark.range(1).select(F.inline(F.array(*listed)))
    ghosts = keyed.join(F.broadcast(firsts), "_key").withColumn("_ghost", F.lit(True))
    rows = keyed.withColumn("_part", part).withColumn("_ghost", F.lit(False)).unionByName(ghosts)
    within = Window.partitionBy("_part").orderBy("_ghost", F.desc("_key"), "text")
    following = {f"next_{c}": F.lead(c).over(within) for c in columns}
    return rows.withColumns(following).filter("NOT _ghost").drop("_key", "_part", "_ghost")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by as many leading ones
    (or all) of the next document by descending doc_id; after the last comes the first.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (arrays),
    near_edited, near_next. Null texts are empty. Rows of equal doc_id follow each other by
    text; rows without id come last. A single row is its own next document. Other columns
    are ignored.
    """
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = with_next(texts.withColumn("print", fingerprint(F.col("text"))), ["text", "print"])
    half = "cast(floor(char_length(text) / 2) AS int)"
    edited = ordered.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.expr(f"concat(substring(text, 1, char_length(text) - {half}), substring(next_text, 1, {half}))").alias("edited"),
        "print",
        "next_print",
    )
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "print",
        "next_print",
        fingerprint(F.col("edited")).alias("edited_print"),
    ).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
