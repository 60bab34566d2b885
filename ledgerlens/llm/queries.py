"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ledgerlens.llm import (
    alignment,
    chats,
    decontamination,
    fingerprints,
    lexical_search,
    licenses,
    mixing,
    near_duplicates,
    private_data,
    repeated_windows,
    token_counts,
    toxicity,
    vector_links,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def _listed(spans: str):
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in private_data.KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _of_kind(number: int):
    return lambda span: span["kind"] == number


def op1_private_data(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = private_data.private_data(_table(spark, folder, "documents"))
    counts = [
        F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{kind}")
        for i, kind in enumerate(private_data.KINDS)
    ]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"))


def op3_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    prints = fingerprints.edited_fingerprints(_table(spark, folder, "documents"))
    return prints.withColumns(
        {c: fingerprints.as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")}
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chats.repair_chats(_table(spark, folder, "conversations"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op7_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    rest = repeated_windows.remove_repeats(_table(spark, folder, "documents"))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "mix_block", "mix_key")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts.token_counts(_table(spark, folder, "documents"), vocabulary)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links.vector_links(_table(spark, folder, "embeddings"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokenizers(
        _table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


LETTERS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LETTERS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op10_decontamination"] = rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

SQL["op2_near_duplicates"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LETTERS}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(m.low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

SQL["op11_vector_links"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(vec_id, other) AS (SELECT a, b FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT vec_id, min(other) AS low FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(m.low, e.vec_id) AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.vec_id = e.vec_id"""

TERMS = rf"coalesce(regexp_extract_all({LETTERS}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

SQL["op13_lexical_search"] = rf"""
WITH d AS (SELECT doc_id, {TERMS} AS t FROM documents),
c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

for _name, _fn in list(globals().items()):
    if _name.startswith("op") and callable(_fn):
        QUERIES[_name] = _fn
