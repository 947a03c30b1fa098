"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import centroids, decontaminate, language, lines, neardup, negatives, packing, passages, quality, sharding, simhash, tokens, urls
from marketloom.llm.common import table

#: Fixed by the contract: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_token_files(manifest)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_dup_words", F.size("spans").cast("long").alias("n_spans"), "spans", "sources")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS t(host, path, verdict)")
    return urls.apply_url_rules(table(spark, sf_dir, "pages"), rules)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, rows.filter("vec_id % 100 = 0").select("vec_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_token_files, op3_decontaminate, op4_line_dedup, op5_substring_dedup,
                                    op6_url_rules, op7_near_duplicates, op8_histogram_shards, op9_language, op10_packing, op11_centroids, op12_simhash, op13_hard_negatives)}


OP4_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, text, i - 1 AS pos, list_transform(ls[i:i + 2], lambda x: trim(x, ' ')) AS c FROM l, unnest(range(1, len(ls) - 1)) AS u(i) WHERE len(ls) >= 3),
r AS (SELECT doc_id, text, pos, rank() OVER (PARTITION BY c ORDER BY doc_id, text, pos) AS rn FROM w WHERE trim(array_to_string(c, ''), ' ') <> ''),
d AS (SELECT DISTINCT doc_id, text, pos + k AS pos FROM r, unnest([0, 1, 2]) AS u(k) WHERE rn > 1),
x AS (SELECT DISTINCT doc_id, text, i - 1 AS pos, ls[i] AS line FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
o AS (SELECT x.doc_id, x.text, count(*) AS n_lines, count(d.pos) AS n_removed,
      string_agg(line, chr(10) ORDER BY x.pos) FILTER (WHERE d.pos IS NULL) AS kept
      FROM x LEFT JOIN d ON x.doc_id = d.doc_id AND x.text = d.text AND x.pos = d.pos GROUP BY x.doc_id, x.text)
SELECT doc_id, CASE WHEN l.text IS NOT NULL THEN coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM l LEFT JOIN o USING (doc_id, text)
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (SELECT page_id, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS rn
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id AND rn = 1
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE ws[i:i + 2] END AS g FROM w, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.b, reach.m FROM reach JOIN t ON t.a = reach.d WHERE reach.m < t.b),
m AS (SELECT d, min(m) AS m FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, m = w.doc_id AS kept FROM w JOIN m ON m.d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


#: What op11's and op13's twins need of the vectors: those that take part, as integers.
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)"


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round as two tables: the nearest centroid of every vector, and the floors of the means."""
    parts = [f"v AS (SELECT vec_id, {_WHOLE} AS q FROM embeddings WHERE {_FINITE} AND len(embedding) = 64)",
             f"c0 AS (SELECT rn - 1 AS c, q FROM (SELECT q, row_number() OVER (ORDER BY sha256('2:' || vec_id), q) AS rn FROM v) WHERE rn <= {k})"]
    near = "SELECT vec_id, v.q, min(struct_pack(d := list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c.c)) AS m FROM v CROSS JOIN c{} c GROUP BY vec_id, v.q"
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        parts.append(f"s{i} AS (SELECT m.c AS c, i, sum(q[i]) AS s, count(*) AS n FROM a{i}, unnest(range(1, 65)) AS u(i) GROUP BY ALL)")
        parts.append(f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{i} GROUP BY c)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)")
    parts.append(f"z AS MATERIALIZED ({near.format(rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(e.q, ',')) AS centroid_sha256 FROM z JOIN c{rounds} e ON e.c = m.c"""


OP13_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op6_url_rules": OP6_SQL, "op7_near_duplicates": OP7_SQL, "op11_centroids": _op11_sql(), "op13_hard_negatives": OP13_SQL}
