"""The queries over the corpus tables: one thin query for each operator, which
derives the columns asked for from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import byte_bpe, decontaminate, html_extract, knn_join, line_dedup, lm_score, ngram_join, quality, substring_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, _read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), window=35)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
q AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM p),
d AS (SELECT r, i FROM q WHERE k IN (SELECT k FROM q GROUP BY k HAVING count(*) > 1)),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM d),
u AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM u ANTI JOIN c USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(_read(spark, sf_dir, "documents"), min_run=2)
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# Runs of 1, 2, 3, ... lines that stand more than once, by adding a line at a time; of
# all runs from one line on, the longest later copy and the longest first one count.
OP3_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS r, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS ls
  FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
l AS MATERIALIZED (SELECT doc_id, r, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS j FROM d),
w AS (SELECT r, j, 1 AS n, md5(x) AS k FROM l QUALIFY count(*) OVER (PARTITION BY md5(x)) > 1
  UNION ALL
  SELECT r, j, n, k FROM (SELECT w.r, w.j, w.n + 1 AS n, md5(w.k || l.x) AS k FROM w JOIN l ON l.r = w.r AND l.j = w.j + w.n) QUALIFY count(*) OVER (PARTITION BY k) > 1),
q AS (SELECT r, j, n, row_number() OVER (PARTITION BY n, k ORDER BY doc_id NULLS FIRST, r, j) = 1 AS first FROM w JOIN d USING (r) WHERE n >= 2),
m AS MATERIALIZED (SELECT r, j, first, max(n) AS n FROM q GROUP BY r, j, first),
g AS (SELECT r, unnest(range(j, j + n)) AS j FROM m WHERE NOT first EXCEPT SELECT r, unnest(range(j, j + n)) AS j FROM m WHERE first),
k AS (SELECT r, count(*) AS n, string_agg(x, chr(10) ORDER BY j) AS t FROM l ANTI JOIN g USING (r, j) GROUP BY r)
SELECT o.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents o JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND coalesce(o.text, '') = d.text LEFT JOIN k USING (r)
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_duplicates(_read(spark, sf_dir, "documents"), n=5, threshold=0.8)
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, array_to_string(ws[s:s + 4], ' ') AS t FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY t)) AS k FROM g GROUP BY r),
c AS (SELECT k, min(r) AS r, count(*) AS copies, any_value(n) AS n FROM n GROUP BY k),
h AS MATERIALIZED (SELECT r, t FROM g WHERE r IN (SELECT r FROM c)),
o AS MATERIALIZED (SELECT a.r AS x, b.r AS y, count(*) AS i FROM h a JOIN h b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
p AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE i >= 0.8 * (a.n + b.n - i)),
e AS MATERIALIZED (SELECT x, y FROM p UNION SELECT y, x FROM p),
z AS (SELECT r AS x, r AS y FROM c UNION SELECT z.x, e.y FROM z JOIN e ON z.y = e.x),
m AS MATERIALIZED (SELECT x, min(y) AS y FROM z GROUP BY x),
l AS (SELECT x, sum(copies) AS links FROM e JOIN c ON c.r = e.y GROUP BY x),
d AS (SELECT n.r, m.y, copies, coalesce(links, 0) + copies - 1 AS links FROM n JOIN c USING (k) JOIN m ON m.x = c.r LEFT JOIN l ON l.x = c.r),
s AS (SELECT y, min(doc_id) AS class_id FROM d JOIN w USING (r) GROUP BY y)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN d USING (r) LEFT JOIN s USING (y)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "log_weight", "gumbel_key", "kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)
    hit, ids = decontaminate.n_hit(), F.array_sort(F.filter("item_ids", lambda x: x.isNotNull()))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, row_number() OVER () AS b, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, b, least(len(ws), 10) AS n, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS s FROM b WHERE len(ws) > 0),
k AS (SELECT DISTINCT item_id, b, n, array_to_string(ws[s:s + n - 1], ' ') AS t FROM i),
n AS (SELECT DISTINCT n FROM k),
p AS (SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS t FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, n WHERE len(ws) >= n)),
h AS (SELECT r, s, p.n, item_id, b FROM p JOIN k ON p.n = k.n AND p.t = k.t),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS j FROM h) GROUP BY r),
d AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id, b FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN d USING (r)
"""


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(_read(spark, sf_dir, "embeddings"), k=10, query_modulus=100).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm_score": op7_lm_score,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_knn_join": op9_knn_join,
    "op10_html_extract": op10_html_extract,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_ngram_join": OP4_SQL,
    "op6_decontaminate": OP6_SQL,
    "op9_knn_join": OP9_SQL,
}
