"""Queries of this subpackage with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontam, exact_dedup, lang_id, lm, near_dedup, packing, token_counts, token_files, toxicity, url_filter
from rivulet.llm.common import id_bucket, read_table, shared_dir
from rivulet.llm.encoders import default_path


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read_table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 5) != 1)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"))
    return lang_id.identify(docs, docs.where("not held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"))
    labels = read_table(spark, sf_dir, "labels").where(id_bucket(F.col("doc_id"), 3) != 1)
    return toxicity.score_toxicity(docs, labels, docs.where("not held_out")).select("doc_id", "held_out", "score", "predicted")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), 2048, 0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, default_path("byte_bpe_50k.json"), 2)
    return token_files.read_token_files(spark, path)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: (verdict, host, path) of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.path_rule(*r) for r in RULES]
    return url_filter.judge(read_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


_OP8_SQL = r"""
WITH rules(rule, verdict, host, path) AS (VALUES
  ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'),
  ('net/de/', 'block', 'net', '/de/'), ('example.net/de/8', 'block', 'example.net', '/de/8'),
  ('org/es/', 'block', 'org', '/es/')),
parts AS (SELECT *, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages),
sites AS (SELECT page_id, row_number() OVER () AS r,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p FROM parts),
fits AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM sites
  JOIN rules ON (h = host OR ends_with(h, '.' || host)) AND starts_with(p, path) GROUP BY r)
SELECT page_id, h AS host, p AS path, rule, coalesce(verdict, 'allow') AS verdict FROM sites LEFT JOIN fits USING (r)
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), default_path("piece_bpe_32k.model"), 4096)
    return docs.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_classes(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


_OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_scoring, op2_near_dedup, op3_language_id, op4_toxicity, op5_best_fit_packing, op6_token_files, op7_decontamination, op8_url_filter, op9_token_counts, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": _OP8_SQL, "op10_exact_dedup": _OP10_SQL}
