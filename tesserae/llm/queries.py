"""The queries of this subpackage and, where SQL can express them, their SQL.

Hashes, tokens, learned weights and random walks aren't SQL's; tests hold those
queries against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import conversations, fingerprints, importance, mixing, near_dedup, packing, phrase_dedup, quality, secret_scan, suffix_dedup, toxicity, url_filter, whitening
from tesserae.llm._shared import documents


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(documents(spark, sf_dir)).drop("kept")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op11_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove(documents(spark, sf_dir)).drop("spans")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.digests(rows, conversations.damaged(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_harmonic_packing, op2_near_dedup, op3_edit_fingerprints, op4_secret_scan, op5_url_filter, op6_weighted_mix, op7_toxicity, op8_suffix_dedup, op9_importance_resampling, op10_quality_rules, op11_phrase_dedup, op12_whitening, op13_conversation_repair)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{r.text}', {str(r.block).upper()})" for r in url_filter.SITE_RULES)
_PATTERNS = "|".join(r.regex().pattern for r in url_filter.PATTERN_RULES).replace("\\Z", "\\z")
URL_SQL = rf"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT rule, block, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM (VALUES {_RULES}) t(rule, block)),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(block, length(rule)) AS block FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, m.rule, CASE WHEN coalesce(m.block, regexp_matches(host || path, '{_PATTERNS.replace("'", "''")}')) THEN 'block' ELSE 'allow' END AS verdict FROM h LEFT JOIN m ON m.page_id IS NOT DISTINCT FROM h.page_id"""


PHRASES_SQL = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM t), x AS (SELECT s.r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM s JOIN t ON t.r = s.r),
c AS (SELECT r, i FROM x SEMI JOIN (SELECT h FROM x GROUP BY h HAVING count(*) > 1) y ON y.h = x.h),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM c),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
k AS (SELECT p.r, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN g ON g.r = p.r AND g.i = p.i GROUP BY p.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.r = t.r"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": URL_SQL, "op11_phrase_dedup": PHRASES_SQL}
