"""The scalar functions for ``spark.sql``: temporary SQL functions, so calls are ordinary expressions to the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tesserae.functions import text

_REFUSED = " OR ".join(f"contains(lower(split(regexp_replace(a, '^\\\\s+', ''), '(?<=[.!?])\\\\s', 2)[0]), '{r}')" for r in text.REFUSALS)
FUNCTIONS = {
    "tokenize(t STRING)": ("ARRAY<STRING>", r"regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+', 0)"),
    "term_id(t STRING)": ("BIGINT", "crc32(t)"),
    "bm25_weight(tf DOUBLE, len DOUBLE, avg_len DOUBLE)": ("DOUBLE", "tf * 2.5 / (tf + if(avg_len > 0, 1.5 * (0.25 + 0.75 * len / avg_len), 1.5))"),
    "idf(n DOUBLE, df DOUBLE)": ("DOUBLE", "ln(1 + (n - df + 0.5) / (df + 0.5))"),
    "rrf(r INT, k INT)": ("DOUBLE", "1.0D / (k + r)"),
    "years_in(t STRING)": ("ARRAY<INT>", r"transform(regexp_extract_all(t, '\\b(1[89]\\d{2}|20[0-2]\\d)\\b', 1), y -> cast(y AS INT))"),
    "period_agreement(s INT, e INT, s2 INT, e2 INT)": ("DOUBLE", "coalesce(greatest(0.0D, (least(e, e2) - greatest(s, s2) + 1) / (greatest(e, e2) - least(s, s2) + 1)) * if(s IS NULL OR e IS NULL OR s2 IS NULL OR e2 IS NULL, NULL, 1), 0.0D)"),
    "citation_markers(t STRING)": ("ARRAY<INT>", r"transform(regexp_extract_all(t, '\\[(\\d+)\\]', 1), n -> cast(n AS INT))"),
    "cited(t STRING, n INT)": ("ARRAY<INT>", r"array_distinct(filter(transform(regexp_extract_all(t, '\\[(\\d+)\\]', 1), x -> cast(x AS INT)), x -> x BETWEEN 1 AND n))"),
    "refused(a STRING)": ("BOOLEAN", _REFUSED),
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0.0D, (s, x) -> s + x * x)))"),
    "question_id(c STRING)": ("STRING", "concat('syn-', replace(c, ':', '-'))"),
    "source_label(title STRING, heading STRING)": ("STRING", "if(coalesce(heading, '') = '', title, concat(title, ' — ', heading))"),
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]
