"""Fixed-width text of small result tables: summaries, gate checks, stage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tesserae.operators.evaluation import dollars

#: Columns of a summary line, with how each is shown.
SUMMARY = (("recall_at_5", "%"), ("recall_at_20", "%"), ("coverage_at_5", "%"), ("mrr", "2"), ("fact_rate", "%"), ("refusal_rate", "%"), ("p50_first_token_ms", "0"), ("p50_total_ms", "0"), ("p95_total_ms", "0"))


def shown(value: float | None, how: str) -> str:
    """A share in percent, or a number with so many places; "-" for null."""
    if value is None:
        return "-"
    return f"{100 * value:.1f}%" if how == "%" else f"{value:,.{how}f}"


def summary_text(summary: DataFrame, key: str = "kind") -> str:
    """A line for each group, in the order of the table."""
    lines = [f"{key:<16}{'n':>6}" + "".join(f"{n:>20}" for n, _ in SUMMARY)]
    lines += [f"{r[key]:<16}{r['questions']:>6}" + "".join(f"{shown(r[n], how):>20}" for n, how in SUMMARY) for r in summary.collect()]
    return "\n".join(lines)


def spend_text(summary: DataFrame, model: str) -> str:
    """What the whole set cost; unknown without cached token counts."""
    from pyspark.sql import functions as F

    row = summary.select("questions", "prompt_tokens", "cached_tokens", "completion_tokens", dollars(F.col("prompt_tokens"), F.col("cached_tokens"), F.col("completion_tokens"), F.lit(model)).alias("cost")).first()
    if row is None or row["cost"] is None:
        return "spend: unknown"
    return f"spend: ${row['cost']:.4f}, ${row['cost'] / max(1, row['questions']):.6f} a question"


def gate_text(checks: DataFrame) -> str:
    rows = checks.orderBy(checks.columns[0], "name").collect()
    lines = [f"{r['status'].upper():<8}{r[0]:<16}{r['name']:<30}{shown(r['baseline'], '3'):>14}{shown(r['candidate'], '3'):>14}  {r['rule']}" for r in rows]
    failed = sum(r["status"] == "fail" for r in rows)
    return "\n".join([*lines, f"FAILED, {failed} checks" if failed else "PASSED"])


def stages_text(shares: DataFrame) -> str:
    rows = shares.orderBy(shares["median_share"].desc(), "name").collect()
    return "\n".join(f"{'  ' * r['depth']}{r['name']:<24}{r['records']:>8}{r['median_ms']:>12.1f}{100 * r['median_share']:>8.1f}%" for r in rows)
