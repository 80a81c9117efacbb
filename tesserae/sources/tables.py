"""Parquet, CSV, JSON lines and TOML, through Spark's readers but for files that people edit."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tesserae.sources import schemas as S


def scan_bronze(spark: SparkSession, root: str) -> DataFrame:
    """All batches of all days; an empty table if there is none yet."""
    try:
        return spark.read.schema(S.BRONZE + ", ingest_date date").parquet(root)
    except AnalysisException:
        return spark.createDataFrame([], S.BRONZE + ", ingest_date date")


def append_bronze(rows: DataFrame, root: str) -> None:
    """Append a batch, a folder a day of fetching."""
    rows.withColumn("ingest_date", F.to_date("fetched_at")).write.mode("append").partitionBy("ingest_date").parquet(root)


def overwrite(rows: DataFrame, root: str) -> None:
    """Write a Silver or Gold table whole."""
    rows.write.mode("overwrite").parquet(root)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(S.SILVER).parquet(root).orderBy("page_id", "position")


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(S.GOLD).parquet(root)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.csv(path, schema=ddl, header=True, mode="FAILFAST")


def write_csv(rows: DataFrame, path: str) -> None:
    """Overwrite, with a header even for no rows."""
    rows.write.mode("overwrite").csv(path, header=True)


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of JSON lines; lines that can't be read are skipped, missing fields null."""
    rows = spark.read.schema(ddl + ", _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").cache()
    return rows.where("_corrupt is null").drop("_corrupt")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def with_defaults(records: DataFrame) -> DataFrame:
    """Run records of older shapes: fields that they lack have their defaults."""
    empty = {"suite": "golden", "draft": "", "standalone": "", "revised": False, "generation_model": ""}
    lists = ("expected_doc_ids", "retrieved", "markers_found", "citations", "expected_answers", "history", "trace")
    types = dict(records.dtypes)
    for c, v in empty.items():
        records = records.withColumn(c, F.coalesce(c, F.lit(v)))
    for c in lists:
        records = records.withColumn(c, F.coalesce(c, F.array().cast(types[c])))
    return records


def read_toml(spark: SparkSession, path: str | Path, key: str, ddl: str, required: tuple[str, ...] = (), unique: str | None = None) -> DataFrame:
    """The tables named ``key`` of a TOML file; unknown fields, missing required ones and repeated ids are errors."""
    rows = tomllib.loads(Path(path).read_text(encoding="utf-8")).get(key, [])
    schema = spark.createDataFrame([], ddl).schema
    _valid(rows, key, {f.name for f in schema.fields}, required, unique)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def _valid(rows: list[dict], key: str, names: set[str], required: tuple[str, ...], unique: str | None) -> None:
    for i, row in enumerate(rows):
        if extra := set(row) - names:
            raise ValueError(f"{key}[{i}]: unknown fields {sorted(extra)}")
        if lacking := [r for r in required if not row.get(r)]:
            raise ValueError(f"{key}[{i}]: missing {lacking}")
    if unique and len({r[unique] for r in rows}) < len(rows):
        raise ValueError(f"{key}: {unique} isn't unique")


def toml_questions(rows: list[dict]) -> str:
    """Generated questions as TOML, read back by the rules of ``read_toml`` and held against what was given."""
    control = {i: f"\\u{i:04x}" for i in (*range(32), 127)}
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').translate(control) + '"'
    out = []
    for r in rows:
        lines = ["[[question]]", *(f"{k} = [{', '.join(map(quote, v))}]" if isinstance(v, list) else f"{k} = {quote(v)}" for k, v in r.items())]
        out.append("\n".join(lines))
    text = "\n\n".join(out) + "\n"
    again = tomllib.loads(text).get("question", [])
    _valid(again, "question", {n.split()[0] for n in S.QUESTION.split(", ")}, ("id", "kind", "text"), "id")
    if again != rows:
        raise ValueError("questions don't survive being written")
    return text
