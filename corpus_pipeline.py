"""From raw documents to packed sequences: quality rules, near-duplicate removal, secret redaction, source mixture, packing.

Each stage works on all that the one before it kept. A driver that writes every
stage's rows as Parquet and reads them again can use ``STAGES``; ``run`` does the
same with reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import mixing, near_dedup, packing, quality, secret_scan
from tesserae.llm._shared import WORD, checkpoint, fresh

#: Rejected rows that are few enough to be sent to every task; beyond, the join shuffles.
FEW = 500_000


def _without(docs: DataFrame, verdicts: DataFrame, identity: Column) -> DataFrame:
    """The rows of the documents but for those that ``verdicts`` reject; ``doc_id`` and a hash tell rows apart, so rows that share an id fare each by themselves."""
    key, mark = fresh("__bad", docs.columns), fresh("__hash", docs.columns)
    bad = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)).distinct()
    bad = checkpoint(bad)
    few = bad.limit(FEW + 1).count() <= FEW
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (identity == F.col(mark)), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust distances reject.

    Null, empty and very short texts fail the base rules; repeated rows fare
    alike; rows that share an id are judged each; an empty table stays empty.
    """
    return _without(docs, quality.judge(docs).select("doc_id", "text_hash", "kept"), quality.text_hash())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least ``doc_id``; of rows that repeat it and its text, the least by all columns.

    Texts without words are in no group and stay, each of them; an empty table stays empty.
    """
    found = checkpoint(near_dedup.classes(docs).select("doc_id", "text_hash", "kept"))
    kept = _without(docs, found, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    if found.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept
    worded, row = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False)), fresh("__row", docs.columns)
    one = kept.where(worded).groupBy("doc_id", "text").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(row))
    return one.select(f"{row}.*").unionByName(kept.where(~worded))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; null and empty texts stay as they are, repeated rows are masked alike."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in its order; null texts count no words, repeated rows are documents of their own."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Hashes order the mixture and tokens fill the sequences: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
