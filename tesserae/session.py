"""A session with the settings that the plans count on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "tesserae", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def few(df: DataFrame, bound: int = 200_000) -> bool:
    """Whether a table has at most ``bound`` rows: then it may be sent to every task."""
    return df.limit(bound + 1).count() <= bound


def sent(df: DataFrame, of: DataFrame | None = None, each: int = 1, bound: int = 200_000) -> DataFrame:
    """``df``, to go to every task if it is few. Where it is costly, count ``of`` instead, a cheap table for each of whose rows it has at most ``each``."""
    return F.broadcast(df) if few(df if of is None else of, bound // each) else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path where all executors can write and read: below ``spark.checkpoint.dir``, or a temporary one of a local session."""
    root = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tesserae-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
