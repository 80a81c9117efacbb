"""Helpers that several operators of this subpackage need."""

from __future__ import annotations

import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: what lies between blanks of ASCII (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"


_checkpoints = itertools.count()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint that every executor can read.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Where
    none is named, a local session gets a temporary one; on a cluster, whose
    executors couldn't read it, that is an error. Every tenth time, Spark's cleaner
    gets a chance to drop what earlier steps left behind.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    if next(_checkpoints) % 10 == 9:
        release(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """A table written as Parquet below the checkpoint folder, which all executors share: compressed, unlike a checkpoint. Drop it when done."""

    def __init__(self, df: DataFrame) -> None:
        self._session = df.sparkSession
        if self._session.sparkContext.getCheckpointDir() is None:
            checkpoint(self._session.range(0))
        self.path = f"{self._session.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.rows = self._session.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self._session._jvm  # noqa: SLF001
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._session._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and checkpoints of earlier rounds of a loop, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # noqa: SLF001


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a column that is missing is null. Columns with other names never matter."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that ``taken`` doesn't have."""
    return name if name not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def words_in(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, by: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over a group's rows up to this one, without one task for a group.

    ``bucket`` must rise with ``order``. Sums of buckets are accumulated (one row
    a bucket), then the rows of a bucket within it, so a group that holds a third
    of all rows is spread over its buckets.
    """
    from pyspark.sql import Window as W

    before = "__before"
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("__sum"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    sums = sums.withColumn(before, F.sum("__sum").over(w.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))).drop("__sum")
    inner = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = df.withColumn("__own", F.sum(value).over(inner))
    keys = [*by, bucket]
    right = sums.select(*(F.col(k).alias(f"__r_{k}") for k in keys), before)
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = own.join(right, on=cond, how="left")
    return joined.withColumn(out, F.col("__own") + F.coalesce(F.col(before), F.lit(0))).drop("__own", before, *(f"__r_{k}" for k in keys))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a worker derives from them stays small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # noqa: SLF001


def kth(rows: DataFrame, key: str, k: int, bins: int = 1024, direct: int = 50_000) -> float | None:
    """The ``k``-th largest value of a double column (null if there are no more than ``k`` rows).

    Histograms of ever narrower ranges find a range of few rows, which alone is
    sorted. Only counts and scalars come to the driver; ``rows`` should be cheap to
    read again.
    """
    n, lo, hi = rows.agg(F.count(key), F.min(key), F.max(key)).first()
    if n <= k or k < 1:
        return None
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        inside = rows.where((F.col(key) >= lo) & (F.col(key) <= hi))
        bin_of = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("b")).collect()
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (lo, hi) == (r["lo"], r["hi"]) or r["n"] <= direct:
            lo, hi = r["lo"], r["hi"]
            break
        lo, hi = r["lo"], r["hi"]
    inside = rows.where((F.col(key) >= lo) & (F.col(key) <= hi))
    return inside.select(key).orderBy(F.desc(key)).limit(k - above).agg(F.min(key)).first()[0]
