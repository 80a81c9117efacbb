"""Incremental variants: new Bronze files to chunks, tokens and spend by time windows, the semantic cache as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.operators import corpus
from tesserae.operators.answers import MAX_ENTRIES, THRESHOLD, SemanticCache
from tesserae.sources import schemas as S


#: Folders of a Gold table that is kept by a stream; more for a larger one.
BUCKETS = 64


def stream_bronze(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.schema(S.BRONZE).option("recursiveFileLookup", "true").parquet(root)


def index_new(spark: SparkSession, bronze: str, gold: str, checkpoint: str, size: int = 1200, overlap: int = 150, buckets: int = BUCKETS) -> StreamingQuery:
    """Chunk the pages that have come since the last run; a page's chunks replace those that it had.

    Pages and chunks lie in ``buckets`` folders by the page's id, the pages in
    ``{gold}-pages``, in a folder for each batch. A batch adds its pages and makes
    the chunks of its buckets anew, from all revisions there (so themes of earlier
    batches are merged); pages of other buckets aren't read. A bucket that is left
    without chunks, as when its only page becomes a redirect, loses its folder. A
    batch that is replayed writes the same again.
    """
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")
    pages, jvm = f"{gold}-pages", spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
    fs = jvm.Path(gold).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.where("page_id is not null").withColumn("bucket", bucket).withColumn("epoch", F.lit(epoch))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(pages)
        if not fs.exists(jvm.Path(pages)):
            return
        known = spark.read.schema(f"{S.BRONZE}, bucket int, epoch long").parquet(pages)
        touched = sorted(r["bucket"] for r in known.where(F.col("epoch") == epoch).select("bucket").distinct().collect())  # as many as there are buckets
        if not touched:
            return
        rows = known.where(F.col("bucket").isin(touched) & (F.col("epoch") <= epoch)).drop("bucket", "epoch").distinct()
        chunks = corpus.build_gold(corpus.build_silver(rows), size, overlap).withColumn("bucket", bucket)
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(gold)
        left = {r["bucket"] for r in chunks.select("bucket").distinct().collect()}
        for b in set(touched) - left:
            fs.delete(jvm.Path(f"{gold}/bucket={b}"), True)

    return stream_bronze(spark, bronze).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spend_windows(calls: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Dollars and calls of each window of a stream of ``at, dollars``; rows later than ``late`` are dropped."""
    windows = calls.withWatermark("at", late).groupBy(F.window("at", width).alias("w"))
    return windows.agg(F.round(F.sum("dollars"), 6).alias("dollars"), F.count("*").alias("calls")).select(F.col("w.start").alias("start"), "dollars", "calls")


def cache_hits(asked: DataFrame, threshold: float = THRESHOLD, size: int = MAX_ENTRIES) -> DataFrame:
    """``tenant, seq, hit`` of a stream of ``tenant, seq, vector, fingerprint``: a cache of at most ``size`` entries is each tenant's state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = SemanticCache(threshold, size)
        if state.exists:
            fingerprint, keys, flat = state.get
            cache.fingerprint, cache.keys = fingerprint, list(keys)
            cache.vectors = list(np.array(flat, float).reshape(len(keys), -1)) if len(keys) else []
        rows = pd.concat(list(frames)).sort_values("seq")
        hits = []
        for r in rows.itertuples(index=False):
            cache.check(r.fingerprint)
            found = cache.lookup(np.asarray(r.vector, float))
            if found is None:
                cache.store(int(r.seq), np.asarray(r.vector, float))
            hits.append(found[0] if found else -1)
        flat = [float(x) for v in cache.vectors for x in v]
        state.update((cache.fingerprint, [int(k) for k in cache.keys], flat))
        yield pd.DataFrame({"tenant": key[0], "seq": rows["seq"].astype("int64"), "hit": hits})

    kind = dict(asked.dtypes)["tenant"]
    return asked.groupBy("tenant").applyInPandasWithState(step, f"tenant {kind}, seq long, hit long", "fingerprint string, keys array<long>, vectors array<double>", "append", GroupStateTimeout.NoTimeout)


def drain(query: StreamingQuery, done: Callable[[], None] | None = None) -> None:
    query.awaitTermination()
    if done:
        done()
