"""Quality by importance resampling: target over raw under hashed n-gram models, sampled by Gumbel top-k.

Texts are bags of hashed words and word pairs. One model is fitted to the
documents labelled good, one to all documents; the log of their ratio over a
document's bag is its importance weight. Adding Gumbel noise and taking the
greatest ``k`` samples ``k`` documents without replacement, each in proportion to
its weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import checkpoint, kth, pick, schema

BUCKETS = 10_000
#: About so many labelled rows, chosen by a hash of doc_id, fit the target model.
LABELLED = 20_000
#: Share of the documents that is sampled: about those that are good among the labelled, and some room.
KEEP = 0.9
SEED = 11
#: Added to every count of a bucket, so that rare n-grams say little.
SMOOTH = 20.0


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def bag(text: str | None, words: _Words, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of the words and word pairs of a text, A-Z lower-cased; null has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(ids):
        return np.empty(0, np.int64)
    pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]
    both = np.concatenate([ids * np.uint64(0xC2B2AE3D27D4EB4F), pairs ^ (pairs >> np.uint64(29))])
    return ((both >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)


def models(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the two models for each bucket; raw counts run over all documents, ``buckets`` sums come back."""
    labels = pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality = 1").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id").distinct()
    n = labels.count()
    if n > bound:
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(labels.withColumn("good", F.lit(1))), "doc_id", "left").select("text", "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, raw, good = _Words(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, flag in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
                counts = np.bincount(bag(text, words, buckets), minlength=buckets)
                raw += counts
                if flag:
                    good += counts
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    sums = rows.mapInArrow(run, schema("bucket long, raw long, good long")).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.full(buckets, SMOOTH), np.full(buckets, SMOOTH)
    for r in sums:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    # both with the same share of smoothing, so that an empty target model says nothing
    raw = raw - SMOOTH + SMOOTH * (raw.sum() / good.sum())
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, log_weight, sample_key`` of every row: the weight, and with Gumbel noise from a hash of ``doc_id`` and ``seed``."""
    buckets = len(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            w = [float(ratio[bag(t, words, buckets)].sum()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    rows = pick(docs, doc_id="long", text="string").mapInArrow(run, schema("doc_id long, log_weight double"))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return rows.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform)))


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = SEED, bound: int = LABELLED) -> DataFrame:
    """``doc_id, log_weight, sample_key, kept`` of every row; ``kept`` marks the ``ceil(keep * rows)`` with the greatest keys.

    Null and empty texts weigh as an average document (log weight 0). Rows that
    tie at the last place, such as repeated rows, are all kept. A null ``doc_id``
    has one noise of its own; labels that are null or missing teach nothing; an
    empty table gives an empty one; other columns aren't read.
    """
    rows = checkpoint(weigh(docs, models(docs, labels, bound), seed))
    least = kth(rows, "sample_key", -int(-keep * rows.count() // 1))
    return rows.withColumn("kept", F.col("sample_key") >= F.lit(least) if least is not None else F.lit(True))
