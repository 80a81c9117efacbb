"""Quality rules: robust multivariate outliers by minimum covariance determinants.

Each text gives counts; base rules reject the plainly bad. Of the others, each
language and source has its own robust centre and covariance: of several starts,
each from a few random rows, concentration steps over all rows (the nearest share
under an estimate gives the next one) lead to that of the least determinant,
which further steps refine. Rows beyond a chi-squared quantile of the squared
Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm._shared import checkpoint, pick, schema

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of a group's rows that an estimate rests on.
SUPPORT = 0.75
#: Starts of each group, concentration steps of every start, and further ones of the best.
STARTS = 6
STEPS = 3
MORE = 2
#: Groups with fewer rows are estimated together: a language's small sources, then all small languages.
MIN_GROUP = 200
#: Share of normal rows that would be rejected. It is this small as statistics of plain texts have longer tails.
TAIL = 1e-10
#: An estimate counts as many rows more, spread this much about its centre, so that a few rows don't make a narrow one.
PRIOR_ROWS = 12
PRIOR_SPREAD = 0.5
#: The least spread of a statistic, in its own unit, lest a statistic that most rows share exactly rejects all others.
FLOOR = 0.2

#: Transformed statistics, in this order.
STATS = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "stutter")
#: Words that a short text borrows from a plain one, so that its shares aren't noise.
PRIOR = 40.0
#: Groups that are few enough for their estimates to go to every task.
FEW_GROUPS = 20_000
SCALE = 4096  # fixed point: sums of whole numbers are the same in any order

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long, n_stutter long"
_OTHER = bytes(c for c in range(256) if c not in SYMBOLS)
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_CONTINUES = bytes(c for c in range(256) if c & 0xC0 == 0x80)


def repeated(words: list[bytes]) -> int:
    """Words that lie in some window of ``WINDOW`` words found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i : i + n] for i in range(WINDOW)), strict=True))
    first: dict[tuple[bytes, ...], int] = {}
    if len(set(grams)) == n:
        return 0
    hit = np.zeros(len(words) + 1, dtype=np.int32)
    for i, g in enumerate(grams):
        j = first.setdefault(g, i)
        if j != i:
            for k in (i, j):
                hit[k] += 1
                if k + WINDOW <= len(words):
                    hit[k + WINDOW] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The base counts of a text, in the order of ``_COUNTS``; null and empty texts have 0 in each."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at blanks of ASCII alone
    joined = b"".join(words)
    seen: set[bytes] = set()
    twice = lines = 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            twice += line in seen
            seen.add(line)
    return (
        len(words), len(joined.translate(None, _CONTINUES)), len(raw.translate(None, _OTHER)), twice,
        repeated(words), len(joined.translate(None, _NOT_UPPER)), lines, sum(map(eq, words, words[1:])),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, lang, source`` and the counts of every text, in one pass that carries no text on."""
    docs = pick(docs, doc_id="long", lang="string", source="string", text="string").select("doc_id", text_hash().alias("text_hash"), "lang", "source", "text")
    own = ["doc_id", "text_hash", "lang", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _COUNTS.split(", ")]
        for batch in batches:
            rows = np.array([counts(t.as_py()) for t in batch.column("text")], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(rows[:, i]) for i in range(len(names)))], [*own, *names])

    return docs.mapInArrow(run, schema("doc_id long, text_hash long, lang string, source string, " + _COUNTS))


def vector() -> list[Column]:
    """The transformed statistics: shares shrunk by ``PRIOR`` words, on scales on which plain texts spread evenly."""
    n = F.col("n_words") + F.lit(PRIOR)
    chars = F.col("word_chars") + F.lit(5 * PRIOR)
    return [
        F.log(chars / n) * 4.0,
        F.log1p(F.col("n_symbols") / n * 50.0),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + F.lit(8.0))) * 2.0,
        F.sqrt(F.col("n_repeat_words") / n) * 2.0,
        F.sqrt(F.col("n_upper") / chars) * 4.0,
        F.sqrt(F.col("n_stutter") / n) * 2.0,
    ]


def _below(x: float, d: int) -> float:
    """The chi-squared distribution of an even number ``d`` of degrees, at ``x``."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))


def quantile(tail: float, d: int = len(STATS)) -> float:
    """The squared distance that a share ``tail`` of normal rows exceeds."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.exp(-mid / 2) * sum((mid / 2) ** i / math.factorial(i) for i in range(d // 2)) > tail else (lo, mid)
    return hi


#: The squared distance within which ``SUPPORT`` of normal rows lie, and by how much their covariance falls short of all rows'.
EDGE = quantile(1 - SUPPORT)
CONSISTENCY = SUPPORT / _below(EDGE, len(STATS) + 2)


def _estimate(rows: DataFrame) -> DataFrame:
    """``grp, start, centre, inverse, logdet`` from the rows of each group and start; sums of whole numbers, so any order agrees."""
    d = len(STATS)
    x = [F.col(f"x{i}") for i in range(d)]
    names = [f"s{i}" for i in range(d)] + [f"s{i}_{j}" for i in range(d) for j in range(i, d)]
    aggs = [*(F.sum(x[i]).alias(f"s{i}") for i in range(d)), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d))]
    sums = rows.groupBy("grp", "start").agg(F.count("*").alias("n"), *aggs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, inverses, dets = [], [], []
            for row in batch.to_pylist():
                mean = np.array([row[f"s{i}"] / row["n"] for i in range(d)])
                cov = np.zeros((d, d))
                for i in range(d):
                    for j in range(i, d):
                        cov[i, j] = cov[j, i] = row[f"s{i}_{j}"] / row["n"] - mean[i] * mean[j]
                cov = covariance(cov / SCALE**2, row["n"])
                centres.append((mean / SCALE).tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("start"), pa.array(centres, doubles), pa.array(inverses, doubles), pa.array(dets, pa.float64())], ["grp", "start", "centre", "inverse", "logdet"])

    return sums.select("grp", "start", "n", *names).mapInArrow(run, schema("grp string, start int, centre array<double>, inverse array<double>, logdet double"))


def covariance(cov: np.ndarray, n: int) -> np.ndarray:
    """The covariance of all rows as that of ``n`` central ones tells it."""
    one = np.eye(len(cov))
    return (n * CONSISTENCY * cov + PRIOR_ROWS * PRIOR_SPREAD**2 * one) / (n + PRIOR_ROWS) + FLOOR**2 * one


def _distance() -> Column:
    """Squared Mahalanobis distance of a row to its group's estimate."""
    d = len(STATS)
    diff = [F.col(f"x{i}") / float(SCALE) - F.col("centre")[i] for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            total = total + diff[i] * diff[j] * F.col("inverse")[i * d + j]
    return total


def _class() -> Column:
    """Narrow classes of the logarithm of the distance: an edge among them is exact to 2 %."""
    return F.floor(F.log1p(_distance()) * 64).cast("long")


def _edges(near: DataFrame) -> DataFrame:
    """``grp, start, edge``: the class with which the nearest ``SUPPORT`` of a group's rows end; a row for each class is all that is exchanged."""
    sums = near.groupBy("grp", "start", "class").agg(F.count("*").alias("n"))
    w = W.partitionBy("grp", "start")
    sums = sums.withColumn("upto", F.sum("n").over(w.orderBy("class").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return sums.where(F.col("upto") >= F.col("all") * SUPPORT).groupBy("grp", "start").agg(F.min("class").alias("edge"))


def estimates(good: DataFrame, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``grp, centre, inverse, logdet, edge`` of the least determinant for each group of rows ``grp, x0, x1, ...``.

    A start is one random row of each of seven random classes of rows, as many as
    span the space. ``send`` marks estimates that go to every task.
    """
    x = [f"x{i}" for i in range(len(STATS))]
    every = good.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))).withColumn("h", F.xxhash64("start", *x))
    few = every.groupBy("grp", "start", F.pmod("h", F.lit(len(STATS) + 1)).alias("c")).agg(F.min(F.struct("h", *x)).alias("row")).select("grp", "start", "row.*")
    fit = checkpoint(_estimate(few))
    near = lambda fit: good.join(send(fit), "grp").withColumn("class", _class())
    for step in range(STEPS + MORE):
        seen = near(fit).select("grp", "start", "class", *x)
        edges = _edges(seen)
        fit = checkpoint(_estimate(seen.join(send(edges), ["grp", "start"]).where(F.col("class") <= F.col("edge"))))
        if step == STEPS - 1:
            best = fit.groupBy("grp").agg(F.min_by(F.struct("start", "centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("best"))
            fit = checkpoint(best.select("grp", "best.*"))
    edges = _edges(near(fit)).select("grp", (F.exp((F.col("edge") + 1) / 64.0) - 1).alias("edge"))
    return fit.drop("start").join(send(edges), "grp")


def text_hash() -> Column:
    """With ``doc_id``, the identity of a row: a 64-bit hash of its text, language and source."""
    return F.xxhash64(*(F.concat(F.lit("="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("text", "lang", "source")))


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """``doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance`` of every row.

    ``distance`` is the squared robust distance (null where the base rules fail);
    rows beyond the quantile of ``tail`` are rejected. Groups of fewer than
    ``MIN_GROUP`` rows share an estimate, at last one of all small groups, however
    few its rows; ``PRIOR_ROWS`` keep that wide. Null and empty texts have no words
    and fail the base rules. Null languages and sources are groups of their own;
    repeated rows each get the same row; an empty table gives an empty one; other
    columns aren't read.
    """
    stats = statistics(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed)
    for i, x in enumerate(vector()):
        rows = rows.withColumn(f"x{i}", F.round(x * SCALE).cast("long"))
    rows, send = _grouped(checkpoint(rows))
    fit = estimates(rows.where(~F.col("base_failed")).select("grp", *(f"x{i}" for i in range(len(STATS)))), send)
    out = rows.join(send(checkpoint(fit)), "grp", "left")
    # where even the central rows spread further than normal ones would, the unit of distance is theirs
    dist = _distance() / F.greatest(F.col("edge") / EDGE, F.lit(1.0))
    out = out.withColumn("distance", F.when(~F.col("base_failed"), dist))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= quantile(tail), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", "text_hash")


def _grouped(rows: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rows with ``grp``: language and source, or what small groups are estimated with; and how to send a table of groups to them.

    Tables of groups go to every task while the groups are few; beyond, joins shuffle.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = rows.withColumn("g1", F.concat_ws("\u0001", part("lang"), part("source"))).withColumn("g2", F.concat_ws("\u0001", part("lang"), F.lit("*")))
    sizes = rows.where(~F.col("base_failed")).groupBy("g1", "g2").agg(F.count("*").alias("n1"))
    g = F.when(F.col("n1") >= MIN_GROUP, F.col("g1"))
    small = sizes.where(F.col("n1") < MIN_GROUP).groupBy("g2").agg(F.sum("n1").alias("n2"))
    names = sizes.join(small, "g2", "left").select("g1", F.coalesce(g, F.when(F.col("n2") >= MIN_GROUP, F.col("g2")), F.lit("*")).alias("grp"))
    names = checkpoint(names)
    few = names.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    send = F.broadcast if few else lambda df: df
    return rows.join(send(names), "g1", "left").drop("g1", "g2"), send
