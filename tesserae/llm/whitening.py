"""Whitened embeddings from an exact covariance, by matrix products of digit slices.

Entries become integers. Centred and multiplied by the number of rows they stay
integers, which are split into limbs of 20 bits: products of limbs over up to
4,096 rows are below 2^53, so float64 BLAS gives them exactly. Limbs are put
together as big integers where they arise; Spark adds these up in two decimal
parts. The covariance is thus known exactly before it is rounded once, whatever
the order of the rows and the number of tasks, and its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import pick, schema

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries of this size or more aren't embeddings; their rows are left out as those with infinite ones are.
LARGEST = 2.0**40
LIMB, BLOCK = 20, 4096
_HALF = 10**30
_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def entries(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x``: vectors as integers; null ones and those with null, infinite or huge entries are left out, as are those of another length than most (of the longer, if as many)."""
    rows = pick(embeddings, vec_id="long", embedding="array<double>").where("size(embedding) > 0")
    sound = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    rows = rows.where(sound).select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    most = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (most["size"] if most else 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column("vec_id").to_pylist(), part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, as 64-bit integers if they fit and else as Python's."""
    fits = n * int(np.abs(x).max(initial=0)) < 2**61 and max(map(abs, sums)) < 2**61
    return x * n - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of 20 bits, lowest first; ``y`` is the sum of digit ``i`` times ``2 ** (20 * i)``."""
    sign, rest, out = np.where(y < 0, -1, 1), abs(y), []
    while not out or np.any(rest):
        out.append((rest & ((1 << LIMB) - 1)).astype(np.int64) * sign)
        rest = rest >> LIMB
    return out


def products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of up to ``BLOCK`` rows, exactly, as Python integers."""
    parts = [p.astype(np.float64) for p in limbs(y)]
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[i:], i):
            p = (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
            out += p if i == j else p + p.T
    return out


def squares(y: np.ndarray) -> list[int]:
    """Of each row, the sum of squares, exactly."""
    parts = limbs(y)
    return [sum(v << (LIMB * k) for k, v in enumerate(row)) for row in zip(*(sum((parts[i] * parts[k - i]).sum(axis=1) for i in range(max(0, k - len(parts) + 1), min(k, len(parts) - 1) + 1)).tolist() for k in range(2 * len(parts) - 1)), strict=True)]


def _few_tasks(rows: DataFrame) -> DataFrame:
    """As many tasks as the cluster runs twice over, so what is merged grows with the cluster and not with the rows."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for ids, x in _blocks(batches):
            own = x.sum(axis=0).astype(object)  # 4,096 entries below 2^47
            n, sums = n + len(ids), own if sums is None else sums + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(sums)), pa.array(range(len(sums)), pa.int32()), pa.array(list(map(Decimal, sums)), pa.decimal128(38, 0))], ["n", "dim", "total"])

    found = _few_tasks(rows).mapInArrow(run, schema("n long, dim int, total decimal(38,0)")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def scatter(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sum over all rows of the products of ``n * x - sums`` with itself, exactly: ``n ** 3`` times the covariance."""
    d = len(sums)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for _, x in _blocks(batches):
            total += products(centred(x, n, sums))
        high, low = zip(*(divmod(int(v), _HALF) for v in total[upper]), strict=True)
        cells = [pa.array(u, pa.int32()) for u in upper]
        yield pa.RecordBatch.from_arrays([*cells, *(pa.array(list(map(Decimal, v)), pa.decimal128(38, 0)) for v in (high, low))], ["i", "j", "high", "low"])

    merged = _few_tasks(rows).mapInArrow(run, schema("i int, j int, high decimal(38,0), low decimal(38,0)")).groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = np.zeros((d, d), object)
    for r in merged.toLocalIterator():  # a cell for each pair of dimensions
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["high"]) * _HALF + int(r["low"])
    return out


def principal(exact: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, of the covariance, its unit eigenvectors as columns, and its trace; directions without variance are left out."""
    v = np.array([[int(c) / n**3 for c in row] for row in exact])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    some = int((e > len(e) * np.finfo(float).eps * max(e[0], 0)).sum())
    return e[: min(most, some)], q[:, : min(most, some)], int(np.trace(exact)) / n**3


def _spread(rows: DataFrame, project, k: int, n: int) -> np.ndarray:
    """Covariance of what ``project`` gives, centred block by block and merged pairwise."""

    def add(a: tuple, b: tuple) -> tuple:
        n, by = a[0] + b[0], b[1] - a[1]
        return n, a[1] + by * (b[0] / n), a[2] + b[2] + np.outer(by, by) * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            z = project(x)
            mean = z.mean(axis=0)
            own = (len(z), mean, (z - mean).T @ (z - mean))
            total = own if total is None else add(total, own)
        if total:
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tolist()], kind), pa.array([total[2].ravel().tolist()], kind)], ["n", "mean", "products"])

    total = None
    for r in _few_tasks(rows).mapInArrow(run, schema("n long, mean array<double>, products array<double>")).toLocalIterator():  # a row of at most 32 x 32 numbers for each task
        own = (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k))
        total = own if total is None else add(total, own)
    return total[2] / n


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Null vectors, empty ones, those with null, infinite or huge (2^40) entries and
    those of another length than most are left out. A component without variance
    can't be whitened and is left out, so equal vectors alone give no rows, as an
    empty table does; repeated rows count each; a null ``vec_id`` stays; columns
    besides ``vec_id`` and ``embedding`` aren't read. Only sums with a cell for
    each pair of dimensions come to the driver.
    """
    rows = entries(embeddings)
    n, sums = totals(rows)
    e, q, trace = principal(scatter(rows, n, sums), n, most) if n else (np.empty(0), np.empty((0, 0)), 0.0)
    k = len(e)
    if not k:
        return rows.sparkSession.createDataFrame([], _RESULT)
    axes = q / np.sqrt(e)

    def project(x: np.ndarray) -> np.ndarray:
        return (centred(x, n, sums) / n).astype(np.float64) @ axes

    error = float(np.abs(_spread(rows, project, k, n) - np.eye(k)).max())
    explained = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            count = len(ids) * k
            far = [Decimal(v) for v in squares(centred(x, n, sums)) for _ in range(k)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i in ids for _ in range(k)], pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))), pa.array(np.full(count, n, np.int64)),
                    pa.array(far, pa.decimal128(38, 0)), pa.array(project(x).ravel()), pa.array(np.tile(explained, len(ids))), pa.array(np.full(count, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema(_RESULT))
