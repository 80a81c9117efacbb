"""Joins of closed spans that meet, as equality joins on tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import few


def _level(start: Column, end: Column) -> Column:
    """The least power of two that a span isn't longer than: it lies in two tiles of that width at most."""
    return F.ceil(F.log2((end.cast("double") - start.cast("double") + 1))).cast("int")


def _levels(df: DataFrame, start: str, end: str) -> list[int]:
    known = df.where(F.col(start) <= F.col(end))
    return [r[0] for r in known.select(_level(F.col(start), F.col(end)).alias("level")).distinct().collect()]  # at most 64


def _tiled(df: DataFrame, start: str, end: str, levels: list[int], side: str) -> DataFrame:
    """A row for each tile that a span touches, at its own level and those above it that occur; no more than two a level."""
    own = _level(F.col(start), F.col(end))
    above = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= own)
    tile = lambda c, level: F.call_function("shiftright", F.col(c).cast("long"), level)
    tiles = F.flatten(F.transform(above, lambda level: F.transform(F.sequence(tile(start, level), tile(end, level)), lambda t: F.struct(level.alias("level"), t.alias("tile"), tile(start, level).alias("first")))))
    rows = df.where(F.col(start) <= F.col(end)).withColumn(f"__own_{side}", own).withColumn("__tile", F.explode(tiles))
    return rows.select("*", F.col("__tile.level").alias("__level"), F.col("__tile.tile").alias("__at"), F.col("__tile.first").alias(f"__first_{side}")).drop("__tile")


def meeting(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], bound: int = 200_000) -> DataFrame:
    """All columns of both sides for each pair of spans that share a point; spans are pairs of integer columns, ends included.

    A pair meets in tiles as wide as the longer of the two, of which each span
    touches two at most; it is told in the last tile where the two begin, so it
    comes once, and lengths may differ without limit. Spans with a null end or that run
    backwards meet nothing; columns must have different names. The right side goes to
    every task if its tiles are at most ``bound``.
    """
    levels = sorted({*_levels(left, *left_span), *_levels(right, *right_span)})
    if not levels:
        return left.limit(0).crossJoin(right.limit(0))
    a, b = _tiled(left, *left_span, levels, "a"), _tiled(right, *right_span, levels, "b")
    if few(right, bound // (2 * len(levels))):
        b = F.broadcast(b)
    pairs = a.join(b, ["__level", "__at"]).where((F.col("__level") == F.greatest("__own_a", "__own_b")) & (F.col("__at") == F.greatest("__first_a", "__first_b")))
    (s, e), (t, f) = left_span, right_span
    return pairs.where((F.col(s) <= F.col(f)) & (F.col(t) <= F.col(e))).select(*left.columns, *right.columns)
