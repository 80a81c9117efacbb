"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every document of a shuffled source has a virtual finish time: the source's
words up to and with it, divided by the source's target. All sources run through
their documents at their own rate, so at time 1 each has given its target. The
documents of all sources are then ordered by that time, and the order is cut at
the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm._shared import checkpoint, fresh, pick, running, words_in

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
#: Rows that a bucket of a running sum should hold.
BUCKET_ROWS = 50_000
#: Rows of a plan that are few enough to be sent to every task; beyond, the join shuffles.
FEW = 500_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` for each source, from rows of ``source, size``.

    Sources by code point, null last, get ``weights`` in turn and share ``share``
    times all words. A target stops at ``most`` times its source; the excess goes
    to the others by weight until none is above: there is one level L with target
    min(most * size, L * weight), found from the running sums of the sources in
    the order in which they stop. The windows see a row for each source.
    """
    return _goal(sizes, weights, share, most).drop("budget")


def _goal(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``targets`` with the ``budget``, which all targets sum up to: from sums of whole numbers, so the same in any order."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = W.partitionBy(F.lit(0))
    turn = (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    per = per.withColumn("budget", F.least(F.sum("source_size").over(one) * F.lit(share), F.sum("cap").over(one)))
    stop_order = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumn("nth", F.row_number().over(stop_order))
    before = one.orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    others = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / others)
    stops = F.col("cap") <= F.col("level") * F.col("weight")
    per = per.withColumn("end_level", F.min(F.when(~stops, F.struct("nth", "level"))).over(one)["level"])
    target = F.when(F.col("end_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("end_level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"), "budget")


def _few(goal: DataFrame, bound: int = 100_000) -> bool:
    """Sources are few enough to be sent to every task; beyond the bound the join shuffles."""
    return goal.limit(bound + 1).count() <= bound


def _passes(rows: DataFrame, most: int) -> DataFrame:
    """A row for each pass over a document, with its virtual ``finish`` time; none for sources without a target."""
    rows = rows.where("target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    return rows.withColumn("finish", _finish(F.col("pass")))


def _finish(turn: Column) -> Column:
    return (F.col("upto") + turn * F.col("source_size")) / F.col("target")


def _cut(rows: DataFrame, total: float, most: int, buckets: int) -> tuple[float, int]:
    """The last finish time, with its tie-break, that the budget ``total`` reaches in the order of finish times.

    Sums of words in buckets of finish times find the bucket in which the budget
    ends; only that bucket is ordered row by row. Scalars alone come to the driver.
    """
    every = _passes(rows, most).withColumn("__b", F.floor(F.col("finish") * buckets))
    w = W.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    upto = every.groupBy("__b").agg(F.sum("size").alias("__n")).withColumn("__upto", F.sum("__n").over(w))
    at = upto.where(F.col("__upto") > total).orderBy("__b").first()
    if at is None:
        return float("inf"), 0
    inner = W.partitionBy("__b").orderBy("finish", "order_key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    last = every.where(F.col("__b") == at["__b"]).withColumn("__own", F.lit(at["__upto"] - at["__n"]) + F.sum("size").over(inner))
    end = last.where(F.col("__own") <= total).agg(F.max(F.struct("finish", "order_key")).alias("end")).first()["end"]
    return (end["finish"], end["order_key"]) if end else (at["__b"] / buckets, -1)


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source, source_size, target, first_finish, passes`` for each document.

    ``first_finish`` is the virtual finish time of the first pass over the
    document (null without a target); ``passes`` says how many of its passes, of
    ``most`` at most, lie before the cut at the total budget. A source is shuffled
    by a hash of ``doc_id`` and ``seed`` and passed in the same order each time, so
    a rerun agrees. Running sums go through buckets of a source, so a source with
    a third of all rows fills many tasks.

    A null text counts 0 words; null sources are one source, the last; repeated
    rows are documents of their own; an empty table gives an empty one; columns
    besides ``doc_id``, ``source`` and ``text`` are not read.
    """
    sized = pick(docs, doc_id="long", source="string", text="string").select("doc_id", "source", words_in(F.col("text")).alias("size"))
    sized = checkpoint(sized)
    buckets = 8 * (sized.count() // BUCKET_ROWS + 1)
    goal = checkpoint(_goal(sized, weights, share, most)).withColumnRenamed("source", "__s")
    total = float(goal.agg(F.max("budget")).first()[0] or 0)
    goal = goal.drop("budget")
    rows = sized.withColumn("order_key", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1))
    rows = rows.withColumn("__b", F.floor(F.col("order_key") / F.lit(float(2**63)) * buckets))
    rows = running(rows, ["source"], "__b", [F.col("order_key"), F.col("doc_id"), F.col("size")], "size", "upto")
    rows = rows.join(F.broadcast(goal) if _few(goal) else goal, F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "__b")
    rows = checkpoint(rows)
    time, key = _cut(rows, total, most, max(64, buckets))
    before = F.lit(0)
    for turn in range(most):
        finish = _finish(F.lit(turn))
        inside = (finish < time) | ((finish == time) & (F.col("order_key") <= key))
        before = before + F.when(F.coalesce(inside, F.lit(False)) & (F.col("target") > 0), 1).otherwise(0)
    first = F.when(F.col("target") > 0, _finish(F.lit(0)))
    return rows.select("doc_id", "size", "source", "source_size", "target", first.alias("first_finish"), before.cast("long").alias("passes"))


def taken(docs: DataFrame, **options: object) -> DataFrame:
    """A row for each document: ``doc_id, size, source_size, target, taken, first_finish``; ``taken`` counts words, repeats counted."""
    return schedule(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "first_finish")


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mix in its order: the rows of ``docs``, each as often as it is taken, range-sorted by finish time over all tasks.

    Rows join their number of passes by ``doc_id`` and source; rows that repeat
    both are told apart by size and text, so each is taken as often as the plan
    says. An empty table gives an empty one; columns of any name pass through.
    """
    at = {c: fresh(f"__{c}", docs.columns) for c in ("id", "source", "nth", "passes", "finish", "target", "whole", "turn", "words")}
    plan = schedule(docs, **options)
    plan = checkpoint(plan.select(*(F.col(c).alias(at[k]) for k, c in {"id": "doc_id", "source": "source", "words": "size", "passes": "passes", "finish": "first_finish", "target": "target", "whole": "source_size"}.items())))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(at["id"])) & docs["source"].cast("string").eqNullSafe(F.col(at["source"]))
    if plan.groupBy(at["id"], at["source"]).count().where("count > 1").isEmpty():
        taken = plan.where(F.col(at["passes"]) > 0)
    else:
        w = W.partitionBy(at["id"], at["source"])
        mine = W.partitionBy(F.col("doc_id").cast("long"), F.col("source").cast("string"))
        docs = docs.withColumn(at["nth"], F.row_number().over(mine.orderBy(words_in(F.col("text")), "text")))
        number = fresh("__number", docs.columns)
        taken = plan.withColumn(number, F.row_number().over(w.orderBy(at["words"], F.col(at["finish"])))).where(F.col(at["passes"]) > 0)
        on = docs["doc_id"].cast("long").eqNullSafe(F.col(at["id"])) & docs["source"].cast("string").eqNullSafe(F.col(at["source"])) & (docs[at["nth"]] == F.col(number))
    columns = [c for c in docs.columns if c != at["nth"]]
    rows = docs.join(F.broadcast(taken) if _few(taken, FEW) else taken, on)
    rows = rows.withColumn(at["turn"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(at["passes"]))))
    turn = F.col(at["finish"]) + (F.col(at["turn"]) - 1) * F.col(at["whole"]) / F.col(at["target"])
    return rows.repartitionByRange(turn, F.col("doc_id")).sortWithinPartitions(turn, F.col("doc_id")).select(*(F.col(f"`{c}`") for c in columns))
