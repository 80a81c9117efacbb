"""Calls to a model under a ceiling: what they may cost at most is known before they are made, what they did cost is counted.

A prompt has no more tokens than bytes, so its cost has a bound. Rows are put in an
order with the running sum of their bounds; those whose sum stays within what is
left are called, in tasks, as one wave. Their true cost is mostly far less, so what
is left after it lets the next rows through, until a row doesn't fit. No task has to
know what others spend, and the ceiling holds whatever is run again.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import text
from tesserae.operators.evaluation import dollars
from tesserae.session import shared_folder
from tesserae.sources.seams import Generator, Reply, spoken

MAX_OUTPUT = 800
#: Tokens that a provider may add to each message.
FRAME = 8
BUCKETS = 1024
NANO = 1_000_000_000
CEILING = "CeilingExceeded: the call isn't made, as it might pass the ceiling"
VERIFY = "Check the draft against the sources. Reply with <answer>the draft, or what the sources support of it</answer>."


class Meter:
    """Calls, tokens and failures so far, for a driver that watches; tasks report as they end, and one that is run again counts again."""

    def __init__(self, spark: SparkSession) -> None:
        zero = spark.sparkContext.accumulator
        self._calls, self._tokens, self._failures = zero(0), zero(0), zero(0)

    def add(self, reply: Reply) -> None:
        self._calls.add(1)
        self._tokens.add(reply.usage.prompt + reply.usage.completion if reply.usage else 0)
        self._failures.add(int(reply.error is not None))

    @property
    def calls(self) -> int:
        return self._calls.value

    @property
    def tokens(self) -> int:
        return self._tokens.value

    @property
    def failures(self) -> int:
        return self._failures.value


def most_tokens(messages: Column) -> Column:
    """As many tokens as messages can have: their bytes, and ``FRAME`` for each."""
    size = lambda m: F.octet_length(F.coalesce(m["content"], F.lit(""))) + F.octet_length(F.coalesce(m["role"], F.lit(""))) + FRAME
    return F.coalesce(F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + size(m)), F.lit(0).cast("long"))


def running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` (whole numbers) up to each row, in an order by a hash of all columns.

    Buckets of the hash are summed first, then rows within theirs, so no task has all
    rows. Rows that are alike in every column are interchangeable; where they are many,
    their bucket is sorted by one task, on disk if need be.
    """
    rows = rows.withColumn("__h", F.xxhash64(*rows.columns)).withColumn("__b", F.pmod("__h", F.lit(BUCKETS)))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # over BUCKETS rows at most
    sums = rows.groupBy("__b").agg(F.sum(value).alias("__s")).select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inner = W.partitionBy("__b").orderBy("__h").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.sum(value).over(inner)).join(F.broadcast(sums), "__b")
    return rows.withColumn(out, F.col("__before") + F.col("__own")).drop("__h", "__b", "__before", "__own")


def _called(rows: DataFrame, generator: Generator, messages: str, meter: Meter | None) -> DataFrame:
    """Add what a call to each row's messages gives; one that fails is recorded, and the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for turns in frame[messages]:
                began = time.perf_counter()
                said = spoken(generator, [{"role": m["role"], "content": m["content"] or ""} for m in (() if turns is None else turns)])
                if meter is not None:
                    meter.add(said)
                use = said.usage
                out.append((said.text, said.error, *((use.prompt, use.completion, use.cached) if use else (None,) * 3), said.first_ms, 1000 * (time.perf_counter() - began)))
            for i, name in enumerate(_REPLY.names):
                frame[name] = pd.Series([o[i] for o in out], index=frame.index, dtype=_DTYPES.get(name, object if i < 2 else "Float64"))
            yield frame

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *_REPLY.fields]))


_COUNTS = ("prompt_tokens", "completion_tokens", "cached_tokens")
_REPLY = T.StructType([
    T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), *(T.StructField(c, T.LongType()) for c in _COUNTS),
    T.StructField("first_token_ms", T.DoubleType()), T.StructField("generate_ms", T.DoubleType()),
])
_DTYPES = dict.fromkeys(_COUNTS, "Int64")


def metered(rows: DataFrame, generator: Generator, model: str, ceiling: float = 0.0, spent: float = 0.0, messages: str = "messages", meter: Meter | None = None, max_output: int = MAX_OUTPUT) -> DataFrame:
    """Add ``answer, error, prompt_tokens, completion_tokens, cached_tokens, first_token_ms, generate_ms, dollars`` to every row.

    The sum of ``dollars``, with what was ``spent`` before, never passes ``ceiling`` (0 or
    less: off). Once a row might pass it, that row and all after it in the order of
    ``running`` are not called: their error says so and they cost nothing. A failed call
    costs what its usage tells, and as much as it may if that is unknown. An answer
    with no visible character is an error (``EmptyCompletion``). Waves are tables in
    the shared folder: a call is only made again if its task is. Waves are about as many
    as calls cost less than they may, so let ``max_output`` be the cap that the service is
    told. Null messages are an
    empty list; repeated rows are called each by itself.
    """
    root, most = shared_folder(rows.sparkSession, "metered"), most_tokens(F.col(messages))
    nano = lambda prompt, cached, completion: F.ceil(dollars(prompt, cached, completion, F.lit(model)) * NANO).cast("long")
    limited = ceiling > 0
    asked = rows.withColumn("__most", nano(most, F.lit(0), F.lit(max_output)))
    asked = _kept(running(asked, "__most", "__upto") if limited else asked.withColumn("__upto", F.lit(1).cast("long")), f"{root}/asked")
    cost = F.when(F.col("prompt_tokens").isNull(), F.col("__most")).otherwise(nano(F.col("prompt_tokens"), F.col("cached_tokens"), F.col("completion_tokens")))
    low, left, n = 0, int((ceiling - spent) * NANO), 0
    while True:
        due = asked.where((F.col("__upto") > low) & (F.col("__upto") <= low + left)) if limited else asked
        wave = _kept(_called(due, generator, messages, meter).withColumn("__nano", cost), f"{root}/calls/wave={n}")
        got = wave.agg(F.max("__upto").alias("top"), F.sum("__nano").alias("nano")).first()
        n += 1
        if not limited or got["top"] is None:
            break
        low, left = got["top"], left - got["nano"]
    spark = rows.sparkSession
    called = spark.read.schema(wave.schema).parquet(*(f"{root}/calls/wave={i}" for i in range(n)))
    refused = asked.where(F.col("__upto") > low) if limited else asked.limit(0)
    none = {f.name: F.lit(None).cast(f.dataType) for f in _REPLY.fields} | {"answer": F.lit(""), "error": F.lit(CEILING), "__nano": F.lit(0).cast("long")}
    return called.unionByName(refused.withColumns(none)).withColumn("dollars", F.col("__nano") / NANO).drop("__most", "__upto", "__nano")


def _kept(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def verified(asked: DataFrame, generator: Generator, model: str, verifier: Generator | None = None, ceiling: float = 0.0, spent: float = 0.0, key: str = "qid", meter: Meter | None = None) -> DataFrame:
    """Answers as ``metered`` gives them, then checked: adds ``draft, revised, verifier_error``. ``asked``: ``key`` (unique), ``sources``, ``messages``.

    Answers with sources that aren't refusals or errors go to the verifier, under what
    the drafts left of the ceiling. The draft is shipped where its reply fails, has no
    answer or is a refusal. Tokens and dollars of both calls are summed.
    """
    drafts = metered(asked, generator, model, ceiling, spent, meter=meter)
    if verifier is None:
        return drafts.withColumns({"draft": F.lit(""), "revised": F.lit(False), "verifier_error": F.lit(None).cast("string")})
    cost = drafts.agg(F.sum("dollars")).first()[0] or 0.0
    worth = F.col("error").isNull() & (F.col("sources") > 0) & ~text.refused(F.col("answer"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shown = F.concat(F.element_at("messages", -1)["content"], F.lit("\n\n# DRAFT\n\n"), F.col("answer"))
    checks = drafts.where(worth).select(F.col(key).alias("__key"), F.array(message("system", F.lit(VERIFY)), message("user", shown)).alias("messages"))
    names = ("answer", "error", *_COUNTS, "generate_ms", "dollars")
    said = metered(checks, verifier, model, ceiling, spent + cost, meter=meter).select("__key", *(F.col(c).alias(f"__{c}") for c in names))
    rows = drafts.join(said, drafts[key] == said["__key"], "left")
    decided = F.when(F.col("__answer") != "", text.verify_decide(F.col("answer"), F.col("__answer")))
    both = {c: F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in (*_COUNTS, "generate_ms", "dollars")}
    rows = rows.withColumn("__d", decided).withColumns({
        **both, "draft": F.when(F.col("__key").isNotNull(), F.col("answer")).otherwise(""), "verifier_error": F.col("__error"),
        "answer": F.coalesce(F.col("__d.answer"), F.col("answer")), "revised": F.coalesce(F.col("__d.revised"), F.lit(False)),
    })
    return rows.drop("__d", "__key", *(f"__{c}" for c in names))


def ledger(answered: DataFrame, what: str) -> DataFrame:
    """``at, dollars, what``: ledger rows of the calls that cost something."""
    return answered.where("dollars > 0").select(F.current_timestamp().alias("at"), "dollars", F.lit(what).alias("what"))


def estimate(tokens: DataFrame, model: str, questions: int, measured: bool) -> dict[str, object]:
    """What so many questions will cost and what that rests on, from one row of mean tokens as ``tokens_per_question`` gives it."""
    row = tokens.withColumn("d", dollars(F.col("prompt_tokens"), F.col("cached_tokens"), F.col("completion_tokens"), F.lit(model))).first()
    basis = f"{row['prompt_tokens']} prompt and {row['completion_tokens']} completion tokens a question, " + (f"as in the newest run of {model}" if measured else f"a usual figure: no run of {model} is there")
    return {"dollars": round(questions * row["d"], 4), "questions": questions, "model": model, "basis": basis}


def spent_by(answered: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``calls, refused, failed, dollars`` for each group, or for all rows."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    stopped = F.col("error").startswith("CeilingExceeded")
    called = ~F.coalesce(stopped, F.lit(False))
    return answered.groupBy(*by).agg(count(called)("calls"), count(F.coalesce(stopped, F.lit(False)))("refused"), count(called & F.col("error").isNotNull())("failed"), F.round(F.sum("dollars"), 9).alias("dollars"))
