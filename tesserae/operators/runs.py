"""Evaluation runs: questions answered as one plan, their records, and the folders that hold them."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import text
from tesserae.operators import answers, evaluation
from tesserae.sources import schemas as S
from tesserae.sources import tables
from tesserae.sources.seams import Generator

K = 5
DIGITS = 4
#: What a metered or verified answer tells a record beside its text, error and time.
ANSWERED = ("draft", "revised", "first_token_ms", "prompt_tokens", "completion_tokens", "cached_tokens")


def run_id(now: dt.datetime | None = None) -> str:
    """The minute of a run, in UTC."""
    return (now or dt.datetime.now(dt.UTC)).astimezone(dt.UTC).strftime("%Y-%m-%dT%H%MZ")


def retrieved(ranked: DataFrame, with_text: int = K) -> DataFrame:
    """``qid, retrieved``: ranked rows as a record keeps them, scores rounded, the text of the first ``with_text`` alone."""
    have = set(ranked.columns)
    score = lambda c: (F.round(c, DIGITS) if c in have else F.lit(None)).cast("double").alias(c)
    row = F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"),
        F.col("title").alias("source"), score("score"), F.when(F.col("rank") <= with_text, F.col("text")).alias("text"), score("rerank_score"), score("sparse_score"),
    )
    return ranked.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("retrieved"))


def answered(rows: DataFrame, generator: Generator, messages: str = "messages") -> DataFrame:
    """Add ``answer, error, generate_ms``; a call that fails is recorded with its row, and the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for turns in frame[messages]:
                began, answer, error = time.perf_counter(), "", None
                try:
                    answer = generator.complete([{"role": m["role"], "content": m["content"]} for m in turns])
                except Exception as e:  # noqa: BLE001  the record tells what went wrong
                    error = f"{type(e).__name__}: {e}"
                out.append((answer, error, 1000 * (time.perf_counter() - began)))
            yield frame.assign(answer=[o[0] for o in out], error=[o[1] for o in out], generate_ms=[o[2] for o in out])

    more = [T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), T.StructField("generate_ms", T.DoubleType())]
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *more]))


def citations(found: Column, numbers: Column) -> Column:
    """Numbers cited, with the documents that bear them in a recorded list."""
    row = lambda n: F.element_at(found, n)
    return F.transform(numbers, lambda n: F.struct(n.cast("int").alias("number"), row(n)["doc_id"].alias("doc_id"), row(n)["source"].alias("source")))


def as_records(questions: DataFrame, ranked: DataFrame, with_text: int = K) -> DataFrame:
    """Records of a search alone, with the fields that metrics read and no answer. ``questions``: as ``schemas.QUESTION``."""
    found = retrieved(ranked, with_text)
    rows = questions.join(found, questions["id"] == found["qid"], "left")
    own = {
        "question_id": F.col("id"), "question": F.col("text"), "kind": F.col("kind"), "expected_doc_ids": F.col("expected"), "expected_answers": F.col("expected_answer"),
        "retrieved": F.col("retrieved"), "history": F.col("history"), "suite": F.col("suite"),
    }
    fields = questions.sparkSession.createDataFrame([], S.RECORD).schema.fields
    return tables.with_defaults(rows.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)))


def run_all(
    questions: DataFrame, ranked: DataFrame, generator: Generator, system: str = "", model: str = "", k: int = K, answer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """A record for each question: one ranked list (``qid, rank, id, doc_id, page_id, title, text, score``), answered from its first ``k`` rows.

    ``answer`` takes the place of plain calls: it adds ``answer, error, generate_ms`` and what
    else a record has (tokens, draft, revised) to rows of ``qid, sources, messages``.
    """
    records = as_records(questions, ranked, k)
    asked = answers.prompts(questions.select(F.col("id").alias("qid"), "text"), ranked, k)
    asked = asked.select("qid", "sources", answers.messages(F.col("prompt"), system).alias("messages"))
    said = (answer(asked) if answer else answered(asked, generator)).drop("messages")
    more = [c for c in said.columns if c in ANSWERED]
    said = said.withColumnsRenamed({"answer": "__answer", "error": "__error", "generate_ms": "__ms"} | {c: f"__{c}" for c in more})
    rows = records.join(said, records["question_id"] == said["qid"])
    answer, sources = F.col("__answer"), F.col("sources")
    rows = rows.withColumns({c: F.col(f"__{c}") for c in more} | {
        "answer": answer, "error": F.col("__error"), "generate_ms": F.col("__ms"), "total_ms": F.col("__ms"), "sources_sent": sources.cast("int"), "generation_model": F.lit(model),
        "markers_found": text.markers(answer).cast("array<int>"), "citations": citations(F.col("retrieved"), text.cited(answer, sources)),
    })
    return rows.select(*records.columns)


def sources_block(found: Column, sent: Column) -> Column:
    """The numbered blocks that an answer was given, from the recorded rows that carry their text."""
    shown = F.filter(found, lambda r: (r["rank"] <= sent) & r["text"].isNotNull())
    return F.array_join(F.transform(shown, lambda r: answers.source_block(r["rank"], r["source"], r["text"])), "\n\n")


def generation_outcome(reply: Column, question: Column, source: Column) -> Column:
    """What became of a question that a model was asked for: failed (no reply), skipped (it says so), rejected or accepted."""
    return F.when(reply.isNull(), "failed").when(text.strip(reply).startswith("SKIP"), "skipped").when(text.usable(question, source), "accepted").otherwise("rejected")


def from_cache(hits: DataFrame) -> DataFrame:
    """Stored answers given to new questions: the question replaced, its source told, no tokens spent, stored citations kept. Needs ``asked, question`` beside a record's fields."""
    none = F.lit(0).cast("long")
    return hits.withColumns({"cached_from": F.col("question"), "question": F.col("asked"), "prompt_tokens": none, "completion_tokens": none, "cached_tokens": none, "first_token_ms": F.lit(0.0), "revised": F.lit(False)}).drop("asked")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at  # noqa: SLF001


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def transcript(records: DataFrame) -> DataFrame:
    """``question_id, text``: each record for a reader, its question, verdict, answer, what was revised, and the ranked list with the expected documents marked."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label:<10}"), c))
    hit = lambda r: F.when(F.array_contains("expected_doc_ids", r["doc_id"]), "*").otherwise(" ")
    score = lambda r: F.coalesce(F.format_number(r["score"], DIGITS), F.lit("-"))
    ranked = F.transform("retrieved", lambda r: F.concat(hit(r), F.lpad(r["rank"].cast("string"), 4, " "), F.lit("  "), F.lpad(score(r), 10, " "), F.lit("  "), F.coalesce(r["doc_id"], F.lit("")), F.lit("  "), F.coalesce(r["source"], F.lit(""))))
    cited = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c["number"].cast("string"), F.lit("] "), F.coalesce(c["source"], F.lit("?")))), ", ")
    verdict = evaluation.verdict(records)
    parts = [
        F.concat(F.lit("## "), F.col("question_id"), F.lit(" ("), F.coalesce("kind", F.lit("")), F.lit(")")), line("question", F.col("question")),
        F.when(F.coalesce("standalone", F.lit("")) != F.coalesce("question", F.lit("")), line("asked as", F.col("standalone"))),
        line("verdict", verdict), line("error", F.col("error")), line("answer", F.col("answer")), F.when(F.col("revised"), line("draft", F.col("draft"))), line("cited", cited), F.array_join(ranked, "\n"),
    ]
    return records.select("question_id", F.array_join(F.array_compact(F.array(*parts)), "\n").alias("text"))


def write_run(root: str, meta: DataFrame, records: DataFrame, summary: str = "") -> str:
    """Write a run's folder, named by its id: records, their transcript, summary, meta. One that is there is never overwritten. ``meta`` has one row, and comes last, so a folder without it is no run."""
    spark = meta.sparkSession
    path = f"{root}/{meta.first()['run_id']}"
    if _exists(spark, path):
        raise FileExistsError(path)
    tables.write_jsonl(records, f"{path}/records", "errorifexists")
    transcript(tables.read_jsonl(spark, f"{path}/records", S.RECORD).transform(tables.with_defaults)).select("text").write.text(f"{path}/transcript", lineSep="\n\n")
    spark.createDataFrame([(line,) for line in summary.split("\n")], "value string").coalesce(1).write.text(f"{path}/summary")
    tables.write_jsonl(meta.coalesce(1), f"{path}/meta", "errorifexists")
    return path


def list_runs(spark: SparkSession, root: str) -> list[str]:
    """Ids of the runs below a folder, the newest first; a folder is a run if it has both meta and records."""
    fs, at = _folder(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted((n for n in names if _exists(spark, f"{root}/{n}/meta/_SUCCESS") and _exists(spark, f"{root}/{n}/records/_SUCCESS")), reverse=True)


def read_run(spark: SparkSession, root: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Meta and records of a listed run; an id is looked up in the list, never made part of a path unseen."""
    if run not in list_runs(spark, root):
        raise LookupError(f"no run {run!r}")
    return tables.read_jsonl(spark, f"{root}/{run}/meta", S.META), tables.with_defaults(tables.read_jsonl(spark, f"{root}/{run}/records", S.RECORD))


def last_run_with(spark: SparkSession, root: str, model: str) -> str | None:
    """Id of the newest run whose first record (of the least ``question_id``) names the model, from one scan of all runs' records; None without one."""
    if not (listed := list_runs(spark, root)):
        return None
    rows = spark.read.schema("question_id string, generation_model string").json([f"{root}/{n}/records" for n in listed])
    rows = rows.withColumn("run_id", F.element_at(F.split("_metadata.file_path", "/"), -3))
    firsts = rows.groupBy("run_id").agg(F.min_by("generation_model", "question_id").alias("model"))
    return firsts.where(F.col("model") == model).agg(F.max("run_id")).first()[0]


def runs_before(asked: DataFrame, runs: DataFrame, key: str = "generation_model") -> DataFrame:
    """``asked`` (``key, at``) with ``run_id``: the newest of ``runs`` (``run_id, key, at``) of the same model from before ``at``, of several at one time the greatest id.

    A day's rows are ordered together, and only a day's last run goes to the days after
    it, so a model with most of the rows is many tasks' work. Null keys are alike, rows
    without a time find none and are found by none.
    """
    own = F.struct(*asked.columns).alias("__asked")
    none = F.lit(None)
    run = F.struct("at", "run_id")
    both = asked.select(F.col(key).alias("__key"), F.col("at").alias("__at"), F.lit(0).alias("__side"), own, none.cast(runs.select(run).schema[0].dataType).alias("__run"))
    rest = runs.where("at is not null").select(F.col(key).alias("__key"), F.col("at").alias("__at"), F.lit(1).alias("__side"), none.cast(asked.select(own).schema[0].dataType).alias("__asked"), run.alias("__run"))
    rows = both.unionByName(rest).withColumn("__day", F.to_date("__at"))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    within = F.last("__run", ignorenulls=True).over(upto(W.partitionBy("__key", "__day").orderBy("__at", "__side", "__run.run_id")))
    days = rows.groupBy(F.col("__key").alias("__k"), F.col("__day").alias("__d")).agg(F.max("__run").alias("__last"))
    days = days.select("__k", "__d", F.last("__last", ignorenulls=True).over(upto(W.partitionBy("__k").orderBy("__d"))).alias("__before"))
    rows = rows.withColumn("__found", within).where("__side = 0")
    found = rows.join(days, rows["__key"].eqNullSafe(days["__k"]) & rows["__day"].eqNullSafe(days["__d"]), "left")
    best = F.when(F.col("__at").isNotNull(), F.coalesce(F.col("__found.run_id"), F.col("__before.run_id")))
    return found.select("__asked.*", best.alias("run_id"))


def generation_report(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """``accepted, skipped, rejected, failed`` of questions that a model was asked for, zeros included."""
    return outcomes.agg(*(F.count_if(F.col(outcome) == o).alias(o) for o in ("accepted", "skipped", "rejected", "failed")))
