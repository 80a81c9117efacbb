"""Command line over the library: ``python -m tesserae.cli COMMAND ...``.

Models and services are the offline stand-ins of ``sources.seams``, unless a
caller of ``main`` passes its own.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import corpus, reports, runs
from tesserae.operators import evaluation as E
from tesserae.operators import retrieval as R
from tesserae.plans import stack
from tesserae.session import session
from tesserae.settings import Settings
from tesserae.sources import schemas as S
from tesserae.sources import seams, tables

#: Arguments of each command by place; those by name are below.
COMMANDS = {
    "curate": ("links", "seeds", "out"), "ingest": ("registry", "bronze", "pages"), "silver": ("bronze", "out"), "chunk": ("silver", "out"), "index": ("gold", "out"),
    "evaluate": ("index", "questions", "runs"), "rescore": ("records",), "trace": ("records",), "gate": ("baseline", "candidate"), "synthesize": ("gold", "out"),
    "judge": ("judgements",), "judge-probe": ("cases",), "split-probe": ("cases",), "sweep": ("pools", "keys"),
}
OPTIONS = {
    "curate": {"--least": {"type": int, "default": corpus.MIN_SEEDS}},
    "ingest": {"--refresh": {"action": "store_true"}, "--batch": {"type": int, "default": seams.MAX_TITLES}},
    "chunk": {"--size": {"type": int, "default": 1200}, "--overlap": {"type": int, "default": 150}},
    "index": {"--resume": {"action": "store_true"}, "--payload-only": {"action": "store_true"}},
    "evaluate": {"--k": {"type": int}, "--hybrid": {"action": "store_true"}, "--temporal": {"action": "store_true"}, "--note": {"default": ""}},
    "gate": {"--changed": {"nargs": "*", "default": []}},
    "trace": {"--question": {}},
    "synthesize": {"--count": {"type": int, "default": 150}, "--seed": {"type": int, "default": 1}},
    "sweep": {"--weights": {"type": float, "nargs": "+", "default": [0.0, 0.5, 1.0]}, "--rrf-k": {"type": int, "nargs": "+", "default": [R.RRF_K]}, "--control": {"type": float}},
}
_PAGE = "title string, page_id long, revision_id long, revision_timestamp string, wikitext string"


def _records(spark: SparkSession, path: str) -> DataFrame:
    return tables.with_defaults(tables.read_jsonl(spark, path, S.RECORD))


def _run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    root, _, name = folder.rstrip("/").rpartition("/")
    return runs.read_run(spark, root or ".", name)


def pages_of(spark: SparkSession, path: str) -> seams.FixedSource:
    """A source of the pages of a JSON-lines file that a person keeps: it goes to the tasks whole."""
    return seams.FixedSource({r["title"]: r.asDict() for r in tables.read_jsonl(spark, path, _PAGE).toLocalIterator()})


def build_index(spark: SparkSession, args: argparse.Namespace, embedder: seams.Embedder) -> None:
    """Index all chunks, those that the index lacks (``--resume``), or give known ones their present payload (``--payload-only``)."""
    gold = tables.read_chunks(spark, args.gold)
    if args.payload_only:
        index = spark.read.parquet(args.out)
        fresh = corpus.payload(gold)
        rows = corpus.set_payload(index, fresh, [c for c in fresh.columns if c != "chunk_id"])
        rows.write.mode("overwrite").parquet(args.out.rstrip("/") + ".payload")  # beside it: a table can't replace the one that it is read from
    elif args.resume:
        corpus.build_index(gold, embedder, spark.read.parquet(args.out)).write.mode("append").parquet(args.out)
    else:
        tables.overwrite(corpus.build_index(gold, embedder), args.out)


def evaluate(spark: SparkSession, args: argparse.Namespace, embedder: seams.Embedder, generator: seams.Generator) -> str:
    """Answer a TOML file of questions from the index and write the run's folder."""
    settings = Settings.of(spark)
    given = {"k": args.k, "hybrid": args.hybrid or None, "temporal": args.temporal or None}
    config = stack.RunConfig.of(settings, **{k: v for k, v in given.items() if v is not None})
    questions, index = tables.read_toml(spark, args.questions, "question", S.QUESTION, ("id", "kind", "text"), "id"), spark.read.parquet(args.index)
    if bad := [c for c in stack.preconditions(generator, lambda: index) if not c.ok]:
        raise SystemExit("; ".join(f"{c.name}: {c.detail}" for c in bad))
    if not (broken := E.question_violations(questions)).isEmpty():
        raise SystemExit("; ".join(f"{r['id']}: {r['rule']}" for r in broken.select("id", "rule").collect()))
    records = stack.execute(index, questions, config, embedder, generator, settings, generator).cache()
    summary = reports.summary_text(E.summarise(records, (("kind",), ())))
    meta = stack.meta(spark, config, settings, run_id=runs.run_id(), points=index.count(), note=args.note)
    return f"{runs.write_run(args.runs, meta, records, summary)}\n{summary}"


def judge_probe(cases: DataFrame) -> DataFrame:
    """``cases, right, wrong, unread``: a judge's replies (``reply``) held against what they should say (``supported``)."""
    said = text.parse_verdict(F.col("reply"))["supported"]
    count = lambda c: F.sum(c.cast("long"))
    return cases.agg(F.count("*").alias("cases"), count(said.isNotNull() & (said == F.col("supported"))).alias("right"), count(said.isNotNull() & (said != F.col("supported"))).alias("wrong"), count(said.isNull()).alias("unread"))


def split_probe(cases: DataFrame) -> DataFrame:
    """``id, claims, passed`` of each reply (``reply``) under its rules (``require``, ``forbid``, ``min_claims``, ``expect_none``)."""
    rows = cases.withColumn("__claims", text.parse_claims(F.col("reply")))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    rules = none(F.col("require"), "array<struct<when:string,then:string>>"), none(F.col("forbid"), "array<string>")
    passed = E.split_check(F.col("__claims"), *rules, F.coalesce("min_claims", F.lit(1)), F.coalesce("expect_none", F.lit(False)))
    return rows.select("id", F.size("__claims").alias("claims"), passed.alias("passed"))


def sweep(spark: SparkSession, args: argparse.Namespace) -> int:
    """Every weight with every ``rrf_k`` over pools fetched once; with ``--control``, the dense list alone must give that recall at 5, else nothing of it counts."""
    pools = tables.read_jsonl(spark, args.pools, "qid string, id string, rank int, arm int")
    configs = spark.createDataFrame([(f"w={w},k={k}", w, k) for w in args.weights for k in args.rrf_k], "config string, weight double, rrf_k int")
    rows = E.sweep(pools, configs, tables.read_jsonl(spark, args.keys, "qid string, id string")).cache()
    rows.orderBy(F.desc("recall_at_5"), "config").show(1000, False)
    if args.control is None:
        return 0
    dense = rows.where(F.col("config") == f"w=0.0,k={args.rrf_k[0]}").first()
    return int(not E.control_matches(dense and dense["recall_at_5"], args.control))


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tesserae")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in COMMANDS.items():
        command = commands.add_parser(name)
        for a in places:
            command.add_argument(a)
        for flag, how in OPTIONS.get(name, {}).items():
            command.add_argument(flag, **how)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, embedder: seams.Embedder = seams.HashingEmbedder(), generator: seams.Generator = seams.ExtractiveGenerator()) -> int:
    args = parse(argv)
    spark = session()
    if args.command == "curate":
        links = tables.read_jsonl(spark, args.links, "theme string, seed string, title string")
        entries = corpus.curate(links, tables.read_jsonl(spark, args.seeds, "theme string, seed string"), args.least)
        tables.write_csv(entries.orderBy("theme", "ordinal").select("theme", "title", "seed_count"), args.out)
    elif args.command == "ingest":
        todo = corpus.pending(tables.read_csv(spark, args.registry, S.REGISTRY), tables.scan_bronze(spark, args.bronze), args.refresh, args.batch)
        got = corpus.fetched(todo, pages_of(spark, args.pages)).cache()
        tables.append_bronze(got.where("page_id is not null"), args.bronze)
        tables.write_csv(got.where("page_id is null").select("theme", F.col("requested_title").alias("title"), "fetched_at"), args.bronze.rstrip("/") + ".missing")
        print(corpus.report([("fetched", got.where("page_id is not null").count()), ("missing", got.where("page_id is null").count())]))
    elif args.command == "silver":
        print(corpus.report(corpus.write_silver(tables.scan_bronze(spark, args.bronze), args.out).items()))
    elif args.command == "chunk":
        tables.overwrite(corpus.build_gold(tables.read_documents(spark, args.silver), args.size, args.overlap), args.out)
    elif args.command == "index":
        build_index(spark, args, embedder)
    elif args.command == "evaluate":
        print(evaluate(spark, args, embedder, generator))
    elif args.command == "rescore":
        E.summarise(_records(spark, args.records), (("suite", "kind"), ("suite",), ())).show(1000, False)
    elif args.command == "trace":
        records = _records(spark, args.records)
        if args.question:
            records = records.where(F.col("question_id") == args.question)
        spans = records.select(F.col("question_id").alias("question"), F.explode("trace").alias("t")).select("question", "t.name", "t.depth", "t.ms")
        print(reports.stages_text(E.stage_shares(spans)))
    elif args.command == "gate":
        checks = stack.gated(_run(spark, args.baseline), _run(spark, args.candidate), set(args.changed)).cache()
        print(reports.gate_text(checks))
        return int(not checks.where("status = 'fail'").isEmpty())
    elif args.command == "synthesize":
        tables.overwrite(E.sample_chunks(tables.read_chunks(spark, args.gold), args.count, args.seed), args.out)
    elif args.command == "judge":
        rows = tables.read_jsonl(spark, args.judgements, S.JUDGEMENT).select(F.col("question_id").alias("answer"), F.explode("claims.supported").alias("supported"))
        E.faithfulness(rows).show()
    elif args.command == "judge-probe":
        found = judge_probe(tables.read_jsonl(spark, args.cases, "id string, reply string, supported boolean"))
        found.show()
        return int(found.first()["right"] < found.first()["cases"])
    elif args.command == "split-probe":
        found = split_probe(tables.read_jsonl(spark, args.cases, "id string, reply string, require array<struct<when:string,then:string>>, forbid array<string>, min_claims int, expect_none boolean"))
        found.show(1000, False)
        return int(not found.where("not passed").isEmpty())
    elif args.command == "sweep":
        return sweep(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
