"""Evaluation analytics over run records: metrics, grouped summaries, gates, sweeps, timelines, costs, probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.session import few, sent

EPSILON = 1e-9
# Fields of a run that change what its numbers mean, and what a gate lets pass.
COMPARABLE = (
    "embedding_model", "generation_model", "collection", "points", "k", "max_per_document", "max_per_article", "overfetch", "reranker", "hybrid",
    "verifier", "temporal", "conversation",
)
TOP_SCORE_FLOOR, LATENCY_FLOOR = 0.001, 900.0
UNSUPPORTED_FLOOR, FAITHFULNESS_FLOOR, FULLY_FLOOR, CLAIMS_FLOOR = 4, 0.007, 2, 35
# Dollars for a million prompt, cached and completion tokens.
PRICES = {"gpt-4.1-mini": (0.40, 0.10, 1.60), "gpt-4.1-nano": (0.10, 0.025, 0.40), "gpt-4.1": (2.00, 0.50, 8.00), "gpt-4o-mini": (0.15, 0.075, 0.60)}
DEFAULT_MODEL = "gpt-4.1-mini"
FALLBACK_TOKENS = (2620, 182, 0)
#: What each metric must do: stay up, stay down, stay, or be reported; with its floor.
RULES = (
    ("recall_at_5", "no drop", 0.0), ("recall_at_20", "no drop", 0.0), ("coverage_at_5", "no drop", 0.0), ("mrr", "no drop", 0.0), ("fact_rate", "no drop", 0.0),
    ("mean_top_score", "no drop", TOP_SCORE_FLOOR), ("refusals", "no change", 0.0), ("answers_with_invalid_marker", "no rise", 0.0),
    ("answers_with_no_citation", "no rise", 0.0), ("errors", "no rise", 0.0), ("p50_total_ms", "reported", LATENCY_FLOOR), ("p50_first_token_ms", "reported", LATENCY_FLOOR),
)


def within(depth: int) -> Column:
    return F.filter("retrieved", lambda r: r["rank"] <= depth)


def expected_at(depth: int) -> Column:
    return F.filter(within(depth), lambda r: F.array_contains("expected_doc_ids", r["doc_id"]))


def hit_at(depth: int) -> Column:
    return F.size(expected_at(depth)) > 0


def coverage_at(depth: int) -> Column:
    """Share of the expected list, repeats counted, that is found; 0 without a key."""
    found = F.transform(within(depth), lambda r: r["doc_id"])
    n = F.size("expected_doc_ids")
    return F.when(n > 0, F.size(F.filter("expected_doc_ids", lambda d: F.array_contains(found, d))) / n).otherwise(F.lit(0.0))


def first_hit_rank() -> Column:
    return F.array_min(F.transform(F.filter("retrieved", lambda r: F.array_contains("expected_doc_ids", r["doc_id"])), lambda r: r["rank"]))


def reciprocal_rank() -> Column:
    return F.coalesce(F.lit(1.0) / first_hit_rank(), F.lit(0.0))


def distinct_at(depth: int, field: str) -> Column:
    return F.size(F.array_distinct(F.transform(within(depth), lambda r: r[field])))


def measured(records: DataFrame) -> DataFrame:
    """Records with their own metrics; all row by row."""
    keyed, facts = F.size("expected_doc_ids") > 0, F.size("expected_answers") > 0
    refused = text.refused(F.col("answer"))
    failed = F.coalesce("error", F.lit("")) != ""
    return records.select(
        "*", F.when(keyed, hit_at(5).cast("double")).alias("m_hit5"), F.when(keyed, hit_at(20).cast("double")).alias("m_hit20"), F.when(keyed, coverage_at(5)).alias("m_cov5"),
        F.when(keyed, reciprocal_rank()).alias("m_rr"), F.when(facts, text.states_fact(F.col("answer"), F.col("expected_answers")).cast("double")).alias("m_fact"),
        F.when(F.size("retrieved") > 0, F.element_at(F.array_sort(F.transform("retrieved", lambda r: F.struct(r["rank"], r["score"]))), 1)["score"]).alias("m_top"),
        distinct_at(5, "doc_id").alias("m_docs5"), distinct_at(5, "page_id").alias("m_pages5"), refused.cast("int").alias("m_refused"),
        ((F.size("citations") == 0) & ~refused & ~failed).cast("int").alias("m_uncited"),
        (F.size(text.invalid_markers(F.col("markers_found"), F.col("sources_sent"))) > 0).cast("int").alias("m_invalid"), failed.cast("int").alias("m_error"),
        F.coalesce("first_token_ms", "total_ms").alias("m_first"),
    )


def nearest(values: Column, fraction: float) -> Column:
    """The value at ``round(fraction * n)``, halves to even, of an array; 0 for none."""
    n = F.size(values)
    at = F.greatest(F.lit(1), F.least(n, F.bround(F.lit(fraction) * n).cast("int")))
    return F.when(n > 0, F.element_at(F.array_sort(values), at)).otherwise(F.lit(0.0))


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """The same for large groups: counts of distinct values, combined before the shuffle, then their running sums."""
    w = W.partitionBy(*by)
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    counts = counts.withColumns({"__upto": F.sum("__n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "__all": F.sum("__n").over(w)})
    at = lambda f: F.greatest(F.lit(1), F.least("__all", F.bround(F.lit(f) * F.col("__all")).cast("long")))
    return counts.groupBy(*by).agg(*(F.min(F.when(F.col("__upto") >= at(f), F.col(value))).alias(f"p{round(f * 100)}") for f in fractions))


def summarise(records: DataFrame, sets: Sequence[Sequence[str]] = (("kind",), ())) -> DataFrame:
    """A row for each group of each grouping set; a column that a set leaves out is "all". Records are as many as questions."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    mean = lambda c: F.avg(c)
    aggs = [
        F.count("*").alias("questions"), mean("m_hit5").alias("recall_at_5"), mean("m_hit20").alias("recall_at_20"), mean("m_cov5").alias("coverage_at_5"), mean("m_rr").alias("mrr"),
        mean("m_fact").alias("fact_rate"), F.count("m_fact").alias("fact_questions"), F.coalesce(mean("m_top"), F.lit(0.0)).alias("mean_top_score"),
        mean("m_docs5").alias("mean_distinct_docs_at_5"), mean("m_pages5").alias("mean_distinct_articles_at_5"), mean("m_refused").alias("refusal_rate"),
        F.sum("m_refused").alias("refusals"), F.sum("m_uncited").alias("answers_with_no_citation"), F.sum("m_invalid").alias("answers_with_invalid_marker"),
        nearest(F.collect_list("total_ms"), 0.5).alias("p50_total_ms"), nearest(F.collect_list("total_ms"), 0.95).alias("p95_total_ms"),
        nearest(F.collect_list("m_first"), 0.5).alias("p50_first_token_ms"), mean("search_ms").alias("mean_search_ms"), mean("generate_ms").alias("mean_generate_ms"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("m_error").alias("errors"),
    ]
    rows = measured(records)
    if not columns:
        return rows.agg(*aggs)
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns))
    out = grouped.agg(*(F.grouping(c).alias(f"__g_{c}") for c in columns), *aggs)
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"__g_{c}") == 1, F.lit("all")).otherwise(F.col(c)))
    return out.orderBy(*(x for c in columns for x in (f"__g_{c}", c))).drop(*(f"__g_{c}" for c in columns))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``qid, id`` of documents that hold a whole passage. Its longest inner token fetches candidates; those alone are searched."""
    inner = lambda t: F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0)))
    keys = F.transform(inner(text.tokenize(F.col("text"))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    asked = passages.select("qid", F.col("text").alias("passage"), F.array_max(keys)["w"].alias("term"))
    small = few(asked)
    put = F.broadcast if small else (lambda x: x)
    rows = docs.select("id", "text", F.explode(F.array_distinct(text.tokenize(F.col("text")))).alias("term")).join(put(asked.where("term is not null")), "term")
    found = rows.where(F.contains("text", F.col("passage"))).select("qid", "id")
    rest = asked.where("term is null")
    return found if rest.isEmpty() else found.unionByName(docs.join(put(rest), F.contains("text", F.col("passage"))).select("qid", "id"))


def copied(docs: DataFrame, questions: DataFrame, window: int = text.COPY_WINDOW) -> DataFrame:
    """``qid, id`` of documents that hold ``window`` words of a question in a row, as ``text.copies_source`` sees it.

    A run's first and last word may end inside a document's, the others are whole
    there: those fetch candidates, which alone are searched. ``docs``: id, text;
    ``questions``: qid, text.
    """
    inner = window - 2
    runs = lambda words, n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, inner))))
    asked = questions.select("qid", F.col("text").alias("question")).withColumn("__w", text.words_ascii(F.col("question")))
    whole = asked.select("qid", "question")
    keys = asked.select("qid", F.explode(F.array_distinct(runs(F.slice("__w", 2, F.greatest(F.size("__w") - 2, F.lit(0))), inner))).alias("run"))
    there = docs.select("id", text.words_ascii(F.col("text")).alias("__w")).select("id", F.explode(F.array_distinct(runs(F.col("__w"), inner))).alias("run"))
    pairs = there.join(sent(keys), "run").select("qid", "id").distinct()
    rows = docs.select("id", "text").join(pairs, "id").join(sent(whole), "qid")
    return rows.where(text.copies_source(F.col("question"), F.col("text"), window)).select("qid", "id")


def _unpivot(row: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    values = [F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value"), F.col(n).cast("string").try_cast("double").alias("number")) for n in names]
    return row.select(*keys, F.explode(F.array(*values)).alias("x")).select(*keys, "x.*")


def comparable(baseline: DataFrame, candidate: DataFrame, changed: Sequence[str] = ()) -> DataFrame:
    """``name, baseline, candidate, rule, status`` of each field of two runs' meta rows: equal, or declared and different."""
    sides = [_unpivot(x, COMPARABLE).select("name", F.col("value").alias(n)) for x, n in ((baseline, "baseline"), (candidate, "candidate"))]
    rows = sides[0].join(sides[1], "name", "full")
    declared, same = F.col("name").isin(*changed) if changed else F.lit(False), F.col("baseline").eqNullSafe(F.col("candidate"))
    status = F.when(declared & same, "fail").when(declared, "warn" if len(changed) > 1 else "pass").when(same, "pass").otherwise("fail")
    return rows.select("name", "baseline", "candidate", F.when(declared, "declared changed").otherwise("equal").alias("rule"), status.alias("status"))


def gate(baseline: DataFrame, candidate: DataFrame, key: str = "suite") -> DataFrame:
    """``suite, name, baseline, candidate, rule, status`` of each metric rule, for the suites of the baseline."""
    names = [n for n, *_ in RULES]
    sides = [_unpivot(x, names, [key]).select(key, "name", F.col("number").alias(n)) for x, n in ((baseline, "baseline"), (candidate, "candidate"))]
    rows = sides[0].join(sides[1], [key, "name"], "left")
    rule = F.element_at(F.create_map(*(F.lit(x) for n, r, f in RULES for x in (n, r))), F.col("name"))
    floor = F.element_at(F.create_map(*(F.lit(x) for n, r, f in RULES for x in (n, f))), F.col("name"))
    a, b = F.col("baseline"), F.col("candidate")
    bad = F.when(rule == "no drop", a - b > floor + EPSILON).when(rule == "no rise", b - a > floor + EPSILON).when(rule == "no change", a != b)
    missing = a.isNull() | b.isNull()
    status = F.when(rule == "reported", "report").when(missing, F.when(a.isNull() & b.isNull(), "pass").otherwise("fail")).when(bad, "fail").otherwise("pass")
    return rows.select(key, "name", "baseline", "candidate", rule.alias("rule"), status.alias("status"))


def sweep(pools: DataFrame, configs: DataFrame, keys: DataFrame, k: int = 20, asked: DataFrame | None = None) -> DataFrame:
    """Recall at 5 and 20 and MRR of each fusion config over pools that were fetched once.

    ``pools``: qid, id, rank, arm (0 dense, 1 sparse); ``configs``: config, weight,
    rrf_k; ``keys``: qid, id. Weight 0 leaves the dense order. With ``asked``, the qid
    of every question that has a key, ``keys`` need only hold those in the pools.
    """
    rows = pools.join(sent(configs))  # as many copies of the pools as there are configs
    w = F.when(F.col("arm") == 0, F.lit(1.0)).otherwise(F.col("weight"))
    fused = rows.groupBy("config", "qid", "id").agg(F.round(F.sum(w / (F.col("rrf_k") + F.col("rank"))), 9).alias("fused"), F.min(F.struct("arm", "rank")).alias("tie"))
    order = W.partitionBy("config", "qid").orderBy(F.desc("fused"), "tie", "id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    hits = ranked.join(keys, ["qid", "id"]).groupBy("config", "qid").agg(F.min("rank").alias("first"))
    asked = (keys if asked is None else asked).select("qid").distinct().join(sent(configs.select("config")))
    each = asked.join(hits, ["config", "qid"], "left")
    share = lambda d: F.avg((F.coalesce("first", F.lit(10**6)) <= d).cast("double"))
    return each.groupBy("config").agg(F.count("*").alias("questions"), share(5).alias("recall_at_5"), share(20).alias("recall_at_20"), F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"))


def control_matches(control: float | None, recorded: float | None, tolerance: float = 1e-6) -> bool:
    return control is not None and recorded is not None and abs(control - recorded) <= tolerance


def stage_shares(spans: DataFrame) -> DataFrame:
    """``name, depth, records, median_ms, median_share``: of each stage over the records that ran it, against their top-level time.

    ``spans``: question, name, depth, ms.
    """
    each = spans.groupBy("question", "name", "depth").agg(F.sum("ms").alias("ms"))
    total = spans.where("depth = 0").groupBy("question").agg(F.sum("ms").alias("total"))
    rows = each.join(total, "question").withColumn("share", F.when(F.col("total") > 0, F.col("ms") / F.col("total")).otherwise(F.lit(0.0)))
    return rows.groupBy("name", "depth").agg(F.count("*").alias("records"), F.percentile("ms", F.lit(0.5)).alias("median_ms"), F.percentile("share", F.lit(0.5)).alias("median_share"))


def unattributed(records: DataFrame) -> DataFrame:
    """Time of a record that no top-level span explains. ``records``: question, total_ms, spans."""
    spent = F.aggregate(F.filter("spans", lambda s: s["depth"] == 0), F.lit(0.0), lambda a, s: a + s["ms"])
    return records.select("question", (F.col("total_ms") - spent).alias("unattributed_ms"))


def replay_diff(recorded: DataFrame, fresh: DataFrame) -> DataFrame:
    """``qid, changed_ranks, only_recorded, only_fresh`` of two ranked lists."""
    both = recorded.select("qid", "rank", F.col("id").alias("old")).join(fresh.select("qid", "rank", F.col("id").alias("new")), ["qid", "rank"], "full")
    rows = both.groupBy("qid").agg(F.sum((~F.col("old").eqNullSafe(F.col("new"))).cast("long")).alias("changed_ranks"), F.collect_set("old").alias("old"), F.collect_set("new").alias("new"))
    gone = lambda a, b: F.size(F.array_except(a, b)).cast("long")
    return rows.select("qid", "changed_ranks", gone("old", "new").alias("only_recorded"), gone("new", "old").alias("only_fresh"))


def dollars(prompt: Column, cached: Column, completion: Column, model: Column) -> Column:
    """Cost of token counts; cached ones are part of the prompt; unknown models cost what the default one does."""
    price = lambda i: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for m, p in PRICES.items() for x in (m, p[i]))), model), F.lit(PRICES[DEFAULT_MODEL][i]))
    fresh = F.greatest(prompt - cached, F.lit(0))
    return (fresh * price(0) + cached * price(1) + completion * price(2)) / 1_000_000


def tokens_per_question(records: DataFrame) -> DataFrame:
    """Mean prompt, completion and cached tokens, halves to even, over records with counts; else the fallback."""
    rows = records.where("prompt_tokens is not null and completion_tokens is not null")
    mean = lambda c, i: F.coalesce(F.bround(F.avg(F.coalesce(c, F.lit(0)))).cast("long"), F.lit(FALLBACK_TOKENS[i]).cast("long")).alias(c)
    return rows.agg(mean("prompt_tokens", 0), mean("completion_tokens", 1), mean("cached_tokens", 2))


def ledger_daily(ledger: DataFrame) -> DataFrame:
    """``day, dollars, calls`` from rows of ``at, dollars``."""
    return ledger.groupBy(F.to_date("at").alias("day")).agg(F.round(F.sum("dollars"), 6).alias("dollars"), F.count("*").alias("calls"))


def admitted(ledger: DataFrame, ceiling: float) -> DataFrame:
    """Whether each call would have been let through: what the day had cost before it is under the ceiling (0 or less: off).

    Minutes are summed where calls lie, a day's 1,440 sums at most are accumulated,
    and calls are accumulated within their minute, so a busy day is many tasks' work.
    Calls without a time are a day of their own.
    """
    rows = ledger.withColumn("__minute", F.date_trunc("minute", "at"))
    w = W.partitionBy(F.to_date("__m")).orderBy("__m").rowsBetween(W.unboundedPreceding, -1)
    minutes = rows.groupBy(F.col("__minute").alias("__m")).agg(F.sum("dollars").alias("__sum")).select("__m", F.coalesce(F.sum("__sum").over(w), F.lit(0.0)).alias("__before"))
    inner = W.partitionBy("__minute").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum("dollars").over(inner), F.lit(0.0))).join(minutes, F.col("__minute").eqNullSafe(F.col("__m")), "left")
    rows = rows.withColumn("spent_before", F.round(F.col("__before") + F.col("__own"), 6)).drop("__minute", "__m", "__before", "__own")
    return rows.withColumn("admitted", F.lit(ceiling <= 0) | (F.col("spent_before") < ceiling))


def faithfulness(claims: DataFrame) -> DataFrame:
    """``answers, claims, unsupported, mean_faithfulness, fully_faithful`` from rows of ``answer, supported`` (null: not judged)."""
    judged = claims.where("supported is not null").groupBy("answer").agg(F.avg(F.col("supported").cast("double")).alias("score"), F.count("*").alias("n"), F.sum((~F.col("supported")).cast("long")).alias("bad"))
    return judged.agg(F.count("*").alias("answers"), F.sum("n").alias("claims"), F.sum("bad").alias("unsupported"), F.avg("score").alias("mean_faithfulness"), F.sum((F.col("score") >= 1.0 - EPSILON).cast("long")).alias("fully_faithful"))


def skip_reason(error: Column, answer: Column, sources: Column, claims: Column) -> Column:
    """Why an answer isn't judged, or null, asked in this order."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "generation error").when(text.refused(answer), "refusal").when(F.coalesce(sources, F.lit("")) == "", "no source text recorded")
        .when(claims.isNull(), "judge failed").when(F.size(claims) == 0, "no factual claims")
    )


def sample_chunks(chunks: DataFrame, n: int = 150, seed: int = 1, least: int = 400) -> DataFrame:
    """One chunk of each article with enough text, ``n`` of them; a hash of id and seed chooses and orders."""
    rows = chunks.where(F.length("text") >= least).withColumn("pick", F.md5(F.concat_ws("/", F.col("chunk_id").cast("string"), F.lit(str(seed)))))
    one = rows.groupBy("page_id").agg(F.min(F.struct("pick", "chunk_id")).alias("x")).select("page_id", "x.*")
    return one.orderBy("pick", "chunk_id").limit(n)


def choose_threshold(pairs: DataFrame, margin: float = 0.005) -> DataFrame:
    """Threshold above the worst near miss of the tuning pairs, and hit and leak rates on the test pairs. ``pairs``: set, paraphrase, negative."""
    at = F.round(F.max(F.when(F.col("set") == "tune", F.col("negative"))) + margin, 4)
    limit = pairs.agg(at.alias("threshold"))
    rows = pairs.where(F.col("set") == "test").join(F.broadcast(limit))
    rate = lambda c: F.avg((F.col(c) >= F.col("threshold")).cast("double"))
    return rows.agg(F.first("threshold").alias("threshold"), rate("paraphrase").alias("hit_rate"), rate("negative").alias("leak_rate"))


def split_check(claims: Column, require: Column, forbid: Column, min_claims: Column, expect_none: Column) -> Column:
    """Whether claims keep a splitting rule: ``when`` implies ``then`` in each claim, nothing forbidden, enough of them (or none)."""
    kept = F.forall(require, lambda r: F.forall(claims, lambda c: ~F.regexp_like(c, r["when"]) | F.regexp_like(c, r["then"])))
    clean = F.forall(forbid, lambda p: ~F.exists(claims, lambda c: F.regexp_like(c, p)))
    return F.when(expect_none, F.size(claims) == 0).otherwise(kept & clean & (F.size(claims) >= min_claims))


def verdict(records: DataFrame) -> Column:
    """``HIT at r``, ``MISS``, or for questions without a key ``REFUSED`` or ``ANSWERED (expected refusal)``."""
    keyed = F.size("expected_doc_ids") > 0
    rank = first_hit_rank()
    return F.when(keyed & rank.isNotNull(), F.concat(F.lit("HIT at "), rank.cast("string"))).when(keyed, "MISS").when(text.refused(F.col("answer")), "REFUSED").otherwise("ANSWERED (expected refusal)")


def question_violations(questions: DataFrame) -> DataFrame:
    """Questions that break a rule: answerable ones need a key, others must have none, history belongs to one suite, ids are unique."""
    questions = questions.withColumn("__n", F.count("*").over(W.partitionBy("id")))
    n = F.col("__n")
    keyed = F.size(F.coalesce("expected", F.array().cast("array<string>"))) > 0
    talks = F.size(F.coalesce("history", F.array().cast(dict(questions.dtypes)["history"]))) > 0
    rules = F.array(
        F.when((F.col("kind") != "unanswerable") & ~keyed, F.lit("no key")), F.when((F.col("kind") == "unanswerable") & keyed, F.lit("key of an unanswerable question")),
        F.when((F.col("suite") == "conversation") != talks, F.lit("history")), F.when(n > 1, F.lit("id not unique")),
        F.when(F.exists(F.coalesce("expected", F.array().cast("array<string>")), lambda d: ~d.rlike(r"^\d+:\d+$")), F.lit("document id")),
    )
    return questions.withColumn("rule", F.explode(F.array_compact(rules))).drop("__n")


def question_counts(questions: DataFrame) -> DataFrame:
    """``suite, kind, questions``: of each suite and kind, of each suite (``kind`` "all") and of all."""
    rows = questions.groupingSets([["suite", "kind"], ["suite"], []], "suite", "kind").agg(F.count("*").alias("questions"), F.grouping("suite").alias("__s"), F.grouping("kind").alias("__k"))
    every = lambda c, g: F.when(F.col(g) == 1, "all").otherwise(F.col(c)).alias(c)
    return rows.select(every("suite", "__s"), every("kind", "__k"), "questions")


def probe_table(verdicts: DataFrame) -> DataFrame:
    """``probe, cases, passed, right, unread, complete`` from a judge's verdicts: ``probe, expect, got`` (null: not read).

    A probe passes if every verdict is as expected and both kinds were expected of it:
    a judge that always says the same would pass half a probe.
    """
    right = F.coalesce(F.col("got") == F.col("expect"), F.lit(False))
    rows = verdicts.groupBy("probe").agg(F.count("*").alias("cases"), F.count_if(right).alias("right"), F.count_if(F.col("got").isNull()).alias("unread"), (F.count_if("expect") * F.count_if(~F.col("expect")) > 0).alias("complete"))
    return rows.select("probe", "cases", (F.col("complete") & (F.col("right") == F.col("cases"))).alias("passed"), "right", "unread", "complete")
