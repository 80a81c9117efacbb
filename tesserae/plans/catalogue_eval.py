"""Catalogue: metrics, summaries, gates, sweeps, timelines, ledgers, prompts, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import answers, runs, spending
from tesserae.operators import evaluation as E
from tesserae.operators import retrieval as R
from tesserae.plans.catalogue import inline, query, values
from tesserae.plans.catalogue_retrieval import BM25, VEC, docs, questions, vector_questions, vectors
from tesserae.session import sent, shared_folder, table
from tesserae.sources import seams


@query("SELECT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q_answer_keys(spark: SparkSession, d: str) -> DataFrame:
    return E.containing(docs(spark, d), questions(spark, d))


KEYS = "keys AS (SELECT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
#: A refusal for every fifth question, else an answer that cites [1] and, every third, [9]; times and tokens told by the number.
ANSWER = "CASE WHEN qid % 5 = 0 THEN 'Not in the sources. Sorry.' WHEN qid % 3 = 0 THEN 'It was 41,291 [1] and [9].' ELSE 'It was ' || qid || ' [1].' END"


def records(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """Run records: BM25 for every question, documents that hold the passage as the key, answers told by the number."""
    ranked = R.bm25_topk(docs(spark, d), questions(spark, d), k)
    found = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("doc_id"), (F.col("id") % 100).alias("page_id"), "score"))).alias("retrieved"))
    keys = E.containing(docs(spark, d), questions(spark, d)).groupBy("qid").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("expected_doc_ids"))
    asked = questions(spark, d).select("qid")
    rows = asked.join(sent(found, asked), "qid", "left").join(sent(keys, asked), "qid", "left")  # a row a question each
    answer = F.expr(ANSWER)
    none = F.array().cast("array<string>")
    return rows.select(
        "qid", F.concat(F.lit("k"), F.col("qid") % 4).alias("kind"), F.concat(F.lit("s"), F.col("qid") % 3).alias("suite"), F.coalesce("expected_doc_ids", none).alias("expected_doc_ids"),
        F.coalesce("retrieved", F.expr("cast(array() as array<struct<rank:int,doc_id:string,page_id:bigint,score:double>>)")).alias("retrieved"), answer.alias("answer"),
        F.when(F.col("qid") % 2 == 0, F.array(F.lit("41291"), F.col("qid").cast("string"))).otherwise(none).alias("expected_answers"), text.markers(answer).alias("markers_found"),
        F.lit(5).alias("sources_sent"), text.cited(answer, F.lit(5)).alias("citations"), F.when(F.col("qid") % 11 == 0, "timeout").alias("error"),
        (F.col("qid") * 37 % 1000).cast("double").alias("total_ms"), F.when(F.col("qid") % 4 != 0, (F.col("qid") * 13 % 500).cast("double")).alias("first_token_ms"),
        (F.col("qid") * 7 % 100).cast("double").alias("search_ms"), (F.col("qid") * 11 % 700).cast("double").alias("generate_ms"),
        F.when(F.col("qid") % 6 != 0, F.col("qid") * 10).alias("prompt_tokens"), F.when(F.col("qid") % 6 != 0, F.col("qid") * 2).alias("completion_tokens"), F.lit(None).cast("long").alias("cached_tokens"),
    )


RECORDS = rf"""WITH {BM25}, {KEYS},
ex AS (SELECT qid, list(id) AS ids FROM keys GROUP BY qid),
rt AS (SELECT qid, list(struct_pack(rank := rank, id := id, score := score) ORDER BY rank) AS ret FROM sparse WHERE rank <= 20 GROUP BY qid),
rec AS (SELECT qid, 'k' || (qid % 4) AS kind, 's' || (qid % 3) AS suite, coalesce(ids, []) AS ids, coalesce(ret, []) AS ret, {ANSWER} AS answer FROM (SELECT item_id AS qid FROM benchmark) LEFT JOIN ex USING (qid) LEFT JOIN rt USING (qid)),
m0 AS (SELECT *, list_filter(ret, lambda r: r.rank <= 5) AS r5, list_min(list_transform(list_filter(ret, lambda r: list_contains(ids, r.id)), lambda r: r.rank)) AS first_rank, qid % 5 = 0 AS refused,
  CASE WHEN qid % 2 = 0 THEN replace(lower(answer), ',', '') END AS flat FROM rec),
m AS (SELECT *, CASE WHEN len(ids) > 0 THEN (first_rank IS NOT NULL AND first_rank <= 5)::INT::DOUBLE END AS hit5, CASE WHEN len(ids) > 0 THEN (first_rank IS NOT NULL)::INT::DOUBLE END AS hit20,
  CASE WHEN len(ids) > 0 THEN len(list_filter(ids, lambda i: list_contains(list_transform(r5, lambda r: r.id), i)))::DOUBLE / len(ids) END AS cov5,
  CASE WHEN len(ids) > 0 THEN coalesce(1.0::DOUBLE / first_rank, 0.0) END AS rr,
  CASE WHEN flat IS NOT NULL THEN (regexp_matches(' ' || flat || ' ', '[^0-9]41291[^0-9]') OR regexp_matches(' ' || flat || ' ', '[^0-9]' || qid || '[^0-9]'))::INT::DOUBLE END AS fact,
  ret[1].score AS top, len(list_distinct(list_transform(r5, lambda r: r.id))) AS docs5, len(list_distinct(list_transform(r5, lambda r: r.id % 100))) AS pages5, (qid % 11 = 0) AS failed,
  (qid * 37 % 1000)::DOUBLE AS total_ms, CASE WHEN qid % 4 <> 0 THEN (qid * 13 % 500)::DOUBLE ELSE (qid * 37 % 1000)::DOUBLE END AS first_ms FROM m0)"""
MEASURES = """count(*) AS questions, round(avg(hit5), 6) AS recall_at_5, round(avg(hit20), 6) AS recall_at_20, round(avg(cov5), 6) AS coverage_at_5, round(avg(rr), 6) AS mrr, round(avg(fact), 6) AS fact_rate,
count(fact) AS fact_questions, round(coalesce(avg(top), 0.0), 5) AS mean_top_score, round(avg(docs5), 6) AS mean_distinct_docs_at_5, round(avg(pages5), 6) AS mean_distinct_articles_at_5,
round(avg(refused::INT), 6) AS refusal_rate, sum((qid % 5 <> 0 AND qid % 3 = 0)::INT)::BIGINT AS answers_with_invalid_marker, sum(0)::BIGINT AS answers_with_no_citation, sum(failed::INT)::BIGINT AS errors,
list_sort(list(total_ms))[greatest(1, least(count(*), round_even(0.5 * count(*), 0)::INT))] AS p50_total_ms, list_sort(list(total_ms))[greatest(1, least(count(*), round_even(0.95 * count(*), 0)::INT))] AS p95_total_ms,
list_sort(list(first_ms))[greatest(1, least(count(*), round_even(0.5 * count(*), 0)::INT))] AS p50_first_token_ms, sum(CASE WHEN qid % 6 <> 0 THEN qid * 10 END)::BIGINT AS prompt_tokens"""
KEPT = ["questions", "fact_questions", "answers_with_invalid_marker", "answers_with_no_citation", "errors", "p50_total_ms", "p95_total_ms", "p50_first_token_ms", "prompt_tokens"]
ROUNDED = ["recall_at_5", "recall_at_20", "coverage_at_5", "mrr", "fact_rate", "mean_distinct_docs_at_5", "mean_distinct_articles_at_5", "refusal_rate"]


def _shown(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, *KEPT, *(F.round(c, 6).alias(c) for c in ROUNDED), F.round("mean_top_score", 5).alias("mean_top_score"))


@query(f"{RECORDS} SELECT coalesce(kind, 'all') AS kind, {MEASURES} FROM m GROUP BY GROUPING SETS ((kind), ())")
def q_metrics_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return _shown(E.summarise(records(spark, d)), ["kind"])


@query(f"{RECORDS} SELECT coalesce(suite, 'all') AS suite, coalesce(kind, 'all') AS kind, {MEASURES} FROM m GROUP BY GROUPING SETS ((suite, kind), (suite), (kind), ())")
def q_metrics_by_suite(spark: SparkSession, d: str) -> DataFrame:
    return _shown(E.summarise(records(spark, d), (("suite", "kind"), ("suite",), ("kind",), ())), ["suite", "kind"])


@query(f"{RECORDS} SELECT qid, len(ids) > 0 AS scored, first_rank, CASE WHEN len(ids) > 0 AND first_rank IS NOT NULL THEN 'HIT at ' || first_rank WHEN len(ids) > 0 THEN 'MISS' WHEN refused THEN 'REFUSED' ELSE 'ANSWERED (expected refusal)' END AS verdict FROM m")
def q_outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.select("qid", (F.size("expected_doc_ids") > 0).alias("scored"), E.first_hit_rank().cast("long").alias("first_rank"), E.verdict(r).alias("verdict"))


@query("""SELECT event_type, list_sort(list(value))[greatest(1, round_even(0.5 * count(*), 0)::INT)] AS p50, list_sort(list(value))[greatest(1, round_even(0.95 * count(*), 0)::INT)] AS p95 FROM events GROUP BY event_type""")
def q_percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return E.nearest_rank(table(spark, d, "events"), ["event_type"], "value", (0.5, 0.95))


GATE_NAMES = ["recall_at_5", "mrr", "refusals", "errors", "p50_total_ms"]


@query(r"""WITH s AS (SELECT lang AS suite, avg(n_chars) AS a, count(*) AS n, max(n_chars) AS mx FROM documents GROUP BY lang), c AS (SELECT lang AS suite, avg(n_chars) AS a, count(*) AS n, max(n_chars) AS mx FROM documents WHERE doc_id % 2 = 0 GROUP BY lang),
u AS (SELECT s.suite, x.name, x.b, x.c, x.rule FROM s LEFT JOIN c USING (suite), LATERAL (SELECT * FROM (VALUES ('recall_at_5', round(s.a, 3), round(c.a, 3), 'no drop'), ('mrr', s.mx::DOUBLE, c.mx::DOUBLE, 'no drop'), ('refusals', s.n::DOUBLE, c.n::DOUBLE, 'no change'), ('errors', s.n::DOUBLE, c.n::DOUBLE, 'no rise'), ('p50_total_ms', s.n::DOUBLE, c.n::DOUBLE, 'reported')) t(name, b, c, rule)) x)
SELECT suite, name, b AS baseline, c AS candidate, rule, CASE WHEN rule = 'reported' THEN 'report' WHEN b IS NULL AND c IS NULL THEN 'pass' WHEN b IS NULL OR c IS NULL THEN 'fail' WHEN rule = 'no drop' AND b - c > 1e-9 THEN 'fail' WHEN rule = 'no rise' AND c - b > 1e-9 THEN 'fail' WHEN rule = 'no change' AND b <> c THEN 'fail' ELSE 'pass' END AS status FROM u""")
def q_gate(spark: SparkSession, d: str) -> DataFrame:
    def summary(rows: DataFrame) -> DataFrame:
        s = rows.groupBy(F.col("lang").alias("suite")).agg(F.round(F.avg("n_chars"), 3).alias("recall_at_5"), F.max("n_chars").alias("mrr"), F.count("*").alias("refusals"))
        s = s.withColumns({"errors": F.col("refusals"), "p50_total_ms": F.col("refusals")})
        return s.withColumns({n: F.lit(None).cast("double") for n, *_ in E.RULES if n not in GATE_NAMES})

    rows = table(spark, d, "documents")
    return E.gate(summary(rows), summary(rows.where("doc_id % 2 = 0"))).where(F.col("name").isin(GATE_NAMES))


@query(f"""WITH {VEC}, {BM25}, pools AS (SELECT qid, id, rank, 0 AS arm FROM dense WHERE rank <= 50 UNION ALL SELECT qid * 50, id, rank, 1 FROM sparse WHERE rank <= 50),
keys AS (SELECT v.vec_id AS qid, w.vec_id AS id FROM embeddings v JOIN embeddings w ON v.label = w.label WHERE v.vec_id % 50 = 0),
configs AS (SELECT * FROM (VALUES ('dense', 0.0, 60), ('half', 0.5, 60), ('equal', 1.0, 60), ('sharp', 1.0, 10)) t(config, weight, rrf_k)),
f AS (SELECT config, qid, id, round(sum(CASE WHEN arm = 0 THEN 1.0::DOUBLE ELSE weight::DOUBLE END / (rrf_k + rank)), 9) AS fused, min(arm * 1000 + rank) AS tie FROM pools, configs GROUP BY config, qid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY config, qid ORDER BY fused DESC, tie, id) AS rank FROM f), h AS (SELECT config, qid, min(rank) AS first FROM r JOIN keys USING (qid, id) WHERE rank <= 20 GROUP BY config, qid),
e AS (SELECT c.config, k.qid, h.first FROM (SELECT DISTINCT qid FROM keys) k CROSS JOIN (SELECT config FROM configs) c LEFT JOIN h USING (config, qid))
SELECT config, count(*) AS questions, round(avg((coalesce(first, 1000000) <= 5)::INT), 6) AS recall_at_5, round(avg((coalesce(first, 1000000) <= 20)::INT), 6) AS recall_at_20, round(avg(coalesce(1.0::DOUBLE / first, 0.0)), 6) AS mrr FROM e GROUP BY config""")
def q_sweep(spark: SparkSession, d: str) -> DataFrame:
    q = vector_questions(spark, d)
    dense = R.dense_topk(vectors(spark, d), q, 50).select("qid", "id", "rank", F.lit(0).alias("arm"))
    sparse = R.bm25_topk(docs(spark, d), questions(spark, d).withColumn("qid", F.col("qid") * 50), 50).select("qid", "id", "rank", F.lit(1).alias("arm"))
    configs = inline(spark, [("dense", 0.0, 60), ("half", 0.5, 60), ("equal", 1.0, 60), ("sharp", 1.0, 10)], "config string, weight double, rrf_k int")
    e = table(spark, d, "embeddings")
    labelled = e.where("vec_id % 50 = 0 and label is not null").select(F.col("vec_id").alias("qid"), F.col("label").alias("wanted"))
    path = shared_folder(spark, "pools")
    dense.unionByName(sparse).write.parquet(path)  # fetched once, read twice
    pools = spark.read.parquet(path)
    found = pools.select("qid", "id").distinct().join(labelled, "qid")  # a question's keys are all vectors of its label: those in its pools are looked up
    keys = e.select(F.col("vec_id").alias("id"), "label").join(found, "id").where("label = wanted").select("qid", "id")
    rows = E.sweep(pools, configs, keys, asked=labelled)
    return rows.select("config", "questions", *(F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_20", "mrr")))


@query("""WITH s AS (SELECT user_id AS question, event_type AS name, sum(value) AS ms FROM events GROUP BY 1, 2), t AS (SELECT question, sum(ms) AS total FROM s GROUP BY 1)
SELECT name, count(*) AS records, round(median(ms), 6) AS median_ms, round(median(CASE WHEN total > 0 THEN ms / total ELSE 0 END), 6) AS median_share FROM s JOIN t USING (question) GROUP BY name""")
def q_stage_shares(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("name"), F.lit(0).alias("depth"), F.col("value").alias("ms"))
    return E.stage_shares(spans).select("name", "records", F.round("median_ms", 6).alias("median_ms"), F.round("median_share", 6).alias("median_share"))


@query("SELECT user_id AS question, round(1000 - sum(CASE WHEN event_type <> 'view' THEN value ELSE 0 END), 6) AS unattributed_ms FROM events GROUP BY 1")
def q_unattributed(spark: SparkSession, d: str) -> DataFrame:
    span = F.struct(F.when(F.col("event_type") == "view", 1).otherwise(0).alias("depth"), F.col("value").alias("ms"))
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("question")).agg(F.collect_list(span).alias("spans")).withColumn("total_ms", F.lit(1000.0))
    return E.unattributed(rows).select("question", F.round("unattributed_ms", 6).alias("unattributed_ms"))


@query(f"""WITH {VEC}, b AS (SELECT coalesce(x.qid, y.qid) AS qid, x.id AS old, y.id AS new FROM (SELECT * FROM dense WHERE rank <= 20) x FULL JOIN (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM period) y ON x.qid = y.qid AND x.rank = y.rank),
g AS (SELECT qid, sum((old IS DISTINCT FROM new)::INT)::BIGINT AS changed_ranks, list(DISTINCT old) FILTER (old IS NOT NULL) AS os, list(DISTINCT new) FILTER (new IS NOT NULL) AS ns FROM b GROUP BY qid)
SELECT qid, changed_ranks, len(list_filter(coalesce(os, []), lambda x: NOT list_contains(coalesce(ns, []), x))) AS only_recorded, len(list_filter(coalesce(ns, []), lambda x: NOT list_contains(coalesce(os, []), x))) AS only_fresh FROM g""")
def q_replay_diff(spark: SparkSession, d: str) -> DataFrame:
    q = vector_questions(spark, d)
    return E.replay_diff(R.dense_topk(vectors(spark, d), q, 20), R.temporal_reorder(R.within_topk(vectors(spark, d), q, 20)))


@query("SELECT ts::DATE AS day, round(sum(value), 6) AS dollars, count(*) AS calls FROM events GROUP BY 1")
def q_ledger_daily(spark: SparkSession, d: str) -> DataFrame:
    return E.ledger_daily(table(spark, d, "events").select(F.col("ts").alias("at"), F.col("value").alias("dollars")))


@query("""WITH s AS (SELECT event_id AS id, round(coalesce(sum(value) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS spent_before FROM events)
SELECT id, spent_before, spent_before < 5000.0 AS admitted FROM s""")
def q_ceiling_admission(spark: SparkSession, d: str) -> DataFrame:
    rows = E.admitted(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("value").alias("dollars")), 5000.0)
    return rows.select("id", F.round("spent_before", 3).alias("spent_before"), "admitted")


PRICE_SQL = values([(m, *p) for m, p in E.PRICES.items()], "model, fp, cp, op")


@query(f"""WITH p AS ({PRICE_SQL}), c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS prompt, length(coalesce(text, '')) // 4 AS cached, turn * 10 AS completion, CASE WHEN turn % 3 = 0 THEN 'gpt-4.1' WHEN turn % 3 = 1 THEN 'gpt-4o-mini' ELSE 'other' END AS model FROM conversations)
SELECT conv_id, turn, round((greatest(prompt - cached, 0) * coalesce(fp, 0.40)::DOUBLE + cached * coalesce(cp, 0.10)::DOUBLE + completion * coalesce(op, 1.60)::DOUBLE) / 1000000, 9) AS dollars FROM c LEFT JOIN p USING (model)""")
def q_dollars(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    model = F.when(F.col("turn") % 3 == 0, "gpt-4.1").when(F.col("turn") % 3 == 1, "gpt-4o-mini").otherwise("other")
    cost = E.dollars(n, F.floor(n / 4), F.col("turn") * 10, model)
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(cost, 9).alias("dollars"))


@query("""WITH c AS (SELECT CASE WHEN turn % 4 <> 0 THEN length(text) END AS p, turn * 10 AS c, CASE WHEN turn % 2 = 0 THEN 7 END AS k FROM conversations WHERE text IS NOT NULL)
SELECT coalesce(round_even(avg(p), 0)::BIGINT, 2620) AS prompt_tokens, coalesce(round_even(avg(c), 0)::BIGINT, 182) AS completion_tokens, coalesce(round_even(avg(coalesce(k, 0)), 0)::BIGINT, 0) AS cached_tokens FROM c WHERE p IS NOT NULL""")
def q_cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("text is not null").select(F.when(F.col("turn") % 4 != 0, F.length("text")).alias("prompt_tokens"), (F.col("turn") * 10).alias("completion_tokens"), F.when(F.col("turn") % 2 == 0, 7).alias("cached_tokens"))
    return E.tokens_per_question(rows)


@query("""WITH r AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, turn, text, CASE WHEN nr = 'assistant' THEN text || ' => ' || substr(nt, 1, 600) END AS pair FROM r WHERE role = 'user')
SELECT conv_id, turn, text, coalesce(array_to_string(list(pair) FILTER (pair IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' | '), '') AS history FROM u""")
def q_conversation_window(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.conversation_windows(table(spark, d, "conversations"))
    pair = F.transform("history", lambda h: F.concat(h["user"], F.lit(" => "), h["assistant"]))
    return rows.select("conv_id", "turn", "text", F.array_join(pair, " | ").alias("history"))


@query(rf"""WITH {BM25}, b AS (SELECT s.qid, count(*) AS sources, string_agg('<source id="' || rank || '" title="' || d.source || ' — ' || d.lang || '">' || chr(10) || d.text || chr(10) || '</source>', chr(10) || chr(10) ORDER BY rank) AS bs FROM sparse s JOIN documents d ON d.doc_id = s.id WHERE rank <= 5 GROUP BY s.qid)
SELECT q.item_id AS qid, coalesce(sources, 0) AS sources, coalesce(bs, 'No sources were found.') || chr(10) || chr(10) || '# QUESTION' || chr(10) || chr(10) || q.text AS prompt FROM benchmark q LEFT JOIN b ON b.qid = q.item_id""")
def q_prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    ranked = R.bm25_topk(docs(spark, d), questions(spark, d), 5)
    rows = docs(spark, d).join(sent(ranked, questions(spark, d), 5), "id").select("qid", "rank", text.source_label(F.col("source"), F.col("lang")).alias("title"), "text")
    return answers.prompts(questions(spark, d), rows).withColumn("sources", F.col("sources").cast("long"))


@query(r"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), n AS (SELECT item_id, list_transform(range(1, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i:i+5], ' ')) AS gs FROM b),
d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS s FROM documents)
SELECT item_id, doc_id FROM n, d WHERE len(list_filter(gs, lambda g: contains(s, g))) > 0""")
def q_copy_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Which benchmark items share a run of words with which documents, of all pairs."""
    found = E.copied(docs(spark, d), questions(spark, d))
    return found.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"))


@query(r"""WITH c AS (SELECT doc_id, lang || '/' || source AS page_id, md5(doc_id || '/7') AS pick FROM documents WHERE length(text) >= 400), o AS (SELECT page_id, min(pick) AS pick, arg_min(doc_id, pick) AS chunk_id FROM c GROUP BY page_id)
SELECT page_id, pick, chunk_id FROM o ORDER BY pick LIMIT 30""")
def q_sample_one_per_article(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "lang", "source").alias("page_id"), "text")
    return E.sample_chunks(rows, 30, 7)


@query("""WITH c AS (SELECT source AS answer, CASE WHEN l.doc_id % 13 = 0 THEN NULL ELSE quality = 1 END AS supported FROM labels l JOIN documents d USING (doc_id)), a AS (SELECT answer, avg(supported::INT) AS s, count(*) AS n, sum((NOT supported)::INT) AS bad FROM c WHERE supported IS NOT NULL GROUP BY answer)
SELECT count(*) AS answers, sum(n)::BIGINT AS claims, sum(bad)::BIGINT AS unsupported, round(avg(s), 6) AS mean_faithfulness, sum((s >= 1 - 1e-9)::INT)::BIGINT AS fully_faithful FROM a""")
def q_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("answer")), "doc_id")
    rows = rows.select("answer", F.when(F.col("doc_id") % 13 != 0, F.col("quality") == 1).alias("supported"))
    return E.faithfulness(rows).withColumn("mean_faithfulness", F.round("mean_faithfulness", 6))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT CASE WHEN a.vec_id % 2 = 0 THEN 'tune' ELSE 'test' END AS st, round(list_cosine_similarity(a.v, b.v), 6) AS paraphrase, round(list_cosine_similarity(a.v, c.v), 6) AS negative FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2),
t AS (SELECT round(max(negative) + 0.005, 4) AS threshold FROM p WHERE st = 'tune') SELECT any_value(threshold) AS threshold, round(avg((paraphrase >= threshold)::INT), 6) AS hit_rate, round(avg((negative >= threshold)::INT), 6) AS leak_rate FROM p, t WHERE st = 'test'""")
def q_cache_probe(spark: SparkSession, d: str) -> DataFrame:
    from tesserae.functions.vectors import cosine

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    b, c = (e.select((F.col("vec_id") - i).alias("vec_id"), F.col("v").alias(n)) for i, n in ((1, "b"), (2, "c")))
    pairs = e.join(b, "vec_id").join(c, "vec_id")
    pairs = pairs.select(F.when(F.col("vec_id") % 2 == 0, "tune").otherwise("test").alias("set"), F.round(cosine(F.col("v"), F.col("b")), 6).alias("paraphrase"), F.round(cosine(F.col("v"), F.col("c")), 6).alias("negative"))
    return E.choose_threshold(pairs).select("threshold", F.round("hit_rate", 6).alias("hit_rate"), F.round("leak_rate", 6).alias("leak_rate"))


def q_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Questions of each label in order through a cache of its own; tests hold it against a fold in Python."""
    rows = table(spark, d, "embeddings").select(F.col("label").alias("tenant"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"), F.lit("f").alias("fingerprint"))
    return answers.replay_cache(rows, threshold=0.5)


query()(q_cache_replay)


@query("SELECT doc_id, substr(sha256(concat_ws(chr(31), lang, source, doc_id::VARCHAR)), 1, 16) AS fingerprint FROM documents")
def q_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("lang"), F.col("source"), F.col("doc_id")).alias("fingerprint"))


@query("""WITH r AS (SELECT conv_id AS id, min(turn) AS a, max(turn) AS b FROM conversations GROUP BY conv_id) SELECT id, rule FROM (SELECT id::VARCHAR AS id, unnest(list_filter([CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN 'no key' END, CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN 'key of an unanswerable question' END, CASE WHEN id % 5 = 0 THEN 'history' END], lambda x: x IS NOT NULL)) AS rule FROM r)""")
def q_question_violations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("n")).distinct()
    rows = c.select(
        F.col("n").cast("string").alias("id"), F.when(F.col("n") % 3 == 0, "unanswerable").otherwise("easy").alias("kind"), F.when(F.col("n") % 2 == 1, F.array(F.lit("1:0"))).alias("expected"),
        F.when(F.col("n") % 5 == 0, "conversation").otherwise("golden").alias("suite"), F.expr("cast(array() as array<struct<user:string,assistant:string>>)").alias("history"),
    )
    return E.question_violations(rows).select("id", "rule")


@query("""WITH asked AS (SELECT event_id AS id, user_id AS m, ts FROM events WHERE event_id % 3 <> 0), runs AS (SELECT user_id AS m, ts, max(event_id) AS run_id FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)
SELECT a.id, r.run_id FROM asked a ASOF LEFT JOIN runs r ON a.m = r.m AND a.ts > r.ts""")
def q_runs_before(spark: SparkSession, d: str) -> DataFrame:
    """Every third event is a run of its user's, the others ask for the newest run before them."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("generation_model"), F.col("ts").alias("at"))
    return runs.runs_before(e.where("id % 3 <> 0"), e.where("id % 3 = 0").withColumnRenamed("id", "run_id")).select("id", "run_id")


@query("SELECT CASE WHEN grouping(s) = 1 THEN 'all' ELSE s END AS suite, CASE WHEN grouping(k) = 1 THEN 'all' ELSE k END AS kind, count(*) AS questions FROM (SELECT source AS s, lang AS k FROM documents) GROUP BY GROUPING SETS ((s, k), (s), ())")
def q_question_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.question_counts(table(spark, d, "documents").select(F.col("source").alias("suite"), F.col("lang").alias("kind")))


@query("""WITH v AS (SELECT source AS probe, quality = 1 AS expect, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE toxic = 0 OR quality = 1 END AS got FROM labels JOIN documents USING (doc_id)),
c AS (SELECT probe, count(*) AS cases, count_if(coalesce(got = expect, false)) AS "right", count_if(got IS NULL) AS unread, bool_or(expect) AND bool_or(NOT expect) AS complete FROM v GROUP BY probe)
SELECT probe, cases, complete AND "right" = cases AS passed, "right", unread, complete FROM c""")
def q_probe_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    got = F.when(F.col("doc_id") % 50 != 7, (F.col("toxic") == 0) | (F.col("quality") == 1))
    return E.probe_table(rows.select(F.col("source").alias("probe"), (F.col("quality") == 1).alias("expect"), got.alias("got")))


@query("""SELECT conv_id, turn, length(t) + 5 AS prompt_tokens, length(t) AS completion_tokens, CASE WHEN trim(t) = '' THEN 'EmptyCompletion: the reply is empty' END AS error,
ceil((((length(t) + 5) * 0.15::DOUBLE) + 0 * 0.075::DOUBLE + length(t) * 0.6::DOUBLE) / 1000000 * 1000000000)::BIGINT AS nano FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)""")
def q_metered_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn said again by a stand-in that counts its tokens, with what it costs; the ceiling is off, tests turn it on."""
    asked = table(spark, d, "conversations").select("conv_id", "turn", answers.messages(F.coalesce("text", F.lit("")), "Echo.").alias("messages"))
    rows = spending.metered(asked, seams.EchoGenerator(), "gpt-4o-mini")
    return rows.select("conv_id", "turn", "prompt_tokens", "completion_tokens", "error", F.round(F.col("dollars") * spending.NANO).cast("long").alias("nano"))


@query("""SELECT count_if(o = 'accepted') AS accepted, count_if(o = 'skipped') AS skipped, count_if(o = 'rejected') AS rejected, count_if(o = 'failed') AS failed FROM (SELECT CASE WHEN r IS NULL THEN 'failed' WHEN starts_with(ltrim(r), 'SKIP') THEN 'skipped' WHEN length(q) BETWEEN 25 AND 220 THEN 'accepted' ELSE 'rejected' END AS o
FROM (SELECT CASE WHEN turn % 7 <> 0 THEN CASE WHEN turn % 5 = 0 THEN 'SKIP ' ELSE 'Zq ' END || coalesce(text, '') END AS r, repeat('z', turn * 4) || '?' AS q FROM conversations))""")
def q_generation_report(spark: SparkSession, d: str) -> DataFrame:
    """Made-up replies and questions told by a turn's number: some failed, some skipped, some too short or too long."""
    reply = F.when(F.col("turn") % 7 != 0, F.concat(F.when(F.col("turn") % 5 == 0, "SKIP ").otherwise("Zq "), F.coalesce("text", F.lit(""))))
    question = F.concat(F.expr("repeat('z', cast(turn * 4 as int))"), F.lit("?"))
    rows = table(spark, d, "conversations").select(runs.generation_outcome(reply, question, F.coalesce("text", F.lit(""))).alias("outcome"))
    return runs.generation_report(rows)
