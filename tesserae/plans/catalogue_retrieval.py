"""Catalogue: tokens, BM25, vectors, fusion, capping, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import periods, text
from tesserae.operators import index as X
from tesserae.operators import retrieval as R
from tesserae.operators.intervals import meeting
from tesserae.plans.catalogue import inline, query
from tesserae.plans.search import SearchConfig, search
from tesserae.session import sent, shared_folder, table

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


BM25 = rf"""
toks AS (SELECT doc_id AS id, {TOKENS} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
stats AS (SELECT count(*) AS n, coalesce(avg(len(t)), 0) AS avgdl FROM toks),
post AS (SELECT id, term, count(*) AS tf, max(length) AS length FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM toks) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark),
bm AS (SELECT qid, id, round(sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl)) * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score
       FROM qt JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY qid, id),
sparse AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm)"""


@query(rf"SELECT doc_id AS id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, avg(len(t)) OVER () AS average_length FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def q_tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d)
    _, mean = R.corpus_stats(rows)
    t = text.tokenize(F.col("text"))
    return rows.select("id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"), F.lit(mean).alias("average_length"))


@query(rf"WITH {BM25} SELECT id, term, tf, length, round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl)), 6) AS weight FROM post, stats")
def q_bm25_weights(spark: SparkSession, d: str) -> DataFrame:
    weighted, _, _ = R.bm25_index(docs(spark, d))
    return weighted.select("id", "term", "tf", F.col("length").cast("long").alias("length"), F.round("weight", 6).alias("weight"))


@query(rf"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, stats")
def q_bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    _, terms, _ = R.bm25_index(docs(spark, d))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(rf"WITH {BM25} SELECT qid, id, score, rank FROM sparse WHERE rank <= 10")
def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_topk(docs(spark, d), questions(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@query(rf"WITH {BM25} SELECT qid, id, score, rank FROM sparse WHERE rank <= 10")
def q_term_blocks_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same from an index of blocks that is built first and then read alone."""
    path = shared_folder(spark, "terms")
    X.build_term_blocks(docs(spark, d), path)
    return X.search_term_blocks(spark, path, questions(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    spans = [F.when(F.col("vec_id") % 7 == 0, None).otherwise(1900 + F.col("vec_id") % 90).cast("int").alias("year_start"), (1900 + F.col("vec_id") % 90 + F.col("vec_id") % 11).cast("int").alias("year_end")]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", *spans)


def vector_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("vec_id % 50 = 0")
    return rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"), (1920 + F.col("vec_id") % 40).cast("int").alias("start"), (1930 + F.col("vec_id") % 40).cast("int").alias("end"))


VEC = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 1900 + vec_id % 90 END AS ys, 1900 + vec_id % 90 + vec_id % 11 AS ye FROM embeddings),
vq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS query, 1920 + vec_id % 40 AS s, 1930 + vec_id % 40 AS e FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT qid, id, round(list_cosine_similarity(vector, query), 6) AS score, ys, ye, s, e FROM v, vq),
dense AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs),
win AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs WHERE ys <= e AND ye >= s),
agr AS (SELECT *, round((least(e, ye) - greatest(s, ys) + 1) / (greatest(e, ye) - least(s, ys) + 1), 6) AS agreement FROM win WHERE rank <= 20),
period AS (SELECT qid, id, score, agreement, row_number() OVER (PARTITION BY qid ORDER BY agreement DESC, score DESC, rank) AS rank FROM agr)"""


@query(f"WITH {VEC} SELECT qid, id, score, rank FROM dense WHERE rank <= 10")
def q_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(vectors(spark, d), vector_questions(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {VEC} SELECT qid, id, score, rank FROM dense WHERE rank <= 10")
def q_vector_lists_all(spark: SparkSession, d: str) -> DataFrame:
    """Every list of the index searched: exact."""
    path = shared_folder(spark, "vectors")
    about = X.build_vector_lists(vectors(spark, d), path, k=10)
    return X.search_vector_lists(spark, path, vector_questions(spark, d), 10, about["lists"]).withColumn("rank", F.col("rank").cast("long"))


@query()
def q_vector_lists_topk(spark: SparkSession, d: str) -> DataFrame:
    """As many lists as the index measured to be enough; tests measure its recall against `q_dense_topk`."""
    path = shared_folder(spark, "vectors")
    X.build_vector_lists(vectors(spark, d), path, k=10)
    return X.search_vector_lists(spark, path, vector_questions(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {VEC} SELECT qid, id, score, rank FROM win WHERE rank <= 10")
def q_dense_within(spark: SparkSession, d: str) -> DataFrame:
    return R.within_topk(vectors(spark, d), vector_questions(spark, d), 10).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VEC} SELECT qid, id, score, agreement, rank FROM period")
def q_temporal_reorder(spark: SparkSession, d: str) -> DataFrame:
    ranked = R.temporal_reorder(R.within_topk(vectors(spark, d), vector_questions(spark, d), 20))
    return ranked.select("qid", "id", "score", "agreement", F.col("rank").cast("long").alias("rank"))


def arms(spark: SparkSession, d: str, depth: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense, period and sparse lists for the questions that both kinds have (ids are shared numbers)."""
    both = [c for c in ("qid", "id", "score", "rank")]
    q = vector_questions(spark, d)
    dense = R.dense_topk(vectors(spark, d), q, depth).select(*both)
    period = R.temporal_reorder(R.within_topk(vectors(spark, d), q, depth)).select(*both)
    mapped = questions(spark, d).withColumn("qid", F.col("qid") * 50)
    return dense, period, R.bm25_topk(docs(spark, d), mapped, depth).select(*both)


ARMS = f"""{VEC}, {BM25},
a_dense AS (SELECT qid, id, score, rank FROM dense WHERE rank <= 20),
a_period AS (SELECT qid, id, score, rank FROM period),
a_sparse AS (SELECT qid * 50 AS qid, id, score, rank FROM sparse WHERE rank <= 20)"""


def fused_sql(parts: list[tuple[str, float]]) -> str:
    union = " UNION ALL ".join(f"SELECT qid, id, rank, score AS own, {i} AS arm, {'TRUE' if n == 'sparse' else 'FALSE'} AS sp, {w} AS w FROM a_{n}" for i, (n, w) in enumerate(parts))
    return f"""fu AS (SELECT qid, id, round(sum(w / (60.0 + rank)), 9) AS fused, min(arm * 1000 + rank) AS tie, coalesce(max(CASE WHEN NOT sp THEN own END), 0.0) AS score,
    max(CASE WHEN sp THEN own END) AS sparse_score FROM ({union}) GROUP BY qid, id),
fused AS (SELECT qid, id, fused, score, sparse_score, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, tie, id) AS rank FROM fu)"""


def _fused(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "id", "fused", "score", "sparse_score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {ARMS}, {fused_sql([('dense', 1.0), ('sparse', 1.0)])} SELECT * FROM fused")
def q_rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    dense, _, sparse = arms(spark, d)
    return _fused(R.rrf([("dense", dense), ("sparse", sparse)]))


@query(f"WITH {ARMS}, {fused_sql([('dense', 1.0), ('sparse', 0.5)])} SELECT * FROM fused")
def q_rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    dense, _, sparse = arms(spark, d)
    return _fused(R.rrf([("dense", dense), ("sparse", sparse)], weights={"sparse": 0.5}))


@query(f"WITH {ARMS}, {fused_sql([('dense', 1.0), ('period', 1.0), ('sparse', 1.0)])} SELECT * FROM fused")
def q_rrf_three_arm(spark: SparkSession, d: str) -> DataFrame:
    dense, period, sparse = arms(spark, d)
    return _fused(R.rrf([("dense", dense), ("period", period), ("sparse", sparse)]))


@query(f"""WITH {ARMS},
head AS (SELECT * FROM a_dense WHERE rank <= 8), lack AS (SELECT s.* FROM a_sparse s ANTI JOIN head h ON s.qid = h.qid AND s.id = h.id),
added AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM lack),
u AS (SELECT qid, id, score, rank, 0 AS segment FROM head UNION ALL SELECT qid, id, score, rank, 1 FROM added WHERE rank <= 5 UNION ALL SELECT qid, id, score, rank, 2 FROM a_dense WHERE rank > 8)
SELECT qid, id, score, segment, row_number() OVER (PARTITION BY qid ORDER BY segment, rank, id) AS rank FROM u""")
def q_union_candidates(spark: SparkSession, d: str) -> DataFrame:
    dense, _, sparse = arms(spark, d)
    return R.union_candidates(dense, sparse, 5, head=8).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {BM25}, r AS (SELECT s.qid, s.id, s.score, s.rank, CASE WHEN s.rank <= 20 THEN len(list_intersect(list_distinct({TOKENS.replace('text', 'b.text')}), t.t))::DOUBLE END AS rerank_score
FROM sparse s JOIN toks t USING (id) JOIN benchmark b ON b.item_id = s.qid WHERE s.rank <= 40)
SELECT qid, id, score, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC NULLS LAST, rank) AS rank FROM r""")
def q_rerank_head(spark: SparkSession, d: str) -> DataFrame:
    ranked = R.bm25_topk(docs(spark, d), questions(spark, d), 40)
    seen = docs(spark, d).select("id", "text").join(sent(ranked, questions(spark, d), 40), "id")
    asked = questions(spark, d).select("qid", F.array_distinct(text.tokenize(F.col("text"))).alias("asked"))
    overlap = F.size(F.array_intersect("asked", text.tokenize(F.col("text")))).cast("double")
    rows = R.rerank(seen.join(sent(asked), "qid"), overlap)
    return rows.select("qid", "id", "score", "rerank_score", F.col("rank").cast("long").alias("rank"))


def _thinned(spark: SparkSession, d: str, per_document: int | None, per_article: int | None) -> DataFrame:
    ranked = R.bm25_topk(docs(spark, d), questions(spark, d), 80)
    where = docs(spark, d).select("id", F.concat_ws("/", "lang", "source").alias("doc_id"), F.col("lang").alias("page_id"))
    rows = R.thin(where.join(sent(ranked, questions(spark, d), 80), "id"), 20, per_document, per_article)
    return rows.select("qid", "id", "doc_id", "page_id", "score", F.col("rank").cast("long").alias("rank"))


THIN = f"""WITH {BM25}, p AS (SELECT s.qid, s.id, concat_ws('/', lang, source) AS doc_id, lang AS page_id, s.score, s.rank AS old FROM sparse s JOIN documents d ON d.doc_id = s.id WHERE rank <= 80),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY old) AS n FROM p) WHERE n <= 2)"""


@query(THIN + " SELECT qid, id, doc_id, page_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY old) AS rank FROM a) WHERE rank <= 20")
def q_thin_section(spark: SparkSession, d: str) -> DataFrame:
    return _thinned(spark, d, 2, None)


@query(THIN + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, page_id ORDER BY old) AS m FROM a) WHERE m <= 5)
SELECT qid, id, doc_id, page_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY old) AS rank FROM b) WHERE rank <= 20""")
def q_thin_article(spark: SparkSession, d: str) -> DataFrame:
    return _thinned(spark, d, 2, 5)


ALL_ARMS = ARMS.replace("AS ye FROM embeddings),", "AS ye FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),", 1)


@query(f"""WITH {ALL_ARMS}, {fused_sql([('dense', 1.0), ('period', 1.0), ('sparse', 1.0)])},
pl AS (SELECT f.qid, f.id, f.score, f.sparse_score, f.rank AS old, id % 40 AS doc_id, id % 8 AS page_id FROM fused f WHERE qid IN (SELECT qid FROM vq) AND qid IN (SELECT item_id * 50 FROM benchmark)),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY old) AS n FROM pl) WHERE n <= 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, page_id ORDER BY old) AS m FROM a) WHERE m <= 3)
SELECT qid, id, doc_id, page_id, score, sparse_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY old) AS rank FROM b) WHERE rank <= 5""")
def q_search_pipeline(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("id", "vector", "year_start", "year_end")
    chunks = docs(spark, d).select("id", "text").join(v, "id", "left").withColumn("doc_id", F.col("id") % 40).withColumn("page_id", F.col("id") % 8)
    asked = vector_questions(spark, d).join(sent(questions(spark, d).withColumn("qid", F.col("qid") * 50)), "qid")
    rows = search(chunks, asked, SearchConfig(k=5, hybrid=True, temporal=True, max_per_article=3))
    return rows.select("qid", "id", "doc_id", "page_id", "score", "sparse_score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {VEC}, p AS (SELECT qid, id, id % 40 AS doc_id, id % 8 AS page_id, score, rank AS old FROM dense WHERE rank <= 20 AND score >= 0.05),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY old) AS n FROM p) WHERE n <= 2)
SELECT qid, id, doc_id, page_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY old) AS rank FROM a) WHERE rank <= 5""")
def q_search_dense(spark: SparkSession, d: str) -> DataFrame:
    chunks = vectors(spark, d).withColumn("doc_id", F.col("id") % 40).withColumn("page_id", F.col("id") % 8).withColumn("text", F.lit(""))
    rows = search(chunks, vector_questions(spark, d).withColumn("text", F.lit("q")), SearchConfig(k=5, min_score=0.05))
    return rows.select("qid", "id", "doc_id", "page_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT o_custkey, year(min(o_orderdate)) AS ys, year(max(o_orderdate)) AS ye FROM orders GROUP BY o_custkey),
e AS (SELECT * FROM (VALUES ('a', 1992, 1994), ('b', 1995, 1995), ('c', 1997, 2001)) t(era, s, e))
SELECT era, o_custkey, ys, ye, round((least(e, ye) - greatest(s, ys) + 1) / (greatest(e, ye) - least(s, ys) + 1), 6) AS agreement FROM s JOIN e ON ys <= e AND ye >= s""")
def q_period_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("ys"), F.year(F.max("o_orderdate")).alias("ye"))
    eras = inline(spark, [("a", 1992, 1994), ("b", 1995, 1995), ("c", 1997, 2001)], "era string, s int, e int")
    rows = meeting(spans, eras, ("ys", "ye"), ("s", "e"))
    return rows.select("era", "o_custkey", F.col("ys").cast("long").alias("ys"), F.col("ye").cast("long").alias("ye"), F.round(periods.agreement(F.col("s"), F.col("e"), F.col("ys"), F.col("ye")), 6).alias("agreement"))
