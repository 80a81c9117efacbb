"""Ranked retrieval. Lists are tables with an explicit ``rank`` from 1; every order ends in an id.

Questions go to the tasks that hold the documents, behind a check of their number
or in groups; documents are never moved but for what matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.periods import agreement
from tesserae.functions.text import tokenize
from tesserae.functions.vectors import cosine
from tesserae.operators.intervals import meeting
from tesserae.operators.nearest import candidates
from tesserae.operators.scoring import best_scores, term_counts
from tesserae.session import few

K1, B = 1.5, 0.75
RRF_K = 60
K, OVERFETCH, RERANK_TOP = 5, 4, 20
DIGITS = 6


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few(df) else df


def top(rows: DataFrame, k: int | None, *order: Column, by: Sequence[str] = ("qid",)) -> DataFrame:
    """Rows with their ``rank`` by ``order`` within ``by``; the first ``k``."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k) if k is not None else ranked


def tf_weight(tf: Column, length: Column, average: Column | float, k1: float = K1, b: float = B) -> Column:
    """Saturated term frequency of BM25; an average length of 0 means no penalty by length."""
    average = F.lit(average) if isinstance(average, float | int) else average
    penalty = F.when(average > 0, F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / average)).otherwise(F.lit(float(k1)))
    return tf * F.lit(k1 + 1) / (tf + penalty)


def corpus_stats(docs: DataFrame) -> tuple[int, float]:
    """Number of documents and their mean number of tokens (0 without documents)."""
    n, mean = docs.agg(F.count("*"), F.coalesce(F.avg(F.size(F.coalesce(tokenize(F.col("text")), F.array()))), F.lit(0.0))).first()
    return n, float(mean)


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``term, id, length, tf`` from ``id, text``; with ``terms``, of those alone, so only matches are exchanged.

    Rows that agree in id and length are one document. Without ``terms`` a row is
    counted where it is read; only ids are exchanged, to find those that come more
    than once, and the postings of these.
    """
    if terms is None:
        again = docs.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__id")
        if again.isEmpty():
            return term_counts(docs, tokenize(F.col("text")))
        again, same = _small(again), F.col("id").eqNullSafe(F.col("__id"))
        each = term_counts(docs.join(again, same, "left_anti"), tokenize(F.col("text")))
        return each.unionByName(term_counts(docs.join(again, same, "left_semi"), tokenize(F.col("text"))).groupBy("term", "id", "length").agg(F.sum("tf").alias("tf")))
    rows = docs.select("id", tokenize(F.col("text")).alias("tokens")).select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    rows = rows.join(_small(terms.select("term").distinct()), "term")
    return rows.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def bm25_index(docs: DataFrame, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame, tuple[int, float]]:
    """Weighted postings, terms with ``df`` and ``idf``, and the corpus statistics, which are taken over all documents first."""
    n, average = corpus_stats(docs)
    each = postings(docs)
    weighted = each.withColumn("weight", tf_weight(F.col("tf"), F.col("length"), average, k1, b)).withColumn("term_id", F.crc32("term"))
    return weighted, terms_of(each, n), (n, average)


def terms_of(each: DataFrame, n: int) -> DataFrame:
    rows = each.groupBy("term").agg(F.count("*").alias("df"))
    return rows.withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def query_terms(questions: DataFrame) -> DataFrame:
    """``qid, term``: each distinct token of a question, with weight 1."""
    return questions.select("qid", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))


def bm25_topk(docs: DataFrame, questions: DataFrame, k: int = K, k1: float = K1, b: float = B) -> DataFrame:
    """``qid, id, score, rank``: documents that share a term, by rounded BM25, then id. ``docs``: id, text; ``questions``: qid, text.

    The corpus is cut into tokens once: its mean length and document frequencies are
    taken from the same exchange of asked terms that the scores are, and only the best
    rows of each group of documents are exchanged after it (`operators/scoring.py`).
    Questions with more terms than may go to every task are joined.
    """
    wanted = query_terms(questions)
    if few(wanted):
        found = best_scores(docs, tokenize(F.col("text")), wanted.toArrow(), dict(wanted.dtypes)["qid"], k, docs.count(), k1, b)
        return top(found.withColumn("score", F.round("score", DIGITS)), k, F.desc("score"), F.asc("id"))
    n, average = corpus_stats(docs)
    found = postings(docs, wanted)
    # counting tf keeps the exchange the same in both branches, so it is made once
    df = found.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))
    asked = wanted.join(df, "term").select("qid", "term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    rated = found.withColumn("weight", tf_weight(F.col("tf"), F.col("length"), average, k1, b)).select("term", "id", "weight")
    scored = rated.join(asked, "term").groupBy("id", "qid").agg(F.round(F.sum(F.col("weight") * F.col("idf")), DIGITS).alias("score"))
    return top(scored.select("qid", "id", "score"), k, F.desc("score"), F.asc("id"))


def dense_topk(vectors: DataFrame, questions: DataFrame, k: int = K, where: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``qid, id, score, rank``: exact cosine. ``vectors``: id, vector; ``questions``: qid, query. ``where`` may use both sides' columns.

    Every question is held against every vector, which is what exact search is, by
    products of blocks (`operators/nearest.py`). Questions that are null or hold a null,
    and a ``where``, go through the expression.
    """
    if where is None:
        return _nearest(vectors, questions, k, carry, (), None)
    pairs = vectors.join(_small(questions), where)
    scored = pairs.select("qid", "id", F.round(cosine(F.col("vector"), F.col("query")), DIGITS).alias("score"), *carry)
    return top(scored, k, F.desc("score"), F.asc("id"))


def _nearest(vectors: DataFrame, questions: DataFrame, k: int, carry: Sequence[str], given: Sequence[str], spans: tuple[Sequence[str], Sequence[str]] | None) -> DataFrame:
    whole = F.coalesce(~F.exists("query", lambda x: x.isNull()), F.lit(False))
    found = candidates(vectors, questions.where(whole), k, carry, given, spans).withColumnRenamed("cosine", "score")
    odd = questions.where(~whole)
    if not odd.isEmpty():
        pairs = vectors.join(_small(odd), F.lit(True)) if spans is None else meeting(vectors, odd, *spans)
        found = found.unionByName(pairs.select("qid", "id", *carry, *given, cosine(F.col("vector"), F.col("query")).alias("score")))
    return top(found.select("qid", "id", F.round("score", DIGITS).alias("score"), *carry, *given), k, F.desc("score"), F.asc("id"))


def within_topk(vectors: DataFrame, questions: DataFrame, k: int = K) -> DataFrame:
    """Exact cosine among vectors whose span meets the question's: ``year_start, year_end`` against ``start, end``; undated ones never do.

    Spans are compared beside the products of blocks; those with a null end or that run backwards meet nothing.
    """
    spans = (("year_start", "year_end"), ("start", "end"))
    dated = vectors.select("id", "vector", *spans[0]).where("year_start <= year_end")
    return _nearest(dated, questions.select("qid", "query", *spans[1]).where("start <= end"), k, spans[0], spans[1], spans)


def temporal_reorder(ranked: DataFrame) -> DataFrame:
    """Ranks anew by the agreement of spans, then cosine; nothing is removed."""
    rows = ranked.withColumn("agreement", F.round(agreement(F.col("start"), F.col("end"), F.col("year_start"), F.col("year_end")), DIGITS)).withColumnRenamed("rank", "__old")
    return top(rows, None, F.desc("agreement"), F.desc("score"), F.asc("__old")).drop("__old")


def rrf(arms: Sequence[tuple[str, DataFrame]], rrf_k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``(name, qid/id/score/rank)`` lists: ``qid, id, fused, score, sparse_score, rank``.

    ``score`` stays the cosine of the dense or period arm (0.0 for rows that only
    the sparse arm has); ties keep the order in which the arms list them.
    """
    weights = weights or {}
    rows = None
    for i, (name, arm) in enumerate(arms):
        own = arm.select("qid", "id", "rank", F.col("score").cast("double").alias("own"), F.lit(i).alias("arm"), F.lit(name == "sparse").alias("sparse"), F.lit(float(weights.get(name, 1.0))).alias("w"))
        rows = own if rows is None else rows.unionByName(own)
    fused = rows.groupBy("qid", "id").agg(
        F.round(F.sum(F.col("w") / (F.lit(rrf_k) + F.col("rank"))), 9).alias("fused"),
        F.min(F.struct("arm", "rank")).alias("__tie"),
        F.coalesce(F.max(F.when(~F.col("sparse"), F.col("own"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("sparse"), F.col("own"))).alias("sparse_score"),
    )
    return top(fused, None, F.desc("fused"), F.asc("__tie"), F.asc("id")).drop("__tie")


def union_candidates(dense: DataFrame, sparse: DataFrame, extra: int, head: int = RERANK_TOP) -> DataFrame:
    """The dense head, the first ``extra`` sparse rows that it lacks, then the dense tail; a row may come twice."""
    front = dense.where(F.col("rank") <= head)
    lacking = sparse.join(front.select("qid", "id"), ["qid", "id"], "left_anti")
    added = top(lacking.withColumnRenamed("rank", "__old"), extra, F.asc("__old")).drop("__old")
    parts = [front.withColumn("segment", F.lit(0)), added.select(*front.columns).withColumn("segment", F.lit(1)), dense.where(F.col("rank") > head).withColumn("segment", F.lit(2))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("rank", "__old")
    return top(rows, None, F.asc("segment"), F.asc("__old"), F.asc("id")).drop("__old")


def rerank(ranked: DataFrame, score: Column, head: int = RERANK_TOP) -> DataFrame:
    """The first ``head`` by a second score, kept as ``rerank_score``; the others follow in their order with none."""
    rows = ranked.withColumn("rerank_score", F.when(F.col("rank") <= head, score)).withColumnRenamed("rank", "__old")
    return top(rows, None, F.col("rerank_score").desc_nulls_last(), F.asc("__old")).drop("__old")


def thin(ranked: DataFrame, k: int | None, per_document: int | None = 2, per_article: int | None = None) -> DataFrame:
    """In order, at most so many rows of a document and of an article, then the first ``k``; capped rows aren't replaced.

    Two windows, one after the other: a document belongs to one article, so rows
    that the first removes never count for the second.
    """
    rows = ranked
    for column, most in (("doc_id", per_document), ("page_id", per_article)):
        if most is not None:
            w = W.partitionBy("qid", column).orderBy("rank")
            rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    return top(rows.withColumnRenamed("rank", "__old"), k, F.asc("__old")).drop("__old")
