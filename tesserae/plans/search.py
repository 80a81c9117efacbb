"""The whole search as one plan for a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import retrieval as R


@dataclass(frozen=True)
class SearchConfig:
    """What a search does; nothing is on that isn't said."""

    k: int = R.K
    overfetch: int = R.OVERFETCH
    min_score: float | None = None
    hybrid: bool = False
    temporal: bool = False
    max_per_document: int | None = 2
    max_per_article: int | None = None
    rrf_k: int = R.RRF_K
    sparse_weight: float = 1.0


def search(chunks: DataFrame, questions: DataFrame, config: SearchConfig = SearchConfig(), rerank_score: Column | None = None) -> DataFrame:
    """Ranked chunks of each question.

    ``chunks``: id, doc_id, page_id, text, vector (and year_start, year_end for the
    temporal arm); ``questions``: qid, text, query (and start, end). The pool of an
    arm is ``k * overfetch``; a least score is applied to the dense pool, before
    fusion; blank questions find nothing; a chunk without a vector is found by its words alone.
    """
    pool = config.k * config.overfetch
    questions = questions.where(F.trim("text") != "")
    vectors = chunks.where("vector is not null")
    dense = R.dense_topk(vectors.select("id", "vector"), questions.select("qid", "query"), pool)
    if config.min_score is not None:
        dense = dense.where(F.col("score") >= config.min_score)
    arms = [("dense", dense)]
    if config.temporal:
        dated = questions.where("start is not null").select("qid", "query", "start", "end")
        arms.append(("period", R.temporal_reorder(R.within_topk(vectors.select("id", "vector", "year_start", "year_end"), dated, pool)).select("qid", "id", "score", "rank")))
    if config.hybrid:
        arms.append(("sparse", R.bm25_topk(chunks.select("id", "text"), questions.select("qid", "text"), pool)))
    if len(arms) > 1:
        ranked = R.rrf(arms, config.rrf_k, {"sparse": config.sparse_weight})
    else:
        ranked = dense.withColumn("sparse_score", F.lit(None).cast("double"))
    where = chunks.select("id", "doc_id", "page_id")
    most = 200_000 // (pool * len(arms))  # each arm gives a question `pool` rows, so the number of questions bounds the list
    ranked = where.join(F.broadcast(ranked) if R.few(questions.select("qid"), most) else ranked, "id")
    if rerank_score is not None:
        ranked = R.rerank(ranked, rerank_score)
    return R.thin(ranked, config.k, config.max_per_document, config.max_per_article)
