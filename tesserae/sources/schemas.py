"""Declared schemas, so that an empty table has the same types as a full one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BRONZE = "page_id long, title string, requested_title string, theme string, revision_id long, revision_timestamp timestamp, wikitext string, fetched_at timestamp, license string"
SILVER = (
    "doc_id string, page_id long, position int, title string, heading string, text string, themes array<string>, link_targets array<string>, categories array<string>, "
    "infobox_type string, infobox array<struct<key:string,value:string>>, revision_id long, revision_timestamp timestamp, license string"
)
GOLD = (
    "chunk_id string, doc_id string, page_id long, position int, title string, heading string, text string, themes array<string>, revision_id long, "
    "revision_timestamp timestamp, license string, year_start int, year_end int, year_source string"
)
REGISTRY = "theme string, title string, seed_count int"
MISSING = "theme string, title string, fetched_at timestamp"
LEDGER = "at timestamp, dollars double, what string"
_TURN = "array<struct<user:string,assistant:string>>"
RECORD = (
    "question_id string, question string, kind string, expected_doc_ids array<string>, "
    "retrieved array<struct<rank:int,chunk_id:string,doc_id:string,page_id:long,source:string,score:double,text:string,rerank_score:double,sparse_score:double>>, "
    "answer string, generation_model string, sources_sent int, markers_found array<int>, citations array<struct<number:int,doc_id:string,source:string>>, "
    "search_ms double, generate_ms double, total_ms double, revised boolean, draft string, first_token_ms double, suite string, expected_answers array<string>, "
    f"history {_TURN}, standalone string, trace array<struct<name:string,depth:int,ms:double,note:string>>, prompt_tokens long, completion_tokens long, "
    "cached_tokens long, error string, extra map<string,string>"
)
META = (
    "run_id string, started_at string, git_sha string, embedding_model string, generation_model string, collection string, points long, k int, max_per_document int, "
    "max_per_article int, overfetch int, reranker string, hybrid string, verifier string, temporal string, conversation string, note string"
)
JUDGEMENT = "question_id string, judge_model string, claims array<struct<text:string,supported:boolean,reason:string>>, faithfulness double, skipped string"
QUESTION = f"id string, kind string, text string, expected array<string>, expected_answer array<string>, history {_TURN}, suite string, note string"


def frame(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A typed table of rows, which may be none."""
    return spark.createDataFrame(rows, ddl)
