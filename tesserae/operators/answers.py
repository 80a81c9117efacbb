"""The answer path: prompts, conversation windows, citations, the semantic cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text

THRESHOLD, MAX_ENTRIES = 0.8124, 256
HISTORY_TURNS, ANSWER_CHARS = 2, 600


def source_block(number: Column, title: Column, body: Column) -> Column:
    return F.concat(F.lit('<source id="'), number.cast("string"), F.lit('" title="'), F.replace(title, F.lit('"'), F.lit("'")), F.lit('">\n'), body, F.lit("\n</source>"))


def prompts(questions: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """``qid, sources, prompt``: numbered blocks of the first ``k`` ranked rows (``qid, rank, title, text``), then the question."""
    block = source_block(F.col("rank"), F.col("title"), F.col("text"))
    blocks = ranked.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    rows = questions.join(blocks, "qid", "left")
    joined = F.coalesce(F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n"), F.lit("No sources were found."))
    return rows.select("qid", F.coalesce(F.size("bs"), F.lit(0)).alias("sources"), F.concat(joined, F.lit("\n\n# QUESTION\n\n"), F.col("text")).alias("prompt"))


def messages(prompt: Column, system: str) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def conversation_windows(turns: DataFrame, depth: int = HISTORY_TURNS, chars: int = ANSWER_CHARS) -> DataFrame:
    """``conv_id, turn, text, history``: each user turn with the last ``depth`` pairs before it, answers cut to ``chars``. ``turns``: conv_id, turn, role, text."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.where("role in ('user', 'assistant')").withColumns({"__next": F.lead("role").over(w), "__reply": F.lead("text").over(w)}).where("role = 'user'")
    pair = F.when(F.col("__next") == "assistant", F.struct(F.col("text").alias("user"), F.substring("__reply", 1, chars).alias("assistant")))
    rows = rows.withColumn("history", F.collect_list(pair).over(w.rowsBetween(-depth, -1)))
    return rows.select("conv_id", "turn", "text", "history")


def finish(answers: DataFrame) -> DataFrame:
    """Ship the verified answer, sum the tokens (null if unknown), and cite from what is shipped. Needs draft, reply, sources, and counts of both calls."""
    decided = text.verify_decide(F.col("draft"), F.col("reply"))
    rows = answers.withColumn("__d", F.when(F.col("reply").isNotNull(), decided).otherwise(F.struct(F.col("draft").alias("answer"), F.lit(False).alias("revised"))))
    total = lambda a, b: F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(None).cast("long")).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    rows = rows.withColumns({"answer": F.col("__d.answer"), "revised": F.col("__d.revised"), "prompt_tokens": total("prompt_tokens", "verify_prompt_tokens"), "completion_tokens": total("completion_tokens", "verify_completion_tokens")})
    return rows.withColumn("citations", text.cited(F.col("answer"), F.col("sources"))).drop("__d")


class SemanticCache:
    """Answers by nearness of question vectors: at most ``size``, the oldest leaves first, another fingerprint empties it."""

    def __init__(self, threshold: float = THRESHOLD, size: int = MAX_ENTRIES) -> None:
        self.threshold, self.size = threshold, size
        self.fingerprint: str | None = None
        self.keys: list[object] = []
        self.vectors: list[np.ndarray] = []

    def check(self, fingerprint: str) -> None:
        if fingerprint != self.fingerprint:
            self.fingerprint, self.keys, self.vectors = fingerprint, [], []

    def lookup(self, vector: np.ndarray) -> tuple[object, float] | None:
        """The nearest entry's key (the earliest of equals) and its cosine, if near enough."""
        if not self.vectors:
            return None
        scores = np.stack(self.vectors) @ self._unit(vector)
        best = int(scores.argmax())
        return (self.keys[best], float(scores[best])) if scores[best] >= self.threshold else None

    def store(self, key: object, vector: np.ndarray) -> None:
        if len(self.keys) >= self.size:
            self.keys.pop(0)
            self.vectors.pop(0)
        self.keys.append(key)
        self.vectors.append(self._unit(vector))

    @staticmethod
    def _unit(vector: np.ndarray) -> np.ndarray:
        n = float(np.linalg.norm(vector))
        if n == 0:
            raise ValueError("zero vector")
        return np.asarray(vector, float) / n


def replay_cache(asked: DataFrame, threshold: float = THRESHOLD, size: int = MAX_ENTRIES) -> DataFrame:
    """``tenant, seq, hit, score`` of each question in order, a cache for each tenant; ``asked``: tenant, seq, vector, fingerprint.

    Rows of a tenant stream through one task in order; the state is ``size`` vectors.
    """
    rows = asked.repartition("tenant").sortWithinPartitions("tenant", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, cache = object(), SemanticCache(threshold, size)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.tenant != tenant:
                    tenant, cache = r.tenant, SemanticCache(threshold, size)
                cache.check(r.fingerprint)
                vector = np.asarray(r.vector, float)
                hit = cache.lookup(vector)
                if hit is None:
                    cache.store(r.seq, vector)
                out.append((r.tenant, r.seq, hit[0] if hit else None, hit[1] if hit else None))
            result = pd.DataFrame(out, columns=["tenant", "seq", "hit", "score"])
            yield result.astype({"hit": "Int64", "score": "Float64"})

    kind = dict(asked.dtypes)["tenant"]
    return rows.select("tenant", "seq", "vector", "fingerprint").mapInPandas(run, f"tenant {kind}, seq long, hit long, score double")
