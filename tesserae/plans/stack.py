"""One wiring of a run, for the command line, the HTTP surface and tests: what it does, what must hold, what it records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import periods, text
from tesserae.operators import evaluation as E
from tesserae.operators import retrieval as R
from tesserae.operators import runs, spending
from tesserae.plans.search import SearchConfig, search
from tesserae.session import few
from tesserae.settings import Settings
from tesserae.sources import schemas as S
from tesserae.sources.seams import Embedder, Generator, embed, generate

SYSTEM = "Answer from the sources alone and cite them as [n]. Say that it is not in the sources if they lack it."
REWRITE = "Rewrite the last question so that it can be read without the turns before it. Reply with the question alone."
#: Fields of a run's meta row that a run may declare as changed against its baseline.
DECLARABLE = ("generation_model", "k", "reranker", "hybrid")


@dataclass(frozen=True)
class RunConfig:
    """What a run does. No field has a default, so none is left out unseen; an empty ``reranker`` is none."""

    k: int
    generation_model: str
    reranker: str
    hybrid: bool
    temporal: bool
    conversation: bool
    max_per_article: int | None

    @classmethod
    def of(cls, settings: Settings, **changed: object) -> RunConfig:
        """What the settings say, but for what ``changed`` names."""
        s = settings
        own = cls(s.k, s.generation_model, s.reranker, s.hybrid, s.temporal, s.conversation, s.max_per_article or None)
        return replace(own, **changed)

    def described(self, settings: Settings = Settings()) -> dict[str, object]:
        """The fields as a meta row has them: switches are told in words, "" where they are off."""
        on = {"hybrid": f"bm25+rrf(k={settings.rrf_k})" if self.hybrid else "", "temporal": "period arm" if self.temporal else "", "conversation": "rewritten" if self.conversation else ""}
        return asdict(self) | on


def meta(spark: SparkSession, config: RunConfig, settings: Settings = Settings(), **known: object) -> DataFrame:
    """The meta row of a run; ``known`` has the fields that a config doesn't tell (``run_id``, ``points``, ``note`` and others)."""
    row = config.described(settings) | {"overfetch": settings.overfetch, "max_per_document": settings.max_per_document} | known
    names = [c.split()[0] for c in S.META.split(", ")]
    if unknown := set(row) - set(names):
        raise ValueError(f"not a field of a run: {sorted(unknown)}")
    return S.frame(spark, [tuple(row.get(n) for n in names)], S.META)


def changed_fields(baseline: DataFrame | None, config: RunConfig, settings: Settings = Settings()) -> frozenset[str]:
    """Declarable fields in which a run differs from its baseline's meta row; none without a baseline."""
    row = baseline.select(*DECLARABLE).first() if baseline is not None else None
    mine = config.described(settings)
    shown = lambda v: "" if v is None else str(v)
    return frozenset(n for n in DECLARABLE if row is not None and shown(row[n]) != shown(mine[n]))


@dataclass(frozen=True)
class Check:
    """Something that a run needs, whether it holds, and a word about it."""

    name: str
    ok: bool
    detail: str


def preconditions(generator: Generator | None, index: Callable[[], DataFrame]) -> list[Check]:
    """Whether there is a generator, the index can be read, and it has rows: what is found here would else be found a whole run later."""
    checks = [Check("generator", generator is not None, "is there" if generator is not None else "none is configured")]
    try:
        empty, error = index().isEmpty(), None
    except Exception as e:  # noqa: BLE001  whatever it is, the index can't be read
        empty, error = True, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    checks.append(Check("index", error is None, error or "can be read"))
    return [*checks, Check("rows in the index", not empty, "none" if empty else "at least one")]


def candidates(dense: DataFrame, sparse: DataFrame, mode: str, pool: int, rrf_k: int = R.RRF_K, weight: float = 1.0, extra: int = 10) -> DataFrame:
    """Rows ``qid, id, rank`` for a second ranking by the mode of a sweep: the dense list, its union with sparse rows, or both fused. ``pool`` bounds the sparse list."""
    sparse = sparse.where(F.col("rank") <= pool)
    if mode == "dense":
        return dense.select("qid", "id", "rank")
    if mode == "union":
        return R.union_candidates(dense.select("qid", "id", "rank"), sparse.select("qid", "id", "rank"), extra).select("qid", "id", "rank")
    if mode == "fuse":
        return R.rrf([("dense", dense), ("sparse", sparse)], rrf_k, {"sparse": weight}).select("qid", "id", "rank")
    raise ValueError(f"mode must be dense, union or fuse, not {mode!r}")


def standalone(questions: DataFrame, rewriter: Generator | None) -> DataFrame:
    """Add ``standalone``: questions with turns before them, rewritten; the question itself without turns or rewriter, or if the reply is no question."""
    own = F.col("text")
    if rewriter is None:
        return questions.withColumn("standalone", own)
    turns = F.array_join(F.transform(F.coalesce("history", F.array().cast("array<struct<user:string,assistant:string>>")), lambda h: F.concat(F.lit("user: "), h["user"], F.lit("\nassistant: "), F.coalesce(h["assistant"], F.lit("")))), "\n")
    talks = F.size("history") > 0
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = questions.withColumn("__messages", F.array(message("system", F.lit(REWRITE)), message("user", F.concat(turns, F.lit("\nuser: "), own))))
    said = generate(asked.where(talks), rewriter, "__messages", "__reply")
    rest = asked.where(~F.coalesce(talks, F.lit(False))).withColumn("__reply", F.lit(None).cast("string"))
    rows = said.unionByName(rest)
    return rows.withColumn("standalone", F.coalesce(text.rewrite_clean(F.col("__reply"), own), own)).drop("__messages", "__reply")


def ranked(index: DataFrame, questions: DataFrame, config: RunConfig, embedder: Embedder, settings: Settings = Settings(), rerank_score: Column | None = None) -> DataFrame:
    """``qid, rank, id, doc_id, page_id, title, heading, text, score``, with what else a search tells, of each question's best chunks; ``questions``: id, text."""
    asked = embed(questions.select(F.col("id").alias("qid"), "text"), embedder, out="query")
    asked = asked.withColumn("__p", periods.parse_period(F.col("text"))).select("*", "__p.*").drop("__p")
    how = SearchConfig(
        k=config.k, overfetch=settings.overfetch, hybrid=config.hybrid, temporal=config.temporal, max_per_document=settings.max_per_document,
        max_per_article=config.max_per_article, rrf_k=settings.rrf_k,
    )
    chunks = index.withColumnRenamed("chunk_id", "id")
    found = search(chunks, asked, how, rerank_score if config.reranker else None)
    shown = chunks.select("id", "title", "heading", "text")
    most = 200_000 // config.k  # a question finds k rows at most
    return shown.join(F.broadcast(found) if few(questions.select("id"), most) else found, "id")


def execute(
    index: DataFrame, questions: DataFrame, config: RunConfig, embedder: Embedder, generator: Generator, settings: Settings = Settings(),
    rewriter: Generator | None = None, rerank_score: Column | None = None, verifier: Generator | None = None, ceiling: float = 0.0, meter: spending.Meter | None = None,
) -> DataFrame:
    """A record for each question: rewritten if it follows turns, searched, answered. ``questions``: as ``schemas.QUESTION``.

    With a ``verifier``, a ``ceiling`` (dollars) or a ``meter``, answers come from
    ``spending.verified``, which makes its calls at once; else they are made as the
    records are computed.
    """
    asked = standalone(questions, rewriter if config.conversation else None)
    found = ranked(index, asked.select("id", F.col("standalone").alias("text")), config, embedder, settings, rerank_score)
    answer = None
    if verifier is not None or ceiling > 0 or meter is not None:
        answer = lambda rows: spending.verified(rows, generator, config.generation_model, verifier, ceiling, meter=meter)
    records = runs.run_all(questions, found, generator, SYSTEM, config.generation_model, min(config.k, settings.k), answer)
    said = asked.select(F.col("id").alias("__id"), F.col("standalone").alias("__said"))
    return records.join(said, records["question_id"] == said["__id"]).withColumn("standalone", F.col("__said")).select(*records.columns)


def gated(baseline: tuple[DataFrame, DataFrame], candidate: tuple[DataFrame, DataFrame], changed: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """All checks of a run against its baseline, each given as meta and records: first that they can be compared, then every metric of every suite."""
    sides = [E.summarise(records, (("suite",), ())) for _, records in (baseline, candidate)]
    fields = E.comparable(baseline[0], candidate[0], sorted(changed))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    fields = fields.select(F.lit("run").alias("suite"), "name", number("baseline"), number("candidate"), "rule", "status")
    return fields.unionByName(E.gate(*sides).select("suite", "name", "baseline", "candidate", "rule", "status"))
