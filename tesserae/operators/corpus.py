"""Corpus tables: curation, ingest, Bronze to Silver to Gold, index upkeep. Idempotent by keys, joins instead of loops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.text import is_non_content, term_id, tokenize, wiki_categories, wiki_links
from tesserae.operators.chunking import OVERLAP, SIZE, chunk_documents, infobox_chunks
from tesserae.operators.markup import MIN_SECTION, parsed
from tesserae.operators.retrieval import corpus_stats, tf_weight
from tesserae.sources import schemas as S
from tesserae.sources.seams import MAX_TITLES, Embedder, RevisionSource, embed

MIN_SEEDS = 2


def rank_candidates(links: DataFrame, least: int = MIN_SEEDS) -> DataFrame:
    """``theme, title, seed_count`` from rows of ``theme, seed, title``: titles that enough seeds link to."""
    return links.groupBy("theme", "title").agg(F.countDistinct("seed").cast("int").alias("seed_count")).where(F.col("seed_count") >= least)


def curate(links: DataFrame, seeds: DataFrame, least: int = MIN_SEEDS) -> DataFrame:
    """Candidates of each theme, and its seeds with the least count where they aren't candidates; ``ordinal`` tells the order."""
    ranked = rank_candidates(links, least)
    own = seeds.select("theme", F.col("seed").alias("title")).distinct().join(ranked, ["theme", "title"], "left_anti").withColumn("seed_count", F.lit(least))
    w = W.partitionBy("theme").orderBy(F.desc("seed_count"), F.asc("title"))
    return ranked.unionByName(own).withColumn("ordinal", F.row_number().over(w))


def missing_seeds(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """``theme, seed`` of seeds for which there is no page (``theme, seed, wikitext``, null if it wasn't found)."""
    return seeds.select("theme", "seed").distinct().join(pages.where("wikitext is not null").select("theme", "seed"), ["theme", "seed"], "left_anti")


def curate_pages(pages: DataFrame, seeds: DataFrame, least: int = MIN_SEEDS) -> DataFrame:
    """``curate`` from the pages of the seeds; a seed without a page is an error, as it is a slip of a person's hand."""
    if lost := missing_seeds(seeds, pages).orderBy("theme", "seed").limit(20).collect():
        raise ValueError("seeds without a page: " + ", ".join(f"{r['theme']}: {r['seed']}" for r in lost))
    return curate(seed_links(pages), seeds, least)


def theme_violations(themes: DataFrame) -> DataFrame:
    """Themes (``slug, name, seeds``) that break a rule, with its name: a slug in lower case that can be a folder and is nobody else's, a seed at least."""
    n = themes.groupBy("slug").agg(F.count("*").alias("__n"))
    rows = themes.join(n, themes["slug"].eqNullSafe(n["slug"])).drop(n["slug"])
    rules = F.array(
        F.when(~F.coalesce(F.col("slug").rlike(r"^[a-z0-9-]+\z"), F.lit(False)), F.lit("slug")), F.when(F.coalesce(F.size("seeds"), F.lit(0)) < 1, F.lit("seeds")), F.when(F.col("__n") > 1, F.lit("slug not unique")),
    )
    return rows.withColumn("rule", F.explode(F.array_compact(rules))).drop("__n")


def seed_links(pages: DataFrame) -> DataFrame:
    """``theme, seed, title`` from seed pages ``theme, seed, wikitext``."""
    return pages.select("theme", "seed", F.explode(wiki_links(F.col("wikitext"))).alias("title"))


def registry_violations(registry: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rule's name."""
    rules = F.array(
        F.when(~F.coalesce(F.col("theme").rlike("^[a-z0-9-]+$"), F.lit(False)), F.lit("theme")),
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.lit("title")),
        F.when(~F.coalesce(F.col("seed_count") >= 1, F.lit(False)), F.lit("seed_count")),
    )
    return registry.withColumn("rule", F.explode(F.array_compact(rules)))


def pending(registry: DataFrame, bronze: DataFrame, refresh: bool = False, batch: int = MAX_TITLES) -> DataFrame:
    """Entries not yet ingested (all on refresh), in batches of one theme."""
    if not 1 <= batch <= MAX_TITLES:
        raise ValueError(f"batch must be 1 to {MAX_TITLES}")
    rows = registry.select("theme", "title").distinct()
    if not refresh:
        rows = rows.join(bronze.select("theme", F.col("requested_title").alias("title")).distinct(), ["theme", "title"], "left_anti")
    w = W.partitionBy("theme").orderBy("title")
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch).cast("int"))


def fetched(entries: DataFrame, source: RevisionSource, license: str = "CC BY-SA 4.0") -> DataFrame:
    """Bronze rows of pending entries, a call to the source for each batch; a title that isn't found has a null ``page_id``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        theme, titles = rows["theme"].iloc[0], rows["title"].tolist()
        got = source.fetch_batch(titles)
        now = pd.Timestamp.now(tz="UTC").tz_localize(None)
        out = [{"page_id": r["page_id"], "title": r["title"], "requested_title": r["requested_title"], "theme": theme, "revision_id": r["revision_id"],
                "revision_timestamp": pd.Timestamp(r["revision_timestamp"]), "wikitext": r["wikitext"], "fetched_at": now, "license": license} for r in got.revisions]
        out += [{"page_id": None, "title": None, "requested_title": t, "theme": theme, "revision_id": None, "revision_timestamp": pd.NaT, "wikitext": None, "fetched_at": now, "license": license} for t in got.missing]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in S.BRONZE.split(", ")])
        return frame.astype({"page_id": "Int64", "revision_id": "Int64"})

    return entries.groupBy("theme", "batch").applyInPandas(run, S.BRONZE)


def articles(bronze: DataFrame) -> DataFrame:
    """A row a page: its newest revision, and its themes sorted and distinct. Aggregates combine before the shuffle."""
    newest = F.max_by(F.struct("title", "wikitext", "revision_id", "revision_timestamp", "license"), F.struct("fetched_at", "revision_id"))
    rows = bronze.groupBy("page_id").agg(F.array_sort(F.collect_set("theme")).alias("themes"), newest.alias("r"))
    return rows.select("page_id", "themes", "r.*")


def build_silver(bronze: DataFrame, least: int = MIN_SECTION, seen: Observation | None = None) -> DataFrame:
    """Sections of articles that have content, with their article's infobox, categories and provenance; ``seen`` counts pages and those skipped as they pass."""
    rows = articles(bronze).withColumn("__skip", is_non_content(F.col("title"), F.col("wikitext")))
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("pages"), F.count_if("__skip").alias("skipped"))
    rows = rows.where(~F.col("__skip")).drop("__skip").withColumn("categories", wiki_categories(F.col("wikitext")))
    rows = parsed(rows, least).select("*", F.explode("parsed.sections").alias("s"))
    return rows.select(
        F.concat_ws(":", F.col("page_id").cast("string"), F.col("s.position").cast("string")).alias("doc_id"), "page_id", "s.position", "title", "s.heading", "s.text",
        "themes", "s.link_targets", "categories", "parsed.infobox_type", "parsed.infobox", "revision_id", "revision_timestamp", "license",
    )


def build_gold(silver: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separator: str = "\n\n") -> DataFrame:
    """Prose chunks, then infobox chunks; ``ordinal`` orders them within each kind and page."""
    base = ["doc_id", "page_id", "title", "heading", "text", "themes", "revision_id", "revision_timestamp", "license"]
    prose = chunk_documents(silver.select(*base, "position"), size, overlap, separator)
    columns = [c.split()[0] for c in S.GOLD.replace("array<string>", "x").split(", ")]
    first = silver.withColumn("__n", F.row_number().over(W.partitionBy("page_id").orderBy("position"))).where("__n = 1")
    boxes = infobox_chunks(silver, size).drop("title", "doc_id").join(first.select("page_id", "doc_id", "title", "themes", "revision_id", "revision_timestamp", "license"), "page_id")
    boxes = boxes.withColumns({"heading": F.lit("Infobox"), "year_start": F.lit(None).cast("int"), "year_end": F.lit(None).cast("int"), "year_source": F.lit("")})
    return prose.select(*columns).withColumn("segment", F.lit(0)).unionByName(boxes.select(*columns).withColumn("segment", F.lit(1)))


def payload(gold: DataFrame) -> DataFrame:
    """What a search needs of a chunk beside its vector; spans are null where undated."""
    return gold.select("chunk_id", "doc_id", "page_id", "position", "title", "heading", "text", "themes", "revision_id", F.date_format("revision_timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("revision_timestamp"), "year_start", "year_end")


def unindexed(chunks: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that the index lacks."""
    return chunks.join(index.select(key), key, "left_anti")


def build_index(gold: DataFrame, embedder: Embedder, index: DataFrame | None = None, batch: int = 200) -> DataFrame:
    """Rows for the index: payload, vector, and the term weights of BM25; with ``index``, of the chunks that it lacks.

    The average length is one aggregate over all chunks, those that the index has
    included, so a resumed build gives the weights of a whole one. A chunk's terms
    are weighted where it lies.
    """
    _, average = corpus_stats(gold)
    rows = payload(gold if index is None else unindexed(gold, index)).withColumn("__tokens", tokenize(F.col("text")))
    weight = lambda t: tf_weight(F.size(F.filter("__tokens", lambda x: x == t)), F.size("__tokens"), average)
    rows = rows.withColumn("sparse", F.transform(F.array_distinct("__tokens"), lambda t: F.struct(term_id(t).alias("term_id"), weight(t).alias("weight"))))
    return embed(rows.drop("__tokens"), embedder, batch=batch)


def upsert(index: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index with the rows put in, the same key replaced."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows)


def set_payload(index: DataFrame, rows: DataFrame, columns: list[str], key: str = "chunk_id") -> DataFrame:
    """New values of ``columns`` where a key exists and the value isn't null; no key is added."""
    new = rows.select(key, *(F.col(c).alias(f"__new_{c}") for c in columns))
    joined = index.join(new, key, "left")
    return joined.select(*(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in index.columns))


def has_all(index: DataFrame, keys: DataFrame, key: str = "chunk_id") -> bool:
    return keys.join(index.select(key), key, "left_anti").isEmpty()


def report(rows: Iterator[tuple[str, int]]) -> str:
    return ", ".join(f"{name} {n:,}" for name, n in rows)


def counted_write(rows: DataFrame, root: str, **counts: Column) -> dict[str, int]:
    """Write a table and count on the way, in one job; ``counts`` are aggregates beside the number of rows. Tasks that are run again count once."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items())).write.mode("overwrite").parquet(root)
    return seen.get


def write_silver(bronze: DataFrame, root: str, least: int = MIN_SECTION) -> dict[str, int]:
    """Write Silver and tell ``articles`` (pages with content), ``skipped`` pages and ``rows``, all from the job that writes."""
    seen = Observation()
    rows = counted_write(build_silver(bronze, least, seen), root)["rows"]
    pages = seen.get
    return {"articles": pages["pages"] - pages["skipped"], "skipped": pages["skipped"], "rows": rows}


def write_index(gold: DataFrame, embedder: Embedder, root: str, batch: int = 200) -> dict[str, int]:
    """Write the whole index and tell ``rows``, ``dated`` chunks and the ``terms`` of their weights."""
    return counted_write(build_index(gold, embedder, batch=batch), root, dated=F.count("year_start"), terms=F.coalesce(F.sum(F.size("sparse")), F.lit(0)))
