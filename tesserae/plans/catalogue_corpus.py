"""Catalogue: sentences, packing, links, curation, dedup, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import periods, text
from tesserae.operators import chunking, corpus
from tesserae.plans.catalogue import query
from tesserae.session import shared_folder, table
from tesserae.sources.store import KeyedTable

DOCS = "(SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)"
#: Sentence boundaries without look-behind: a mark that texts don't hold stands for the blank.
PIECES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+(["''(\[]?[A-Z0-9])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
ABBR = ", ".join(f"'{a}'" for a in text.ABBREVIATIONS)
SENTENCES = rf"""CASE WHEN len({PIECES}) = 0 THEN []::VARCHAR[] ELSE list_reduce(list_transform({PIECES}, lambda x: [x]),
  lambda a, x: CASE WHEN list_contains([{ABBR}], lower(regexp_extract(a[-1], '([\p{{L}}\p{{N}}_.]+)\.$', 1))) THEN list_concat(a[:-2], [a[-1] || ' ' || x[1]]) ELSE list_concat(a, x) END) END"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))


@query(f"WITH s AS (SELECT doc_id, {SENTENCES} AS s FROM {DOCS}) SELECT doc_id, len(s) AS n, coalesce(s[1], '') AS first, coalesce(s[-1], '') AS last, md5(array_to_string(s, chr(30))) AS all_of_them FROM s")
def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = docs(spark, d).select("doc_id", text.sentences(F.col("text")).alias("s"))
    end = lambda i: F.coalesce(F.try_element_at("s", F.lit(i)), F.lit(""))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), end(1).alias("first"), end(-1).alias("last"), F.md5(F.array_join("s", "\u001e")).alias("all_of_them"))


def pack_sql(pieces: str, size: int, joiner: str) -> str:
    """The greedy fold, with pieces wrapped as accumulators."""
    return f"""CASE WHEN len({pieces}) = 0 THEN []::VARCHAR[] ELSE list_append(list_reduce(list_transform({pieces}, lambda x: {{'d': []::VARCHAR[], 'c': x}}),
  lambda a, x: CASE WHEN length(a.c) + {len(joiner)} + length(x.c) > {size} THEN {{'d': list_append(a.d, a.c), 'c': x.c}} ELSE {{'d': a.d, 'c': a.c || '{joiner}' || x.c}} END).d,
  list_reduce(list_transform({pieces}, lambda x: {{'d': []::VARCHAR[], 'c': x}}),
  lambda a, x: CASE WHEN length(a.c) + {len(joiner)} + length(x.c) > {size} THEN {{'d': list_append(a.d, a.c), 'c': x.c}} ELSE {{'d': a.d, 'c': a.c || '{joiner}' || x.c}} END).c) END"""


PARAGRAPHS = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"WITH p AS (SELECT doc_id, {PARAGRAPHS} AS ps FROM {DOCS}), b AS (SELECT doc_id, {pack_sql('ps', 1200, chr(10))} AS b FROM p) SELECT doc_id, generate_subscripts(b, 1) - 1 AS position, unnest(b) AS body FROM b")
def q_pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    packed = chunking.pack(chunking.paragraphs(F.col("text"), "\n"), 1200, "\n")
    return docs(spark, d).select("doc_id", F.posexplode(packed).alias("position", "body")).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH s AS (SELECT doc_id, list_reverse({SENTENCES}) AS s FROM {DOCS}), n AS (SELECT doc_id, s, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[:i], lambda x: length(x))) + i - 1) AS sums FROM s)
SELECT doc_id, array_to_string(list_reverse(s[:len(list_filter(sums, lambda x: x <= 150))]), ' ') AS overlap FROM n""")
def q_overlap(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", chunking.overlap_text(F.col("text"), 150).alias("overlap"))


def folded(pieces: str, size: int, joiner: str) -> str:
    """The greedy fold, from nothing."""
    step = f"CASE WHEN a.c IS NULL THEN {{'d': a.d, 'c': x}} WHEN length(a.c) + 1 + length(x) > {size} THEN {{'d': list_append(a.d, a.c), 'c': x}} ELSE {{'d': a.d, 'c': a.c || {joiner} || x}} END"
    return ended(f"list_reduce({pieces}, lambda a, x: {step}, {{'d': []::VARCHAR[], 'c': NULL::VARCHAR}})")


def ended(fold: str) -> str:
    return f"list_transform([{fold}], lambda r: CASE WHEN r.c IS NULL THEN r.d ELSE list_append(r.d, r.c) END)[1]"


_HEADED = "CASE WHEN a.c IS NULL THEN x ELSE a.c || chr(10) || x END"
HEADED = ended(
    f"""list_reduce({PARAGRAPHS}, lambda a, x: CASE WHEN length(x) <= 70 AND NOT regexp_matches(x, '[.!?")]$') THEN {{'d': a.d, 'c': {_HEADED}}} ELSE {{'d': list_append(a.d, {_HEADED}), 'c': NULL::VARCHAR}} END, {{'d': []::VARCHAR[], 'c': NULL::VARCHAR}})"""
)
YEARS = r"list_transform(regexp_extract_all({}, '\b(1[89]\d{{2}}|20[0-2]\d)\b', 1), lambda y: y::INT)"


@query(rf"""WITH p AS (SELECT doc_id, {HEADED} AS ps FROM {DOCS}),
k AS (SELECT doc_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS text FROM p),
r AS (SELECT doc_id, k, CASE WHEN length(text) <= 1200 THEN [text] ELSE {folded(SENTENCES, 1200, "' '")} END AS rs FROM k),
j AS (SELECT doc_id, k, generate_subscripts(rs, 1) AS j, unnest(rs) AS run FROM r),
w AS (SELECT doc_id, k, j, CASE WHEN length(run) <= 1200 THEN [run] ELSE {folded(r"list_filter(string_split_regex(run, '\s+'), lambda x: x <> '')", 1200, "' '")} END AS ws FROM j),
i AS (SELECT doc_id, k, j, generate_subscripts(ws, 1) AS i, unnest(ws) AS u FROM w),
u AS (SELECT doc_id, list(u ORDER BY k, j, i) AS us FROM i GROUP BY doc_id),
f AS (SELECT doc_id, {folded("us", 1200, "chr(10)")} AS b FROM u),
b AS (SELECT doc_id, CASE WHEN len(b) > 1 AND length(b[-1]) < 200 THEN list_append(b[:-3], b[-2] || chr(10) || b[-1]) ELSE b END AS b FROM f),
c AS (SELECT doc_id, generate_subscripts(b, 1) - 1 AS position, unnest(b) AS body FROM b),
l AS (SELECT doc_id, position, body, coalesce(lag(body) OVER (PARTITION BY doc_id ORDER BY position), '') AS text FROM c),
s AS (SELECT doc_id, position, body, list_reverse({SENTENCES}) AS s FROM l),
n AS (SELECT *, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[:i], lambda x: length(x))) + i - 1) AS sums FROM s),
o AS (SELECT *, array_to_string(list_reverse(s[:len(list_filter(sums, lambda x: x <= 150))]), ' ') AS before FROM n),
y AS (SELECT o.doc_id, position, body, before, source AS title, lang AS heading, {YEARS.format("lang")} AS yh, {YEARS.format("source")} AS yt, {YEARS.format("body")} AS yb FROM o JOIN documents d ON d.doc_id = o.doc_id),
z AS (SELECT *, CASE WHEN len(yh) > 0 THEN yh WHEN len(yt) > 0 THEN yt ELSE yb END AS ys FROM y)
SELECT doc_id::VARCHAR AS doc_id, doc_id AS page_id, title, heading, position, doc_id || ':' || position AS chunk_id,
  CASE WHEN heading <> '' THEN title || ' — ' || heading ELSE title END || chr(10) || chr(10) || CASE WHEN before <> '' THEN before || chr(10) || chr(10) ELSE '' END || body AS text,
  list_min(ys) AS year_start, list_max(ys) AS year_end, CASE WHEN len(yh) > 0 THEN 'heading' WHEN len(yt) > 0 THEN 'title' WHEN len(yb) > 0 THEN 'text' ELSE '' END AS year_source FROM z""")
def q_chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.col("lang").alias("heading"), "text")
    return chunking.chunk_documents(rows, separator="\n").withColumn("position", F.col("position").cast("long"))


@query(r"""WITH t AS (SELECT o_custkey, string_agg(strftime(o_orderdate, '%Y-%m-%d'), ' ' ORDER BY o_orderkey) AS body, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS heading FROM orders GROUP BY o_custkey),
y AS (SELECT o_custkey, list_transform(regexp_extract_all(body, '\b(1[89]\d{2}|20[0-2]\d)\b', 1), lambda x: x::INT) AS ys FROM t)
SELECT o_custkey, list_min(ys) AS year_start, list_max(ys) AS year_end, CASE WHEN len(ys) > 0 THEN 'text' ELSE '' END AS year_source FROM y""")
def q_years_span(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("t")))), lambda x: x["t"]), " ").alias("body"))
    return o.select("o_custkey", periods.chunk_span(F.lit("no year"), F.lit(""), F.col("body")).alias("s")).select("o_custkey", "s.*")


@query(f"""WITH f AS (SELECT p_partkey, ['name: ' || p_name, 'brand: ' || p_brand, 'type: ' || p_type, 'size: ' || p_size] AS fs, p_brand FROM part), b AS (SELECT p_partkey, p_brand, {pack_sql('fs', 40, chr(10))} AS b FROM f),
e AS (SELECT p_partkey, p_brand, generate_subscripts(b, 1) - 1 AS position, unnest(b) AS body FROM b)
SELECT p_partkey || ':infobox:' || position AS chunk_id, p_partkey || ':0' AS doc_id, p_partkey AS page_id, p_brand || ' -- Infobox' || chr(10) || chr(10) || body AS text FROM e""")
def q_infobox_chunks(spark: SparkSession, d: str) -> DataFrame:
    field = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))
    rows = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(":0")).alias("doc_id"), F.col("p_partkey").alias("page_id"), F.lit(0).alias("position"), F.col("p_brand").alias("title"),
                                          F.array(field("name", "p_name"), field("brand", "p_brand"), field("type", "p_type"), field("size", "p_size")).alias("infobox"))
    return chunking.infobox_chunks(rows, 40).select("chunk_id", "doc_id", "page_id", "text")


HREFS = r"""h AS (SELECT page_id, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS theme, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS hs FROM pages),
l AS (SELECT DISTINCT theme, page_id AS seed, unnest(hs) AS title FROM h)"""


def hrefs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.col("page_id").alias("seed"), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("theme"), F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), 1).alias("hs"))
    return p.select("theme", "seed", F.explode(F.array_distinct("hs")).alias("title"))


@query(f"WITH {HREFS} SELECT theme, title, count(DISTINCT seed)::INT AS seed_count FROM l GROUP BY theme, title HAVING count(DISTINCT seed) >= 2")
def q_rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    return corpus.rank_candidates(hrefs(spark, d))


@query(f"""WITH {HREFS}, r AS (SELECT theme, title, count(DISTINCT seed) AS n FROM l GROUP BY theme, title HAVING count(DISTINCT seed) >= 2),
o AS (SELECT DISTINCT theme, 'seed ' || seed AS title FROM l), u AS (SELECT * FROM r UNION ALL SELECT o.theme, o.title, 2 FROM o ANTI JOIN r USING (theme, title))
SELECT theme, title, n::INT AS seed_count, row_number() OVER (PARTITION BY theme ORDER BY n DESC, title) AS ordinal FROM u""")
def q_curate(spark: SparkSession, d: str) -> DataFrame:
    links = hrefs(spark, d)
    seeds = links.select("theme", F.concat(F.lit("seed "), F.col("seed").cast("string")).alias("seed")).distinct()
    return corpus.curate(links, seeds).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"SELECT d.doc_id, d.lang FROM {DOCS} d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def q_resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return corpus.unindexed(docs(spark, d).select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query(f"SELECT doc_id, quality, toxic FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'de') USING (doc_id) UNION ALL SELECT doc_id, -1, 0 FROM {DOCS} WHERE lang = 'de'")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = docs(spark, d).where("lang = 'de'").select("doc_id", F.lit(-1).alias("quality"), F.lit(0).alias("toxic"))
    return corpus.upsert(table(spark, d, "labels"), new, "doc_id")


@query("""WITH a AS (SELECT doc_id, lang, source FROM documents WHERE lang <> 'de'), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang, source FROM documents WHERE lang = 'de' OR doc_id % 3 = 0),
u AS (SELECT * FROM a ANTI JOIN b USING (doc_id) UNION ALL SELECT * FROM b) SELECT doc_id, lang, coalesce('q' || l.quality, u.source) AS source FROM u LEFT JOIN labels l USING (doc_id) WHERE doc_id % 7 <> 1""")
def q_keyed_table(spark: SparkSession, d: str) -> DataFrame:
    """Four versions of a table kept by key: made, put in, refreshed from another table, taken out."""
    t, rows = KeyedTable(spark, shared_folder(spark, "keyed")), table(spark, d, "documents").select("doc_id", "lang", "source")
    t.create(rows.where("lang <> 'de'"), "doc_id", 16)
    t.upsert(rows.where("lang = 'de' or doc_id % 3 = 0").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "new").otherwise(F.col("lang"))))
    t.set_payload(table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source")), ["source"])
    t.delete(rows.where("doc_id % 7 = 1"))
    return t.read()


@query("SELECT d.doc_id, d.lang, coalesce('q' || l.quality, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_payload_refresh(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    return corpus.set_payload(table(spark, d, "documents").select("doc_id", "lang", "source"), new, ["source"], "doc_id")


@query("SELECT l.doc_id + 5 AS doc_id, l.quality FROM labels l ANTI JOIN documents d ON d.doc_id = l.doc_id + 5")
def q_unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus.unindexed(table(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id"), "quality"), table(spark, d, "documents"), "doc_id")


@query(r"""WITH r AS (SELECT source AS theme, 'doc ' || doc_id AS title FROM documents), b AS (SELECT source AS theme, 'doc ' || doc_id AS title FROM documents JOIN labels USING (doc_id)),
p AS (SELECT * FROM r ANTI JOIN b USING (theme, title)) SELECT theme, title, ((row_number() OVER (PARTITION BY theme ORDER BY title) - 1) // 50)::INT AS batch FROM p""")
def q_ingest_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("theme"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    done = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("theme", F.col("title").alias("requested_title"))
    return corpus.pending(rows, done)


@query(r"""SELECT theme, title, rule FROM (SELECT source AS theme, lang AS title, doc_id % 3 AS seed_count, doc_id FROM documents), LATERAL (SELECT unnest(list_filter([CASE WHEN seed_count < 1 THEN 'seed_count' END, CASE WHEN NOT regexp_full_match(theme, '[a-z0-9-]+') THEN 'theme' END], lambda x: x IS NOT NULL)) AS rule)""")
def q_registry_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("theme"), F.col("lang").alias("title"), (F.col("doc_id") % 3).cast("int").alias("seed_count"))
    return corpus.registry_violations(rows).select("theme", "title", "rule")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{00a0}\x{1680}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}]', ' ', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def q_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.whitespace(F.col("text")).alias("text"))


@query(f"WITH {HREFS} SELECT DISTINCT theme, seed FROM l WHERE seed % 3 = 0")
def q_missing_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds whose page isn't there: every third page is taken away."""
    seeds = hrefs(spark, d).select("theme", "seed")
    return corpus.missing_seeds(seeds, seeds.where("seed % 3 <> 0").withColumn("wikitext", F.lit("")))


@query(r"""WITH t AS (SELECT CASE WHEN doc_id % 4 = 0 THEN lang || '-' || source WHEN doc_id % 4 = 1 THEN 'Theme ' || doc_id ELSE 'd-' || doc_id END AS slug, doc_id, doc_id % 3 AS n FROM documents), u AS (SELECT *, count(*) OVER (PARTITION BY slug) AS c FROM t)
SELECT doc_id, rule FROM (SELECT doc_id, unnest(list_filter([CASE WHEN NOT coalesce(regexp_full_match(slug, '[a-z0-9-]+'), false) THEN 'slug' END, CASE WHEN n < 1 THEN 'seeds' END, CASE WHEN c > 1 THEN 'slug not unique' END], lambda x: x IS NOT NULL)) AS rule FROM u)""")
def q_theme_violations(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    slug = F.when(n % 4 == 0, F.concat("lang", F.lit("-"), "source")).when(n % 4 == 1, F.concat(F.lit("Theme "), n.cast("string"))).otherwise(F.concat(F.lit("d-"), n.cast("string")))
    rows = table(spark, d, "documents").select("doc_id", slug.alias("slug"), F.lit("name").alias("name"), F.expr("array_repeat('s', cast(doc_id % 3 as int))").alias("seeds"))
    return corpus.theme_violations(rows).select("doc_id", "rule")


@query("SELECT doc_id, 'https://en.wikipedia.org/w/index.php?oldid=' || doc_id AS url FROM documents")
def q_revision_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.revision_url(F.col("doc_id")).alias("url"))
