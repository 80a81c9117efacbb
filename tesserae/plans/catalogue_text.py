"""Catalogue: titles, links, markup, periods, answers and verdicts, over texts put together from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import periods, text
from tesserae.operators import corpus
from tesserae.operators import evaluation as E
from tesserae.plans.catalogue import query
from tesserae.session import table


def turn(xs: list[str], by: str = "doc_id") -> Column:
    """One of the texts, by the remainder of an id."""
    return F.element_at(F.array(*map(F.lit, xs)), (F.col(by) % len(xs) + 1).cast("int"))


def turn_sql(xs: list[str], by: str = "doc_id") -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in xs) + f"][({by} % {len(xs)} + 1)::INT]"


def names(xs: object) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def target_sql(raw: str) -> str:
    """The name before namespaces are looked at."""
    return "replace(" + trimmed(f"regexp_extract(regexp_replace({trimmed(raw)}, '^:+', ''), '^([^#]*)', 1)") + ", '_', ' ')"


NAMED = f"CASE WHEN t <> '' AND NOT (contains(t, ':') AND substr(t, strpos(t, ':') + 1) <> '' AND list_contains({names(text.NON_ARTICLE)}, lower(trim(split_part(t, ':', 1))))) THEN replace(upper(t[1]), 'ẞ', 'SS') || t[2:] END"

BEFORE, AFTER = ["", "  ", ":", "Category:", "File:", "wikt:", " : ", "Star trek: "], ["", "#History", "  ", "#", " # x"]


@query(f"""WITH r AS (SELECT doc_id, {turn_sql(BEFORE)} || replace(source, '-', '_') || '_' || lang || {turn_sql(AFTER)} AS raw FROM documents), n AS (SELECT doc_id, raw, {target_sql("raw")} AS t FROM r)
SELECT doc_id, raw, {NAMED} AS title FROM n""")
def q_normalise_target(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(turn(BEFORE), F.replace("source", F.lit("-"), F.lit("_")), F.lit("_"), F.col("lang"), turn(AFTER))
    rows = table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return rows.withColumn("title", text.normalise_target(F.col("raw")))


HEADS, TAILS = ["List of ", "Outline of the ", "", "LISTS OF ", "Listening to ", "", " index of "], ["", " (disambiguation)", "", " (Disambiguation) 2", ""]
OPENINGS = ["#REDIRECT [[x]] ", "{{dab|x}}", "", "  #redirect", "{{ Hndis }}", "{{stub}}", "{{dabble}}", "", "", "", ""]


@query(rf"""WITH r AS (SELECT doc_id, {turn_sql(HEADS)} || source || {turn_sql(TAILS)} AS title, {turn_sql(OPENINGS)} || coalesce(text, '') AS w FROM documents)
SELECT doc_id, title, regexp_matches(lower(trim(title)), '^({"|".join(text.TITLE_PREFIXES)})') OR contains(lower(title), '(disambiguation)') OR regexp_matches(w, '(?i)^\s*#redirect') OR regexp_matches(w, '(?i)\{{\{{\s*({"|".join(text.DISAMBIGUATION)})\s*[|}}]') AS dropped FROM r""")
def q_non_content(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat(turn(HEADS), "source", turn(TAILS)).alias("title"), F.concat(turn(OPENINGS), F.coalesce("text", F.lit(""))).alias("w"))
    return rows.select("doc_id", "title", text.is_non_content(F.col("title"), F.col("w")).alias("dropped"))


LINKS = f"""h AS (SELECT page_id AS seed, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS theme, unnest(regexp_extract_all(html, 'href="/([^"\\[\\]|]+)', 1)) AS raw FROM pages), n AS (SELECT seed, theme, {target_sql("raw")} AS t FROM h),
l AS (SELECT DISTINCT theme, seed, {NAMED} AS title FROM n WHERE {NAMED} IS NOT NULL)"""


@query(f"WITH {LINKS} SELECT theme, seed, title FROM l")
def q_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of seed pages, their anchors put as markup."""
    markup = F.regexp_replace("html", r'<a [^>]*?href="/([^"]*)"[^>]*>', r"[[$1]]")
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("theme"), F.col("page_id").alias("seed"), markup.alias("wikitext"))
    return corpus.seed_links(pages)


@query("""WITH b AS (SELECT doc_id % 100 AS page_id, source, lang, doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id % 7 DESC, doc_id DESC) AS n FROM documents)
SELECT page_id, (SELECT array_to_string(list_sort(list(DISTINCT source)), ',') FROM b c WHERE c.page_id = b.page_id) AS themes, lang AS title, doc_id AS revision_id, md5(text) AS digest FROM b WHERE n = 1""")
def q_dedup_group(spark: SparkSession, d: str) -> DataFrame:
    """A page's newest revision and its themes: documents as revisions of a hundred pages."""
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("doc_id") % 7)
    bronze = table(spark, d, "documents").select((F.col("doc_id") % 100).alias("page_id"), F.col("source").alias("theme"), F.col("lang").alias("title"), F.coalesce("text", F.lit("")).alias("wikitext"), F.col("doc_id").alias("revision_id"), at.alias("revision_timestamp"), at.alias("fetched_at"), F.lit("x").alias("license"))
    return corpus.articles(bronze).select("page_id", F.array_join("themes", ",").alias("themes"), "title", "revision_id", F.md5("wikitext").alias("digest"))


#: A page's markup around the letters of a text, and what should be left of it.
PAGE = ["{{Infobox treaty\n| name = [[Rome]]\n| image = x.jpg\n| note = <ref>n</ref>\n}}\n", ".<ref>see here</ref> It was signed{{sfn|A|2001}} in [[Rome|the city]] and [[berlin]]. [[File:a.jpg|thumb|of [[Paris]]]]\n\n\n\n", "\n== Later ==\n", " lasted within {{convert|50|km}} of {{lang|de|Berlin}}&nbsp;now.\n== References ==\n", "\n[[Category:Old_things|key]] [[Category:New things]]"]
WORDS = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(rf"""WITH w AS (SELECT doc_id AS page_id, {WORDS} AS w FROM documents), s AS (SELECT page_id, '' AS heading, w || '. It was signed in the city and berlin.' AS text, ['Berlin', 'Rome'] AS links, 0 AS o FROM w
UNION ALL SELECT page_id, 'Later', w || ' lasted within 50 km of Berlin now.', []::VARCHAR[], 1 FROM w)
SELECT page_id || ':' || position AS doc_id, page_id, heading, text, array_to_string(links, ',') AS links, 'New things,Old things' AS categories, 'treaty' AS infobox_type, 'name=Rome' AS infobox FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS position FROM s WHERE length(text) >= 200)""")
def q_silver_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections, links, categories and infobox of markup that holds each text."""
    w = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    at = F.timestamp_seconds(F.lit(0))
    bronze = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("t").alias("theme"), F.lit("A page").alias("title"), F.concat(F.lit(PAGE[0]), w, F.lit(PAGE[1]), F.lit(PAGE[2]), w, F.lit(PAGE[3]), w, F.lit(PAGE[4])).alias("wikitext"), F.lit(1).cast("long").alias("revision_id"), at.alias("revision_timestamp"), at.alias("fetched_at"), F.lit("x").alias("license"))
    box = F.array_join(F.transform("infobox", lambda f: F.concat(f["key"], F.lit("="), f["value"])), ",")
    return corpus.build_silver(bronze).select("doc_id", "page_id", "heading", "text", F.array_join("link_targets", ",").alias("links"), F.array_join("categories", ",").alias("categories"), "infobox_type", box.alias("infobox"))


ASKED = ["What happened from {y} to {z}?", "The crisis of {y}–{z}", "Who ruled in {y}?", "the early {t}s", "the late {t}s to the mid-{u}s", "what came after {y}", "the {y} treaty ending the First World War", "early Cold War spies", "nothing dated here", "the middle of {y} and early {z}", "after the war, between {y} and {z}", "life in the {u}s, before the Great War", "{y} was interwar"]
YEARS = {"y": "1900 + doc_id % 90", "z": "1905 + doc_id * 7 % 90", "t": "1900 + doc_id % 9 * 10", "u": "1910 + doc_id % 7 * 10"}


def asked_sql() -> str:
    x = turn_sql(ASKED)
    for k, e in YEARS.items():
        x = f"replace({x}, '{{{k}}}', ({e})::VARCHAR)"
    return x


def _era_sql(at: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(question), '{n}') THEN {periods.ERAS[n][at]}" for n in sorted(periods.ERAS, key=len, reverse=True)) + " END"


_RANGE_SQL = r"'(?i)\b(1[89]\d{2}|20[0-2]\d)\s*(?:-|--|–|—|to|and|until)\s*(1[89]\d{2}|20[0-2]\d)\b'"
_TENS_SQL = r"'(?i)\b(early|mid|late)?[\s-]*(1[89]\d0|20[0-2]0)s\b'"


def _decade_sql(at: int) -> str:
    part = "CASE x.w " + " ".join(f"WHEN '{k}' THEN {v[at]}" for k, v in periods.DECADE_PARTS.items()) + " END"
    return f"list_{('min', 'max')[at]}(list_transform(list_zip(ws, ts), lambda p: {part.replace('x.w', "lower(coalesce(p[1], ''))")} + p[2]::INT))"


@query(rf"""WITH q AS (SELECT doc_id, {asked_sql()} AS question FROM documents),
p AS (SELECT *, regexp_extract(question, {_RANGE_SQL}, 1) AS a, regexp_extract(question, {_RANGE_SQL}, 2) AS b, regexp_extract_all(question, {_TENS_SQL}, 1) AS ws, regexp_extract_all(question, {_TENS_SQL}, 2) AS ts,
  list_transform(regexp_extract_all(question, '\b(1[89]\d{{2}}|20[0-2]\d)\b', 1), lambda y: y::INT) AS ys, NOT regexp_matches(question, '{periods.DIRECTIONAL}') AS points FROM q)
SELECT doc_id, question, CASE WHEN a <> '' THEN least(a::INT, b::INT) WHEN len(ts) > 0 THEN {_decade_sql(0)} WHEN points THEN coalesce(list_min(ys), {_era_sql(0)}) END AS start,
  CASE WHEN a <> '' THEN greatest(a::INT, b::INT) WHEN len(ts) > 0 THEN {_decade_sql(1)} WHEN points THEN coalesce(list_max(ys), {_era_sql(1)}) END AS "end" FROM p""")
def q_parse_period(spark: SparkSession, d: str) -> DataFrame:
    question = turn(ASKED)
    for k, e in YEARS.items():
        question = F.replace(question, F.lit("{" + k + "}"), F.expr(f"cast({e} as string)"))
    rows = table(spark, d, "documents").select("doc_id", question.alias("question")).withColumn("p", periods.parse_period(F.col("question")))
    return rows.select("doc_id", "question", "p.start", "p.end")


META = {"embedding_model": "max(lang)", "generation_model": "min(source)", "collection": "max('c')", "points": "cast(count(*) as string)", "k": "max('5')", "reranker": "cast(max(n_chars) as string)", "hybrid": "min(lang)"}


def _meta_sql(where: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, {META.get(n, 'max(NULL)').replace('as string', 'as varchar')} AS value FROM documents{where}" for n in E.COMPARABLE)


@query(f"""WITH a AS ({_meta_sql("")}), b AS ({_meta_sql(" WHERE doc_id % 2 = 0")}), j AS (SELECT name, a.value AS baseline, b.value AS candidate, name IN ('reranker', 'k') AS declared, a.value IS NOT DISTINCT FROM b.value AS same FROM a JOIN b USING (name))
SELECT name, baseline, candidate, CASE WHEN declared THEN 'declared changed' ELSE 'equal' END AS rule, CASE WHEN declared AND same THEN 'fail' WHEN declared THEN 'warn' WHEN same THEN 'pass' ELSE 'fail' END AS status FROM j""")
def q_gate_comparability(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    meta = lambda rows: rows.agg(*(F.expr(META.get(n, "cast(null as string)")).alias(n) for n in E.COMPARABLE))
    return E.comparable(meta(docs), meta(docs.where("doc_id % 2 = 0")), ("reranker", "k"))


SAID = ["Not in the sources. ", "The sources do not cover this! ", "It was [1]. ", "In 1956, 699 died [2][7][2]. ", "About 1,485 men [3] [1] [0]. ", "It cost 41,291 [5]; "]
FORMS = {"1": ["699"], "2": ["485", "41291"], "3": []}


@query(r"""WITH r AS (SELECT conv_id, turn, """ + turn_sql(SAID, "(conv_id + turn)") + r""" || coalesce(text, '') AS answer, CASE (conv_id % 3)::INT WHEN 1 THEN ['699'] WHEN 2 THEN ['485', '41291'] ELSE [] END AS forms FROM conversations),
m AS (SELECT *, regexp_extract_all(answer, '\[(\d+)\]', 1) AS ms, """ + trimmed("answer") + r""" AS t, replace(lower(answer), ',', '') AS flat FROM r),
f AS (SELECT *, lower(CASE WHEN regexp_matches(t, '(?s)[.!?]\s') THEN regexp_extract(t, '(?s)^(.*?[.!?])\s', 1) ELSE t END) AS first FROM m)
SELECT conv_id, turn, contains(first, 'not in the sources') OR contains(first, 'the sources do not cover') OR contains(first, 'the sources do not provide') AS refused, array_to_string(ms, ',') AS markers,
  array_to_string(list_filter(ms, lambda x, i: list_position(ms, x) = i AND x::INT BETWEEN 1 AND 5), ',') AS cited,
  array_to_string(list_filter(ms, lambda x: x::INT < 1 OR x::INT > 5), ',') AS invalid,
  CASE WHEN len(forms) > 0 THEN len(list_filter(forms, lambda x: regexp_matches(flat, '(^|[^0-9])' || x || '([^0-9]|$)'))) > 0 END AS states_fact FROM f""")
def q_refused_citations_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("n", F.col("conv_id") + F.col("turn"))
    rows = rows.select("conv_id", "turn", F.concat(turn(SAID, "n"), F.coalesce("text", F.lit(""))).alias("answer"))
    forms = F.when(F.col("conv_id") % 3 == 1, F.array(F.lit("699"))).when(F.col("conv_id") % 3 == 2, F.array(F.lit("485"), F.lit("41291"))).otherwise(F.array().cast("array<string>"))
    a, join = F.col("answer"), lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("conv_id", "turn", text.refused(a).alias("refused"), join(text.markers(a)).alias("markers"), join(text.cited(a, F.lit(5))).alias("cited"), join(text.invalid_markers(text.markers(a), F.lit(5))).alias("invalid"), text.states_fact(a, forms).alias("states_fact"))


RULED = ["SUPPORTED - ", "NOT SUPPORTED - ", "not supported ", "Unclear: ", "supported: yes - ", "\nSupported - "]


@query(f"""WITH r AS (SELECT item_id, {trimmed(turn_sql(RULED, "item_id") + " || text")} AS t FROM benchmark), f AS (SELECT item_id, split_part(t, chr(10), 1) AS f FROM r)
SELECT item_id, CASE WHEN contains(upper(f), 'NOT SUPPORTED') THEN FALSE WHEN contains(upper(f), 'SUPPORTED') THEN TRUE END AS supported, {trimmed("regexp_extract(f, '^[^-]*-(.*)$', 1)")} AS reason FROM f""")
def q_verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", text.parse_verdict(F.concat(turn(RULED, "item_id"), F.col("text"))).alias("v"))
    return rows.select("item_id", "v.supported", "v.reason")


LISTED = r"list_filter(list_transform(string_split_regex(r, '\r\n|\r|\n'), lambda s: " + trimmed(r"regexp_replace(regexp_replace(s, '^\s*(?:\d+[.)]|[-*•])\s*', ''), '\[\d+\]', '', 'g')") + "), lambda s: length(s) > 10)"


@query(rf"""WITH r AS (SELECT doc_id, '1. ' || replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || '- '), '! ', ' [3]!' || chr(10) || '2) ') AS r FROM documents), c AS (SELECT doc_id, ({LISTED})[1:12] AS c FROM r)
SELECT doc_id, len(c) AS claims, md5(array_to_string(c, '|')) AS digest, len(list_filter(c, lambda x: regexp_matches(x, 'a.*e') AND NOT regexp_matches(x, 'o'))) = 0 AND len(list_filter(c, lambda x: regexp_matches(x, '(?i)xx|\d{{9}}'))) = 0 AND len(c) >= 2 AS passed FROM c""")
def q_split_probe(spark: SparkSession, d: str) -> DataFrame:
    """Claims read from a reply that lists a text's sentences, and whether they keep a rule."""
    reply = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n- ")), F.lit("! "), F.lit(" [3]!\n2) "))
    rows = table(spark, d, "documents").select("doc_id", text.parse_claims(F.concat(F.lit("1. "), reply)).alias("c"))
    ok = E.split_check(F.col("c"), F.array(F.struct(F.lit("a.*e").alias("when"), F.lit("o").alias("then"))), F.array(F.lit(r"(?i)xx|\d{9}")), F.lit(2), F.lit(False))
    return rows.select("doc_id", F.size("c").cast("long").alias("claims"), F.md5(F.array_join("c", "|")).alias("digest"), ok.alias("passed"))


@query(rf"""WITH b AS (SELECT item_id, text, regexp_replace(' "' || text || '" ', '^["''\s]+|["''\s]+$', '', 'g') AS r, {trimmed(r"regexp_replace(text || '  ' || text, '\s+', ' ', 'g')")} AS h FROM benchmark)
SELECT item_id, CASE WHEN r = '' OR length(r) > 300 OR contains(r, chr(10)) THEN 'q' ELSE r END AS rewrite, CASE WHEN length(h) BETWEEN 120 AND 1200 THEN h END AS hyde, 'syn-' || item_id || '-1-2' AS id,
lower({trimmed(r"regexp_replace(' Infobox ' || chr(10) || text, '\s+', ' ', 'g')")}) AS template FROM b""")
def q_cleaners(spark: SparkSession, d: str) -> DataFrame:
    t, i = F.col("text"), F.col("item_id").cast("string")
    return table(spark, d, "benchmark").select(
        "item_id", text.rewrite_clean(F.concat(F.lit(' "'), t, F.lit('" ')), F.lit("q")).alias("rewrite"), text.hyde_clean(F.concat(t, F.lit("  "), t)).alias("hyde"),
        text.question_id(F.concat(i, F.lit(":1:2"))).alias("id"), text.template_name(F.concat(F.lit(" Infobox <!-- x -->\n"), t)).alias("template"),
    )


OPEN, CLOSE = ["<answer>", "no block ", "<answer> Not in the sources. ", "x <answer>Better: ", "<answer>  "], [" </answer>", "", "</answer>", "</answer> y <answer>z</answer>", "\n</answer>"]


@query(rf"""WITH r AS (SELECT item_id, text AS draft, {turn_sql(OPEN, "item_id")} || text || {turn_sql(CLOSE, "item_id")} AS reply FROM benchmark), b AS (SELECT *, {trimmed("regexp_extract(reply, '(?s)<answer>(.*?)</answer>', 1)")} AS b FROM r),
k AS (SELECT *, b = '' OR regexp_matches(lower(CASE WHEN regexp_matches(b, '(?s)[.!?]\s') THEN regexp_extract(b, '(?s)^(.*?[.!?])\s', 1) ELSE b END), '{"|".join(text.REFUSALS)}') AS k FROM b)
SELECT item_id, CASE WHEN k THEN draft ELSE b END AS answer, NOT k AND string_split_regex(b, '\s+') <> string_split_regex({trimmed("draft")}, '\s+') AS revised FROM k""")
def q_verify_decide(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", text.verify_decide(F.col("text"), F.concat(turn(OPEN, "item_id"), "text", turn(CLOSE, "item_id"))).alias("x"))
    return rows.select("item_id", "x.answer", "x.revised")


@query(r"""SELECT item_id, right(q, 1) = '?' AND length(q) BETWEEN 25 AND 220 AND NOT regexp_matches(lower(q), '""" + "|".join(text.BANNED) + r"""') AS usable FROM (SELECT item_id, """ + trimmed("text || CASE WHEN item_id % 2 = 0 THEN '?' WHEN item_id % 3 = 0 THEN ' in the text?' ELSE '' END") + """ AS q FROM benchmark)""")
def q_usable(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat("text", F.when(F.col("item_id") % 2 == 0, "?").when(F.col("item_id") % 3 == 0, " in the text?").otherwise(""))
    return table(spark, d, "benchmark").select("item_id", text.usable(q, F.lit("another text altogether")).alias("usable"))
