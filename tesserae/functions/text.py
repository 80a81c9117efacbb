"""Text expressions. All take and give columns; none needs Python on the executors."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces whose pages aren't articles.
NON_ARTICLE = (
    "category", "file", "image", "media", "template", "module", "help", "portal", "wikipedia", "wp", "special", "talk", "user", "draft",
    "mediawiki", "book", "timedtext", "wikt", "commons", "s",
)
# Abbreviations whose full stop doesn't end a sentence.
ABBREVIATIONS = (
    "u.s", "u.k", "u.s.s.r", "e.g", "i.e", "cf", "ca", "c", "approx", "vs", "mr", "mrs", "ms", "dr", "prof", "gen", "col", "lt", "sgt", "capt",
    "st", "mt", "no", "vol", "pp", "ed", "jr", "sr",
)
# How a refusal opens.
REFUSALS = ("not in the sources", "the sources do not cover", "the sources do not provide")
# Phrases of questions about a passage instead of the world.
BANNED = (
    "the passage", "this passage", "the text", "this text", "the article", "this article", "the excerpt", "the source", "the document",
    "mentioned above", "described above",
)

TOKEN = r"[\p{L}\p{N}]+"
# Fixed value: where a sentence may end, so that boundaries agree with those of existing chunks.
SENTENCE = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"
#: Between an end mark and white space: what is cheap to see is looked at first, as this is tried at every character.
_MARK = r"(?U)(?<=[.!?])(?=\s)"
#: Right after an abbreviation, whose stop ends no sentence.
_ABBREVIATED = r"(?<=(?<![\w.])(?iu:" + "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True)) + r")\.)"
COPY_WINDOW = 6
MAX_CLAIMS = 12


def _any(columns: list[Column]) -> Column:
    return functools.reduce(operator.or_, columns)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: What Unicode calls white space.
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(c, F.lit(_BLANKS))


def tokenize(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def term_id(term: Column) -> Column:
    """CRC32 of a term's UTF-8 bytes, unsigned, as a long."""
    return F.crc32(term)


def is_non_article(title: Column) -> Column:
    """Whether a link leads into a namespace of no articles (a colon alone doesn't)."""
    rest = F.regexp_extract(title, r"(?s)^[^:]*:(.*)$", 1)
    return (F.instr(title, ":") > 0) & (rest != "") & F.lower(strip(F.substring_index(title, ":", 1))).isin(*NON_ARTICLE)


def normalise_target(raw: Column) -> Column:
    """The article that a link names: no leading colons, no ``#`` part, spaces for underscores, first letter upper; else null."""
    t = F.regexp_replace(strip(raw), "^:+", "")
    t = F.replace(strip(F.regexp_extract(t, "(?s)^([^#]*)", 1)), F.lit("_"), F.lit(" "))
    name = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2**30))
    return F.when((t != "") & ~is_non_article(t), name)


def wiki_links(wikitext: Column) -> Column:
    """Sorted distinct articles that any link of a markup text names."""
    raw = F.regexp_extract_all(wikitext, F.lit(r"\[\[([^\[\]\|]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, normalise_target), lambda t: t.isNotNull())))


def wiki_categories(wikitext: Column) -> Column:
    """Sorted distinct categories that a markup text declares, without sort keys."""
    raw = F.regexp_extract_all(wikitext, F.lit(r"(?i)\[\[\s*:?\s*category:([^\[\]\|]*)"), 1)
    names = F.transform(raw, lambda t: F.replace(strip(t), F.lit("_"), F.lit(" ")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda t: t != "")))


# Titles and templates of pages without a subject of their own.
TITLE_PREFIXES = ("list of", "lists of", "outline of", "index of", "timeline of", "glossary of", "bibliography of")
DISAMBIGUATION = ("disambiguation", "disambig", "dab", "hndis", "geodis", "numberdis")


def is_non_content(title: Column, wikitext: Column) -> Column:
    """Lists, outlines, disambiguations and redirects; never judged by length."""
    low = F.lower(strip(title))
    template = r"(?i)\{\{\s*(" + "|".join(DISAMBIGUATION) + r")\s*[|}]"
    return low.rlike("^(" + "|".join(TITLE_PREFIXES) + ")") | F.contains(low, F.lit("(disambiguation)")) | wikitext.rlike(r"(?i)^\s*#redirect") | wikitext.rlike(template)


def template_name(raw: Column) -> Column:
    """Without comments, white space in one, lower case."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(raw, r"(?s)<!--.*?-->", ""), r"\s+", " ")))


def whitespace(text: Column) -> Column:
    """Unusual spaces plain, no spaces at line ends, two line feeds at most in a row, trimmed."""
    t = F.regexp_replace(text, r"[   -​  　]", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Sentences of a text; one that would end in an abbreviation takes in the next one. Blank texts have none.

    Gaps after abbreviations become a space and the others are cut at, so the work grows with the text.
    """
    whole = F.regexp_replace(strip(text), _MARK + _ABBREVIATED + SENTENCE, " ")
    return F.filter(F.transform(F.split(whole, _MARK + _ABBREVIATED.replace("(?<=", "(?<!", 1) + SENTENCE), strip), lambda s: s != "")


def refused(answer: Column) -> Column:
    """Whether the first sentence declines the question."""
    first = F.lower(F.element_at(F.split(strip(answer), r"(?<=[.!?])\s", 2), 1))
    return _any([F.contains(first, F.lit(x)) for x in REFUSALS])


def markers(text: Column) -> Column:
    """All citation numbers ``[n]`` in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int"))


def cited(text: Column, sources: Column) -> Column:
    """Distinct citation numbers that name one of ``sources`` sources, in order of first use."""
    return F.array_distinct(F.filter(markers(text), lambda n: (n >= 1) & (n <= sources)))


def invalid_markers(found: Column, sources: Column) -> Column:
    return F.filter(found, lambda n: (n < 1) | (n > sources))


def states_fact(answer: Column, forms: Column) -> Column:
    """Whether an answer states one of the forms: case and commas aside, numbers not within longer ones; null without forms."""
    flat = lambda c: F.replace(F.lower(c), F.lit(","), F.lit(""))

    def pattern(form: Column) -> Column:
        f = flat(form)
        quoted = F.concat(F.lit(r"\Q"), F.replace(f, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        return F.concat(F.when(f.rlike(r"^\d"), F.lit(r"(?<!\d)")).otherwise(F.lit("")), quoted, F.when(f.rlike(r"\d$"), F.lit(r"(?!\d)")).otherwise(F.lit("")))

    return F.when(F.size(forms) > 0, F.exists(forms, lambda f: F.regexp_like(flat(answer), pattern(f))))


def words_ascii(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def copies_source(question: Column, text: Column, window: int = COPY_WINDOW) -> Column:
    """Whether ``window`` words of the question in a row stand in the text, its ends inside words included."""
    asked, source = words_ascii(question), F.array_join(words_ascii(text), " ")
    starts = F.when(F.size(asked) >= window, F.sequence(F.lit(1), F.size(asked) - (window - 1))).otherwise(F.array().cast("array<int>"))
    return F.exists(F.transform(starts, lambda i: F.array_join(F.slice(asked, i, window), " ")), lambda g: F.contains(source, g))


def usable(question: Column, text: Column, least: int = 25, most: int = 220) -> Column:
    q = strip(question)
    return q.endswith("?") & F.length(q).between(least, most) & ~_any([F.contains(F.lower(q), F.lit(b)) for b in BANNED]) & ~copies_source(q, text)


def parse_claims(text: Column, limit: int = MAX_CLAIMS) -> Column:
    """Claims, one a line, without bullets and citations; longer than 10 characters, ``limit`` at most."""
    bare = lambda s: strip(F.regexp_replace(F.regexp_replace(s, r"^\s*(?:\d+[.)]|[-*•])\s*", ""), r"\[\d+\]", ""))
    return F.slice(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), bare), lambda s: F.length(s) > 10), 1, limit)


def parse_verdict(text: Column) -> Column:
    """``supported`` (null if neither is said) and the reason after the first dash of the first line."""
    first = F.element_at(F.split(strip(text), "\n", 2), 1)
    up = F.upper(first)
    said = F.when(F.contains(up, F.lit("NOT SUPPORTED")), F.lit(False)).when(F.contains(up, F.lit("SUPPORTED")), F.lit(True))
    return F.struct(said.alias("supported"), strip(F.regexp_extract(first, r"^[^-]*-(.*)$", 1)).alias("reason"))


def rewrite_clean(text: Column, question: Column, most: int = 300) -> Column:
    """A rewritten question, or the original if it is empty, long or of several lines."""
    t = F.regexp_replace(strip(text), r"^[\"'\s]+|[\"'\s]+$", "")
    return F.when((t == "") | (F.length(t) > most) | F.contains(t, F.lit("\n")), question).otherwise(t)


def hyde_clean(passage: Column, least: int = 120, most: int = 1200) -> Column:
    t = strip(F.regexp_replace(passage, r"\s+", " "))
    return F.when(F.length(t).between(least, most), t)


def verify_decide(draft: Column, reply: Column) -> Column:
    """The answer to ship, and whether its words changed: the ``<answer>`` block unless missing, empty or a refusal."""
    block = strip(F.regexp_extract(reply, r"(?s)<answer>(.*?)</answer>", 1))
    keep = (block == "") | refused(block)
    words = lambda c: F.split(strip(c), r"\s+")
    return F.struct(F.when(keep, draft).otherwise(block).alias("answer"), (~keep & (words(block) != words(draft))).alias("revised"))


def fingerprint(*parts: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256 over the parts, joined by unit separators."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(p.cast("string") for p in parts)), 256), 1, 16)


def question_id(chunk_id: Column) -> Column:
    return F.concat(F.lit("syn-"), F.replace(chunk_id, F.lit(":"), F.lit("-")))


def source_label(title: Column, heading: Column) -> Column:
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(title, F.lit(" — "), heading)).otherwise(title)


def revision_url(revision_id: Column, wiki: str = "https://en.wikipedia.org") -> Column:
    """The lasting link to the revision that a text came from, which later edits don't change."""
    return F.concat(F.lit(f"{wiki}/w/index.php?oldid="), revision_id.cast("string"))
