"""Chunks of documents, by folds within one row: no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.periods import chunk_span
from tesserae.functions.text import let, sentences, source_label, strip

SIZE, OVERLAP, MIN_TAIL, HEADING_MAX = 1200, 150, 200, 70
PARAGRAPH = "\n\n"

_STRINGS = "array<string>"
_FOLD = "struct<done:array<string>,cur:string>"


def _seed() -> Column:
    return F.struct(F.array().cast(_STRINGS).alias("done"), F.lit(None).cast("string").alias("cur")).cast(_FOLD)


def _finish(acc: Column) -> Column:
    return F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))


def pack(pieces: Column, size: int | Column, joiner: str) -> Column:
    """Pieces joined greedily, in order, to strings of at most ``size`` characters; a longer piece stands alone."""

    def add(acc: Column, piece: Column) -> Column:
        longer = F.length(acc["cur"]) + len(joiner) + F.length(piece) > size
        return (
            F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), piece.alias("cur")))
            .when(longer, F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), piece.alias("cur")))
            .otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit(joiner), piece).alias("cur")))
        )

    return F.aggregate(pieces, _seed(), add, _finish)


def attach_headings(paragraphs: Column) -> Column:
    """Short paragraphs without an end mark are put, on a line of their own, before the next paragraph; the last ones stand alone."""
    heading = lambda p: (F.length(p) <= HEADING_MAX) & ~p.rlike(r'[.!?")]$')

    def add(acc: Column, p: Column) -> Column:
        whole = F.when(acc["cur"].isNull(), p).otherwise(F.concat(acc["cur"], F.lit("\n"), p))
        return F.when(heading(p), F.struct(acc["done"].alias("done"), whole.alias("cur"))).otherwise(F.struct(F.concat(acc["done"], F.array(whole)).alias("done"), F.lit(None).cast("string").alias("cur")))

    return F.aggregate(paragraphs, _seed(), add, _finish)


def paragraphs(text: Column, separator: str = PARAGRAPH) -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


def units(text: Column, size: int, separator: str = PARAGRAPH) -> Column:
    """Paragraphs, the long ones as runs of sentences, and runs that are longer still, of one sentence each, as runs of words."""
    words = lambda s: pack(F.filter(F.split(s, r"\s+"), lambda w: w != ""), size, " ")
    cut = lambda runs: F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= size, F.array(r)).otherwise(words(r))))
    joined = attach_headings(paragraphs(text, separator))
    return F.flatten(F.transform(joined, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(pack(sentences(p), size, " ")))))


def _from_end(found: Column, overlap: int) -> Column:
    """``t``, the last sentences that fit, and ``stop``, whether one didn't."""
    seed = F.struct(F.lit("").alias("t"), F.lit(False).alias("stop"))

    def add(acc: Column, s: Column) -> Column:
        t = F.when(acc["t"] == "", s).otherwise(F.concat(s, F.lit(" "), acc["t"]))
        stop = acc["stop"] | (F.length(t) > overlap)
        return F.struct(F.when(stop, acc["t"]).otherwise(t).alias("t"), stop.alias("stop"))

    return F.aggregate(F.reverse(found), seed, add)


def overlap_text(body: Column, overlap: int) -> Column:
    """Whole sentences from the end of a body, ``overlap`` characters at most, joined by spaces.

    They are looked for in the end of the body alone, but for what may be cut off
    there; only if all of that fits, in the whole body.
    """
    tail = sentences(F.right(body, F.lit(2 * overlap + 100)))
    of_tail = _from_end(F.slice(tail, F.lit(2), F.greatest(F.size(tail) - 1, F.lit(0))), overlap)
    return let(of_tail, lambda r: F.when(r["stop"], r["t"]).otherwise(_from_end(sentences(body), overlap)["t"]))


def bodies(text: Column, size: int = SIZE, separator: str = PARAGRAPH, min_tail: int = MIN_TAIL) -> Column:
    """Bodies of chunks; a last one shorter than ``min_tail`` joins the one before it, whatever the size."""

    def whole(found: Column) -> Column:
        n = F.size(found)
        tail = F.concat(F.element_at(found, -2), F.lit(separator), F.element_at(found, -1))
        short = (n > 1) & (F.length(F.try_element_at(found, F.lit(-1))) < min_tail)
        return F.when(short, F.concat(F.slice(found, 1, F.greatest(n - 2, F.lit(0))), F.array(tail))).otherwise(found)

    return let(pack(units(text, size, separator), size, separator), whole)


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separator: str = PARAGRAPH) -> DataFrame:
    """Chunks of sections ``doc_id, page_id, title, heading, text`` with all other columns kept.

    A chunk's text is its label, the overlap of the body before it, and its body,
    set apart by blank lines; ids count from 0 in each document; years are told
    from heading, title or body.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    # an inner explode would have the optimizer compute the bodies again to see which rows have any
    rows = docs.withColumn("__bodies", bodies(F.col("text"), size, separator))
    rows = rows.select(*(c for c in docs.columns if c not in ("text", "position")), "__bodies", F.posexplode_outer("__bodies").alias("position", "__body")).where("position is not null")
    before = F.when(F.col("position") > 0, overlap_text(F.element_at("__bodies", F.col("position")), overlap))
    label = source_label(F.col("title"), F.col("heading"))
    text = F.concat_ws("\n\n", label, F.filter(F.array(before), lambda t: t != ""), F.col("__body"))
    span = chunk_span(F.col("heading"), F.col("title"), F.col("__body"))
    rows = rows.withColumn("chunk_id", F.concat_ws(":", "doc_id", F.col("position").cast("string"))).withColumn("text", text).withColumn("__span", span)
    return rows.select("*", "__span.*").drop("__bodies", "__body", "__span")


def infobox_chunks(sections: DataFrame, size: int = SIZE) -> DataFrame:
    """``chunk_id, doc_id, page_id, title, position, text`` of each page's infobox, told once, from its first section."""
    first = W.partitionBy("page_id").orderBy("position")
    rows = sections.where("size(infobox) > 0").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    lines = F.transform("infobox", lambda f: F.concat(f["key"], F.lit(": "), f["value"]))
    packed = pack(lines, size, "\n")
    rows = rows.select("doc_id", "page_id", "title", F.posexplode(packed).alias("position", "body"))
    text = F.concat(F.col("title"), F.lit(" -- Infobox\n\n"), F.col("body"))
    return rows.select(F.concat(F.col("page_id").cast("string"), F.lit(":infobox:"), F.col("position").cast("string")).alias("chunk_id"), "doc_id", "page_id", "title", "position", text.alias("text"))
