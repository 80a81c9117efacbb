"""Encyclopedia markup to prose: nested templates, links, tags and tables need a parser, so this is Python, once a page."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.batches import pieces
from tesserae.functions.text import NON_ARTICLE

# Templates of which the named positions, or all positional parameters, are prose.
KEEP = {"lang": (2,), "convert": (1, 2), "flag": (1,), "flagcountry": (1,)}
KEEP_ALL = (
    "birth date", "birth date and age", "death date", "death date and age", "start date", "start date and age", "end date", "end date and age",
    "dts", "plainlist", "ubl", "unbulleted list", "hlist", "collapsible list", "native name", "nowrap", "nobold", "small",
)
# Starts of infobox field names that hold no facts, and headings of sections without prose.
SKIP_FIELDS = (
    "image", "caption", "coordinates", "flag", "map", "logo", "alt", "width", "size", "border", "pushpin", "photo", "signature", "seal", "blank", "module",
)
DROP_HEADINGS = (
    "references", "references and notes", "references and sources", "notes", "notes and references", "notes and citations", "explanatory notes",
    "footnotes", "citations", "citations and notes", "sources", "sources and references", "general references", "works cited", "bibliography",
    "further reading", "see also", "external links", "external link",
)
MIN_SECTION = 200

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_HOLD = re.compile("\x02(\\d+)\x03")
_HEADING = re.compile(r"^==(?!=)\s*(.*?)\s*==[ \t]*$", re.M)


def target(raw: str) -> str | None:
    """The article that a link names, or None."""
    title = raw.strip().lstrip(":").partition("#")[0].strip().replace("_", " ")
    space, colon, rest = title.partition(":")
    if not title or (colon and rest and space.strip().lower() in NON_ARTICLE):
        return None
    return title[0].upper() + title[1:]


def _name(raw: str) -> str:
    return " ".join(_COMMENT.sub("", raw).split()).lower()


def _innermost(text: str, opening: str, closing: str, replace: Callable[[str], str]) -> str:
    """Replace balanced pairs from the inside out; marks without a partner stay."""
    starts: list[int] = []
    out: list[str] = []
    i = 0
    while i < len(text):
        if text.startswith(opening, i):
            starts.append(len(out))
            out.append(opening)
            i += len(opening)
        elif starts and text.startswith(closing, i):
            at = starts.pop()
            inner = "".join(out[at + 1 :])
            del out[at:]
            out.append(replace(inner))
            i += len(closing)
        else:
            stop = min((p for p in (text.find(opening, i + 1), text.find(closing, i + 1)) if p >= 0), default=len(text))
            out.append(text[i:stop])
            i = stop
    return "".join(out)


def _split(inner: str) -> list[str]:
    """Parts between bars that aren't inside a link."""
    parts, depth, last, i = [], 0, 0, 0
    while i < len(inner):
        if inner.startswith("[[", i):
            depth, i = depth + 1, i + 2
        elif inner.startswith("]]", i):
            depth, i = max(0, depth - 1), i + 2
        else:
            if inner[i] == "|" and not depth:
                parts.append(inner[last:i])
                last = i + 1
            i += 1
    return [*parts, inner[last:]]


def parameters(inner: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """A template's name and its parameters: key, value, and whether the key is written out."""
    name, *parts = _split(inner)
    found, nth = [], 0
    for part in parts:
        key, eq, value = part.partition("=")
        if eq and "[[" not in key and "\x02" not in key:
            found.append((key.strip(), value, True))
        else:
            nth += 1
            found.append((str(nth), part, False))
    return _name(name), found


def _rescued(inner: str) -> str | None:
    name, found = parameters(inner)
    if name in KEEP_ALL:
        return " ".join(v.strip() for _, v, named in found if not named and v.strip())
    if name not in KEEP:
        return None
    last = {k: v for k, v, _ in found}
    return " ".join(last[str(i)].strip() for i in KEEP[name] if str(i) in last)


def _drop_links(text: str, keep: Callable[[str], str]) -> str:
    return _innermost(text, "[[", "]]", lambda inner: keep(inner) if target(inner.partition("|")[0]) is not None else "")


def clean(wikitext: str) -> tuple[str, list[str]]:
    """Prose of a markup text, and the articles that it links to, sorted."""
    held: list[str] = []

    def template(inner: str) -> str:
        text = _rescued(inner)
        if text is None:
            held.append(inner)
            return f"\x02{len(held) - 1}\x03"
        return text

    text = _COMMENT.sub("", re.sub("[\x02\x03]", "", wikitext))
    text = _innermost(text, "{{", "}}", template)
    text = re.sub(r"<ref\b[^<>]*/\s*>", "", text, flags=re.I)
    text = re.sub(r"<ref\b[^<>]*>.*?</ref\s*>", "", text, flags=re.I | re.S)
    text = _innermost(text, "{|", "|}", lambda _: "")
    text = re.sub(r"<table\b[^<>]*>.*?</table\s*>", "", text, flags=re.I | re.S)
    whole = text  # dropped templates keep their links
    while _HOLD.search(whole):
        whole = _HOLD.sub(lambda m: "{{" + held[int(m[1])] + "}}", whole)
    marked = _drop_links(whole, lambda inner: f"[\x04[{inner}]\x04]")
    kept = {target(m[1]) or "" for m in re.finditer(r"\[\x04\[([^\[\]|]*)", marked)}
    text = _drop_links(_HOLD.sub("", text), lambda inner: inner.rpartition("|")[2])
    text = re.sub(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]", r"\1", text)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"^(={1,6})\s*(.*?)\s*\1[ \t]*$", r"\2", text, flags=re.M)
    text = re.sub(r"</?[A-Za-z][^<>]*>", "", text)
    text = re.sub(r"^[*#:;]+\s*", "", text, flags=re.M)
    return tidy(html.unescape(text)), sorted(kept - {""})


def tidy(text: str) -> str:
    text = re.sub(r"[   -​  　]", " ", text)
    text = re.sub(r"[ \t]+$", "", text, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def templates(wikitext: str) -> list[str]:
    """Insides of all templates, outer ones before those in them."""
    found: list[tuple[int, str]] = []
    opens: list[int] = []
    for m in re.finditer(r"\{\{|\}\}", wikitext):
        if m[0] == "{{":
            opens.append(m.start())
        elif opens:
            at = opens.pop()
            found.append((at, wikitext[at + 2 : m.start()]))
    return [inner for _, inner in sorted(found)]


def infobox(wikitext: str) -> tuple[str, list[tuple[str, str]]] | None:
    """Type and fields of the first infobox, or None. A field given twice has its last value at its first place."""
    for inner in templates(wikitext):
        if not _name(_flat_split(inner)[0]).startswith("infobox"):
            continue
        fields: dict[str, str] = {}
        for part in _flat_split(inner)[1:]:
            key, _, value = part.partition("=")
            key = _name(key)
            if key.startswith(SKIP_FIELDS):
                continue
            value = " ".join(clean(value)[0].split())
            if value:
                fields[key] = value
        return _name(_flat_split(inner)[0]).removeprefix("infobox").strip() or "unknown", list(fields.items())
    return None


def _flat_split(inner: str) -> list[str]:
    """Parts between bars outside of links and templates."""
    parts, depth, last = [], 0, 0
    for m in re.finditer(r"\[\[|\{\{|\]\]|\}\}|\|", inner):
        if m[0] == "|":
            if not depth:
                parts.append(inner[last : m.start()])
                last = m.end()
        else:
            depth = max(0, depth + (1 if m[0] in ("[[", "{{") else -1))
    return [*parts, inner[last:]]


def sections(wikitext: str, least: int = MIN_SECTION) -> list[tuple[int, str, str, list[str]]]:
    """Position, heading, prose and links of the lead and the sections at level 2, deeper ones inside; apparatus and short ones dropped."""
    cuts = list(_HEADING.finditer(wikitext))
    spans = [("", wikitext[: cuts[0].start() if cuts else len(wikitext)])]
    spans += [(m[1], wikitext[m.end() : n.start() if n else len(wikitext)]) for m, n in zip(cuts, [*cuts, None][1:], strict=True)]
    out = []
    for raw, body in spans:
        heading = clean(raw)[0]
        if heading.lower() in DROP_HEADINGS:
            continue
        text, links = clean(body)
        if len(text) >= least:
            out.append((len(out), heading, text, links))
    return out


#: Bytes of markup that a task holds as Python's strings at once.
PIECE = 2_000_000
_PARSED = "struct<infobox_type:string,infobox:array<struct<key:string,value:string>>,sections:array<struct<position:int,heading:string,text:string,link_targets:array<string>>>>"
_KIND = pa.struct([
    ("infobox_type", pa.string()), ("infobox", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))),
    ("sections", pa.list_(pa.struct([("position", pa.int32()), ("heading", pa.string()), ("text", pa.string()), ("link_targets", pa.list_(pa.string()))]))),
])


def parsed_batches(batches: Iterator[pa.RecordBatch], least: int = MIN_SECTION, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``parsed`` more, in pieces of about ``most`` bytes of markup; a page is in one piece."""
    for whole in batches:
        sizes = pc.binary_length(whole.column("wikitext")).to_numpy(zero_copy_only=False)
        for batch in pieces(whole, sizes, most):
            rows = []
            for text in batch.column("wikitext"):
                text = text.as_py()
                box = infobox(text)
                found = [dict(zip(("position", "heading", "text", "link_targets"), s, strict=True)) for s in sections(text, least)]
                rows.append({"infobox_type": box and box[0], "infobox": [{"key": k, "value": v} for k, v in box[1]] if box else [], "sections": found})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _KIND)], [*batch.schema.names, "parsed"])


def parsed(pages: DataFrame, least: int = MIN_SECTION) -> DataFrame:
    """Pages (``page_id, wikitext`` and any others) with a column ``parsed``: infobox and sections. Arrow batches, no shuffle."""
    pages = pages.withColumn("wikitext", F.coalesce("wikitext", F.lit("")))
    out = T.StructType([*pages.schema.fields, T.StructField("parsed", T._parse_datatype_string(_PARSED))])  # noqa: SLF001
    return pages.mapInArrow(lambda batches: parsed_batches(batches, least), out)
