"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a line of a filter list: ``host/path`` rules bind a host with all its
subdomains and a start of the path, pattern rules (``*`` any run, ``^`` a
separator or the end) match anywhere in ``host + path``. Each rule is stored
under one of its literal tokens, the one that the judged URLs use least; a URL's
tokens fetch the rules stored under them, and only those run their regular
expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import pick, schema

#: Rules are held by every worker; a longer list is refused.
MAX_RULES = 200_000

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_SPLIT = re.compile(r"\A.*?://([^/?#]*)([^?#]*)", re.S)


@dataclass(frozen=True)
class Rule:
    """``text``: ``host/path`` of a site rule, or a pattern. ``block``: else it allows."""

    text: str
    block: bool
    site: bool = True

    def regex(self) -> re.Pattern[str]:
        if self.site:
            host, slash, path = self.text.partition("/")
            return re.compile(r"\A(?:[^/]*\.)?" + re.escape(host.translate(_LOWER)) + re.escape(slash + path), re.S)
        parts = {"*": ".*", "^": r"(?:\A|[^A-Za-z0-9_%-]|\Z)"}
        return re.compile("".join(parts.get(c) or re.escape(c) for c in self.text), re.S)

    def literals(self) -> list[str]:
        """Tokens that every matching URL has in full: those with a fixed border on both sides."""
        text = self.text.translate(_LOWER)
        if self.site:
            text = f"^{text}"
        found = []
        for m in _TOKEN.finditer(text):
            left, right = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if left and right and left != "*" and right != "*":
                found.append(m[0])
        return found


#: The contract's rules.
SITE_RULES = (
    Rule("net/", block=True),
    Rule("example.net/en/", block=False),
    Rule("example.com/de/", block=True),
    Rule("org/fr/", block=False),
)
#: What the method blocks where no site rule fits.
PATTERN_RULES = tuple(
    Rule(p, block=True, site=False)
    for p in ("spam-farm.", "cheap-pills.", "casino-win.", "free-bets.", "adult-x.", "ads-track.", "^casino^", "^viagra^", "^torrent^", "^xxx^")
)


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    m = _SPLIT.match(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class Index:
    """Rules by their rarest literal token; rules without one are always candidates."""

    def __init__(self, rules: Iterable[Rule], seen: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[int, Rule, re.Pattern[str]]]] = defaultdict(list)
        self.always: list[tuple[int, Rule, re.Pattern[str]]] = []
        for n, rule in enumerate(rules):
            item = (n, rule, rule.regex())
            tokens = rule.literals()
            if tokens:
                self.by_token[min(tokens, key=lambda t: (seen.get(t, 0), t))].append(item)
            else:
                self.always.append(item)

    def matches(self, host: str, path: str) -> list[Rule]:
        whole = host + path
        found = list(self.always)
        for token in set(_TOKEN.findall(whole.translate(_LOWER))):
            found += self.by_token.get(token, ())
        return [rule for _, rule, regex in sorted(found, key=lambda x: x[0]) if regex.search(whole)]


def judge(host: str, path: str, index: Index) -> tuple[str | None, str]:
    """The longest site rule that fits (or null) and the verdict: that rule's, else block if a pattern blocks and none allows."""
    found = index.matches(host, path)
    site = max((r for r in found if r.site), key=lambda r: len(r.text), default=None)
    if site:
        return site.text, "block" if site.block else "allow"
    loose = [r.block for r in found if not r.site]
    return None, "block" if loose and all(loose) else "allow"


def token_counts(pages: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all pages."""
    if not tokens:
        return {}
    found = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), 0))
    each = pages.select(F.explode(F.array_intersect(found, F.array(*map(F.lit, tokens)))).alias("token"))
    return {r["token"]: r["n"] for r in each.groupBy("token").agg(F.count("*").alias("n")).collect()}


def filter_urls(pages: DataFrame, rules: Iterable[Rule] = SITE_RULES + PATTERN_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page, in one pass without a shuffle.

    The rules travel to the workers (``MAX_RULES`` at most; more raise
    ``ValueError``); only the counts of the rules' own tokens come to the driver.
    A null URL, or one without ``://``, has an empty host and path, no rule and
    the verdict "allow". Repeated rows are judged alike; an empty table gives an
    empty one; columns besides ``page_id`` and ``url`` are not read.
    """
    rules = tuple(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most")
    pages = pick(pages, page_id="long", url="string")
    several = sorted({t for r in rules if len(set(r.literals())) > 1 for t in r.literals()})
    seen = token_counts(pages, several)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, seen)
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = split(url)
                out.append((host, path, *judge(host, path, index)))
            columns = zip(*out, strict=True) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.mapInArrow(run, schema("page_id long, host string, path string, rule string, verdict string"))
