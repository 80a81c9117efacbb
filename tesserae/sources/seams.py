"""The four seams to models and services, with deterministic stand-ins that need no network."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

MAX_TITLES = 50
MAX_TEXTS = 256
RETRIED = (429, 500, 502, 503, 504)


class Embedder(Protocol):
    width: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: Sequence[str]) -> list[float]: ...


class Generator(Protocol):
    def complete(self, messages: Sequence[dict[str, str]]) -> str: ...


@dataclass(frozen=True)
class Usage:
    """Tokens that a call took; cached ones are part of the prompt."""

    prompt: int
    completion: int
    cached: int = 0


class StreamingGenerator(Protocol):
    def stream(self, messages: Sequence[dict[str, str]]) -> Iterator[str | Usage]: ...


@dataclass(frozen=True)
class Reply:
    """What a call gave: its text, or "" and an error; the usage if the service told it, even of a call that broke off."""

    text: str
    usage: Usage | None
    first_ms: float | None
    error: str | None


class EmptyCompletion(RuntimeError):
    """A reply without a visible character."""


@dataclass(frozen=True)
class FetchResult:
    revisions: list[dict]
    missing: list[str]


class RevisionSource(Protocol):
    def fetch_batch(self, titles: Sequence[str]) -> FetchResult: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Counts of tokens in ``width`` hashed places and a constant, so that no vector is zero."""

    width: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if len(texts) > MAX_TEXTS:
            raise ValueError(f"{len(texts)} texts; {MAX_TEXTS} at most")
        out = []
        for text in texts:
            v = [0.0] * (self.width - 1) + [1.0]
            for word in text.lower().split():
                v[zlib.crc32(word.encode()) % (self.width - 1)] += 1.0
            out.append(v)
        return out


@dataclass(frozen=True)
class OverlapReranker:
    """Distinct words shared with the query."""

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        asked = set(query.lower().split())
        return [float(len(asked & set(t.lower().split()))) for t in texts]


@dataclass(frozen=True)
class ExtractiveGenerator:
    """Answers with the first sentence of the first source, cited; refuses without sources."""

    def complete(self, messages: Sequence[dict[str, str]]) -> str:
        body = messages[-1]["content"]
        start = body.find("\n", body.find("<source ")) + 1
        if not start or "<source " not in body:
            return "Not in the sources."
        return body[start:].split(". ")[0].split("\n</source>")[0].strip().rstrip(".") + " [1]."


@dataclass(frozen=True)
class EchoGenerator:
    """Says the last message again, in two pieces; a token is a character."""

    def stream(self, messages: Sequence[dict[str, str]]) -> Iterator[str | Usage]:
        said = messages[-1]["content"]
        yield Usage(sum(len(m["content"]) for m in messages), len(said))
        half = len(said) // 2
        yield from (said[:half], said[half:])


@dataclass(frozen=True)
class FixedSource:
    """Pages from a mapping of titles; ``redirects`` are followed, loops and unknown titles are missing."""

    pages: dict[str, dict]
    redirects: dict[str, str] = field(default_factory=dict)

    def fetch_batch(self, titles: Sequence[str]) -> FetchResult:
        if len(titles) > MAX_TITLES:
            raise ValueError(f"{len(titles)} titles; {MAX_TITLES} at most")
        found, missing = [], []
        for title in titles:
            at, seen = title, set()
            while at in self.redirects and at not in seen:
                seen.add(at)
                at = self.redirects[at]
            page = self.pages.get(at)
            if page and page.get("page_id") is not None and page.get("wikitext") is not None:
                found.append(page | {"requested_title": title, "title": at})
            else:
                missing.append(title)
        return FetchResult(found, missing)


@dataclass(frozen=True)
class WikiSource:
    """Newest revisions of a wiki, through ``get``, which sends the parameters of a query and gives its JSON; it must be picklable.

    Titles that the wiki normalises or redirects are followed, loops are missing, and
    so is a page without an id, a revision or a main slot. Each found page bears
    the title that was asked for.
    """

    get: Callable[[dict[str, str]], dict]

    def fetch_batch(self, titles: Sequence[str]) -> FetchResult:
        if len(titles) > MAX_TITLES:
            raise ValueError(f"{len(titles)} titles; {MAX_TITLES} at most")
        if not titles:
            return FetchResult([], [])
        asked = {"action": "query", "format": "json", "formatversion": "2", "prop": "revisions", "rvprop": "ids|timestamp|content", "rvslots": "main", "redirects": "1", "titles": "|".join(titles)}
        reply = self.get(asked).get("query", {})
        leads = {step["from"]: step["to"] for kind in ("normalized", "redirects") for step in reply.get(kind, [])}
        pages = {row["title"]: row for page in reply.get("pages", []) if (row := _page(page))}
        found = FixedSource(pages, leads).fetch_batch(titles)
        return FetchResult(found.revisions, found.missing)


def _page(page: dict) -> dict | None:
    """A page of a reply as a Bronze row has it; None if a part is lacking."""
    newest = next(iter(page.get("revisions") or []), {})
    text = newest.get("slots", {}).get("main", {}).get("content")
    if page.get("pageid") is None or newest.get("revid") is None or text is None:
        return None
    return {"page_id": page["pageid"], "title": page["title"], "revision_id": newest["revid"], "revision_timestamp": newest.get("timestamp"), "wikitext": text}


class Unavailable(RuntimeError):
    """A service that still failed after the retries."""


def retried(call: Callable[[], tuple[int, object, float | None]], retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call until the status isn't one that passes; waits as told by the service, else 1, 2, 4, 8 seconds."""
    for attempt in range(retries + 1):
        try:
            status, body, wait = call()
        except ConnectionError:
            status, body, wait = 503, None, None
        if status < 400:
            return body
        if status not in RETRIED:
            raise Unavailable(f"status {status}")
        if attempt < retries:
            sleep(wait if wait is not None else 2.0**attempt)
    raise Unavailable(f"status {status} after {retries} retries")


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector", batch: int = 200) -> DataFrame:
    """Add an embedding; the model is made once a worker and called with ``batch`` texts at most, in order."""
    if not 1 <= batch <= MAX_TEXTS:
        raise ValueError(f"batch must be 1 to {MAX_TEXTS}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            found = [v for i in range(0, len(texts), batch) for v in embedder.embed(texts[i : i + batch])]
            if any(len(v) != embedder.width for v in found):
                raise ValueError("a vector has another width")
            yield frame.assign(**{out: found})

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def generate(rows: DataFrame, generator: Generator, messages: str = "messages", out: str = "answer") -> DataFrame:
    """Add the answer to each row's messages (an array of ``role, content``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: [generator.complete([{"role": m["role"], "content": m["content"]} for m in ms]) for ms in frame[messages]]})

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def spoken(generator: Generator | StreamingGenerator, messages: Sequence[dict[str, str]]) -> Reply:
    """One call, whole or in pieces; blanks before the first visible piece are no part of the answer, nor is it timed by them."""
    began, pieces, usage, first, error = time.perf_counter(), [], None, None, None
    try:
        for piece in generator.stream(messages) if hasattr(generator, "stream") else iter((generator.complete(messages),)):
            if isinstance(piece, Usage):
                usage = piece
            elif piece := piece if pieces else (piece or "").lstrip():
                first = first if pieces else 1000 * (time.perf_counter() - began)
                pieces.append(piece)
        if not pieces:
            raise EmptyCompletion("the reply is empty")
    except Exception as e:  # noqa: BLE001  the reply tells what went wrong
        error = f"{type(e).__name__}: {e}"
    return Reply("" if error else "".join(pieces).rstrip(), usage, first, error)


def fetch(titles: Iterable[str], source: RevisionSource, batch: int = MAX_TITLES) -> Iterator[FetchResult]:
    titles = list(titles)
    for i in range(0, len(titles), batch):
        yield source.fetch_batch(titles[i : i + batch])
