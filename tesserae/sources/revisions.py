"""Newest revisions of a wiki as a Spark data source: a registry's titles in ranges, each fetched by a task of its own."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserae.sources import schemas as S
from tesserae.sources.seams import MAX_TITLES, WikiSource, retried

AGENT = "tesserae (corpus builder)"


@dataclass(frozen=True)
class HttpSender:
    """Sends the parameters of a query to a wiki's API and gives its JSON; waits and tries again as ``retried`` does."""

    api: str
    agent: str = AGENT
    timeout: float = 30.0
    retries: int = 4

    def __call__(self, asked: dict[str, str]) -> dict:
        request = urllib.request.Request(self.api, urllib.parse.urlencode(asked).encode(), {"User-Agent": self.agent})

        def call() -> tuple[int, object, float | None]:
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return reply.status, json.load(reply), None
            except urllib.error.HTTPError as e:
                wait = e.headers.get("Retry-After") or ""
                return e.code, None, float(wait) if wait.isdigit() else None
            except (urllib.error.URLError, TimeoutError) as e:
                raise ConnectionError(str(e)) from e

        return retried(call, self.retries)


def entries(path: str) -> Iterator[tuple[str, str]]:
    """``theme, title`` of a file of a registry, as ``tables.write_csv`` writes it, a line at a time."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_stream(name) as raw:
        for row in csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline=""), escapechar="\\", doublequote=False):
            yield row["theme"], row["title"]


class TitleRange(InputPartition):
    """Entries ``start`` to ``stop`` of one file."""

    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


class RevisionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if lacking := [o for o in ("api", "registry") if not options.get(o)]:
            raise ValueError(f"revisions: missing options {lacking}")
        self.registry, self.license = options["registry"].rstrip("/"), options.get("license", "CC BY-SA 4.0")
        self.each, self.batch = int(options.get("titlesPerTask", 10 * MAX_TITLES)), int(options.get("batch", MAX_TITLES))
        if self.each < 1 or not 1 <= self.batch <= MAX_TITLES:
            raise ValueError(f"titlesPerTask must be 1 or more, batch 1 to {MAX_TITLES}")
        self.source = WikiSource(HttpSender(options["api"], options.get("agent", AGENT), float(options.get("timeout", 30)), int(options.get("retries", 4))))

    def partitions(self) -> list[InputPartition]:
        """Ranges of the registry's files; the driver counts entries and keeps none."""
        where, root = fs.FileSystem.from_uri(self.registry)
        names = sorted(f.base_name for f in where.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", ".")))
        paths = [f"{self.registry}/{n}" for n in names]
        return [TitleRange(p, i, i + self.each) for p in paths for i in range(0, sum(1 for _ in entries(p)), self.each)]

    def read(self, partition: TitleRange | None) -> Iterator[tuple]:
        if partition is None:  # an empty registry
            return
        rows = islice(entries(partition.path), partition.start, partition.stop)
        while batch := list(islice(rows, self.batch)):
            found = {p["requested_title"]: p for p in self.source.fetch_batch(list(dict.fromkeys(t for _, t in batch))).revisions}
            now = dt.datetime.now(dt.UTC)
            for theme, title in batch:
                p: dict[str, Any] = found.get(title, {})
                at = p.get("revision_timestamp")
                yield p.get("page_id"), p.get("title"), title, theme, p.get("revision_id"), at and dt.datetime.fromisoformat(at), p.get("wikitext"), now, self.license


class Revisions(DataSource):
    """``spark.read.format("revisions")``: Bronze rows of a registry's titles; one that isn't found has a null ``page_id``.

    Options: ``api`` (address of the wiki's API), ``registry`` (folder of CSV files in
    storage that all executors read), ``titlesPerTask``, ``batch``, ``agent``,
    ``timeout``, ``retries``, ``license``. A task that is run again fetches its range
    again; an empty registry gives an empty table; a title in two themes is asked for
    once and gives a row for each.
    """

    @classmethod
    def name(cls) -> str:
        return "revisions"

    def schema(self) -> str:
        return S.BRONZE

    def reader(self, schema: object) -> DataSourceReader:
        return RevisionReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Revisions)
