"""Typed settings: defaults, then a session's ``spark.tesserae.*``; unknown names are errors. Also the log."""

from __future__ import annotations

import dataclasses
import logging
import sys
from dataclasses import dataclass
from logging.handlers import RotatingFileHandler

from pyspark.sql import SparkSession

PREFIX = "spark.tesserae."


@dataclass(frozen=True)
class Settings:
    k: int = 5
    overfetch: int = 4
    max_per_document: int = 2
    chunk_size: int = 1200
    chunk_overlap: int = 150
    hybrid: bool = False
    temporal: bool = False
    conversation: bool = False
    reranker: str = ""
    generation_model: str = ""
    max_per_article: int = 0
    rrf_k: int = 60
    run_ceiling: float = 0.5
    day_ceiling: float = 1.0

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {k.removeprefix(PREFIX): v for k, v in spark.sparkContext.getConf().getAll() if k.startswith(PREFIX)}
        kinds = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        if unknown := set(given) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        read = lambda kind, v: v.lower() == "true" if kind is bool else kind(v)
        return cls(**{k: read(kinds[k], v) for k, v in given.items()})


def configure_logging(path: str | None = None, level: int = logging.INFO) -> None:
    """Errors and a rotating file (if named) get the library's log; a second call changes nothing."""
    log = logging.getLogger("tesserae")
    if log.handlers:
        return
    log.setLevel(level)
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if path:
        handlers.append(RotatingFileHandler(path, maxBytes=5_000_000, backupCount=3))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(h)
