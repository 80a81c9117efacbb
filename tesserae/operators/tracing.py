"""Spans of a live request, in the shape that stage analytics read."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Span:
    name: str
    depth: int
    ms: float | None = None
    note: str = ""


@dataclass
class Trace:
    """Spans in the order of entry; a span's time is filled in when it ends, by error too."""

    spans: list[Span] = field(default_factory=list)
    _depth: int = 0

    @contextmanager
    def span(self, name: str, note: str = "") -> Iterator[Span]:
        own = Span(name, self._depth, note=note)
        self.spans.append(own)
        self._depth += 1
        began = time.perf_counter()
        try:
            yield own
        finally:
            own.ms = (time.perf_counter() - began) * 1000
            self._depth -= 1

    def rows(self) -> list[tuple[str, int, float | None, str]]:
        return [(s.name, s.depth, s.ms, s.note) for s in self.spans]
