"""Document fingerprints by randomised edit embedding.

All texts share one random walk: at step ``j`` the character under the pointer is
put out, and a random bit that belongs to the step and the character says
whether the pointer moves on. Walks over texts a few edits apart fall into step
again soon after each edit, so the edit distance of two texts shows as the
Hamming distance of what they put out. A fingerprint samples ``CELLS`` of the
steps; cell by cell, the sampled step is a record of a random priority among the
steps of the walk, so texts of about equal length sample the same steps. Bands of
cells give candidate pairs, which are verified by the likeness of fingerprints.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import checkpoint, pick, schema

CELLS = 256
#: Walks take this many steps for each character: what a pointer needs on average to get through.
PACE = 2
PERIOD = 1 << 14
SEED = 31
#: With fewer walks than this at a time, each is walked alone.
ALONE = 24
BLOCK = 64
#: Characters that a task walks over at a time, and about so many rows make one stretch of ids.
CHARS = 16_000_000
STRETCH_ROWS = 2_000
MAX_STRETCHES = 16_384
BANDS = 32

_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


class Walker:
    """The shared walk and its records; each worker makes one."""

    def __init__(self, cells: int = CELLS, seed: int = SEED) -> None:
        self.cells = cells
        self.moves = np.random.default_rng(seed).integers(0, 2, size=(PERIOD, 256), dtype=np.int64)
        self.rows = [bytes(r.astype(np.uint8)) for r in self.moves]
        self.draws = [random.Random(f"{seed}/{c}") for c in range(cells)]
        self.next = [0] * cells
        self.records: dict[int, list[int]] = {}
        self.steps: list[int] = []
        self.known = 0

    def upto(self, steps: int) -> None:
        """Know all records before ``steps``: after one at ``t``, the next is at ``t / u`` for a uniform ``u``."""
        if steps <= self.known:
            return
        for c in range(self.cells):
            while self.next[c] < steps:
                t = self.next[c]
                self.records.setdefault(t, []).append(c)
                self.next[c] = int((t + 1) / (1 - self.draws[c].random()))
        self.known = steps
        self.steps = sorted(self.records)

    def walk(self, codes: list[np.ndarray]) -> np.ndarray:
        """Cell values (0 to 15) of each text, given as bytes of its characters; all 0 for an empty one."""
        out = np.zeros((len(codes), self.cells), np.uint8)
        order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
        lengths = np.array([len(codes[i]) for i in order], np.int64)
        if not len(order) or not lengths[0]:
            return out
        self.upto(PACE * int(lengths[0]))
        pad = np.zeros(BLOCK, np.uint8)
        text = np.concatenate([x for i in order for x in (codes[i], pad)])
        starts = np.concatenate([[0], np.cumsum(lengths + BLOCK)[:-1]])
        ends, pos, cells = starts + lengths, starts.copy(), np.zeros((len(order), self.cells), np.uint8)
        j = 0
        while True:
            m = int(np.searchsorted(-PACE * lengths, -j, side="left"))  # walks that have steps left
            if m < ALONE:
                break
            for _ in range(BLOCK):
                c = text[pos[:m]]
                if j in self.records:
                    live = m if PACE * lengths[m - 1] > j else int(np.searchsorted(-PACE * lengths, -j, side="left"))
                    cells[:live, self.records[j]] = c[:live, None]
                pos[:m] += self.moves[j % PERIOD][c]
                j += 1
            np.minimum(pos[:m], ends[:m], out=pos[:m])
        for i in range(m):
            self._alone(text[starts[i] : ends[i]].tobytes(), int(pos[i] - starts[i]), j, PACE * int(lengths[i]), cells[i])
        out[order] = (cells ^ (cells >> 4)) & 15
        return out

    def _alone(self, text: bytes, at: int, j: int, last: int, cells: np.ndarray) -> None:
        import bisect

        rows, mask, size = self.rows, PERIOD - 1, len(text)
        nth = bisect.bisect_left(self.steps, j)
        while j < last:
            stop = min(last, self.steps[nth]) if nth < len(self.steps) else last
            while j < stop and at < size:
                at += rows[j & mask][text[at]]
                j += 1
            j = stop
            if j >= last:
                break
            cells[self.records[j]] = text[at] if at < size else 0
            if at < size:
                at += rows[j & mask][text[at]]
            j += 1
            nth += 1


def codes(text: str) -> np.ndarray:
    """A byte for each character: the characters of Latin-1 as they are, others folded."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((c ^ ((c >> 8) * 31)) & 255).astype(np.uint8)


def prints(values: np.ndarray) -> list[str]:
    """Fingerprints as strings, a hexadecimal digit for each cell."""
    return [bytes(r).decode() for r in _HEX[values]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal cells, row by row."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every whole text; null is empty, and empty texts have all cells 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints(walker.walk([codes(t) for t in texts])), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema("doc_id long, n_chars long, fingerprint string"))


def similar(docs: DataFrame, least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """``a, b, likeness``: star-shaped pairs of fingerprints that share a band and are at least so alike.

    A row for each distinct fingerprint, named by its least ``doc_id``, goes to
    the bucket of each of its ``bands`` runs of cells; in a bucket, the pairs with
    its least member are verified, so pairs grow with the bucket, not its square.
    """
    width = CELLS // bands
    each = fingerprints(docs).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    each = checkpoint(each)
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.concat_ws(":", i, F.substring("fingerprint", i * width + 1, F.lit(width))))
    keyed = each.select("doc_id", "fingerprint", F.explode(cut).alias("key"))
    tops = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "fingerprint")).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keyed.join(tops, "key").where(F.col("doc_id") > F.col("top.doc_id"))
    pairs = pairs.select(F.col("top.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("top.fingerprint").alias("x"), F.col("fingerprint").alias("y")).distinct()
    same = F.aggregate(F.zip_with(F.split("x", ""), F.split("y", ""), lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.select("a", "b", (same / float(CELLS)).alias("likeness")).where(F.col("likeness") >= least)


def edited(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next document.

    The next document is that with the next smaller ``doc_id``; after the least
    comes the greatest. The edited text has its last ``floor(n_chars / 2)``
    characters replaced by as many from the start of the next document. Rows that
    repeat a ``doc_id`` follow each other by text; null ids come last; a table of
    one row is its own next document; null texts are empty; an empty table gives
    an empty one; columns besides ``doc_id`` and ``text`` aren't read.

    Each text crosses the network once: ids fall into stretches whose borders are
    ids of the table, and the document at a border is sent to both sides, so the
    next document of every row is in its stretch. Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    docs = pick(docs, doc_id="long", text="string")
    n, top = docs.select("doc_id").agg(F.count("*"), F.max("doc_id")).first()
    parts = max(1, min(MAX_STRETCHES, n // STRETCH_ROWS))
    borders: list[int] = []
    if parts > 1 and top is not None:
        found = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(max(10_000, 20 * parts)))).first()[0]
        borders = sorted({b for b in found if b != top})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(borders, np.int64)
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            null = np.array(ids.is_null())
            plain = np.array(ids.fill_null(0), np.int64)
            stretch = np.searchsorted(edges, plain, side="left").astype(np.int64)  # ids up to a border, with it
            stretch[null] = 0
            yield pa.RecordBatch.from_arrays([pa.array(stretch), pa.array(np.zeros(len(ids), bool)), ids, text], ["stretch", "guest", "doc_id", "text"])
            guest = np.flatnonzero(~null & (np.isin(plain, edges) | (plain == top)))
            if len(edges) and len(guest):
                at = pa.array(guest)
                home = np.where(plain[guest] == top, 0, stretch[guest] + 1)
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(np.ones(len(guest), bool)), ids.take(at), text.take(at)], ["stretch", "guest", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, schema("stretch long, guest boolean, doc_id long, text string"))
    # stretch i is dealt to task i, so no task gets several by chance
    dealt = dealt.repartitionById(len(borders) + 1, F.col("stretch").cast("int")).sortWithinPartitions("stretch", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("stretch", "guest", "doc_id", "text")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        pairs: list[tuple[int | None, str, str]] = []
        size = 0
        alone = not borders
        first = last = None
        for stretch, guest, doc_id, text in rows(batches):
            text = text or ""
            if last and last[0] == stretch and not last[1]:
                pairs.append((last[2], last[3], text))
                size += len(text)
            last = (stretch, guest, doc_id, text)
            first = first or last
            if size > CHARS:
                yield _compared(pairs, walker)
                pairs, size = [], 0
        if alone and last:
            pairs.append((last[2], last[3], first[3]))
        yield _compared(pairs, walker)

    return dealt.mapInArrow(run, schema("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))


def _compared(pairs: list[tuple[int | None, str, str]], walker: Walker) -> pa.RecordBatch:
    """The result for each ``(doc_id, text, next text)``; a text that follows the one before it is walked once."""
    texts: list[str] = []
    own, following = [], []
    for _, text, other in pairs:
        if not texts or texts[-1] is not text:
            texts.append(text)
        own.append(len(texts) - 1)
        texts.append(other)
        following.append(len(texts) - 1)
    changed = [t[: len(t) - len(t) // 2] + o[: len(t) // 2] for _, t, o in pairs]
    values = walker.walk([codes(t) for t in (*texts, *changed)])
    a, b, c = values[own], values[len(texts) :], values[following]
    cols = [
        pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array(prints(a), pa.string()), pa.array(prints(b), pa.string()), pa.array(likeness(a, b), pa.float64()), pa.array(likeness(a, c), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
