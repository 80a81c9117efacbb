"""Harmonic packing: pieces by reciprocal-capacity class, a fixed number of pieces to a bin of each class.

A class ``k`` holds pieces longer than ``capacity / (k + 1)`` and no longer than
``capacity / k``; ``k`` of them fill a bin, so a bin is filled without looking at
any other and workers fill theirs alone. Documents may be cut, so each is cut to
whole capacities and then to the longest class lengths that fit, down to a least
length; only its tail, shorter than that, is of any length, and falls in a class
with little to lose. Bins that a worker can't fill go on to a second round over
the leftovers of many workers, and what is left there is put together by first
fit, decreasing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import checkpoint, pick, schema

CAPACITY = 1024
#: Documents are cut to class lengths down to this; shorter tails stay as they are.
LEAST = 64
#: Vocabulary, by its public name, and the id that ends a document.
VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Tasks whose leftovers meet in a second round; each leaves fewer than ``k`` pieces of class ``k``.
TASKS = 128

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass", "task", "bin", "nth", "offset"]
_SCHEMA = _PIECE + ", klass int, task int, bin long, nth int, `offset` long"


def encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to token ids of a byte-level BPE vocabulary in the format of the library ``tokenizers``.

    The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``:
    a special string within a text has its own id. They are computed by ``tiktoken``
    from the same file's vocabulary, of which the ids are the merge ranks, at several
    times the speed; a test holds the two against each other.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        model = json.load(f)
    added = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    special = set(added.values())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
    bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: np.array(bpe.encode(text, allowed_special="all", disallowed_special=()), dtype="<u4")


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Lengths into which ``n`` tokens are cut: whole capacities, the longest class lengths that fit, a tail."""
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    while rest >= least:
        part = capacity // -(-capacity // rest)  # the longest capacity // k that fits
        lengths.append(part)
        rest -= part
    return lengths + [rest] * (rest > 0)


def klass(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """All pieces; those in bins that their task filled have ``bin`` and ``offset``, the others null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get().partitionId()
        waiting: dict[int, list[tuple]] = defaultdict(list)
        types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        bins = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _NAMES)

        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(END)) if text else np.array([END], "<u4")
                raw, start = ids.astype("<u4").tobytes(), 0
                for length in cuts(len(ids), capacity, least):
                    k = klass(length, capacity)
                    own = waiting[k]
                    own.append((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(ids)))
                    start += length
                    if len(own) == k:
                        at = 0
                        for nth, p in enumerate(own):
                            out.append((*p, k, task, bins, nth, at))
                            at += p[2]
                        bins += 1
                        own.clear()
            yield batch_of(out)
        yield batch_of([(*p, k, task, None, None, None) for k, own in waiting.items() for p in own])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema(_SCHEMA))


def _second_round(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Fill bins of each class from the leftovers of many tasks; then join unfilled bins by first fit, decreasing."""
    rows = rows.sort_values(["klass", "doc_id", "start", "length", "ids_crc32", "task"], kind="stable").reset_index(drop=True)
    whole = rows.groupby("klass").cumcount() // rows["klass"]
    rows["bin"] = pd.factorize(pd.MultiIndex.from_arrays([rows["klass"], whole]))[0] if len(rows) else []
    sums = rows.groupby("bin").agg(length=("length", "sum"), count=("length", "size"), klass=("klass", "first"))
    loose = sums[sums["count"] < sums["klass"]].sort_values("length", ascending=False, kind="stable")
    open_bins: list[list[int]] = []
    moved: dict[int, int] = {}
    for own, length in loose["length"].items():
        home = next((b for b in open_bins if b[1] + length <= capacity), None)
        if home is None:
            open_bins.append([own, length])
        else:
            home[1] += length
            moved[own] = home[0]
    rows["bin"] = rows["bin"].replace(moved)
    rows = rows.sort_values(["bin", "klass", "doc_id", "start", "ids_crc32"], kind="stable")
    rows["nth"] = rows.groupby("bin").cumcount()
    rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, klass`` of every piece.

    A null or empty text is the end id alone; a null ``doc_id`` stays null;
    repeated rows are packed each; an empty table gives no pieces; columns besides
    ``doc_id`` and ``text`` aren't read. ``path`` names a vocabulary file. Pieces,
    not texts, are written once to the checkpoint folder, so a lost task's bins
    are never filled twice; only leftovers (fewer than ``k`` pieces of class ``k``
    a task) are shuffled, in groups of ``TASKS`` tasks.
    """
    done = checkpoint(pieces(docs, path, capacity, least))
    full = done.where("bin is not null").withColumn("sequence_id", F.shiftleft(F.col("task").cast("long"), 40) + F.col("bin"))
    left = done.where("bin is null").select(*_NAMES[:5], "klass", "task").withColumn("grp", F.floor(F.col("task") / TASKS).cast("long"))
    left = left.withColumn("no_id", F.col("doc_id").isNull()).fillna(0, ["doc_id"])  # pandas would make floats of nullable ids

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _second_round(rows, capacity)
        rows["sequence_id"] = (2**62) + (rows["grp"] * 2**32) + rows["bin"]
        return rows[[*_NAMES[:5], "sequence_id", "offset", "klass", "no_id"]]

    rest = left.groupBy("grp").applyInPandas(run, schema(_PIECE + ", sequence_id long, `offset` long, klass int, no_id boolean"))
    rest = rest.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
    return full.select(*_NAMES[:5], "sequence_id", "offset", "klass").unionByName(rest)
