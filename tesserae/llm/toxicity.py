"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits written
for letters onto one skeleton, so that disguised words meet their entry. Entry
weights are learned from labelled documents; matches inside an exception phrase
don't count; the weight found is set against the text's length.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import checkpoint, pick, schema

#: About so many labelled rows, chosen by a hash of doc_id, teach the lexicon; further ones aren't read.
LABELLED = 20_000
#: An entry needs this much evidence (log-likelihood ratio), and so many families of documents.
EVIDENCE = 11.0
FAMILIES = 3
THRESHOLD = 0.7
HELD_OUT = 1  # the remainder of crc32(doc_id) by 3 that isn't learned from

EXCEPTIONS = ("trash can", "trash bin", "trash bag", "circus clown", "class clown", "clown fish", "idiot proof")

#: Letters by what they are easily taken for.
_LOOKALIKE = {
    "a": "аα4@", "b": "вβ", "c": "с", "d": "ԁ", "e": "еε3", "g": "ɡ", "h": "һн", "j": "ј", "k": "кκ", "m": "м", "n": "η",
    "o": "оο0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ζ",
    "i": "іι1l!|",
}
_FOLD = {ord(c): k for k, others in _LOOKALIKE.items() for c in others}
_FOLD |= {ord(c): None for c in "­​‌‍⁠﻿"}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD[0xFF2C] = _FOLD[0xFF4C] = "i"
_TOKEN = re.compile(r"[^\W_]+")
_RUN = re.compile(r"(.)\1{2,}", re.S)


def fold(text: str | None) -> str:
    """The skeleton of a text; null is empty. Letters written three times or more count once."""
    return _RUN.sub(r"\1", (text or "").lower().translate(_FOLD))


class Lexicon:
    """Weighted entries and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS) -> None:
        import ahocorasick

        self.weights = weights
        self.tree = ahocorasick.Automaton()
        for word, weight in weights.items():
            self.tree.add_word(word, (len(word), weight))
        for phrase in exceptions:
            key = fold(phrase)
            self.tree.add_word(key, (len(key), None))
        self.empty = not len(self.tree)
        if not self.empty:
            self.tree.make_automaton()

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Of a text: weight found a word of the text, weight found, number of matches; whole words only."""
        s = fold(text)
        if self.empty or not s:
            return 0.0, 0.0, 0
        found, spared = [], []
        for end, (size, weight) in self.tree.iter(s):
            start = end - size + 1
            if (start and s[start - 1].isalnum()) or (end + 1 < len(s) and s[end + 1].isalnum()):
                continue
            if weight is None:
                spared.append((start, end))
            else:
                found.append((start, end, weight))
        if spared:  # in the order of their ends; of those that end at or after a match, the one that starts first may hold it
            ends, first = [b for _, b in spared], [a for a, _ in spared]
            for i in range(len(first) - 2, -1, -1):
                first[i] = min(first[i], first[i + 1])
            found = [x for x in found if (i := bisect.bisect_left(ends, x[1])) == len(ends) or first[i] > x[0]]
        total = sum(w for *_, w in found)
        return total / (1 + s.count(" ") + s.count("\n")), total, len(found)


def _inputs(density: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(density), np.log1p(50 * np.maximum(density, 0)), np.log1p(np.maximum(total, 0))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's steps; slopes stay at or above zero, as more weight never speaks for a text."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = np.clip(w - np.clip(np.linalg.solve(hess, grad), -2, 2), [-20, 0, 0], [20, 20, 20])
    return w


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``text, toxic`` of about ``bound`` labelled documents at most, none of them held out."""
    labels = pick(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").where(~_held_out())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    if n > bound:
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    return checkpoint(pick(docs, doc_id="long", text="string").join(F.broadcast(labels), "doc_id").select("text", "toxic"))


def learn(rows: DataFrame) -> dict[str, float]:
    """Entries and weights (log odds) from rows of ``text, toxic``.

    Documents are counted by family, the least word hash, so that a text with
    many copies is evidence once. Every word with the evidence is an entry; the
    sample bounds their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {w for w in _TOKEN.findall(fold(text)) if 3 <= len(w) <= 40}
                if found:
                    family = min(xxhash.xxh3_64_intdigest(w) for w in found) >> 1
                    out += [(w, family, toxic) for w in found]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["word", "family", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(run, schema("word string, family long, toxic int")).groupBy("word", "family").agg(F.max("toxic").alias("toxic"))
    seen = checkpoint(seen)
    total = seen.select("family", "toxic").distinct().groupBy().agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")).first()
    big_t, big_n = float(total["t"] or 0) + 1, float(total["n"] or 0) + 1
    share = big_t / (big_t + big_n)
    words = seen.groupBy("word").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("n"))
    rate = F.col("t") / (F.col("t") + F.col("n"))
    part = lambda c, r: F.when(F.col(c) > 0, F.col(c) * F.log(r)).otherwise(0.0)
    evidence = 2 * (part("t", rate / share) + part("n", (1 - rate) / (1 - share)))
    weight = F.log(((F.col("t") + 0.5) / big_t) / ((F.col("n") + 0.5) / big_n))
    best = words.where(f"t >= {FAMILIES}").where((rate > share) & (evidence >= EVIDENCE)).select("word", weight.alias("weight"), evidence.alias("evidence"))
    return {r["word"]: r["weight"] for r in best.where("weight >= 1.5").orderBy(F.desc("evidence"), "word").collect()}


def score(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = EXCEPTIONS, bound: int = LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_matches`` of every row.

    The lexicon (words of the bounded sample) and three coefficients go to the
    workers; every whole text is read once more. Null and empty texts match
    nothing and get the score of a text without a match; a null ``doc_id`` isn't
    held out; repeated rows score alike; without any labels all scores are 0.5 or
    less; an empty table gives an empty one. Only ``doc_id`` and ``text`` are read.
    """
    rows = sample(docs, labels, bound)
    weights = learn(rows)
    exceptions = tuple(exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, exceptions)
        for batch in batches:
            f = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), batch.column("toxic")], ["density", "total", "toxic"])

    got = rows.mapInArrow(measure, schema("density double, total double, toxic int")).toPandas()  # bounded by the sample
    fit = _logistic(_inputs(got["density"].to_numpy(), got["total"].to_numpy()), got["toxic"].to_numpy(dtype=float))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, exceptions)
        for batch in batches:
            f = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-_inputs(f[:, 0], f[:, 1]) @ fit))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(f[:, 2].astype(np.int64))], ["doc_id", "score", "n_matches"])

    out = pick(docs, doc_id="long", text="string").mapInArrow(judge, schema("doc_id long, score double, n_matches long"))
    return out.select("doc_id", _held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_matches")
