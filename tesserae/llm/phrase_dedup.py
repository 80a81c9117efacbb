"""Passages of 35 words that recur, found by automata of their least phrases.

A window of 35 words owns the least (by hash) of its 28 phrases of eight words;
equal windows own equal phrases. Phrases that are least somewhere are counted
over all texts, and only windows that own a phrase seen twice are counted as
well: those seen twice are confirmed. Texts are dealt to shards. Each shard gets
the phrases of confirmed windows that stand in its texts, compiles them to an
Aho-Corasick automaton over words, and streams its texts through it: around each
occurrence the windows are held against the confirmed ones.

A shard's automaton never holds more phrases than its own texts have, and what
is exchanged grows with the texts. No step depends on how often a phrase or a
window occurs: counts are summed where the texts are, copies of a text are
read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import Written, checkpoint, pick, schema, slices

LENGTH = 35
PHRASE = 8
OWN = LENGTH - PHRASE + 1  # phrases of a window
#: Hashes of repeated phrases that are few enough to go to every worker (32 MB); beyond, phrases join them by a shuffle.
FEW = 4_000_000
#: Bytes of text that one automaton should serve.
SHARD = 16 << 20
#: Bytes of text held at once, but for a longer text, and bytes of words hashed at once, but for a longer word.
LOT, STEP = 2 << 20, 1 << 20
#: Windows and phrases that a task puts together by shard.
TOGETHER = 1_000_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MOST = np.uint64(2**64 - 1)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M1
    x += b
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each ``width`` neighbours: of powers of two, then of two such runs that overlap."""
    k = 1
    while k * 2 <= width:
        h = _joined(h[:-k], h[k:])
        k *= 2
    return h if k == width else _joined(h[: -(width - k)], h[width - k :])


def _over(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """``f`` (least or greatest) over each ``width`` neighbours."""
    k = 1
    while k * 2 <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return x if k == width else f(x[: -(width - k)], x[width - k :])


_LETTER = np.ones(256, bool)
_LETTER[list(b" \t\n\x0b\x0c\r")] = False


def _hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, from sums of their bytes times powers of an odd number; they tell words apart, whatever lies between them."""
    out, powers = np.empty(len(starts), np.uint64), np.empty(0, np.uint64)
    size = np.cumsum(ends - starts)
    lo = 0
    while lo < len(starts):
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + STEP, "right")))
        part, length = flat[starts[lo] : ends[hi - 1]], ends[lo:hi] - starts[lo:hi]
        if length.max() > len(powers):
            powers = np.cumprod(np.full(int(length.max()), _M2))
        first = np.cumsum(length) - length
        letters = part[_LETTER[part]].astype(np.uint64)
        letters *= powers[np.arange(len(letters)) - np.repeat(first, length)]
        out[lo:hi] = _joined(np.add.reduceat(letters, first), length.astype(np.uint64))
        lo = hi
    return out


class Words:
    """The words of some texts, one text after another, and hashes of what they hold."""

    def __init__(self, texts: list[bytes]) -> None:
        flat = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        edges = np.diff(_LETTER[flat].astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        after = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        self.lengths = np.diff(after, prepend=0)
        self.ends = after
        self.hash = _hashes(flat, starts, ends)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the place of each word: whether a window starts there, and the phrase it owns."""
        n = len(self.hash) - LENGTH + 1
        if n < 1:
            return np.empty(0, bool), np.empty(0, np.uint64)
        self.phrase = _runs(self.hash, PHRASE)
        inside = np.ones(n, bool)
        for end in self.ends[:-1].tolist():
            inside[max(0, end - LENGTH + 1) : end] = False
        return inside, _over(self.phrase, OWN, np.minimum)[:n]

    def least(self, inside: np.ndarray, owned: np.ndarray) -> np.ndarray:
        """Places of phrases that a window owns, each once."""
        edge = np.zeros(OWN - 1, np.uint64)
        most = _over(np.concatenate([edge, np.where(inside, owned, 0), edge]), OWN, np.maximum)
        return np.flatnonzero(most >= self.phrase[: len(most)])

    def digests(self) -> np.ndarray:
        return _runs(self.hash, LENGTH)

    def symbols(self) -> np.ndarray:
        """Two letters a word, of 64 even and 64 odd ones: nodes of an automaton have few children, and no match starts within a word."""
        low = self.hash.astype(np.uint16)
        out = np.empty(2 * len(low), np.uint8)
        out[0::2] = 32 + (low & 63)
        out[1::2] = 96 + (low >> 6 & 63)
        return out


def _lots(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[Words, list[bytes], list[list]]]:
    """Texts in lots of about ``LOT`` bytes: their words, their bytes, and the other columns."""
    for batch in slices(batches, 256):
        values = [batch.column(c).to_pylist() for c in columns]
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        lo = size = 0
        for hi, text in enumerate(texts, 1):
            size += len(text)
            if size >= LOT or hi == len(texts):
                yield Words(texts[lo:hi]), texts[lo:hi], [v[lo:hi] for v in values]
                lo, size = hi, 0


def _distinct(docs: DataFrame) -> DataFrame:
    """``key, text, n``: each text once, with its number of copies."""
    rows = pick(docs, text="string").select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    return rows.groupBy("key").agg(F.first("text").alias("text"), F.least(F.count("*"), F.lit(2)).alias("n"))


def repeated_phrases(texts: DataFrame) -> DataFrame:
    """``h``: hashes of phrases that windows own at more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, (copies,) in _lots(batches, "n"):
            at = words.least(*words.windows()) if len(words.hash) >= LENGTH else np.empty(0, np.int64)
            n = np.repeat(np.array(copies, np.int64), words.lengths)[at]
            yield pa.RecordBatch.from_arrays([pa.array(words.phrase[at].view(np.int64) if len(at) else [], pa.int64()), pa.array(n)], ["h", "n"])

    return texts.select("text", "n").mapInArrow(run, schema("h long, n long")).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


_FOUND = "h long, d long, shard int, n long, phrase binary"


def _owned(texts: DataFrame, repeated: DataFrame, few: int) -> DataFrame:
    """Windows that own a repeated phrase (``h, d, shard, n``) and, with ``d`` null, the words of these phrases."""
    fields = ["h", "d", "shard", "n", "phrase"]

    def told(words: Words, known: np.ndarray, shards: list[int], copies: list[int]) -> pa.RecordBatch:
        inside, owned = words.windows()
        place = np.minimum(np.searchsorted(known, owned), len(known) - 1)
        at = np.flatnonzero(inside & (known[place] == owned))
        shard, n = (np.repeat(np.array(v, t), words.lengths) for v, t in ((shards, np.int32), (copies, np.int64)))
        found = np.intersect1d(words.least(inside, owned), np.flatnonzero(np.isin(words.phrase, owned[at])))
        symbols = words.symbols()
        _, first = np.unique(np.stack([words.phrase[found].view(np.int64), shard[found].astype(np.int64)], 1), axis=0, return_index=True)
        found = found[first]
        phrases = [symbols[2 * p : 2 * (p + PHRASE)].tobytes() for p in found.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([owned[at], words.phrase[found]]).view(np.int64)),
                pa.concat_arrays([pa.array(words.digests()[at].view(np.int64)), pa.nulls(len(found), pa.int64())]),
                pa.array(np.concatenate([shard[at], shard[found]])),
                pa.array(np.concatenate([n[at], np.full(len(found), 2)])),
                pa.concat_arrays([pa.nulls(len(at), pa.binary()), pa.array(phrases, pa.binary())]),
            ],
            fields,
        )

    if repeated.limit(few + 1).count() <= few:
        table = repeated.toArrow().column("h").to_numpy().view(np.uint64)  # bounded: `few` hashes at most
        shared = texts.sparkSession.sparkContext.broadcast(np.sort(table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for words, _, (shards, copies) in _lots(batches, "shard", "n"):
                if len(known) and len(words.hash) >= LENGTH:
                    yield told(words, known, shards, copies)

        return texts.select("text", "shard", "n").mapInArrow(run, schema(_FOUND))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, (keys,) in _lots(batches, "key"):
            at = words.least(*words.windows()) if len(words.hash) >= LENGTH else np.empty(0, np.int64)
            of = np.repeat(np.arange(len(keys)), words.lengths)[at]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in of.tolist()], pa.binary()), pa.array(words.phrase[at].view(np.int64) if len(at) else [], pa.int64())], ["key", "h"])

    own = texts.select("text", "key").mapInArrow(places, schema("key binary, h long")).distinct().join(repeated, "h").groupBy("key").agg(F.collect_list("h").alias("known"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, (shards, copies, known) in _lots(batches, "shard", "n", "known"):
            if len(words.hash) >= LENGTH:
                yield told(words, np.unique(np.concatenate([np.array(x, np.int64) for x in known]).view(np.uint64)), shards, copies)

    return texts.join(own, "key").select("text", "shard", "n", "known").mapInArrow(each, schema(_FOUND))


class Automaton:
    """Phrases of a shard (hash and words) and the confirmed windows (phrase that they own, digest) of its texts."""

    def __init__(self, phrases: np.ndarray, windows: np.ndarray) -> None:
        windows = windows[np.argsort(windows["d"], kind="stable")]
        self.digest, self.owner = np.ascontiguousarray(windows["d"]), np.ascontiguousarray(windows["h"])
        self.find = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases["words"][np.isin(phrases["h"], self.owner)].tolist():
            self.find.add_word(phrase.decode("latin-1"))
        self.find.make_automaton()

    def covered(self, words: Words) -> np.ndarray:
        """Of each word: whether a confirmed window covers it."""
        out = np.zeros(len(words.hash) + 1, np.int64)
        if not len(self.find) or len(words.hash) < LENGTH:
            return out[:-1] > 0
        ends = np.fromiter((end for end, _ in self.find.iter(words.symbols().tobytes().decode("latin-1"))), np.int64) // 2
        if not len(ends):
            return out[:-1] > 0
        inside, owned = words.windows()
        near = np.zeros(len(inside) + 1, np.int64)  # windows that hold an occurrence
        start = ends - PHRASE + 1
        near += np.bincount(np.clip(start - OWN + 1, 0, len(inside)), minlength=len(near))
        near -= np.bincount(np.clip(start + 1, 0, len(inside)), minlength=len(near))
        at = np.flatnonzero(inside & (np.cumsum(near[:-1]) > 0))
        d = words.digests()[at]
        place = np.minimum(np.searchsorted(self.digest, d), len(self.digest) - 1)
        at = at[(self.digest[place] == d) & (self.owner[place] == owned[at])]
        out[at] += 1
        out[at + LENGTH] -= 1
        return np.cumsum(out[:-1]) > 0


def left(text: bytes, spans: list[dict]) -> bytes:
    """Words outside the spans, joined by one space."""
    words, out, at = text.split(), [], 0
    for s in spans:
        out += words[at : s["lo"]]
        at = s["hi"]
    return b" ".join(out + words[at:])


_RESULT = "key binary, n_words long, n_removed long, spans array<struct<lo:long,hi:long>>, kept_sha256 string"


_WINDOW = np.dtype([("h", np.uint64), ("d", np.uint64)])
_OF_PHRASE = np.dtype([("h", np.uint64), ("words", f"S{2 * PHRASE}")])


def _packed(confirmed: DataFrame) -> DataFrame:
    """``shard, windows, phrases``: what a task has for a shard, put together."""

    def told(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by("shard")
        shard = table.column("shard").to_numpy()
        phrased = table.column("d").is_null().to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        h, d = table.column("h").to_numpy().view(np.uint64), table.column("d").fill_null(0).to_numpy().view(np.uint64)
        windows = np.empty(len(h), _WINDOW)
        windows["h"], windows["d"] = h, d
        phrases = np.zeros(len(h), _OF_PHRASE)
        phrases["h"][phrased] = h[phrased]
        phrases["words"][phrased] = np.frombuffer(b"".join(table.column("phrase").filter(table.column("d").is_null()).to_pylist()), f"S{2 * PHRASE}")
        rows = [(int(shard[lo]), windows[lo:hi][~phrased[lo:hi]].tobytes(), phrases[lo:hi][phrased[lo:hi]].tobytes()) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "windows", "phrases"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                yield told(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield told(pa.Table.from_batches(held))

    return confirmed.select("shard", "h", "d", "phrase").mapInArrow(run, schema("shard int, windows binary, phrases binary"))


def _located(texts: DataFrame, confirmed: DataFrame, shards: int) -> DataFrame:
    """Each text's words, removed spans and digest: shard ``i`` is task ``i``, phrases come before texts."""
    phrases = _packed(confirmed).select("shard", F.lit(0).alias("kind"), "windows", "phrases", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"))
    rows = texts.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("windows"), F.lit(None).cast("binary").alias("phrases"), "key", "text")

    def result(automaton: Automaton, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for words, texts, (keys,) in _lots(iter([batch]), "key"):
            gone, out, at = automaton.covered(words), [], 0
            for n, text in zip(words.lengths.tolist(), texts, strict=True):
                mine = gone[at : at + n]
                at += n
                edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=np.int8(0), append=np.int8(0))) if mine.any() else np.empty(0, np.int64)
                spans = [{"lo": lo, "hi": hi} for lo, hi in edges.reshape(-1, 2).tolist()]
                out.append((n, int(mine.sum()), spans, hashlib.sha256(left(text, spans)).hexdigest()))
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["key", "n_words", "n_removed", "spans", "kept_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, automaton = None, [], None
        for batch in batches:
            at, of, kinds = 0, batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = [*(np.flatnonzero((np.diff(of) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for end in cuts if batch.num_rows else []:
                part = batch.slice(at, end - at)
                if of[at] != shard:
                    shard, held, automaton = of[at], [], None
                if kinds[at] == 0:
                    held += zip(part.column("windows").to_pylist(), part.column("phrases").to_pylist(), strict=True)
                else:
                    if automaton is None:
                        windows, phrases = (b"".join(x) for x in zip(*held, strict=True)) if held else (b"", b"")
                        automaton, held = Automaton(np.frombuffer(phrases, _OF_PHRASE), np.frombuffer(windows, _WINDOW)), []
                    yield from result(automaton, part.select(["key", "text"]))
                at = end

    return phrases.union(rows).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(run, schema(_RESULT))


def repeats(docs: DataFrame, few: int = FEW, shard: int = SHARD) -> DataFrame:
    """``key, n_words, n_removed, spans, kept_sha256`` of each different text; ``spans`` are runs of removed words, from 0, the end exclusive."""
    found = Written(_distinct(docs))
    shards = found.rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // shard + 1
    texts = found.rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    repeated = checkpoint(repeated_phrases(texts))
    windows = _owned(texts, repeated, few).groupBy("h", "d").agg(F.sum("n").alias("n"), F.collect_set("shard").alias("shards"), F.first("phrase", ignorenulls=True).alias("phrase"))
    confirmed = windows.where("n > 1").select(F.explode("shards").alias("shard"), "h", "d", "phrase")
    out = checkpoint(_located(texts, confirmed, shards))
    found.drop()
    return out


def remove(docs: DataFrame, few: int = FEW, shard: int = SHARD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` of every row.

    Words are what lies between ASCII blanks, unchanged. Windows are judged on the
    input; a text of 35 words or more that occurs twice repeats itself as a whole.
    Null and empty texts have no words; shorter texts keep all; repeated rows count
    as copies; a null ``doc_id`` stays; an empty table gives an empty one; columns
    besides ``doc_id`` and ``text`` aren't read.
    """
    own = pick(docs, doc_id="long", text="string").select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    return own.join(repeats(docs, few, shard), "key", "left").select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def kept_texts(docs: DataFrame, few: int = FEW, shard: int = SHARD) -> DataFrame:
    """``doc_id, text``: the words that stay, joined by one space."""
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    rows = rows.join(repeats(docs, few, shard).select("key", "spans"), "key", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [left(t.encode("utf-8", "surrogatepass"), s).decode("utf-8", "surrogatepass") for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, schema("doc_id long, text string"))
