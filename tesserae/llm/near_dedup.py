"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

One hash of each shingle fills ``BANDS * ROWS`` bins with their least hash; an
empty bin copies the bin that its own probe sequence first finds filled (the
optimal densification). ``ROWS`` bins make a band, equal bands a bucket. In a
bucket only the edges between its centre, the member that meets most others in
all its buckets, and the others are candidates, and they are confirmed on the
full sets. Members that this leaves outside their centre's component are compared
with all members under that centre, in blocks, so no link is lost. Copies of one
text need the star alone, so candidates grow with the buckets' members; only
members that are alike below the threshold are compared one with another. At a
similarity of 0.8, a pair meets in 13 of the buckets on average, and in none with a probability of about 1e-7
(``(1 - 0.8**ROWS)**BANDS``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import checkpoint, pick, schema, slices

SHINGLE = 4
PERCENT = 80
BANDS = 40
ROWS = 5
BINS = BANDS * ROWS
#: Ids that are few enough to be sent to every task; beyond, the join shuffles.
FEW = 2_000_000
#: Rows of ids that a join sends to every task; beyond, it shuffles.
LIGHT = 100_000
#: Shingles of the nodes that a task compares with others at a time.
BLOCK = 250_000

_U = np.uint64
_MULT = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5)]
_PROBES = np.random.default_rng(20).integers(0, BINS, size=(BINS, 1024), dtype=np.int64)
_BAND_MULT = np.random.default_rng(21).integers(1, 2**63, size=(BANDS, ROWS), dtype=np.uint64) | _U(1)


class _Words(dict):
    """Hashes of words, each computed once while the table is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_set(text: str | None, words: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; A-Z are lower-cased, words lie between blanks of ASCII.

    With fewer words than a shingle has, the whole sequence is one; null and
    blank texts have none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(size, len(ids))
    n = len(ids) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mix(h * _MULT[k % 4] + ids[k : k + n])
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The ``BINS`` densified minima of a set of hashes that isn't empty."""
    bins = ((hashes >> _U(32)) * _U(BINS)) >> _U(32)  # rises with the hash, so the first of a bin is its least
    first = np.flatnonzero(np.diff(bins, prepend=_U(BINS)))
    sig = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    at = bins[first].astype(np.int64)
    sig[at], filled[at] = hashes[first], True
    empty = np.flatnonzero(~filled)
    for wide in (slice(0, 8), slice(8, 1024)):
        if not len(empty):
            break
        probes = _PROBES[empty, wide]
        hit = filled[probes]
        nth = hit.argmax(axis=1)
        ok = hit[np.arange(len(empty)), nth]
        sig[empty[ok]] = sig[probes[np.arange(len(empty)), nth][ok]]
        empty = empty[~ok]
    if len(empty):  # sets of a few shingles: the next filled bin, round the circle
        at = np.flatnonzero(filled)
        sig[empty] = sig[at[np.searchsorted(at, empty) % len(at)]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = _mix((_mix(sig.reshape(BANDS, ROWS)) * _BAND_MULT).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64)


def _print(hashes: np.ndarray) -> bytes | None:
    """The identity of a set: 128 bits of its hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, node, bands, text_hash``; ``node`` is the identity of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            bands = np.concatenate([band_keys(signature(s)) if len(s) else np.zeros(BANDS, np.int64) for s in sets]) if sets else np.zeros(0, np.int64)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_print(s) for s in sets], pa.binary()), column, batch.column("text_hash")], ["doc_id", "n_shingles", "node", "bands", "text_hash"])

    rows = pick(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.mapInArrow(run, schema("doc_id long, n_shingles long, node binary, bands array<long>, text_hash long"))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, hashes`` of the wanted nodes, from the text of the document that stands for each."""
    wanted = nodes.select(F.col("id").alias("__id"), "node")
    wanted = F.broadcast(wanted) if wanted.limit(FEW + 1).count() <= FEW else wanted
    docs = pick(docs, doc_id="long", text="string")
    rows = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__id"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            keep = [i for i, (s, n) in enumerate(zip(sets, batch.column("node").to_pylist(), strict=True)) if _print(s) == n]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["node", "hashes"])

    found = rows.mapInArrow(run, schema("node binary, hashes binary"))
    return found.groupBy("node").agg(F.first("hashes").alias("hashes"))


def _light(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpointed table and its number of rows. If it is small, it is in few parts and sent to every task that joins it; else joins shuffle it."""
    df = checkpoint(df)
    n = df.count()
    return (F.broadcast(df.coalesce(8)) if n <= LIGHT else df), n


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges ``a, b`` with 100 * intersection >= percent * union of their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    pairs = left.join(edges, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "ha", "hb").mapInArrow(run, schema("a binary, b binary"))


def components(edges: DataFrame) -> DataFrame:
    """``node, comp``: the least node of each component of the edges ``a, b``, for every node that has an edge.

    Labels are lowered by neighbours and then by their own labels (pointer
    jumping), so rounds grow with the logarithm of a component's width.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    both = both.coalesce(8) if both.count() <= LIGHT else both
    labels, n = _light(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while n:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        lower = near.join(labels, near["a"] == labels["node"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new, n = _light(lower.join(F.broadcast(jump) if n <= LIGHT else jump, "mid").select("node", "old", F.least("mid", "far").alias("comp")))
        labels = new.select("node", "comp")
        labels = F.broadcast(labels) if n <= LIGHT else labels
        if new.where("old != comp").isEmpty():
            break
    return labels


def merged(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """``node, comp`` after further edges (a node without a label is its own)."""
    if labels is None:
        return _light(components(new))[0]
    for end in ("a", "b"):
        new = new.join(labels.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    joined, n = _light(components(new.where("a != b")))
    moved = joined.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    moved = F.broadcast(moved) if n <= LIGHT else moved
    old = labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return _light(old.unionByName(joined.join(labels.select("node"), "node", "left_anti")))[0]


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Signatures of all rows, ``(node, id, n)`` of the distinct sets that share buckets, and ``node, comp`` of those with confirmed links.

    No link between members of a bucket is lost, whatever other buckets hold: of
    two members in different components, one is outside the centre's, and each of
    those is compared with all members (`_second`).
    """
    sigs = checkpoint(signatures(docs))
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    full = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1"))
    members = checkpoint(keyed.join(full, "key"))
    info = checkpoint(members.groupBy("node").agg(F.sum("cnt").alias("score")).join(nodes.select("node", "id", "n"), "node"))
    sets = checkpoint(_sets(docs, info))
    rows = members.join(info.select("node", "n", "score"), "node").select("key", "node", "n", "score")
    tops, _ = _light(rows.groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("top")).select("key", "top.*").withColumnsRenamed({"score": "s", "node": "centre", "n": "m"}).drop("s"))
    near = checkpoint(rows.join(tops, "key").where("node != centre").select("centre", "m", "node", "n").distinct())
    pairs = near.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    new, n = _light(_confirmed(pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), sets, percent))
    labels = merged(None, new) if n else None
    new, n = _light(_second(near, labels, sets, percent))
    if n:
        labels = merged(labels, new)
    return sigs, info, labels


def _second(near: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` of the nodes outside their centre's component with all nodes under that centre.

    A centre's nodes fall into blocks of about ``BLOCK`` shingles, and so do those
    outside its component; a task sees one block of each. What crosses the network
    is blocks, and what comes out is links, not pairs. Copies of a text are in
    their centre's component, so few nodes ask, unless many texts are alike below
    the threshold only.
    """
    if labels is None:
        rows = near.withColumn("comp", F.col("node")).withColumn("asks", F.lit(True))
    else:
        rows = near.join(labels, "node", "left").join(labels.select(F.col("node").alias("centre"), F.col("comp").alias("home")), "centre", "left")
        rows = rows.withColumn("comp", F.coalesce("comp", "node")).withColumn("asks", F.col("comp") != F.coalesce("home", "centre"))
    rows = checkpoint(rows.select("centre", "node", "n", "comp", "asks"))
    blocks = lambda c: F.ceil(F.sum(c) / BLOCK).alias
    per = rows.groupBy("centre").agg(F.count("*").alias("members"), blocks("n")("all_blocks"), blocks(F.when(F.col("asks"), F.col("n")).otherwise(0))("ask_blocks"))
    per, _ = _light(per.where("ask_blocks > 0 and members > 1").drop("members"))
    rows = rows.join(per, "centre")
    nth = lambda c: F.pmod(F.xxhash64("node"), c)
    each = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    told = rows.select("centre", nth(F.col("all_blocks")).alias("x"), each(F.col("ask_blocks")).alias("y"), "node", "comp", F.lit(False).alias("asks"))
    asked = rows.where("asks").select("centre", each(F.col("all_blocks")).alias("x"), nth(F.col("ask_blocks")).alias("y"), "node", "comp", F.lit(True).alias("asks"))

    def run(rows: pa.Table) -> pa.Table:
        asks = np.array(rows.column("asks"), bool)
        node, comp = rows.column("node").to_pylist(), rows.column("comp").to_pylist()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes")]
        own = np.flatnonzero(~asks)
        out: list[tuple[bytes, bytes]] = []
        if len(own):
            sizes = np.array([len(found[i]) for i in own])
            hashes, owner = np.concatenate([found[i] for i in own]), np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            for i in np.flatnonzero(asks):
                lo, hi = np.searchsorted(hashes, found[i], "left"), np.searchsorted(hashes, found[i], "right")
                hits = hi - lo
                at = np.arange(hits.sum()) + np.repeat(lo - np.cumsum(hits) + hits, hits)
                both = np.bincount(owner[at], minlength=len(own))
                alike = own[100 * both >= percent * (len(found[i]) + sizes - both)]
                out += [(min(node[i], node[j]), max(node[i], node[j])) for j in alike if comp[i] != comp[j]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return told.union(asked).join(sets, "node").groupBy("centre", "x", "y").applyInArrow(run, schema("a binary, b binary")).distinct()


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` of every row.

    ``component_id`` is the least ``doc_id`` that links reach, itself included;
    ``kept`` marks the rows whose own ``doc_id`` that is. Rows with equal sets
    are one node of the graph, so groups of copies cost one row each. Null, empty
    and blank texts have no set and are linked with nothing; rows that repeat a
    ``doc_id`` are linked by their texts, and if both belong to it are kept both;
    a null ``doc_id`` is the least of no class but one of its own kind; an empty
    table gives an empty one; columns besides ``doc_id`` and ``text`` aren't read.
    """
    sigs, info, labels = links(docs, percent)
    rows = sigs.select("doc_id", "n_shingles", "node", "text_hash")
    twins = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("c")).where("c > 1").select("node", "id")
    if labels is None:
        named = twins
    else:
        ids = labels.join(info.select("node", "id"), "node")
        least = checkpoint(ids.groupBy("comp").agg(F.min("id").alias("id")))
        linked = labels.join(least, "comp").select("node", "id")
        named = twins.join(linked, "node", "left_anti").unionByName(linked)
    named = checkpoint(named)
    few = named.limit(FEW // 8 + 1).count() <= FEW // 8
    out = rows.join(F.broadcast(named) if few else named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
