"""Repeated 200-byte strings by a distributed merge sort of suffixes that uses common prefixes.

Of texts with copies one is looked at; the copies repeat as wholes. Anchors, bytes picked by their surroundings (least hash of 125
neighbouring 16-byte strings), stand in for all suffixes: the first 140 bytes of any
200-byte string hold one, and equal strings hold it at the same place. Suffixes whose
first 76 bytes occur once in the corpus are told by counting hashes and dropped, as in
string sorting by distinguishing prefixes. The others are sorted where they are,
exchanged as front-coded sorted runs (each suffix without the prefix that it
shares with the one before it), and merged by loser trees that carry common
prefix lengths, so no known prefix is compared again. Groups in that order that
agree on 76 bytes are sorted by what lies to the left as well; an agreement of 200
bytes or more in all marks the bytes it covers. A group takes time in proportion to
its suffixes (times the 125 starts of strings around an anchor), not to their pairs.

Suffixes of a prefix with more than ``HOT`` occurrences aren't gathered in one
task. For them, ranges of string starts around the anchor are halved: a range is
settled if what all its strings share occurs once (none repeats) or if all that
they span occurs twice (all repeat); counts alone are exchanged.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.batches import pieces
from tesserae.llm._shared import Written, checkpoint, pick, schema, slices

LENGTH = 200
GRAM = 16
NEAR = 125  # GRAM-byte strings of which the least is an anchor
LEFT = NEAR - 1
CORE = LENGTH - LEFT
#: Occurrences of a prefix beyond which its suffixes are handled by counting; a group takes a merge time in proportion to its suffixes.
HOT = 50_000
#: Hashes of repeated prefixes that are few enough to go to every worker as a table of bits (64 MB at most); beyond, anchors join them by a shuffle.
FEW = 32_000_000
#: Suffixes that one merge should hold, and merges at most.
MERGE_ROWS = 40_000
MERGES = 16_384

#: Bytes of text that are hashed at once, so that what this takes stays in a core's cache, and that a sorted run is made of.
BLOCK = 1 << 16
PIECE = 1 << 24
#: Bytes of text whose hashes one task counts.
PART = 1 << 26
#: Texts with copies that are few enough to go to every worker.
COPIES = 500_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SMALL = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))


def _sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """``f`` over each ``w`` neighbours, from those of 2, 4, 8, ..."""
    n, k = len(x) - w + 1, 1
    while 2 * k <= w:
        x, k = f(x[:-k], x[k:]), 2 * k
    return f(x[:n], x[w - k : w - k + n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _M1
    return h ^ (h >> np.uint64(32))


def _block_anchors(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(flat) - GRAM + 1
    if n < NEAR:
        return np.empty(0, np.int64)
    h, k = flat.astype(np.uint32), 1
    for m in _SMALL[:4]:  # of 2, 4, 8, 16 bytes
        h, k = h[:-k] * m + h[k:], 2 * k
    h ^= h >> np.uint32(15)
    h *= _SMALL[4]
    h ^= h >> np.uint32(13)
    np.maximum(h, 1, out=h)
    least = _sliding(h, NEAR, np.minimum)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        least[lo if hi - lo < LENGTH else hi - NEAR - GRAM + 2 : hi] = 0  # no neighbours across the ends of texts
    ends = np.zeros(NEAR - 1, np.uint32)
    return np.flatnonzero(_sliding(np.concatenate([ends, least, ends]), NEAR, np.maximum) >= h)


def anchors(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that have at least ``CORE`` bytes of their text after them, and the numbers of their texts; ``bounds`` cut ``flat`` into texts."""
    found, low, last = [np.empty(0, np.int64)], 0, len(bounds) - 1
    while low < last:
        high = min(max(int(np.searchsorted(bounds, bounds[low] + BLOCK)), low + 1), last)
        at, end = int(bounds[low]), int(bounds[high])
        found.append(_block_anchors(flat[at:end], bounds[low : high + 1] - at) + at)
        low = high
    at = np.concatenate(found)
    text = np.searchsorted(bounds, at, side="right") - 1
    ok = at <= bounds[text + 1] - CORE
    return at[ok], text[ok]


def _windows(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes for each position."""
    if not len(at):
        return np.empty((0, width), np.uint8)
    return np.ndarray((len(flat) - width + 1,), f"V{width}", flat, 0, (1,))[at].view(np.uint8).reshape(-1, width)


def _cores(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the ``CORE`` bytes after anchors."""
    h = np.full(len(at), CORE, np.uint64)
    for column in (*_windows(flat, at, 72).view(np.uint64).T, *_windows(flat, at + CORE - 8, 8).view(np.uint64).T):
        h = _mixed(h ^ column * _M2)
    return _mixed(h)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, and where each begins and the last ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from pieces(batch, np.diff(_bytes(batch.column("text"))[1]), PIECE)


def _strings(rows: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The first ``lengths`` bytes of each row."""
    flat = rows[np.arange(rows.shape[1]) < lengths[:, None]]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows filled up with zeros, and their lengths."""
    rows = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in strings]), np.uint8).reshape(len(strings), width)
    return rows, np.fromiter(map(len, strings), np.int64, len(strings))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _texts(docs: DataFrame) -> DataFrame:
    docs = pick(docs, doc_id="long", text="string")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))


def repeated_prefixes(texts: DataFrame, parts: int = 1) -> DataFrame:
    """``h, n``: hashes of the prefixes after anchors that occur more than once, and how often; each of ``parts`` tasks counts a range of hashes.

    Hashes are exchanged as arrays: those that occur once in a piece of texts, and those that occur more often with their number.
    """
    kind = schema("part int, lone binary, more binary, n binary")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        for batch in _by_size(batches):
            flat, bounds = _bytes(batch.column("text"))
            h, n = np.unique(_cores(flat, anchors(flat, bounds)[0]), return_counts=True)
            lone, more = h[n == 1], h[n > 1]
            lists = ((lone, lone), (more, more), (n[n > 1].astype(np.int64), more))
            columns = [pa.array([x.tobytes() for x in np.split(values, np.searchsorted(by, cuts))], pa.binary()) for values, by in lists]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), *columns], ["part", "lone", "more", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for part, lone, more, n in zip(*(batch.column(c).to_pylist() for c in ("part", "lone", "more", "n")), strict=True):
                lists = own.setdefault(part, ([], []))
                lists[0].append(lone)
                lists[1].append((more, n))
        for part in list(own):
            lone, often = own.pop(part)
            h, times = np.unique(np.frombuffer(b"".join(lone), np.uint64), return_counts=True)
            more, n = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*often, strict=True), (np.uint64, np.int64), strict=True))
            again = (times > 1) | np.isin(h, more)
            h, of = np.unique(np.concatenate([more, h[again]]), return_inverse=True)
            sums = np.bincount(of, np.concatenate([n, times[again]]), len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sums)], ["h", "n"])

    return texts.select("text").mapInArrow(split, kind).repartitionById(parts, "part").mapInArrow(count, schema("h long, n long"))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree on ``known`` bytes."""
    most = min(len(a), len(b))
    differ = int.from_bytes(a[known:most], "big") ^ int.from_bytes(b[known:most], "big")
    return most - (differ.bit_length() + 7) // 8


Suffix = tuple[bytes, bytes, bytes, int, int]  # after the anchor; before it, reversed; text key; position; occurrences


def coded(right: np.ndarray, left: np.ndarray, key: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, at: np.ndarray, n: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sorted suffixes as bytes, each as the length ``shared`` with the one before it and what follows that; and where each begins."""
    rows = np.empty((len(at), 12 + LENGTH + LEFT + 16), np.uint8)
    for column, x in enumerate((shared, n_right - shared, n_left, n)):
        rows[:, column] = x
    rows[:, 4:12] = at.astype("<u8").view(np.uint8).reshape(-1, 8)
    rows[:, 12 : 12 + LENGTH], rows[:, 12 + LENGTH : -16], rows[:, -16:] = right, left, key
    used = np.ones(rows.shape, bool)
    column = np.arange(LENGTH, dtype=np.uint8)
    used[:, 12 : 12 + LENGTH] = (column >= shared.astype(np.uint8)[:, None]) & (column < n_right.astype(np.uint8)[:, None])
    used[:, 12 + LENGTH : -16] = column[:LEFT] < n_left.astype(np.uint8)[:, None]
    return rows[used], np.concatenate([[0], np.cumsum(28 + n_right - shared + n_left)])


def packed(n: int, rows: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", n) + rows)


def front_coded(run: list[Suffix]) -> bytes:
    """A sorted run of suffixes."""
    if not run:
        return packed(0, b"")
    rights, lefts, keys, at, n = zip(*run, strict=True)
    (right, n_right), (left, n_left) = _matrix(rights, LENGTH), _matrix(lefts, LEFT)
    shared = np.array([0, *(common(a, b) for a, b in zip(rights, rights[1:], strict=False))])
    return packed(len(run), coded(right, left, _matrix(keys, 16)[0], n_right, n_left, np.array(at), np.array(n), shared)[0].tobytes())


def decoded(blob: bytes) -> tuple[list[Suffix], list[int]]:
    """The suffixes of a run, and the length that each shares with the one before it."""
    blob = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, last, run, lcps = struct.unpack_from("<I", blob), 4, b"", [], []
    unpack = struct.Struct("<BBBBQ").unpack_from
    for _ in range(n):
        shared, rest, before, times, pos = unpack(blob, at)
        at += 12
        last = last[:shared] + blob[at : at + rest]
        at += rest
        left = blob[at : at + before]
        at += before
        run.append((last, left, blob[at : at + 16], pos, times))
        at += 16
        lcps.append(shared)
    return run, lcps


def merged(runs: list[tuple[list[Suffix], list[int]]]) -> Iterator[tuple[Suffix, int]]:
    """All suffixes of sorted runs in order, each with its common prefix with the one before it.

    A loser tree: each player is a run's next suffix with its common prefix with
    the last winner. The longer prefix wins; only equal ones compare bytes, from
    that prefix on, and the loser keeps what it shares with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    ends = [len(r[0]) for r in runs]
    nth = [0] * len(runs)
    strings: list[bytes | None] = [r[0][0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    lcp = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = strings[a], strings[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        shared = common(x, y, lcp[a])
        if x[shared : shared + 1] <= y[shared : shared + 1]:
            lcp[b] = shared
            return a, b
        lcp[a] = shared
        return b, a

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if size > 1 else 0
    while strings[best] is not None:
        run, shared = runs[best]
        i = nth[best]
        yield run[i], lcp[best]
        i += 1
        nth[best] = i
        if i < ends[best]:
            strings[best], lcp[best] = run[i][0], shared[i]
        else:
            strings[best] = None
        node = (best + size) >> 1
        x, known = strings[best], lcp[best]
        while node:  # as in `play`, without a call
            other = losers[node]
            y = strings[other]
            if y is not None:
                theirs, lost = lcp[other], x is None
                if not lost:
                    lost = theirs > known
                    if theirs == known:
                        shared = common(x, y, known)
                        lost = x[shared : shared + 1] > y[shared : shared + 1]
                        lcp[best if lost else other] = shared
                if lost:
                    losers[node], best, x, known = best, other, y, theirs
            node >>= 1


def _covered(suffixes: list[Suffix], lcps: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes in order: those with repeats around their anchors, and how far these reach to the left and to the right.

    ``lcps[i]`` is what suffix ``i`` shares with ``i - 1``; those that share
    ``CORE`` bytes are a group. Every repeat that a pair shows holds the anchor, so
    a suffix's repeats join in one stretch. One that occurs twice in its run was
    settled there and stands for the others to be compared with.
    """
    lcp = np.array(lcps)
    lcp[:1] = 0
    starts = lcp < CORE
    group = np.cumsum(starts)
    own = np.flatnonzero(np.bincount(group)[group] > 1)  # where in ``suffixes``
    if not len(own):
        return own, own, own
    some = [suffixes[i] for i in own.tolist()]
    group, r = group[own], np.where(starts[own], 0, lcp[own])
    (right, n_right), (left, n_left) = _matrix([x[0] for x in some], LENGTH), _matrix([x[1] for x in some], LEFT)
    seeks = np.array([x[4] for x in some]) < 2
    # the order of what lies before, within groups
    keys = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), left, n_left.astype(np.uint8)[:, None]], axis=1)
    by_left = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
    x, y = by_left[:-1], by_left[1:]
    near_l = np.where(group[x] == group[y], np.minimum(_agree(left[x], left[y]), np.minimum(n_left[x], n_left[y])), -1)
    near_r = np.where(near_l < 0, 0, np.minimum(_agree(right[x], right[y]), np.minimum(n_right[x], n_right[y])))
    next_l = np.where(starts[own][1:], -1, np.minimum(_agree(left[:-1], left[1:]), np.minimum(n_left[:-1], n_left[1:])))
    # what the nearest suffixes to the right and to the left share; if one of them shares the most on both sides, no other does better
    most_l, most_r = np.full(len(own), -1), np.zeros(len(own), np.int64)
    pairs = [(np.arange(len(own) - 1), np.arange(1, len(own)), next_l, r[1:]), (x, y, near_l, near_r)]
    pairs += [(b, a, l_, r_) for a, b, l_, r_ in pairs]
    for a, _, l_, r_ in pairs:
        most_l[a], most_r[a] = np.maximum(most_l[a], l_), np.maximum(most_r[a], np.where(l_ < 0, 0, r_))
    may = seeks & (most_l >= 0) & (most_l + most_r >= LENGTH)
    best = np.zeros(len(own), bool)
    for a, _, l_, r_ in pairs:
        best[a] |= (l_ == most_l[a]) & (r_ == most_r[a])
    hard = may & ~best
    low, high = np.where(may, LENGTH - most_r, 1), np.where(may, most_l, 0)  # starts of repeated strings, before the anchor
    if hard.any():
        # in their groups: strings from ``at`` bytes before the anchor are equal if their classes of prefixes to both sides are
        inside = np.flatnonzero(np.isin(group, group[hard]))
        place = np.empty(len(own), np.int64)
        place[inside] = np.arange(len(inside))
        order = by_left[np.isin(by_left, inside)]
        l_lcp = np.concatenate([[-1], near_l])[np.isin(by_left, inside)]
        l_lcp[np.concatenate([[True], group[order][1:] != group[order][:-1]])] = -1
        r_lcp, n_l, n_r = r[inside], n_left[inside], n_right[inside]
        order = place[order]
        todo = place[np.flatnonzero(hard)]
        top, bottom = most_l[inside], LENGTH - most_r[inside]

        def again(at: int, asked: np.ndarray) -> np.ndarray:
            """Which of the suffixes ``asked`` repeat the string that begins ``at`` bytes before their anchor."""
            classes = np.empty(len(inside), np.int64)
            classes[order] = np.cumsum(l_lcp < at)
            classes += np.cumsum(r_lcp < LENGTH - at) * (len(inside) + 1)
            there = (n_l >= at) & (n_r >= LENGTH - at)
            known = np.sort(classes[there])
            mine = classes[asked]
            return there[asked] & (np.searchsorted(known, mine, side="right") - np.searchsorted(known, mine) > 1)

        first, last = np.full(len(inside), LENGTH), np.full(len(inside), -1)
        left_over = todo
        for at in range(int(top[todo].max()), int(bottom[todo].min()) - 1, -1):
            asked = left_over[(top[left_over] >= at) & (bottom[left_over] <= at)]
            if len(asked):
                last[asked[again(at, asked)]] = at
                left_over = left_over[(last[left_over] < 0) & (bottom[left_over] < at)]
            if not len(left_over):
                break
        left_over = todo[last[todo] >= 0]
        for at in range(int(bottom[todo].min()), int(top[todo].max()) + 1):
            asked = left_over[bottom[left_over] <= at]
            if len(asked):
                first[asked[again(at, asked)]] = at
                left_over = left_over[first[left_over] == LENGTH]
            if not len(left_over):
                break
        low[hard], high[hard] = first[todo], last[todo]
    ok = np.flatnonzero(may & (low <= high))
    return own[ok], high[ok], LENGTH - low[ok]


_MARK = "key binary, lo long, hi long"


def _marks(found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    """Overlapping stretches of a text joined."""
    out: list[list] = []
    for key, lo, hi in sorted(found):
        if out and out[-1][0] == key and lo <= out[-1][2]:
            out[-1][2] = max(hi, out[-1][2])
        else:
            out.append([key, lo, hi])
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["key", "lo", "hi"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches of each text, overlapping and touching ones joined."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            own: list[dict[str, int]] = []
            for s in spans:
                if own and s["lo"] <= own[-1]["hi"]:
                    own[-1]["hi"] = max(own[-1]["hi"], s["hi"])
                else:
                    own.append(s)
            out.append(own)
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, kind)], ["key", "spans"])


_OUT = "part long, run binary, hot binary, before binary, key binary, lo long, hi long, n long"
_OUT_ARROW = [("part", pa.int64()), ("run", pa.binary()), ("hot", pa.binary()), ("before", pa.binary()), ("key", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())]


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in _OUT_ARROW], [c for c, _ in _OUT_ARROW])


def _runs(candidates: DataFrame, wanted, splitters: list[bytes]) -> DataFrame:
    """Of each piece of texts: front-coded runs by merge, suffixes of hot prefixes, and stretches that repeat within the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(splitters, f"S{CORE}")
        for batch in _by_size(batches):
            flat, bounds, at, text, hot = wanted(batch)
            if not len(at):
                continue
            keys = _bytes(batch.column("key"))[0].reshape(-1, 16)
            n_left, n_right = np.minimum(at - bounds[text], LEFT), np.minimum(bounds[text + 1] - at, LENGTH)
            around = _windows(np.concatenate([np.zeros(LEFT, np.uint8), flat, np.zeros(LENGTH, np.uint8)]), at, LEFT + LENGTH)
            rows = np.empty((len(at), LENGTH + LEFT + 2), np.uint8)
            rows[:, :LENGTH], rows[:, LENGTH + 1 : -1] = around[:, LEFT:], around[:, LEFT - 1 :: -1]
            rows[:, LENGTH], rows[:, -1] = n_right, n_left
            del around
            for of, lengths, first in ((LENGTH, n_right, 0), (LEFT, n_left, LENGTH + 1)):  # a text's end: zeros, and the length after them
                short = np.flatnonzero(lengths < of)
                rows[short, first : first + of] *= np.arange(of) < lengths[short, None]
            order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
            rows, at, text, hot, n_left, n_right = rows[order], at[order], text[order], hot[order], n_left[order], n_right[order]
            kinds = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
            n = np.diff(np.append(kinds, len(at)))
            settled = np.repeat(n > 1, n) & (n_left + n_right >= LENGTH)
            lo, hi, of = at[settled] - n_left[settled] + text[settled], at[settled] + n_right[settled] + text[settled], text[settled]  # texts kept apart by a place
            if len(lo):
                order = np.argsort(lo, kind="stable")
                lo, hi, of = lo[order], np.maximum.accumulate(hi[order]), of[order]
                begins = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                lo, hi, of = lo[begins], hi[np.append(begins[1:], len(hi)) - 1], of[begins]
                yield _rows(key=_strings(keys[of], np.full(len(of), 16)), lo=pa.array(lo - bounds[of] - of), hi=pa.array(hi - bounds[of] - of))
            n = np.minimum(n, 2)
            for is_hot in (True, False):
                some = kinds[hot[kinds] == is_hot]
                times = n[hot[kinds] == is_hot]
                if not len(some):
                    continue
                right, left, key, begin = rows[some, :LENGTH], rows[some, LENGTH + 1 : -1], keys[text[some]], at[some] - bounds[text[some]]
                n_r, n_l = n_right[some], n_left[some]
                if is_hot:
                    yield _rows(hot=_strings(right, n_r), before=_strings(left, n_l), key=_strings(key, np.full(len(key), 16)), lo=pa.array(begin), n=pa.array(times))
                    continue
                shared = np.zeros(len(some), np.int64)
                shared[1:] = np.minimum(_agree(right[1:], right[:-1]), np.minimum(n_r[1:], n_r[:-1]))
                ends = [*np.searchsorted(np.ascontiguousarray(right[:, :CORE]).view(f"S{CORE}").ravel(), cuts).tolist(), len(some)]
                parts = [(i, a, b) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]
                shared[[a for _, a, _ in parts]] = 0
                blob, offsets = coded(right, left, key, n_r, n_l, begin, times, shared)
                yield _rows(part=pa.array([i for i, _, _ in parts], pa.int64()), run=pa.array([packed(b - a, blob[offsets[a] : offsets[b]].tobytes()) for _, a, b in parts], pa.binary()))

    return candidates.mapInArrow(run, schema(_OUT))


#: Bits of a table of hashes that one task fills.
SLICE = 22


def _table(repeated: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A table of bits, 16 or more for each of ``n`` hashes: a hash whose bit isn't set is none of them. And how many bits of a hash tell its place."""
    bits = max(SLICE, (16 * n).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            for part in np.unique(place >> np.uint64(SLICE)).tolist():
                here = place[place >> np.uint64(SLICE) == part] & np.uint64(2**SLICE - 1)
                own.setdefault(part, np.zeros(2**SLICE, bool))[here] = True
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in own.values()], pa.binary())], ["part", "bits"])

    part = F.shiftrightunsigned("h", 64 - bits + SLICE) if bits > SLICE else F.lit(0)
    rows = repeated.select("h", part.cast("int").alias("part")).repartitionById(2 ** (bits - SLICE), "part").select("h").mapInArrow(run, schema("part long, bits binary"))
    table = np.zeros(2 ** (bits - 3), np.uint8)
    for row in rows.toLocalIterator():
        table[row["part"] << (SLICE - 3) :][: 2 ** (SLICE - 3)] |= np.frombuffer(row["bits"], np.uint8)
    return table, bits


def _candidates(texts: DataFrame, repeated: DataFrame, few: int) -> tuple[DataFrame, object]:
    """Texts, and a function that gives of a piece of them their bytes and bounds, and the anchors of repeated prefixes, their texts, and if they are hot.

    While there are ``few`` hashes at most, a table of bits tells them, so some of
    the anchors that it gives occur once; they only cost what comparing them does.
    """
    sc = texts.sparkSession.sparkContext
    n = repeated.count()
    if n <= few:
        often = np.sort(np.array([r["h"] for r in repeated.where(F.col("n") > HOT).select("h").collect()], np.int64))  # one in HOT anchors at most
        known = sc.broadcast((*_table(repeated, n), often))

        def wanted(batch: pa.RecordBatch) -> tuple:
            table, bits, often = known.value
            flat, bounds = _bytes(batch.column("text"))
            at, text = anchors(flat, bounds)
            h = _cores(flat, at)
            place = h >> np.uint64(64 - bits)
            ok = (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            return flat, bounds, at[ok], text[ok], np.isin(h[ok].view(np.int64), often)

        return texts.select("text", "key"), wanted

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(batches):
            flat, bounds = _bytes(batch.column("text"))
            at, text = anchors(flat, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(_cores(flat, at).view(np.int64)), batch.column("key").take(pa.array(text)), pa.array(at - bounds[text])], ["h", "key", "at"])

    # a text with copies is told once; copies as such are known from their number
    places = texts.select("text", "key").mapInArrow(find, schema("h long, key binary, at long")).distinct()
    places = places.join(repeated, "h").groupBy("key").agg(F.collect_set(F.struct("at", (F.col("n") > HOT).alias("hot"))).alias("places"))
    both = texts.select("text", "key").join(places, "key")

    def listed(batch: pa.RecordBatch) -> tuple:
        flat, bounds = _bytes(batch.column("text"))
        places = batch.column("places")
        text = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
        at, hot = (places.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "hot"))
        order = np.lexsort((at, text))
        return flat, bounds, (at + bounds[text])[order], text[order], hot.astype(bool)[order]

    return both, listed


def _splitters(candidates: DataFrame, wanted, merges: int, n: int) -> list[bytes]:
    """Prefixes that cut the candidates into about ``merges`` equal ranges, from those of about 4,000 texts."""
    if merges < 2:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(batches):
            flat, _, at, _, hot = wanted(batch)
            rows = _windows(flat, at[~hot][::7], CORE)
            yield pa.RecordBatch.from_arrays([_strings(rows, np.full(len(rows), CORE))], ["prefix"])

    some = candidates.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // 4_000))) == 0)
    found = sorted(some.mapInArrow(run, schema("prefix binary")).limit(20_000).toArrow().column("prefix").to_pylist())
    return sorted({bytes(found[len(found) * i // merges]) for i in range(1, merges)}) if found else []


def _merge(runs: DataFrame, parts: int) -> DataFrame:
    """Stretches that repeat within the ranges ``part``; range ``i`` is dealt to task ``i``, so no task gets several by chance."""

    def merge(blobs: list[bytes]) -> pa.RecordBatch:
        suffixes, lcps = map(list, zip(*merged([decoded(b) for b in blobs]), strict=True))
        at, left, right = _covered(suffixes, lcps)
        return _marks([(s[2], s[3] - a, s[3] + b) for s, a, b in zip([suffixes[i] for i in at.tolist()], left.tolist(), right.tolist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), strict=True):
                if p != part and blobs:
                    yield merge(blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield merge(blobs)

    return runs.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(run, schema(_MARK))


def _halve(hot: DataFrame) -> DataFrame | None:
    """Stretches that repeat among the suffixes of hot prefixes (``right, left, key, at, n``), by counting.

    A settled range stays for the others to be counted with, as one row for all that are equal.
    """
    items = hot.select("right", "left", "key", "at", "n", F.lit(1).alias("open"), F.lit(0).alias("lo"), F.lit(128).alias("width"))
    found = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, span = [], []
            for right, left, lo, width in zip(*(batch.column(c).to_pylist() for c in ("right", "left", "lo", "width")), strict=True):
                hi = lo + width - 1
                need, most = max(0, LENGTH - hi), LENGTH - lo
                salt = struct.pack("<HH", lo, width)
                there = len(left) >= lo and len(right) >= need
                core.append(xxhash.xxh3_128_digest(salt + left[:lo] + b"|" + right[:need]) if there else None)
                whole = len(left) >= hi and len(right) >= most
                span.append(xxhash.xxh3_128_digest(salt + left[:hi] + b"|" + right[:most]) if whole else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(core, pa.binary()), pa.array(span, pa.binary())], [*batch.schema.names, "core", "span"])

    while True:
        told = items.mapInArrow(run, schema("right binary, left binary, key binary, at long, n long, open int, lo int, width int, core binary, span binary")).where("core is not null")
        told = checkpoint(told)
        cores = checkpoint(told.groupBy("core").agg(F.sum("n").alias("c"), F.max("open").alias("o")).where("c > 1 and o = 1").select("core"))
        if cores.isEmpty():
            return found
        spans = checkpoint(told.where("span is not null").groupBy("span").agg(F.sum("n").alias("s")).where("s > 1"))
        told = checkpoint(told.join(cores, "core").join(spans, "span", "left"))
        repeat = F.coalesce((F.col("s") > 1) | (F.col("width") == 1), F.lit(False))
        most = F.least(F.col("lo") + F.col("width") - 1, F.length("left"))
        marks = told.where(repeat & (F.col("open") == 1)).select("key", (F.col("at") - most).alias("lo"), (F.col("at") - F.col("lo") + LENGTH).alias("hi"))
        found = marks if found is None else found.union(marks)
        fields = ["right", "left", "key", "at", "n", "open", "lo", "width"]
        settled = told.where(repeat & (F.col("width") > 1)).groupBy("span").agg(*(F.first(c).alias(c) for c in fields)).withColumn("n", F.lit(2).cast("long")).withColumn("open", F.lit(0))
        rest = told.where(~repeat).select(*fields).union(settled.select(*fields))
        half = (F.col("width") / 2).cast("int")
        items = rest.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select(*fields[:6], (F.col("lo") + F.col("side") * half).alias("lo"), half.alias("width"))


WIDTHS = (32, 8, 2, 1)
#: Repeated hashes of ranges of a width that are few enough to go to every worker (64 MB); beyond, ranges are halved by joins.
HOT_HASHES = 4_000_000


def _prefix_hashes(rows: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 0, 1, 2, ... bytes of each row."""
    out = [np.full(len(rows), rows.shape[1], np.uint64)]
    for column in rows.T:
        out.append(_mixed(out[-1] ^ (column.astype(np.uint64) + np.uint64(1)) * _M2))
    return out


class _Ranges:
    """Ranges of string starts around anchors, of the suffixes of a batch."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.rows = batch.num_rows
        (right, n_right), (left, n_left) = _matrix(batch.column("right").to_pylist(), LENGTH), _matrix(batch.column("left").to_pylist(), LEFT)
        self.n_right, self.n_left = n_right, n_left
        self._right, self._left = np.array(_prefix_hashes(right)), np.array(_prefix_hashes(left))

    def hashes(self, i: np.ndarray, lo: np.ndarray, width: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of what all strings of a range share or, ``whole``, of what they span; and where there is one, as texts may end before."""
        before, after = (lo + width - 1, LENGTH - lo) if whole else (lo, np.maximum(0, LENGTH - lo - width + 1))
        there = (self.n_left[i] >= before) & (self.n_right[i] >= after)
        salt = (lo.astype(np.uint64) << np.uint64(9)) + np.uint64(2 * width + whole)
        h = _mixed(self._left[np.minimum(before, LEFT), i] * _M2 + salt)
        return _mixed(_mixed(h ^ self._right[after, i] * _M2)), there

    def walk(self, levels: list) -> tuple[tuple[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray, int]]]:
        """Suffixes and starts of the ranges of the next width that may repeat, and of settled ones that do."""
        starts = np.arange(0, LEFT + 1, WIDTHS[0])
        i, lo = np.repeat(np.arange(self.rows), len(starts)), np.tile(starts, self.rows)
        done, settled = np.zeros(len(i), bool), []
        for (cores, spans), width in levels:
            alike = _times(cores, *self.hashes(i, lo, width, whole=False))
            i, lo, done, alike = (x[alike > 0] for x in (i, lo, done, alike))
            same = _times(spans, *self.hashes(i, lo, width, whole=True))
            now = ~done & ((same > 0) | (width == 1))
            settled.append((i[now], lo[now], width))
            further = alike > same  # a settled range goes on only for those that share its core and not all of it
            i, lo, done = i[further], lo[further], (done | now)[further]
            nth = WIDTHS.index(width) + 1
            if nth < len(WIDTHS):
                steps = np.arange(0, width, WIDTHS[nth])
                i, lo, done = np.repeat(i, len(steps)), np.add.outer(lo, steps).ravel(), np.repeat(done, len(steps))
                i, lo, done = i[lo <= LEFT], lo[lo <= LEFT], done[lo <= LEFT]
        return (i, lo), settled


def _times(known: tuple[np.ndarray, np.ndarray], h: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How often hashes occur, 0 for those that aren't known."""
    hashes, n = known
    if not len(hashes):
        return np.zeros(len(h), np.int64)
    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(there & (hashes[place] == h), n[place], 0)


def _narrowed(hot: DataFrame) -> DataFrame | None:
    """Stretches that repeat among the suffixes of hot prefixes, by counting hashes of ever narrower ranges.

    Every pass tells a range's fate from the hashes that repeated in the passes
    before; equal suffixes give equal hashes, which are counted where they are, so
    only as many as differ are exchanged. 64-bit hashes decide here: a false match
    among 1e8 ranges has a probability of about 3e-4. Hashes that repeat go to the
    workers while there are ``HOT_HASHES`` at most; beyond, `_halve` takes over,
    which exchanges them by joins.
    """
    sc = hot.sparkSession.sparkContext
    known: list = []
    for width in WIDTHS:
        levels = list(known)

        def count(batches: Iterator[pa.RecordBatch], width: int = width, levels: list = levels) -> Iterator[pa.RecordBatch]:
            got = [(b.value, w) for b, w in levels]
            for batch in slices(batches, 4096):
                ranges, times = _Ranges(batch), batch.column("n").to_numpy()
                i, lo = ranges.walk(got)[0]
                for whole in (False, True):
                    h, there = ranges.hashes(i, lo, width, whole)
                    h, of = np.unique(h[there], return_inverse=True)
                    n = np.bincount(of, times[i[there]], len(h)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), whole)), pa.array(h.view(np.int64)), pa.array(n)], ["span", "h", "n"])

        repeat = checkpoint(hot.mapInArrow(count, schema("span boolean, h long, n long")).groupBy("span", "h").agg(F.sum("n").alias("n")).where("n > 1").select("span", "h", "n"))
        if repeat.limit(HOT_HASHES + 1).count() > HOT_HASHES:
            return _halve(hot)
        repeat = repeat.toArrow()  # bounded by the check before
        span, n = np.array(repeat.column("span"), bool), repeat.column("n").to_numpy()
        h = repeat.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        span, n, h = span[order], n[order], h[order]
        known.append((sc.broadcast(tuple((h[x], n[x]) for x in (~span, span))), width))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.value, w) for b, w in known]
        for batch in slices(batches, 4096):
            ranges = _Ranges(batch)
            low, high = np.full(batch.num_rows, LENGTH), np.full(batch.num_rows, -1)
            for i, lo, width in ranges.walk(got)[1]:
                np.minimum.at(low, i, lo)
                np.maximum.at(high, i, np.minimum(lo + width - 1, ranges.n_left[i]))
            some = np.flatnonzero(high >= 0)
            at = batch.column("at").to_numpy()[some]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some)), pa.array(at - high[some]), pa.array(at - low[some] + LENGTH)], ["key", "lo", "hi"])

    return hot.mapInArrow(mark, schema(_MARK))


def _once(texts: DataFrame, copies: DataFrame, n: int, many: bool) -> tuple[DataFrame, Written | None]:
    """One text of those that are equal (if repeated rows have its least id, all of them), and what is to be dropped when done.

    ``n`` texts have copies; where they are ``many`` of all rows, what is left is written once.
    """
    if not n:
        return texts, None
    first = copies.select("key", "first", F.lit(True).alias("copied"))
    kept = texts.join(F.broadcast(first) if n <= COPIES else first, "key", "left").where(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).select(*texts.columns)
    if n <= COPIES and not many:
        return kept, None
    written = Written(kept)
    return written.rows, written


def repeats(docs: DataFrame, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Texts with their keys, and ``key, spans``: the sorted, disjoint stretches of each text that repeat."""
    texts = _texts(docs)
    counted = checkpoint(texts.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min(F.octet_length("text").cast("long")).alias("hi")))
    copies = counted.where("n > 1")
    n, rows, size, copied = counted.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "hi")), F.count_if(F.col("n") > 1)).first()
    once, written = _once(texts, copies, copied, many=rows > 2 * n)
    repeated = checkpoint(repeated_prefixes(once, max(size // PART + 1, docs.sparkSession.sparkContext.defaultParallelism)))
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    candidates, wanted = _candidates(once, repeated, few)
    splitters = _splitters(candidates, wanted, min(MERGES, total // MERGE_ROWS + 1), n)
    found = Written(_runs(candidates, wanted, splitters))
    out = found.rows
    marks = out.where("hi is not null").select("key", "lo", "hi")
    marks = marks.union(copies.where(F.col("hi") >= LENGTH).select("key", F.lit(0).cast("long").alias("lo"), "hi"))
    marks = marks.union(_merge(out.where("run is not null").select("part", "run"), len(splitters) + 1))
    hot = out.where("hot is not null").select(F.col("hot").alias("right"), F.col("before").alias("left"), "key", F.col("lo").alias("at"), "n")
    more = None if hot.isEmpty() else _narrowed(hot)
    marks = marks.union(more) if more is not None else marks
    grouped = marks.distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    spans = checkpoint(grouped.mapInArrow(_joined, schema("key binary, spans array<struct<lo:long,hi:long>>")))
    found.drop()
    if written:
        written.drop()
    return texts, spans


def remove(docs: DataFrame, few: int = FEW) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row; ``kept`` holds the remaining bytes.

    Strings are judged on the input; a text that occurs twice repeats itself. Null
    texts are empty; texts of fewer than 200 bytes keep all; repeated rows count
    as copies; a null ``doc_id`` stays; an empty table gives an empty one; columns
    besides ``doc_id`` and ``text`` aren't read.
    """
    texts, spans = repeats(docs, few)
    rows = texts.join(spans, "key", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, kept, at, number = text.encode("utf-8", "surrogatepass"), [], 0, 0
                for s in found or ():
                    kept.append(raw[at : s["lo"]])
                    at = s["hi"]
                    number += 1
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), number, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
