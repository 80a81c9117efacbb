"""Repair of the turns of conversations by a scan of min-plus matrices.

What edits may make of a conversation is told by four states: nothing yet, after
the system turn, after a user's, after an assistant's. A turn is a 4x4 matrix of
(cost, audit) elements: the cheapest edits that lead from one state to another,
with any insertions before it; of equal costs the least audit string. Products
add costs, join audits and keep the least. Edits of equal cost over the same turns are never
prefixes of one another, so the least stays the least whatever is joined to it,
and products are associative: turns are multiplied in blocks where they are, blocks
in trees of 64, and the choice of states is handed down the tree again. No task
holds more than a block of turns or 64 nodes, however long a conversation is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import Written, checkpoint, pick, running, schema

#: Turns of a block, as a power of two; nodes that one product of the tree joins.
BLOCK_BITS, FAN = 10, 64
#: Bytes of repaired text in one row at most, but for a longer turn.
PIECE = 1 << 20
BLANKS = " \t\n\x0b\f\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5

Element = tuple[int, str]
Matrix = list[Element | None]  # 4 x 4, by rows
#: The state that a role leads to from each state where it may come.
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
CLOSURE: Matrix = [
    (0, ""), None, (INSERT, "I"), (2 * INSERT, "II"),
    None, (0, ""), (INSERT, "I"), (2 * INSERT, "II"),
    None, None, (0, ""), (INSERT, "I"),
    None, None, (INSERT, "I"), (0, ""),
]


def product(p: Matrix, q: Matrix) -> Matrix:
    out: Matrix = [None] * 16
    for i in range(4):
        for k in range(4):
            a = p[4 * i + k]
            if a is None:
                continue
            for j in range(4):
                b = q[4 * k + j]
                if b is not None:
                    cost, best = a[0] + b[0], out[4 * i + j]
                    if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                        out[4 * i + j] = (cost, a[1] + b[1])
    return out


@functools.lru_cache
def turn(initial: str, fault: int) -> Matrix:
    """Of a turn, insertions before it included."""
    own: Matrix = [None] * 16
    for i in range(4):
        own[5 * i] = (DELETE, "D")
    if fault not in (BLANK, DUPLICATE):
        more = CUT if fault == TRUNCATED else 0
        for i, j in (STEPS["u"] | STEPS["a"]).items():
            own[4 * i + j] = (REROLE + more, "R")
        for i, j in STEPS.get(initial, {}).items():
            own[4 * i + j] = (KEEP + more, "K")
    return product(CLOSURE, own)


def closed(p: Matrix) -> tuple[Element, int, str]:
    """Cheapest edits of a whole conversation, the state its last turn leaves, and what is inserted after it."""
    found = []
    for k in range(4):
        for end in ENDS:
            a, b = p[k], CLOSURE[4 * k + end]
            if a is not None and b is not None:
                found.append(((a[0] + b[0], a[1] + b[1]), k, b[1]))
    return min(found)


def way(nodes: list[Matrix], start: int, end: int) -> list[tuple[int, int]]:
    """Of each node its states before and after, on the cheapest way from ``start`` to ``end``."""
    best: list[Element | None] = [(0, "") if s == start else None for s in range(4)]
    back: list[list[int]] = []
    for p in nodes:
        nxt: list[Element | None] = [None] * 4
        came = [0] * 4
        for k in range(4):
            for j in range(4):
                a, b = best[k], p[4 * k + j]
                if a is not None and b is not None and (nxt[j] is None or (a[0] + b[0], a[1] + b[1]) < nxt[j]):
                    nxt[j], came[j] = (a[0] + b[0], a[1] + b[1]), k
        best = nxt
        back.append(came)
    out, at = [], end
    for came in reversed(back):
        out.append((came[at], at))
        at = came[at]
    return out[::-1]


def edited(turns: Iterator[tuple[str, str]], state: int, audit: str) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of what an audit makes of turns (role and text), from a state on; deleted ones give nothing."""
    at = 0

    def inserted() -> Iterator[tuple[str, str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = ASSISTANT if state == USER else USER
            at += 1
            yield "I", "assistant" if state == ASSISTANT else "user", ""

    for role, text in turns:
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        if edit == "R":
            state = ASSISTANT if state == USER else USER
            role = "assistant" if state == ASSISTANT else "user"
        else:
            state = STEPS[role[:1]][state]
        yield edit, role, text
    yield from inserted()


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns after damage by a hash of ``conv_id:turn``: dropped, emptied, without end marks, repeated, or said by the user."""
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string")
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).alias("kind")).where("kind > 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _key(conv_id: Column) -> Column:
    """Tells conversations apart; a null id is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _ordered(turns: DataFrame) -> Written:
    """``c, turn, role, text, pos``, where ``pos`` rises with a conversation's turns. Ranges of turns are sorted, not conversations, so a long one lies in many tasks."""
    rows = pick(turns, conv_id="long", turn="long", role="string", text="string")
    rows = rows.select(_key(F.col("conv_id")).alias("c"), "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.monotonically_increasing_id().alias("row"))
    order = ["c", "turn", "role", "text", "row"]  # nulls come first
    return Written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("pos", F.monotonically_increasing_id()))


def _faults(rows: DataFrame) -> DataFrame:
    """``c, pos, initial, fault`` of ordered turns."""
    bare = F.rtrim("text", F.lit(BLANKS))
    said = F.md5(F.concat(*(x for c in ("c", "role", "text") for x in (F.length(c).cast("string"), F.lit(":"), F.col(c)))))
    light = rows.select("c", "pos", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(*".!?").alias("ended"), said.alias("said"))
    first = light.where("not blank").groupBy("said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select("said", "first")
    light = light.join(first, "said", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(SOUND)
    return light.select("c", "pos", "initial", fault.alias("fault"))


_NODE = "c string, at long, costs array<long>, audits array<string>, first string, last string, illegal long, blank long, duplicate long, truncated long"
_FIELDS = ["c", "at", "costs", "audits", "first", "last", "illegal", "blank", "duplicate", "truncated"]
_TYPES = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.string(), *[pa.int64()] * 4]


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Node:
    """What is known of a run of turns, and how it is joined to that of the run after it."""

    def __init__(self, matrix: Matrix, first: str, last: str, illegal: int, faults: list[int]) -> None:
        self.matrix, self.first, self.last, self.illegal, self.faults = matrix, first, last, illegal, faults

    @classmethod
    def of(cls, initial: str, fault: int) -> _Node:
        return cls(turn(initial, fault), initial, initial, 0, [int(fault == f) for f in (BLANK, DUPLICATE, TRUNCATED)])

    @classmethod
    def read(cls, row: dict) -> _Node:
        matrix = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)]
        return cls(matrix, row["first"], row["last"], row["illegal"], [row[f] for f in ("blank", "duplicate", "truncated")])

    def add(self, other: _Node) -> None:
        self.matrix = product(self.matrix, other.matrix)
        self.illegal += other.illegal + (not _legal(self.last, other.first))
        self.last = other.last
        self.faults = [a + b for a, b in zip(self.faults, other.faults, strict=True)]

    def row(self, c: str, at: int) -> tuple:
        return (c, at, [e and e[0] for e in self.matrix], [e and e[1] for e in self.matrix], self.first, self.last, self.illegal, *self.faults)


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that follow one another and share their keys."""
    from itertools import groupby

    rows = (r for batch in batches for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist())
    yield from groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _sent(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], lot: int = 256) -> Iterator[pa.RecordBatch]:
    from itertools import batched

    for some in batched(rows, lot):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)


def _multiplied(groups: Iterator[tuple[tuple, Iterator[_Node]]]) -> Iterator[tuple]:
    for (c, at), nodes in groups:
        total = next(nodes)
        for node in nodes:
            total.add(node)
        yield total.row(c, at)


def _blocks(faults: DataFrame) -> DataFrame:
    """A node for each block of ``2 ** BLOCK_BITS`` turns of a conversation; ``at`` is the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = ((k, (_Node.of(r["initial"], r["fault"]) for r in rows)) for k, rows in _groups(batches, "c", "at"))
        yield from _sent(_multiplied(groups), _FIELDS, _TYPES)

    rows = faults.withColumn("at", F.shiftright("pos", BLOCK_BITS))
    return rows.repartition("at").sortWithinPartitions("at", "c", "pos").mapInArrow(run, schema(_NODE))


def _parents(nodes: DataFrame) -> DataFrame:
    """A node for each ``FAN`` nodes whose numbers ``at`` follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = ((k, map(_Node.read, rows)) for k, rows in _groups(batches, "c", "parent"))
        yield from _sent(_multiplied(groups), _FIELDS, _TYPES, 16)

    rows = nodes.withColumn("parent", F.floor(F.col("at") / FAN))
    return rows.repartition("c", "parent").sortWithinPartitions("c", "parent", "at").mapInArrow(run, schema(_NODE))


_ROOT = "c string, illegal long, blank long, duplicate long, truncated long, cost long, audit string, state int, tail string"


def _roots(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    (cost, audit), state, tail = closed(_Node.read(r).matrix)
                    yield r["c"], r["illegal"], r["blank"], r["duplicate"], r["truncated"], cost, audit, state, tail

        yield from _sent(told(), ["c", "illegal", "blank", "duplicate", "truncated", "cost", "audit", "state", "tail"], [pa.string(), *[pa.int64()] * 5, pa.string(), pa.int32(), pa.string()])

    return nodes.mapInArrow(run, schema(_ROOT))


def _handed_down(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """``c, at, start, end, tail`` of nodes, from those of their parents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            for (c, _), rows in _groups(batches, "c", "parent"):
                own = list(rows)  # FAN at most
                found = way([_Node.read(r).matrix for r in own], own[0]["start"], own[0]["end"])
                for i, (r, (start, end)) in enumerate(zip(own, found, strict=True)):
                    yield c, r["at"], start, end, r["tail"] if i == len(own) - 1 else ""

        yield from _sent(told(), ["c", "at", "start", "end", "tail"], [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()])

    rows = nodes.withColumn("parent", F.floor(F.col("at") / FAN)).join(chosen.withColumnRenamed("at", "parent"), ["c", "parent"])
    return rows.repartition("c", "parent").sortWithinPartitions("c", "parent", "at").mapInArrow(run, schema("c string, at long, start int, end int, tail string"))


def _planned(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots, one a conversation, and the edits of each block: ``c, at, state, audit``. ``blocks`` should be cheap to read again."""
    parts = blocks.groupBy("c").count().where("count > 1").select("c")
    several = checkpoint(parts)
    whole = blocks.join(several, "c", "left_anti")
    roots = checkpoint(_roots(whole))
    ends = roots.select("c", F.lit(NOTHING).alias("start"), F.col("state").alias("end"), "tail")
    plan = whole.join(ends, "c")
    if not several.isEmpty():
        long = blocks.join(several, "c").withColumn("block", F.col("at")).withColumn("one", F.lit(1).cast("long"))
        numbers = running(long.select("c", "block", "one").withColumn("task", F.shiftright("block", 33 - BLOCK_BITS)), ["c"], "task", [F.col("block")], "one", "number")
        levels = [checkpoint(long.drop("at", "one").join(numbers.select("c", "block", (F.col("number") - 1).alias("at")), ["c", "block"]).select(*_FIELDS, "block"))]
        last = levels[0].agg(F.max("at")).first()[0]
        while last > 0:
            levels.append(checkpoint(_parents(levels[-1])))
            last //= FAN
        tops = checkpoint(_roots(levels[-1]))
        roots = roots.union(tops)
        chosen = tops.select("c", F.lit(0).cast("long").alias("at"), F.lit(NOTHING).alias("start"), F.col("state").alias("end"), "tail")
        for level in reversed(levels[:-1]):
            chosen = checkpoint(_handed_down(level, chosen))
        found = levels[0].join(chosen, ["c", "at"]).drop("at").withColumnRenamed("block", "at")
        plan = plan.unionByName(found.select(*plan.columns))
    audit = F.concat(F.element_at("audits", (F.col("start") * 4 + F.col("end") + 1).cast("int")), "tail")
    return roots, plan.select("c", "at", F.col("start").alias("state"), audit.alias("audit"))


_PIECE = "c string, at long, piece int, turns array<struct<edit:string,role:string,text:string>>"
_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def _applied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``c, at, piece, turns``: repaired turns in pieces of about ``PIECE`` bytes; a block's edits come to its task before its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            for (at, c), own in _groups(batches, "at", "c"):
                edits = next(own)
                piece, lot, size = 0, [], 0
                for edit, role, text in edited(((r["role"], r["text"]) for r in own), edits["state"], edits["audit"]):
                    lot.append({"edit": edit, "role": role, "text": text})
                    size += len(text)
                    if size >= PIECE:
                        yield c, at, piece, lot
                        piece, lot, size = piece + 1, [], 0
                if lot:
                    yield c, at, piece, lot

        yield from _sent(told(), ["c", "at", "piece", "turns"], [pa.string(), pa.int64(), pa.int32(), _TURNS], 64)

    none = lambda c, t: F.lit(None).cast(t).alias(c)
    edits = plan.select("at", "c", F.lit(-1).cast("long").alias("pos"), none("role", "string"), none("text", "string"), "state", "audit")
    turns = rows.select(F.shiftright("pos", BLOCK_BITS).alias("at"), "c", "pos", "role", "text", none("state", "int"), none("audit", "string"))
    return edits.union(turns).repartition("at").sortWithinPartitions("at", "c", "pos").mapInArrow(run, schema(_PIECE))


def _hashed(pieces: DataFrame) -> DataFrame:
    """``c, repaired_sha256``: of ``role:text`` lines in order. A conversation's pieces pass through its task one after another; only the hash is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            from itertools import groupby

            rows = ((c, lines) for b in batches for c, lines in zip(b.column("c").to_pylist(), b.column("lines").to_pylist(), strict=True))
            for c, own in groupby(rows, key=lambda r: r[0]):
                sha = hashlib.sha256(next(own)[1])
                for _, lines in own:
                    sha.update(b"\n")
                    sha.update(lines)
                yield c, sha.hexdigest()

        yield from _sent(told(), ["c", "repaired_sha256"], [pa.string(), pa.string()])

    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").cast("binary")
    rows = pieces.select("c", "at", "piece", lines.alias("lines"))
    return rows.repartition("c").sortWithinPartitions("c", "at", "piece").select("c", "lines").mapInArrow(run, schema("c string, repaired_sha256 string"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with conversations and what mends them at least cost, and the mended turns.

    The first table has ``c, gaps, blank, duplicate, illegal, truncated, cost,
    audit`` of each conversation with turns (``c`` is ``=`` and its id, or empty
    for turns without one), the second its mended turns in pieces, in the order
    ``c, at, piece``. Null roles and texts are one space; null turns come first;
    turns of the same number are ordered by role and text; repeated rows are turns
    each; an empty table gives empty ones; other columns aren't read.
    """
    ordered = _ordered(turns)
    rows = ordered.rows
    nodes = Written(_blocks(_faults(rows)))
    roots, plan = _planned(nodes.rows)
    spans = rows.groupBy("c", "turn").agg(F.lit(1)).groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = roots.join(spans, "c").select("c", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return found, _applied(rows, plan)


def digests(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of the first table, from the turns of the second; one without turns counts 0 and repairs to nothing."""
    found, pieces = repair(turns)
    every = pick(conversations, conv_id="long").distinct().withColumn("c", _key(F.col("conv_id")))
    rows = every.join(found, "c", "left").join(_hashed(pieces), "c", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
