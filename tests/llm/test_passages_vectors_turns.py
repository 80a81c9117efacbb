"""Recurring passages, whitened vectors and repaired conversations against brute force and awkward rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tesserae.llm import conversations, phrase_dedup, queries, whitening

DATA = "/root/testdata/sf0.001"
NODE = "x string, h long, d long, c string, key string, shard int, text_hash long"


def removed(rows):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(3)
    words = lambda n, of=10**6: [f"v{rnd.randrange(of)}" for _ in range(n)]
    common, hot = words(35), words(90)
    rows = [(i, " ".join(words(rnd.randrange(40)) + hot[rnd.randrange(30) : 90 - rnd.randrange(30)] + words(rnd.randrange(60)))) for i in range(60)]
    rows += [(100 + i, "\t\n".join(words(9) + common[: 34 + i % 2] + words(9))) for i in range(6)]  # one word short, or whole
    rows += [(200, " ".join(["same"] * 40)), (201, " ".join(["same"] * 34)), (202, " ".join(words(300, 2))), (203, " ".join(words(50, 3) * 3))]
    rows += [(300, None), (301, ""), (302, " \n\x1c  "), (None, " ".join(common)), (303, " ".join(hot)), (303, " ".join(hot)), (304, " ".join(words(20_000) + common)), (305, "é ü " * 36)]
    return rows


@pytest.mark.parametrize("few, shard", [(phrase_dedup.FEW, phrase_dedup.SHARD), (phrase_dedup.FEW, 3_000), (5, 3_000)])
def test_phrase_dedup(spark, passages, few, shard):
    df = spark.createDataFrame([(t, i, *[None] * 7) for i, t in passages], f"text string, doc_id long, {NODE}")
    rows = phrase_dedup.remove(df, few, shard)
    assert sorted((tuple(r)[:4] for r in rows.collect()), key=str) == removed(passages)
    kept = {r["doc_id"]: r["text"] for r in phrase_dedup.kept_texts(df, few, shard).collect()}
    for r in rows.collect():
        if r["doc_id"] not in (None, 303):
            assert hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest() == r["kept_sha256"]
            assert sum(s["hi"] - s["lo"] for s in r["spans"]) == r["n_removed"]


def test_phrase_dedup_in_small_lots(spark, passages, monkeypatch):
    """However texts are put together and words hashed, the hashes are the same."""
    texts = [t.encode() for _, t in passages if t]
    whole = phrase_dedup.Words(texts)
    assert whole.lengths.tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(phrase_dedup, "STEP", 9)
    assert np.array_equal(whole.hash, np.concatenate([phrase_dedup.Words([t]).hash for t in texts]))
    spelled = {w for t in texts for w in t.split()}
    assert len(np.unique(whole.hash)) == len(spelled) and len(phrase_dedup.Words([]).hash) == 0


def test_phrase_dedup_of_nothing(spark):
    assert phrase_dedup.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_phrase_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = con.execute(queries.oracle_sql()["op11_phrase_dedup"]).fetchall()
    assert sorted(map(tuple, queries.op11_phrase_dedup(spark, DATA).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == sorted(theirs)


def whitened(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64).astype(object) + 1_000_000
    n = len(x)
    y = n * x - x.sum(axis=0)
    exact = y.T @ y
    e, q = np.linalg.eigh(np.array([[int(c) / n**3 for c in r] for r in exact]))
    e, q = e[::-1], q[:, ::-1]
    return (y**2).sum(axis=1).tolist(), (y / n).astype(float) @ q / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def test_whitening(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = sorted(map(tuple, queries.op12_whitening(spark, DATA).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()))
    vectors = [r["embedding"] for r in df.orderBy("vec_id").collect()]
    far, z, share = whitened(vectors)
    n = len(vectors)
    assert len(rows) == 32 * n and {r[2] for r in rows} == {n} and max(r[6] for r in rows) <= 1e-9
    assert [r[3] for r in rows[::32]] == far
    got = np.array([r[4] for r in rows]).reshape(n, 32)
    assert np.abs(got * np.sign((got * z[:, :32]).sum(axis=0)) - z[:, :32]).max() < 1e-9
    assert np.allclose([r[5] for r in rows[:32]], share[:32], rtol=1e-6)


def test_whitening_awkward(spark):
    nan, inf = float("nan"), float("inf")
    sound = [[1.0, 2.0, 0.5], [0.25, -1.0, 3.0], [1.0, 2.0, 0.5], [-7.5, 0.0, 1e6], [3.0, 1.0, -1e6]]
    odd = [None, [], [1.0, None, 2.0], [nan, 1.0, 2.0], [inf, 1.0, 2.0], [2.0**40, 0.0, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    df = spark.createDataFrame([(i if i else None, v, 1, 2, 3) for i, v in enumerate(sound + odd)], "vec_id long, embedding array<double>, n int, dim int, component int")
    rows = whitening.whiten(df).collect()
    far, z, share = whitened(sound)
    assert sorted({r["vec_id"] or 0 for r in rows}) == [0, 1, 2, 3, 4] and {r["component"] for r in rows} == {1, 2, 3}
    for r in rows:
        i = r["vec_id"] or 0
        assert int(r["deviation"]) == far[i] and r["n"] == 5 and abs(r["explained"] - share[r["component"] - 1]) <= 1e-4 * share[r["component"] - 1]
        assert r["identity_error"] < 1e-4 and abs(abs(r["whitened"]) - abs(z[i, r["component"] - 1])) < 1e-4
    assert whitening.whiten(df.where("vec_id < 0")).count() == 0  # empty
    assert whitening.whiten(df.where("vec_id is null or vec_id = 2")).count() == 0  # equal vectors alone


def test_exact_products():
    rnd = random.Random(1)
    y = np.array([[rnd.randrange(-(2**80), 2**80) for _ in range(3)] for _ in range(50)], object)
    assert (whitening.products(y) == y.T @ y).all() and whitening.squares(y) == (y**2).sum(axis=1).tolist()
    small = np.array([[2**40 - 1, -(2**39)], [0, 0], [-1, 1]], np.int64)
    assert (whitening.products(small) == small.astype(object).T @ small.astype(object)).all()
    assert sum(p.astype(object) << (20 * i) for i, p in enumerate(whitening.limbs(y))).tolist() == y.tolist()
    x = np.array([[2**45, 1], [3, -(2**45)]], np.int64)
    assert (whitening.centred(x, 10**9, [5, 7]) == x.astype(object) * 10**9 - np.array([5, 7], object)).all()


def cheapest(rows):
    """The edits of least cost, then least audit, by search over what is done and said last."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        for r in ("user", "assistant"):
            if r[0] in follows[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, r[0], (*out, (r, ""))))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            if role and role[0] in follows[last]:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
            for r in ("user", "assistant"):
                if r[0] in follows[last]:
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, r[0], (*out, (r, text))))


def mended(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        own, r, x = turns[c], " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, own in turns.items():
        own.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, judged = set(), []
        for _, r, x in own:
            bare = x.rstrip(" \t\n\x0b\f\r")
            judged.append((r, x, "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((r, x))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))  # noqa: B905
        cost, audit, fixed = cheapest(judged)
        faults = [sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()))
    return sorted(out, key=str)


def test_conversations(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    assert sorted((tuple(r) for r in queries.op13_conversation_repair(spark, DATA).collect()), key=str) == mended(map(tuple, rows))


@pytest.fixture(scope="module")
def muddle():
    rnd = random.Random(5)
    roles, ends = [None, "user", "assistant", "system", "", "tool", "User"], ["", "a.", "b", "c!", "d? ", "e.\n", "  ", " ", "é\n?\r"]
    rows = [(rnd.choice([None, 1, 2, 3, 3, 3]), rnd.choice([None, *range(40)]), rnd.choice(roles), rnd.choice(ends) + rnd.choice(["", f"{rnd.random()}."]) if rnd.random() < 0.8 else None) for _ in range(150)]
    rows += [(8, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(120)] + [(9, 5, "user", "x" * 60_000 + ".")] * 3
    return rows + [(20 + i, None, r, "so.") for i, r in enumerate(("system", "user", "assistant", None))]


@pytest.mark.parametrize("bits, fan", [(10, 64), (2, 2), (0, 3)])
def test_conversations_in_blocks(spark, muddle, bits, fan, monkeypatch):
    """However turns are cut to blocks and blocks joined, the edits are the cheapest."""
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    monkeypatch.setattr(conversations, "FAN", fan)
    monkeypatch.setattr(conversations, "PIECE", 50)
    df = spark.createDataFrame([(r, t, c, x, 1, 2, 3) for c, t, r, x in muddle], "role string, turn long, conv_id long, text string, at int, c int, pos int")
    assert sorted((tuple(r) for r in conversations.digests(df, conversations.damaged(df)).collect()), key=str) == mended(muddle)


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digests(df, df).count() == 0
    none = spark.createDataFrame([(1, 1, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert tuple(conversations.digests(none, df).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_products_of_turns_associate():
    rnd = random.Random(2)
    turns = [conversations.turn(rnd.choice("sua?"), rnd.randrange(4)) for _ in range(40)]
    left = turns[0]
    for t in turns[1:]:
        left = conversations.product(left, t)
    level = turns
    while len(level) > 1:
        level = [conversations.product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert left == level[0]
