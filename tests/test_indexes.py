"""Persisted indexes, the table kept by key, interval joins, chunks of a stream: against exact searches, plain joins and broken writes."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import index as X
from tesserae.operators import nearest, scoring
from tesserae.operators import retrieval as R
from tesserae.operators.intervals import meeting
from tesserae.plans import catalogue  # noqa: F401
from tesserae.plans import catalogue_retrieval as C
from tesserae.sources import schemas as S
from tesserae.sources import tables
from tesserae.sources.store import Conflict, KeyedTable
from tesserae.streaming import incremental as I

DATA = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(df):
    return set(df.inputFiles())


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 40 directions."""
    rnd = np.random.default_rng(4)
    middle = rnd.normal(size=(40, 16))
    x = middle[rnd.integers(40, size=1500)] + rnd.normal(scale=0.4, size=(1500, 16))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(-1, None), (-2, [0.0] * 16)], "id long, vector array<double>").repartition(3).cache()


def recall(got, want):
    key = lambda df: {(r["qid"], r["id"]) for r in df.collect()}
    want = key(want)
    return len(key(got) & want) / len(want)


def test_vector_lists_recall(spark, tmp_path, clustered):
    path = str(tmp_path / "v")
    about = X.build_vector_lists(clustered, path, k=10)
    asked = clustered.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    exact = R.dense_topk(clustered.where("vector is not null"), asked, 10)
    assert about["rows"] == 1501 and about["probes"] < about["lists"] / 4
    assert recall(X.search_vector_lists(spark, path, asked, 10), exact) >= 0.9
    assert rows(X.search_vector_lists(spark, path, asked, 10, about["lists"]).select("qid", "id", "rank")) == rows(exact.select("qid", "id", "rank"))
    # a question reads its own lists' folders and no others
    one = X.search_vector_lists(spark, path, asked.where("qid = 50"), 10)
    pruned = re.search(r"PartitionFilters: \[([^\]]*list#[^\]]*)\]", one._jdf.queryExecution().explainString(one._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert pruned and pruned[1].count(",") <= about["probes"] + 1


def test_vector_lists_over_a_table(spark, tmp_path):
    """Vectors without much structure: more lists are needed, and the index finds out how many."""
    path = str(tmp_path / "v")
    X.build_vector_lists(C.vectors(spark, DATA), path, k=10)
    asked = C.vector_questions(spark, DATA)
    assert recall(X.search_vector_lists(spark, path, asked, 10), R.dense_topk(C.vectors(spark, DATA), asked, 10)) >= 0.9


def test_vector_lists_of_nothing(spark, tmp_path, clustered):
    about = X.build_vector_lists(clustered.where("vector is null"), str(tmp_path / "v"))
    asked = clustered.where("id = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    assert about["rows"] == 0 and X.search_vector_lists(spark, str(tmp_path / "v"), asked).count() == 0


def test_term_blocks(spark, tmp_path):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randrange(60)))) for i in range(3000)] + [(-1, None), (-2, "rare " * 30), (-3, "rare")], "id long, text string").repartition(4, "id").cache()
    asked = spark.createDataFrame([(1, "rare w1"), (2, "w2 w3 w2"), (3, "nowhere"), (4, ""), (5, "Rare")], "qid long, text string")
    path = str(tmp_path / "t")
    assert X.build_term_blocks(docs, path)["documents"] == 3003
    for k in (1, 5, 4000):
        assert rows(X.search_term_blocks(spark, path, asked, k).select("qid", "id", "score", "rank")) == rows(R.bm25_topk(docs, asked, k).select("qid", "id", "score", "rank"))
    assert all("/t/blocks/" in f for f in files(X.search_term_blocks(spark, path, asked, 5)))  # no document is read
    X.build_term_blocks(docs.limit(0), str(tmp_path / "none"))
    assert X.search_term_blocks(spark, str(tmp_path / "none"), asked).count() == 0


def test_bm25_makes_postings_once_and_keeps_none(spark):
    found = R.bm25_topk(C.docs(spark, DATA), C.questions(spark, DATA), 5)
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString() or "ReusedExchange" in found._jdf.queryExecution().toString()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0 or not any("term" in str(v) for v in spark.sparkContext._jsc.getPersistentRDDs().values())


@pytest.mark.parametrize("bound", [200_000, 0])
def test_meeting_spans(spark, bound):
    rnd = random.Random(1)
    spans = lambda n, lengths: [(i, x, x + rnd.choice(lengths)) for i in range(n) for x in [rnd.randrange(-500, 500)]]
    a = [*spans(200, [0, 1, 5, 100, 3000]), (998, None, 3), (999, 5, 2)]
    b = [*spans(100, [0, 2, 7, 50]), (9, None, None), (10, 3, None)]
    left, right = spark.createDataFrame(a, "i long, s int, e int"), spark.createDataFrame(b, "j long, t int, f int")
    found = meeting(left, right, ("s", "e"), ("t", "f"), bound)
    want = sorted((x[0], y[0]) for x in a for y in b if None not in x + y and x[1] <= x[2] and x[1] <= y[2] and y[1] <= x[2])
    assert rows(found.select("i", "j")) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert meeting(left.limit(0), right.limit(0), ("s", "e"), ("t", "f")).count() == 0


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"))
    first = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.lit("x").alias("w"))
    assert not t.exists() and t.create(first, "k", 16) == 1 and t.count() == 500
    with pytest.raises(FileExistsError):
        t.create(first, "k")
    assert t.ensure(first, "k") == 1
    with pytest.raises(ValueError, match="create it again"):
        t.ensure(first, "v")
    before = {f for f, _ in t.manifest()["parts"].values()}
    assert t.upsert(spark.createDataFrame([("5", 9, "y"), ("new", 7, "y"), ("new", 8, "y")], "k string, v int, w string")) == 2
    assert t.count() == t.read().count() == 501 and rows(t.read().where("v > 1")) == [("5", 9, "y"), ("new", 8, "y")]
    assert len(before & {f for f, _ in t.manifest()["parts"].values()}) >= 14  # of 16 buckets two were written anew
    assert t.set_payload(spark.createDataFrame([("5", None), ("6", "z"), ("gone", "z")], "k string, w string"), ["w"]) == 3
    assert rows(t.read().where("w <> 'x'")) == [("5", 9, "y"), ("6", 1, "z"), ("new", 8, "y")] and t.read(1).where("w = 'x'").count() == 500
    t.delete(first.select("k"))
    assert rows(t.read()) == [("new", 8, "y")] and len(t.manifest()["parts"]) == 1 and t.vacuum() >= 3 and t.versions() == [4] and t.count() == 1
    assert t.create(first, "k", 4, again=True) == 5 and t.count() == 500


def test_a_broken_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"))
    t.create(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k", 4)
    failing = spark.createDataFrame([("a", 5)], "k string, v int").withColumn("v", F.when(F.col("v") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(failing)
    assert t.versions() == [1] and rows(t.read()) == [("a", 1), ("b", 2)]
    monkeypatch.setattr(t, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))  # killed after the files, before the manifest
    with pytest.raises(KeyboardInterrupt):
        t.upsert(spark.createDataFrame([("a", 6)], "k string, v int"))
    again = KeyedTable(spark, t.path)
    assert rows(again.read()) == [("a", 1), ("b", 2)] and again.vacuum() >= 1 and rows(again.read()) == [("a", 1), ("b", 2)]
    with pytest.raises(Conflict):
        again._commit(1, again.manifest())


def test_a_page_that_becomes_a_redirect_loses_its_chunks(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    bronze, gold, checkpoint = (str(tmp_path / x) for x in ("b", "g", "c"))
    page = "Lead " + "word " * 60
    tables.append_bronze(S.frame(spark, [(i, f"T{i}", f"T{i}", "t", 1, t, page, t, "x") for i in (1, 2)], S.BRONZE), bronze)
    I.drain(I.index_new(spark, bronze, gold, checkpoint))
    assert {r["page_id"] for r in spark.read.parquet(gold).collect()} == {1, 2}
    later = dt.datetime(2024, 5, 1)
    tables.append_bronze(S.frame(spark, [(1, "T1", "T1", "t", 2, later, "#REDIRECT [[T2]]", later, "x")], S.BRONZE), bronze)
    I.drain(I.index_new(spark, bronze, gold, checkpoint))
    assert {r["page_id"] for r in spark.read.parquet(gold).collect()} == {2}


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Copies, nulls, zeros, other lengths, infinities and numbers that overflow or vanish, with spans of all kinds."""
    rng = np.random.default_rng(5)
    x = [[float(v) for v in rng.integers(-3, 4, 6)] for _ in range(60)] + [[1.0, 2.0, 3.0, 0.0, 0.0, 1.0]] * 40
    x += [None, None, [0.0] * 6, [1.0, 2.0], [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [1e200] * 6, [1e-200] * 6, [-1e-170, 1.0, 0.0, 0.0, 0.0, 0.0]]
    spans = [(None if i % 9 == 0 else i % 13, i % 13 + i % 5 - (i % 11 == 0)) for i in range(len(x))]
    return spark.createDataFrame([(997 * i % 1009, v, *s) for i, (v, s) in enumerate(zip(x, spans))], "id long, vector array<double>, year_start int, year_end int").repartition(3).cache()


@pytest.mark.parametrize("k", [1, 7, 500])
def test_blocks_are_the_expression(spark, odd_vectors, k, monkeypatch):
    monkeypatch.setattr(nearest, "GROUP", 30)  # several groups of questions
    asked = odd_vectors.select(F.col("id").alias("qid"), F.col("vector").alias("query"), F.col("year_start").alias("start"), F.col("year_end").alias("end"))
    told = lambda df: sorted((tuple(str(v) for v in r) for r in df.select("qid", "id", "score", "rank").collect()))
    pairs = odd_vectors.select("id", "vector")
    assert told(R.dense_topk(pairs, asked.select("qid", "query"), k)) == told(R.dense_topk(pairs, asked.select("qid", "query"), k, where=F.lit(True)))
    meet = (F.col("year_start") <= F.col("end")) & (F.col("year_end") >= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("year_start") <= F.col("year_end"))
    assert told(R.within_topk(odd_vectors, asked, k)) == told(R.dense_topk(odd_vectors, asked, k, where=meet))


def test_blocks_round_as_spark(spark):
    x = [0.1234565, -0.1234565, 0.0000005, 0.9999995, 1.0, 0.3333333333, 0.12345649999999999, 2.5e-7, -0.0]
    df = spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 6))
    assert [r[0] for r in df.collect()] == nearest.rounded(np.array(x)).tolist()


def test_dense_plans_have_no_product_of_rows(spark):
    for name in ("q_dense_topk", "q_dense_within", "q_rrf_hybrid", "q_search_dense"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "list_cosine" not in plan and "MapInArrow" in plan, name


def test_lists_are_searched_by_blocks(spark, tmp_path, clustered):
    """Some lists of each question, against the same told row by row; no row of a question and a list is exchanged."""
    path = str(tmp_path / "v")
    about = X.build_vector_lists(clustered, path, k=10, lists=20)
    asked = clustered.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])
    pairs = spark.createDataFrame([(r["qid"], int(i)) for r in asked.collect() for i in nearest.nearest_lists(np.array([r["query"]]), centroids, 3)[0]], "qid long, list int")
    stored = spark.read.parquet(f"{path}/lists").join(pairs, "list").withColumnRenamed("qid", "of")
    found = X.search_vector_lists(spark, path, asked, 10, 3)
    assert about["lists"] == 20 and rows(found) == rows(R.dense_topk(stored, asked, 10, where=F.col("of") == F.col("qid")))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_term_blocks_are_made_where_documents_are_read(spark, tmp_path):
    docs = spark.range(0, 900, 1, 3).select("id", F.concat_ws(" ", F.lit("a b"), F.expr("repeat('c ', cast(id % 5 as int))"), F.concat(F.lit("d"), F.col("id") % 7)).alias("text"))
    X.build_term_blocks(docs, str(tmp_path / "t"))
    blocks = spark.read.parquet(str(tmp_path / "t" / "blocks"))
    assert not (tmp_path / "t" / "tokens").exists()  # the corpus isn't written again
    assert blocks.groupBy("range").count().count() == 9 and blocks.agg(F.max(F.size("postings"))).first()[0] == 128
    assert {r["term"]: r["n"] for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}["c"] == 720


def test_postings_are_counted_where_documents_are_read(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TOKENS", 7)
    texts = [(1, "a b a"), (2, "b"), (3, None), (4, ""), (5, "Ä ä c, c"), (None, "a a"), (6, "long " * 40 + "a")]
    told = lambda d: sorted((tuple(r) for r in R.postings(d).select("term", "id", "length", "tf").collect()), key=str)
    once = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    assert told(once) == sorted([("a", 1, 3, 2), ("b", 1, 3, 1), ("b", 2, 1, 1), ("ä", 5, 4, 2), ("c", 5, 4, 2), ("a", None, 2, 2), ("long", 6, 41, 40), ("a", 6, 41, 1)], key=str)
    weighted, _, stats = R.bm25_index(once)
    assert "Exchange" not in weighted._jdf.queryExecution().executedPlan().toString() and stats == (7, 51 / 7)
    again = once.union(spark.createDataFrame([(1, "a c d"), (1, "a"), (None, "b a")], once.schema))  # ids that repeat, and null ones
    want = again.select("id", F.size(text.tokenize(F.col("text"))).alias("length"), F.explode(text.tokenize(F.col("text"))).alias("term")).groupBy("term", "id", "length").count()
    assert told(again) == sorted((tuple(r) for r in want.select("term", "id", "length", "count").collect()), key=str)
    assert told(once.limit(0)) == []


def test_bm25_cuts_each_text_once_and_in_pieces(spark, tmp_path, monkeypatch):
    texts = [(1, "a b a"), (2, "b"), (3, None), (4, ""), (5, "Ä ä c, c"), (None, "a a"), (6, "long " * 40 + "a"), (1, "a c d"), (1, "b a b"), (7, "x y")]
    asked = spark.createDataFrame([(1, "a b"), (2, "C ä a a"), (3, "?"), (4, "none"), (None, "long a")], "qid long, text string")
    spark.createDataFrame(texts, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    plain = spark.read.parquet(str(tmp_path / "d"))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = scoring.counted

    def bounded(tokens, terms):
        assert len(tokens.flatten()) < 7 + 41  # less than TOKENS and a row more
        return counted(tokens, terms)

    told = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    with monkeypatch.context() as m:
        m.setattr(R, "few", lambda *_: False)  # the joined form
        want = told(R.bm25_topk(plain, asked, 2))
    monkeypatch.setattr(scoring, "TOKENS", 7)
    monkeypatch.setattr(scoring, "counted", bounded)
    docs = plain.mapInArrow(seen, "id long, text string")
    assert told(R.bm25_topk(docs, asked, 2)) == want
    assert read.value == 2 * len(texts)  # their number, then the texts
