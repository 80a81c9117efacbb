"""Runs: records of questions answered in one plan, their folders, and the index that they search."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesserae.operators import corpus, runs
from tesserae.operators import evaluation as E
from tesserae.sources import schemas as S
from tesserae.sources import seams

QUESTIONS = [("a", "easy", "Where?", ["1:0"], ["Rome"], [], "golden", ""), ("b", "unanswerable", "Who?", [], [], [], "golden", ""), ("c", "easy", "When?", ["9:9"], [], [], "golden", "")]
RANKED = [("a", i, f"1:0:{i}", "1:0" if i == 2 else f"2:{i}", 1, f"T{i}", f"Rome fell in year {i}. More.", 0.123456) for i in range(1, 8)] + [("c", 1, "3:1:0", "3:1", 3, 'Q "x"', "boom", 0.5)]


@pytest.fixture(scope="module")
def records(spark):
    class Brittle:  # defined here, so that workers get it by value
        def complete(self, messages):
            if "boom" in messages[-1]["content"]:
                raise TimeoutError("too slow")
            return seams.ExtractiveGenerator().complete(messages)

    questions = S.frame(spark, QUESTIONS, S.QUESTION)
    ranked = spark.createDataFrame(RANKED, "qid string, rank int, id string, doc_id string, page_id long, title string, text string, score double")
    return runs.run_all(questions, ranked, Brittle(), "Answer.", "m").cache()


def test_run_all(spark, records):
    rows = {r["question_id"]: r for r in records.collect()}
    assert records.dtypes == S.frame(spark, [], S.RECORD).dtypes
    a, b, c = (rows[x] for x in "abc")
    assert a["answer"] == "Rome fell in year 1 [1]." and a["sources_sent"] == 5 and [x["doc_id"] for x in a["citations"]] == ["2:1"]
    assert [r["rank"] for r in a["retrieved"]] == list(range(1, 8)) and a["retrieved"][0]["score"] == 0.1235
    assert [r["text"] is not None for r in a["retrieved"]] == [True] * 5 + [False] * 2
    assert b["answer"] == "Not in the sources." and b["retrieved"] == [] and b["sources_sent"] == 0 and b["error"] is None
    assert c["answer"] == "" and c["error"] == "TimeoutError: too slow"  # recorded, and the others went on
    blocks = {r["question_id"]: r["b"] for r in records.select("question_id", runs.sources_block(F.col("retrieved"), F.col("sources_sent")).alias("b")).collect()}
    assert blocks["a"].count("<source ") == 5 and blocks["c"] == "<source id=\"1\" title=\"Q 'x'\">\nboom\n</source>" and blocks["b"] == ""
    one = E.summarise(records, ((),)).first()
    assert (one["questions"], one["errors"], one["mrr"], one["refusals"]) == (3, 1, 0.25, 1)


def test_run_folders(spark, records, tmp_path):
    root = str(tmp_path / "runs")
    assert runs.list_runs(spark, root) == []
    for minute in (1, 2):
        name = runs.run_id(dt.datetime(2024, 5, 1, 12, minute, tzinfo=dt.UTC))
        meta = spark.createDataFrame([(name, 20)], "run_id string, k int")
        runs.write_run(root, meta, records, "two\nlines")
    with pytest.raises(FileExistsError):
        runs.write_run(root, meta, records)
    (tmp_path / "runs" / "unfinished" / "records").mkdir(parents=True)
    assert runs.list_runs(spark, root) == ["2024-05-01T1202Z", "2024-05-01T1201Z"]
    got, again = runs.read_run(spark, root, "2024-05-01T1201Z")
    assert got.first()["k"] == 20 and got.first()["note"] is None
    assert sorted(r["answer"] for r in again.collect()) == sorted(r["answer"] for r in records.collect())
    with pytest.raises(LookupError):
        runs.read_run(spark, root, "../runs/2024-05-01T1201Z")


def test_outcomes_and_cache(spark):
    rows = spark.createDataFrame([(None, ""), (" SKIP: nothing", ""), ("x", "Which treaty ended the long war in the north?"), ("x", "Short?")], "reply string, q string")
    said = rows.select(runs.generation_outcome(F.col("reply"), F.col("q"), F.lit("some other source")).alias("o")).collect()
    assert [r["o"] for r in said] == ["failed", "skipped", "accepted", "rejected"]
    hit = spark.createDataFrame([("new?", "old?", "It was [1].", 7, True)], "asked string, question string, answer string, prompt_tokens long, revised boolean")
    got = runs.from_cache(hit).first()
    assert (got["question"], got["cached_from"], got["answer"], got["prompt_tokens"], got["revised"]) == ("new?", "old?", "It was [1].", 0, False)


def test_index_build(spark):
    t = dt.datetime(2024, 1, 1)
    texts = ["rome rome berlin", "one two three four five", ""]
    gold = S.frame(spark, [(f"1:0:{i}", "1:0", 1, i, "T", "", x, ["t"], 1, t, "x", None, None, "") for i, x in enumerate(texts)], S.GOLD)
    whole = corpus.build_index(gold, seams.HashingEmbedder(8)).cache()
    first = whole.where("chunk_id = '1:0:0'").first()
    average = 8 / 3
    want = {1: 1 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / average)), 2: 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / average))}
    assert sorted(x["weight"] for x in first["sparse"]) == pytest.approx(sorted(want.values())) and len(first["vector"]) == 8
    rest = corpus.build_index(gold, seams.HashingEmbedder(8), whole.where("chunk_id <> '1:0:0'").select("chunk_id")).collect()
    assert rest == [first]  # a resumed build gives what the whole one gave
    with pytest.raises(ValueError, match="256"):
        corpus.build_index(gold, seams.HashingEmbedder(8), batch=257)
