"""Calls under a ceiling, verified answers, a watched run, newest runs, a wiki as a data source, counts while writing."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from tesserae.operators import answers, corpus, jobs, runs, spending
from tesserae.operators import evaluation as E
from tesserae.sources import revisions, seams, tables
from tesserae.sources import schemas as S

MODEL = "gpt-4o-mini"


def asked(spark, texts, parts=3):
    rows = spark.createDataFrame(list(enumerate(texts)), "qid long, text string").repartition(parts)
    return rows.select("qid", F.lit(1).alias("sources"), answers.messages(F.coalesce("text", F.lit("")), "").alias("messages"))


def test_ceiling(spark):
    texts = [f"question {i} " * (1 + i % 5) for i in range(300)]
    free = {r["qid"]: r for r in spending.metered(asked(spark, texts), seams.EchoGenerator(), MODEL).collect()}
    whole = sum(r["dollars"] for r in free.values())
    assert all(free[i]["answer"] == texts[i].strip() and free[i]["prompt_tokens"] == len(texts[i]) for i in free) and whole > 0
    most = 120 * 0.6e-6
    for share in (0.3, 0.9, 3.0):
        meter = spending.Meter(spark)
        ceiling = whole * share + most
        rows = spending.metered(asked(spark, texts), seams.EchoGenerator(), MODEL, ceiling + 1.0, 1.0, meter=meter, max_output=120).collect()
        called = [r for r in rows if not (r["error"] or "").startswith("CeilingExceeded")]
        spent = sum(r["dollars"] for r in rows)
        assert len(rows) == 300 and meter.calls == len(called) and spent <= ceiling
        assert all(r["dollars"] == free[r["qid"]]["dollars"] for r in called) and all(r["dollars"] == 0 and r["answer"] == "" for r in rows if r not in called)
        assert len(called) == 300 if share > 1 else 0 < len(called) < 300
        assert share > 1 or spent > ceiling - 2 * most  # what is left unspent is less than a call and a half may cost
    none = spending.metered(asked(spark, texts), seams.EchoGenerator(), MODEL, 1.0, 1.0)
    assert spending.spent_by(none).first().asDict() == {"calls": 0, "refused": 300, "failed": 0, "dollars": 0.0}


def test_awkward_calls(spark):
    class Brittle:
        def stream(self, messages):
            said = messages[-1]["content"]
            yield "\n "
            if said == "early":
                raise TimeoutError("slow")
            if said == "late":
                yield seams.Usage(10, 3)
                yield "half an ans"
                raise TimeoutError("slow")
            yield f"  {said}"

    texts = ["early", "late", "", None, "good", "good"]
    rows = spending.metered(asked(spark, texts), Brittle(), MODEL, 1.0)
    got = {r["qid"]: r for r in rows.collect()}
    assert [got[i]["error"] for i in range(6)] == ["TimeoutError: slow"] * 2 + ["EmptyCompletion: the reply is empty"] * 2 + [None] * 2
    assert got[4]["answer"] == "good" and got[4]["first_token_ms"] >= 0 and got[0]["answer"] == got[1]["answer"] == ""
    assert got[1]["dollars"] == pytest.approx((10 * 0.15 + 3 * 0.6) / 1e6) and got[0]["dollars"] > 800 * 0.6e-6  # unknown usage costs the most that it may
    assert spending.spent_by(rows).first()["failed"] == 4 and spending.ledger(rows, "eval").count() == 6
    empty = spending.metered(asked(spark, ["x"]).limit(0), Brittle(), MODEL, 1.0)
    assert empty.count() == 0 and {"answer", "dollars"} <= set(empty.columns)


def test_verified(spark):
    class Checker:
        def complete(self, messages):
            draft = messages[-1]["content"].split("# DRAFT")[1].strip()
            if "boom" in draft:
                raise TimeoutError("slow")
            return f"<answer>{draft.replace('1390', '1391')}</answer>"

    texts = ["It fell in 1390.", "It was salt.", "boom", "Not in the sources."]
    rows = spending.verified(asked(spark, texts), seams.EchoGenerator(), MODEL, Checker())
    got = {r["qid"]: r for r in rows.collect()}
    assert [got[i]["answer"] for i in range(4)] == ["It fell in 1391.", "It was salt.", "boom", "Not in the sources."]
    assert [got[i]["revised"] for i in range(4)] == [True, False, False, False] and got[0]["draft"] == texts[0] and got[3]["draft"] == ""
    assert got[2]["verifier_error"] == "TimeoutError: slow" and got[0]["error"] is None
    one = spending.verified(asked(spark, texts[:1]), seams.EchoGenerator(), MODEL, Checker(), ceiling=4.9e-4)  # enough for a draft, not for its check
    assert (r := one.first())["answer"] == texts[0] and r["verifier_error"].startswith("CeilingExceeded") and not r["revised"]


def test_watched_and_cancelled(spark, tmp_path):
    class Slow:
        def complete(self, messages):
            time.sleep(0.2 if messages[-1]["content"] == "0" else 30)
            return "said"

    job, meter = jobs.Job(spark), spending.Meter(spark)

    def work(job):
        job.watch(meter)
        job.step(0, "answers")
        spending.metered(asked(spark, [str(i) for i in range(4)], 4).repartitionByRange(4, "qid"), Slow(), MODEL, meter=meter).count()
        job.step(1, "folder")
        (tmp_path / "run").mkdir()
        return "done"

    assert job.start("a", 2, work)
    end = time.time() + 60
    while job.status().calls < 1 and time.time() < end:
        time.sleep(0.1)
    assert job.status().calls == 1 and job.cancel()
    assert job.wait(20).state == jobs.CANCELLED and not (tmp_path / "run").exists()


def test_newest_run_of_a_model(spark, tmp_path):
    root = str(tmp_path / "runs")
    assert runs.last_run_with(spark, root, "m") is None
    for name, models in (("2024-01-01T0000Z", "mm"), ("2024-01-02T0000Z", "mn"), ("2024-01-03T0000Z", "nm")):
        rows = [(f"q{i}", m, 100 + i, 10) for i, m in enumerate(models)]
        runs.write_run(root, spark.createDataFrame([(name,)], "run_id string"), tables.with_defaults(full(spark, rows)))
    assert runs.last_run_with(spark, root, "m") == "2024-01-02T0000Z" and runs.last_run_with(spark, root, "n") == "2024-01-03T0000Z" and runs.last_run_with(spark, root, "o") is None
    tokens = E.tokens_per_question(runs.read_run(spark, root, "2024-01-02T0000Z")[1])
    cost = spending.estimate(tokens, MODEL, 10, True)
    assert cost["dollars"] == round(10 * (100 * 0.15 + 10 * 0.6) / 1e6, 4) and "newest run" in cost["basis"]
    text = "".join(p.read_text() for p in (tmp_path / "runs" / "2024-01-01T0000Z" / "transcript").glob("part-*"))
    assert text.count("## q") == 2 and "*   1" in text and "[1] Rome" in text and "draft" not in text


def full(spark, rows):
    found = F.expr("array(named_struct('rank', 1, 'chunk_id', 'c', 'doc_id', '1:0', 'page_id', 1L, 'source', 'Rome', 'score', 0.5D, 'text', 't', 'rerank_score', null, 'sparse_score', null))")
    own = {"retrieved": found, "expected_doc_ids": F.array(F.lit("1:0")), "question": F.lit("Where?"), "standalone": F.lit("Where?"), "answer": F.lit("There [1]."), "citations": F.expr("array(named_struct('number', 1, 'doc_id', '1:0', 'source', 'Rome'))")}
    base = spark.createDataFrame(rows, "question_id string, generation_model string, prompt_tokens long, completion_tokens long").withColumns(own)
    fields = S.frame(spark, [], S.RECORD).schema.fields
    return base.select(*((F.col(f.name) if f.name in base.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def test_runs_before_awkward(spark):
    ddl = "generation_model string, at timestamp"
    asked = spark.sql("select * from values ('m', timestamp'2024-01-05 10:00:00', 1), ('m', timestamp'2024-01-05 09:00:00', 2), (null, timestamp'2024-01-09 00:00:00', 3), ('m', null, 4), ('x', timestamp'2024-01-05 10:00:00', 5), ('m', timestamp'2024-01-05 10:00:00', 1) as t(generation_model, at, n)")
    got = spark.sql("select * from values ('r1', 'm', timestamp'2024-01-03 10:00:00'), ('r0', 'm', timestamp'2024-01-03 10:00:00'), ('r2', 'm', timestamp'2024-01-05 09:00:00'), ('r3', null, timestamp'2024-01-01 00:00:00'), ('r4', 'm', null) as t(run_id, generation_model, at)")
    rows = sorted((r["n"], r["run_id"]) for r in runs.runs_before(asked, got).fillna("-", ["run_id"]).collect())
    assert rows == [(1, "r2"), (1, "r2"), (2, "r1"), (3, "r3"), (4, "-"), (5, "-")]
    assert runs.runs_before(asked, got.limit(0)).where("run_id is not null").isEmpty() and spark.createDataFrame([], ddl).isEmpty()


@pytest.fixture
def wiki():
    """A wiki on this machine: every third title is unknown, one is a redirect, and its first reply is "too many"."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            titles = asked["titles"][0].split("|")
            seen.append(titles)
            if len(seen) == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            lead = [{"from": "T 1", "to": "T 2"}] if "T 1" in titles else []
            page = lambda t: {"title": t, "pageid": int(t.split()[1]), "revisions": [{"revid": 7, "timestamp": "2024-05-01T10:00:00Z", "slots": {"main": {"content": f"text of {t}"}}}]}
            pages = [page(t) for t in {"T 2" if t == "T 1" else t for t in titles} if int(t.split()[1]) % 3]
            body = json.dumps({"query": {"redirects": lead, "pages": pages}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/api.php", seen
    server.shutdown()


def test_wiki_data_source(spark, tmp_path, wiki):
    api, seen = wiki
    registry = [("towns", f"T {i}", 2) for i in range(1, 131)] + [("ports", "T 4", 2), ("ports", 'T 5 "x", y', 2)]
    tables.write_csv(spark.createDataFrame(registry, S.REGISTRY).coalesce(2), str(tmp_path / "registry"))
    revisions.register(spark)
    rows = spark.read.format("revisions").options(api=api, registry=str(tmp_path / "registry"), titlesPerTask=60, batch=20).load()
    assert rows.dtypes == S.frame(spark, [], S.BRONZE).dtypes and rows.rdd.getNumPartitions() >= 3
    got = {(r["theme"], r["requested_title"]): r for r in rows.collect()}
    assert set(got) == {(t, n) for t, n, _ in registry} and max(map(len, seen)) <= 20
    assert all((r["page_id"] is None) == (int(n.split()[1]) % 3 == 0) for (_, n), r in got.items() if n != "T 1")
    assert got["towns", "T 1"]["title"] == "T 2" and got["ports", "T 4"]["wikitext"] == "text of T 4" and got["towns", "T 4"]["revision_timestamp"].year == 2024
    tables.write_csv(spark.createDataFrame([], S.REGISTRY), str(tmp_path / "none"))
    assert spark.read.format("revisions").options(api=api, registry=str(tmp_path / "none")).load().count() == 0
    with pytest.raises(Exception, match="missing options"):
        spark.read.format("revisions").options(api=api).load().count()


def test_counts_while_writing(spark, tmp_path):
    pages = [(i, f"Page {i}" if i % 4 else "List of pages", f"Page {i}", "t", i, None, "" if i % 5 == 0 else f"Lead of page {i}. " * 20 + "\n== Past ==\n" + "It was long ago. " * 20, None, "cc") for i in range(1, 21)]
    bronze = S.frame(spark, pages, S.BRONZE).repartition(3)
    at = str(tmp_path / "silver")
    got = corpus.write_silver(bronze, at)
    silver = tables.read_documents(spark, at)
    assert got["rows"] == silver.count() > 0 and got["articles"] + got["skipped"] == 20 and got["skipped"] > 0
    assert silver.select("page_id").distinct().count() <= got["articles"]
    gold = corpus.build_gold(silver)
    found = corpus.write_index(gold, seams.HashingEmbedder(8), str(tmp_path / "index"))
    again = spark.read.parquet(str(tmp_path / "index"))
    assert found == {"rows": again.count(), "dated": again.where("year_start is not null").count(), "terms": again.agg(F.sum(F.size("sparse"))).first()[0]}
    assert corpus.counted_write(again.limit(0), str(tmp_path / "none"))["rows"] == 0


def test_seeds_and_probes(spark):
    seeds = spark.createDataFrame([("t", "A"), ("t", "B"), ("t", "B")], "theme string, seed string")
    pages = spark.createDataFrame([("t", "A", "[[X]] [[Y]]"), ("t", "B", "[[X]]")], "theme string, seed string, wikitext string")
    assert {r["title"] for r in corpus.curate_pages(pages, seeds).collect()} == {"X", "A", "B"}
    with pytest.raises(ValueError, match="t: B"):
        corpus.curate_pages(pages.withColumn("wikitext", F.when(F.col("seed") != "B", F.col("wikitext"))), seeds)
    cases = [("a", True, True), ("a", False, False), ("b", True, True), ("c", True, True), ("c", False, None)]
    got = {r["probe"]: r for r in E.probe_table(spark.createDataFrame(cases, "probe string, expect boolean, got boolean")).collect()}
    assert [got[p]["passed"] for p in "abc"] == [True, False, False] and not got["b"]["complete"] and got["c"]["unread"] == 1
    good = {"id": "a", "kind": "easy", "text": "tab\there\nand \"so\" \\", "expected": ["1:0"]}
    assert "\\u0009" in tables.toml_questions([good])
    for bad, why in (([good, good], "unique"), ([good | {"other": "x"}], "unknown"), ([{"id": "a", "kind": "easy"}], "missing")):
        with pytest.raises(ValueError, match=why):
            tables.toml_questions(bad)
