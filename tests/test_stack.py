"""The wiring of a run, the job that runs it, the HTTP surface, the wiki source, and the command line from pages to a gated run."""

import http.client
import json
import threading

import pytest
from pyspark.sql import functions as F

from tesserae import cli, service
from tesserae.operators import corpus, jobs, runs
from tesserae.plans import stack
from tesserae.settings import Settings
from tesserae.sources import schemas as S
from tesserae.sources import seams

PAGES = [("Alba", "The walls of Alba were raised in 1204. They fell again in 1390 after a long siege by sea."), ("Brix", "Brix traded salt and wool. Its harbour silted up in the 1700s and the town grew poor."), ("Corvo", "Corvo had three mills on one river. A flood of 1862 left one of them standing.")]
SETTINGS = Settings(k=2, max_per_document=1, day_ceiling=1.0, generation_model="m")


@pytest.fixture(scope="module")
def index(spark):
    names = [c.split()[0] for c in S.GOLD.replace("array<string>", "x").split(", ")]
    rows = [dict(chunk_id=f"{i}:0:0", doc_id=f"{i}:0", page_id=i, position=0, title=t, heading="", text=x, themes=["towns"], revision_id=1, license="", year_start=1204 if t == "Alba" else None, year_end=1390 if t == "Alba" else None, year_source="") for i, (t, x) in enumerate(PAGES, 1)]
    gold = S.frame(spark, [tuple(r.get(n) for n in names) for r in rows], S.GOLD)
    return corpus.build_index(gold, seams.HashingEmbedder()).cache()


@pytest.fixture(scope="module")
def asked(spark):
    turns = [("What of Alba?", "It had walls [1].")]
    rows = [("a", "easy", "What did Brix trade, salt and wool?", ["2:0"], ["salt"], [], "golden", ""), ("b", "easy", "the walls of Alba in 1204", ["1:0"], [], turns, "conversation", ""), ("c", "unanswerable", " ", [], [], [], "golden", "")]
    return S.frame(spark, rows, S.QUESTION)


@pytest.fixture(scope="module")
def app(spark, index, asked, tmp_path_factory):
    return service.App(spark, lambda: index, lambda: asked, seams.HashingEmbedder(), seams.ExtractiveGenerator(), str(tmp_path_factory.mktemp("runs")), SETTINGS, ("m", "n"))


def test_config_tells_what_changed(spark):
    config = stack.RunConfig.of(SETTINGS, hybrid=True)
    meta = stack.meta(spark, config, SETTINGS, run_id="r", points=3)
    row = meta.first()
    assert (row["hybrid"], row["temporal"], row["k"], row["generation_model"], row["note"]) == ("bm25+rrf(k=60)", "", 2, "m", None)
    assert stack.changed_fields(meta, config, SETTINGS) == stack.changed_fields(None, config) == frozenset()
    assert stack.changed_fields(meta, stack.RunConfig.of(SETTINGS, k=9), SETTINGS) == {"hybrid", "k"}
    with pytest.raises(ValueError):
        stack.meta(spark, config, SETTINGS, colour="red")
    with pytest.raises(TypeError):
        stack.RunConfig(k=1)


def test_preconditions(spark, index):
    assert all(c.ok for c in stack.preconditions(seams.ExtractiveGenerator(), lambda: index))
    assert [c.ok for c in stack.preconditions(None, lambda: index.limit(0))] == [False, True, False]
    assert [c.ok for c in stack.preconditions(None, lambda: spark.read.parquet("/nowhere/at/all"))] == [False, False, False]


def test_candidates(spark):
    rows = lambda ids: spark.createDataFrame([("q", i, float(-r), r) for r, i in enumerate(ids, 1)], "qid string, id string, score double, rank int")
    ids = lambda mode, pool: [r["id"] for r in stack.candidates(rows("abc"), rows("bxyz"), mode, pool).orderBy("rank").collect()]
    assert ids("dense", 4) == list("abc") and ids("union", 2) == list("abcx")
    assert ids("fuse", 2) == ["b", "a", "x", "c"]
    with pytest.raises(ValueError):
        ids("other", 2)


def test_execute(index, asked):
    class Rewriter:
        def complete(self, messages):
            return '"What did Corvo have?"' if "user: What of Alba?" in messages[-1]["content"] else "x" * 999

    config = stack.RunConfig.of(SETTINGS, hybrid=True, temporal=True, conversation=True)
    rows = {r["question_id"]: r for r in stack.execute(index, asked, config, seams.HashingEmbedder(), seams.ExtractiveGenerator(), SETTINGS, Rewriter()).collect()}
    assert rows["a"]["retrieved"][0]["doc_id"] == "2:0" and rows["a"]["answer"] == "Brix traded salt and wool [1]." and rows["a"]["standalone"] == asked.first()["text"]
    assert rows["b"]["standalone"] == "What did Corvo have?" and rows["b"]["retrieved"][0]["doc_id"] == "3:0"
    assert rows["c"]["retrieved"] == [] and rows["c"]["sources_sent"] == 0


def test_job(spark):
    job, go = jobs.Job(spark), threading.Event()
    assert job.status().state == jobs.IDLE and not job.cancel()

    def work(j):
        j.step(1, "wait")
        go.wait(30)
        j.step(2, "after")
        return "there"

    assert job.start("a", 2, work) and not job.start("b", 2, work)
    go.set()
    assert (job.wait(30).state, job.status().result, job.status().completed) == (jobs.DONE, "there", 2)
    assert job.start("c", 1, lambda j: 1 / 0) and job.wait(30).state == jobs.FAILED and "ZeroDivisionError" in job.status().error
    go.clear()
    assert job.start("d", 1, lambda j: (go.wait(30), j.step(1, "late"), "")[2]) and job.cancel()
    go.set()
    assert job.wait(30).state == jobs.CANCELLED


def test_surface(app):
    get = lambda target: app.respond("GET", target)
    assert get("/health") == (200, {"status": "ok"}) and get("/ready")[0] == 200 and "GET /search" in get("/")[1]["routes"]
    assert get("/nothing")[0] == 404 and app.respond("PUT", "/ask")[0] == 405 and get("/runs/../x")[0] == 404
    status, found = get("/search?q=salt+and+wool&k=1&hybrid=true")
    assert status == 200 and [r["doc_id"] for r in found["results"]] == ["2:0"]
    assert [get(t)[0] for t in ("/search", "/search?q=" + "x" * 501, "/search?q=a&k=51", "/search?q=a&k=0", "/search?q=a&temporal=maybe")] == [422] * 5
    ask = lambda value: app.respond("POST", "/ask", json.dumps(value).encode())
    status, said = ask({"question": "What did Brix trade, salt and wool?", "k": 1})
    assert status == 200 and said["answer"] == "Brix traded salt and wool [1]." and said["sources"][0]["doc_id"] == "2:0"
    assert [ask(v)[0] for v in ([], {"question": 1}, {"question": "a", "model": "z"}, {"question": "a", "history": [{}]})] == [422] * 4
    assert app.respond("POST", "/ask", b"{")[0] == 422
    names = [n for n, _ in app.events(json.dumps({"question": "salt and wool"}).encode())]
    assert names[0] == "sources" and names[-2:] == ["done", "trace"] and set(names[1:-2]) == {"token"}
    assert [n for n, _ in app.events(b"{")] == ["error", "trace"]
    app.spent_today = lambda: 1.0
    assert ask({"question": "a"})[0] == 402 and app.respond("POST", "/eval/run")[0] == 402
    app.spent_today = lambda: 0.0
    assert app.respond("POST", "/eval/run", b"", "10.0.0.9")[0] == 403 and app.respond("DELETE", "/eval/run")[0] == 409
    assert app.respond("POST", "/eval/run", b'{"baseline": "none"}')[0] == 404


def test_evaluation_over_http(app):
    assert app.respond("GET", "/eval/plan")[1]["questions"] == 3
    server = service.serve(app, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        web = http.client.HTTPConnection("127.0.0.1", server.server_address[1], timeout=120)
        web.request("POST", "/eval/run", "{}")
        reply = web.getresponse()
        assert reply.status == 200 and json.loads(reply.read())["state"] == jobs.RUNNING
        assert app.job.wait(120).state == jobs.DONE, app.job.status()
        web.request("GET", "/runs")
        (name,) = json.loads(web.getresponse().read())["runs"]
        web.request("GET", f"/runs/{name}")
        shown = json.loads(web.getresponse().read())
        assert shown["meta"]["k"] == 2 and [q["verdict"] for q in shown["questions"]][0] == "HIT at 1" and "recall_at_5" in shown["summary"]
        web.request("POST", "/ask", '{"question": "salt and wool"}', {"Accept": "text/event-stream"})
        assert web.getresponse().read().decode().startswith("event: sources\n")
    finally:
        server.shutdown()
        server.server_close()


def test_wiki_source():
    asked = []

    def get(params):
        asked.append(params)
        slots = lambda text: [{"revid": 7, "timestamp": "2024-01-01T00:00:00Z", "slots": {"main": {"content": text}}}]
        return {"query": {
            "normalized": [{"from": "alba", "to": "Alba"}], "redirects": [{"from": "Alba", "to": "Alba (town)"}, {"from": "X", "to": "Y"}, {"from": "Y", "to": "X"}],
            "pages": [{"pageid": 1, "title": "Alba (town)", "revisions": slots("text")}, {"title": "Gone", "missing": True}, {"pageid": 3, "title": "Bare"}, {"title": "No id", "revisions": slots("t")}],
        }}

    got = seams.WikiSource(get).fetch_batch(["alba", "Gone", "Bare", "No id", "X"])
    assert got.missing == ["Gone", "Bare", "No id", "X"] and asked[0]["titles"] == "alba|Gone|Bare|No id|X"
    assert got.revisions == [{"page_id": 1, "title": "Alba (town)", "revision_id": 7, "revision_timestamp": "2024-01-01T00:00:00Z", "wikitext": "text", "requested_title": "alba"}]
    assert seams.WikiSource(get).fetch_batch([]) == seams.FetchResult([], []) and len(asked) == 1
    with pytest.raises(ValueError):
        seams.WikiSource(get).fetch_batch(["t"] * 51)


def _lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_commands_from_pages_to_a_gated_run(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    long = " It was rebuilt, and its people kept the records of every year in the town hall." * 4
    pages = [{"title": t, "page_id": i, "revision_id": 1, "revision_timestamp": "2024-01-01T00:00:00", "wikitext": x + long} for i, (t, x) in enumerate(PAGES, 1)]
    links = [{"theme": "towns", "seed": s, "title": t} for s in ("s", "r") for t in ("Alba", "Brix", "Lost")]
    assert cli.main(["curate", _lines(tmp_path / "links", links), _lines(tmp_path / "seeds", [{"theme": "towns", "seed": "Corvo"}]), at("registry")]) == 0
    assert cli.main(["ingest", at("registry"), at("bronze"), _lines(tmp_path / "pages", pages)]) == 0
    assert "fetched 3, missing 1" in capsys.readouterr().out
    assert cli.main(["silver", at("bronze"), at("silver")]) == cli.main(["chunk", at("silver"), at("gold")]) == cli.main(["index", at("gold"), at("index")]) == 0
    n = spark.read.parquet(at("index")).count()
    assert n >= 3 and cli.main(["index", at("gold"), at("index"), "--resume"]) == 0 and spark.read.parquet(at("index")).count() == n
    assert cli.main(["index", at("gold"), at("index"), "--payload-only"]) == 0 and spark.read.parquet(at("index.payload")).count() == n
    (tmp_path / "q.toml").write_text('[[question]]\nid = "a"\nkind = "easy"\ntext = "salt and wool of Brix"\nexpected = ["2:0"]\nsuite = "golden"\n')
    assert cli.main(["evaluate", at("index"), at("q.toml"), at("runs"), "--hybrid"]) == 0
    (run,) = runs.list_runs(spark, at("runs"))
    assert cli.main(["gate", at(f"runs/{run}"), at(f"runs/{run}")]) == 0
    assert cli.main(["gate", at(f"runs/{run}"), at(f"runs/{run}"), "--changed", "k"]) == 1  # declared, but not so
    assert "FAILED, 1 checks" in capsys.readouterr().out


def test_probe_and_sweep_commands(tmp_path, capsys):
    right = [{"id": "a", "reply": "SUPPORTED - said so", "supported": True}, {"id": "b", "reply": "not supported", "supported": False}]
    assert cli.main(["judge-probe", _lines(tmp_path / "j1", right)]) == 0 and cli.main(["judge-probe", _lines(tmp_path / "j2", [*right, {"id": "c", "reply": "perhaps", "supported": True}])]) == 1
    case = {"id": "a", "reply": "- Alba fell in 1390.\n- Brix traded salt.", "forbid": ["silver"], "min_claims": 2}
    assert cli.main(["split-probe", _lines(tmp_path / "s1", [case])]) == 0 and cli.main(["split-probe", _lines(tmp_path / "s2", [case | {"forbid": ["salt"]}])]) == 1
    pools = [{"qid": "q", "id": i, "rank": r, "arm": arm} for arm, ids in enumerate(("ab", "ca")) for r, i in enumerate(ids, 1)]
    args = ["sweep", _lines(tmp_path / "pools", pools), _lines(tmp_path / "keys", [{"qid": "q", "id": "a"}])]
    assert cli.main([*args, "--control", "1.0"]) == 0 and cli.main([*args, "--control", "0.5"]) == 1
    assert "w=0.5,k=60" in capsys.readouterr().out
