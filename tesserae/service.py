"""The library over HTTP, with the standard library's server: search, answers, runs and one evaluation at a time.

``App.respond`` is the whole surface without a socket; ``serve`` puts it on one.
Search and answers run as plans over the index that the app was given, which it
keeps; the runs are folders of ``operators.runs``.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators import evaluation as E
from tesserae.operators import jobs, reports, runs, spending
from tesserae.plans import stack
from tesserae.settings import Settings
from tesserae.sources import schemas as S
from tesserae.sources.seams import Embedder, Generator, Unavailable

MAX_QUESTION, MAX_K, MAX_TURNS = 500, 50, 20
MAX_BODY = 1_000_000


class Refused(Exception):
    """An answer other than success: its status and a word about it."""

    def __init__(self, status: HTTPStatus, detail: str) -> None:
        super().__init__(detail)
        self.status, self.detail = status, detail


@dataclass
class App:
    """``index``: as ``corpus.build_index`` gives it; ``questions``: the evaluation set; ``models`` may be chosen by an ask or a run."""

    spark: SparkSession
    index: Callable[[], DataFrame]
    questions: Callable[[], DataFrame]
    embedder: Embedder
    generator: Generator | None
    runs_root: str
    settings: Settings = Settings()
    models: tuple[str, ...] = ()
    spent_today: Callable[[], float] = lambda: 0.0
    job: jobs.Job = field(init=False)

    def __post_init__(self) -> None:
        self.job = jobs.Job(self.spark)

    def respond(self, method: str, target: str, body: bytes = b"", client: str = "127.0.0.1") -> tuple[HTTPStatus, object]:
        """Status and JSON value of a request; errors are values too, with a ``detail``."""
        url = urlsplit(target)
        given = {k: v[-1] for k, v in parse_qs(url.query).items()}
        path = url.path.rstrip("/") or "/"
        try:
            if method in ("GET", "HEAD") and path.startswith("/runs/"):
                return HTTPStatus.OK, self.one_run(path.removeprefix("/runs/"))
            routes = {
                ("GET", "/"): lambda: {"routes": sorted(f"{m} {p}" for m, p in routes)}, ("GET", "/health"): lambda: {"status": "ok"}, ("GET", "/ready"): self.ready,
                ("GET", "/options"): self.options, ("GET", "/search"): lambda: self.search(given), ("POST", "/ask"): lambda: self.ask(_json(body)),
                ("GET", "/runs"): lambda: {"runs": runs.list_runs(self.spark, self.runs_root)}, ("GET", "/eval/plan"): lambda: self.plan(given),
                ("GET", "/eval/run"): lambda: asdict(self.job.status()), ("POST", "/eval/run"): lambda: self.start(_json(body), client), ("DELETE", "/eval/run"): lambda: self.cancel(client),
            }
            if (method, path) not in routes:
                known = any(p == path for _, p in routes)
                raise Refused(HTTPStatus.METHOD_NOT_ALLOWED if known else HTTPStatus.NOT_FOUND, f"{method} {path}")
            return HTTPStatus.OK, routes[method, path]()
        except Refused as e:
            return e.status, {"detail": e.detail}
        except Unavailable as e:
            return HTTPStatus.SERVICE_UNAVAILABLE, {"detail": str(e)}

    def ready(self) -> dict:
        checks = stack.preconditions(self.generator, self.index)
        if bad := [f"{c.name}: {c.detail}" for c in checks if not c.ok]:
            raise Refused(HTTPStatus.SERVICE_UNAVAILABLE, "; ".join(bad))
        return {"status": "ready", "checks": [asdict(c) for c in checks]}

    def options(self) -> dict:
        return {"models": list(self.models), "k": {"least": 1, "most": MAX_K, "default": self.settings.k}, "hybrid": [False, True], "temporal": [False, True]}

    def search(self, given: dict[str, str]) -> dict:
        text, config = self._question(given.get("q")), self._config(given)
        return {"question": text, "results": self._found(text, config)}

    def ask(self, given: dict) -> dict:
        """The answer to a question, with what it rests on; what the day may cost is checked before any call."""
        text, config = self._question(given.get("question")), self._config(given)
        turns = given.get("history") or []
        if not isinstance(turns, list) or len(turns) > MAX_TURNS or not all(isinstance(t, dict) and isinstance(t.get("user"), str) for t in turns):
            raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"history must be a list of at most {MAX_TURNS} turns")
        self._affordable()
        if self.generator is None:
            raise Refused(HTTPStatus.SERVICE_UNAVAILABLE, "no generator is configured")
        began = time.perf_counter()
        row = ("asked", "easy", text, [], [], [(t["user"], t.get("assistant")) for t in turns], "asked", "")
        record = stack.execute(self.index(), S.frame(self.spark, [row], S.QUESTION), config, self.embedder, self.generator, self.settings, self.generator).first().asDict(recursive=True)
        if record["error"]:
            raise Unavailable(record["error"])
        sources = [{k: r[k] for k in ("rank", "chunk_id", "doc_id", "source", "score")} for r in record["retrieved"] if r["rank"] <= record["sources_sent"]]
        return {"answer": record["answer"], "standalone": record["standalone"], "citations": record["citations"], "sources": sources, "ms": round(1000 * (time.perf_counter() - began), 1)}

    def events(self, body: bytes) -> Iterator[tuple[str, object]]:
        """An ask as events: ``sources``, a ``token`` for each word, ``done`` or ``error``, ``trace``."""
        began = time.perf_counter()
        status, reply = self.respond("POST", "/ask", body)
        if status == HTTPStatus.OK:
            yield "sources", reply["sources"]
            words = reply["answer"].split(" ")
            yield from (("token", w + " " * (i + 1 < len(words))) for i, w in enumerate(words))
            yield "done", {k: reply[k] for k in ("answer", "citations", "standalone")}
        else:
            yield "error", {"status": int(status), **reply}
        yield "trace", {"ms": round(1000 * (time.perf_counter() - began), 1)}

    def one_run(self, name: str) -> dict:
        try:
            meta, records = runs.read_run(self.spark, self.runs_root, name)
        except LookupError as e:
            raise Refused(HTTPStatus.NOT_FOUND, str(e)) from None
        verdicts = records.select("question_id", "kind", "suite", "question", "answer", "error", E.verdict(records).alias("verdict")).orderBy("question_id")
        return {"meta": meta.first().asDict(), "summary": reports.summary_text(E.summarise(records, (("kind",), ()))), "questions": [r.asDict() for r in verdicts.collect()]}

    def plan(self, given: dict) -> dict:
        """What a run would ask, cost and need, before it starts."""
        config = self._config(given)
        last = runs.last_run_with(self.spark, self.runs_root, config.generation_model)
        records = runs.read_run(self.spark, self.runs_root, last)[1] if last else S.frame(self.spark, [], S.RECORD)
        cost = spending.estimate(E.tokens_per_question(records), config.generation_model, self.questions().count(), last is not None)
        return {"config": asdict(config), "questions": cost["questions"], "dollars": cost["dollars"], "basis": cost["basis"], "ceiling": self.settings.run_ceiling, "checks": [asdict(c) for c in stack.preconditions(self.generator, self.index)]}

    def start(self, given: dict, client: str) -> dict:
        """Begin an evaluation, gated against ``baseline`` (a run's id) if one is given; 403 from afar, 409 while one is under way."""
        _local(client)
        if self.job.status().state == jobs.RUNNING:
            raise Refused(HTTPStatus.CONFLICT, "a run is under way")
        config, baseline = self._config(given), given.get("baseline")
        if baseline is not None and baseline not in runs.list_runs(self.spark, self.runs_root):
            raise Refused(HTTPStatus.NOT_FOUND, f"no run {baseline!r}")
        self._affordable()
        plan = self.plan(given)
        if self.settings.run_ceiling > 0 and plan["dollars"] > self.settings.run_ceiling:
            raise Refused(HTTPStatus.PAYMENT_REQUIRED, f"the run would cost ${plan['dollars']:.4f}; its ceiling is ${self.settings.run_ceiling:.4f}")
        self.ready()
        run = runs.run_id(dt.datetime.now(dt.UTC))
        if run in runs.list_runs(self.spark, self.runs_root) or not self.job.start(run, 3, lambda job: self.evaluate(job, run, config, baseline)):
            raise Refused(HTTPStatus.CONFLICT, "a run is under way, or one has this minute's id")
        return asdict(self.job.status())

    def evaluate(self, job: jobs.Job, run: str, config: stack.RunConfig, baseline: str | None) -> str:
        """Ask all questions, write the run's folder, then gate it; the records are computed once."""
        job.step(0, "answers")
        job.watch(meter := spending.Meter(self.spark))
        records = stack.execute(self.index(), self.questions(), config, self.embedder, self.generator, self.settings, self.generator, ceiling=self.settings.run_ceiling, meter=meter).cache()
        try:
            records.count()
            job.step(1, "folder")
            meta = stack.meta(self.spark, config, self.settings, run_id=run, points=self.index().count())
            path = runs.write_run(self.runs_root, meta, records, reports.summary_text(E.summarise(records, (("kind",), ()))))
            job.step(2, "gate")
            if baseline is None:
                return path
            old = runs.read_run(self.spark, self.runs_root, baseline)
            failed = stack.gated(old, (meta, records), stack.changed_fields(old[0], config, self.settings)).where("status = 'fail'").count()
            return f"{path} ({'passed' if not failed else f'{failed} checks failed'})"
        finally:
            records.unpersist()

    def cancel(self, client: str) -> dict:
        _local(client)
        if not self.job.cancel():
            raise Refused(HTTPStatus.CONFLICT, "no run is under way")
        return asdict(self.job.status())

    def _affordable(self) -> None:
        if 0 < self.settings.day_ceiling <= self.spent_today():
            raise Refused(HTTPStatus.PAYMENT_REQUIRED, f"today's ceiling of ${self.settings.day_ceiling:.2f} is reached")

    def _question(self, text: object) -> str:
        if not isinstance(text, str) or not text.strip() or len(text) > MAX_QUESTION:
            raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"a question has 1 to {MAX_QUESTION} characters")
        return text.strip()

    def _config(self, given: dict) -> stack.RunConfig:
        """The settings with what a request overrides: ``k``, ``hybrid``, ``temporal``, and a ``model`` of the list."""
        own: dict[str, object] = {}
        if "k" in given:
            if not str(given["k"]).isdecimal() or not 1 <= int(given["k"]) <= MAX_K:
                raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"k must be 1 to {MAX_K}")
            own["k"] = int(given["k"])
        for switch in ("hybrid", "temporal"):
            if switch in given:
                if str(given[switch]).lower() not in ("true", "false"):
                    raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"{switch} must be true or false")
                own[switch] = str(given[switch]).lower() == "true"
        if given.get("model"):
            if given["model"] not in self.models:
                raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"model must be one of {list(self.models)}")
            own["generation_model"] = given["model"]
        return stack.RunConfig.of(self.settings, **own)

    def _found(self, text: str, config: stack.RunConfig) -> list[dict]:
        asked = self.spark.createDataFrame([("asked", text)], "id string, text string")
        found = stack.ranked(self.index(), asked, config, self.embedder, self.settings)
        return [r.asDict(recursive=True) for r in found.select("rank", "id", "doc_id", "title", "heading", "text", "score").orderBy("rank").collect()]


def _json(body: bytes) -> dict:
    try:
        value = json.loads(body or b"{}")
    except ValueError:
        raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, "the body isn't JSON") from None
    if not isinstance(value, dict):
        raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, "the body must be an object")
    return value


def _local(client: str) -> None:
    """Runs cost money, so they are started and stopped from this machine alone."""
    if not ipaddress.ip_address(client.split("%")[0]).is_loopback:
        raise Refused(HTTPStatus.FORBIDDEN, "runs are started from this machine alone")


def serve(app: App, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for the app; call ``serve_forever`` on it. An ask that accepts ``text/event-stream`` gets its answer as events."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            length = self.headers.get("Content-Length", "0")
            if not length.isdecimal() or int(length) > MAX_BODY:
                return self._send(HTTPStatus.REQUEST_ENTITY_TOO_LARGE, {"detail": f"at most {MAX_BODY} bytes"})
            body = self.rfile.read(int(length))
            if self.command == "POST" and urlsplit(self.path).path == "/ask" and "text/event-stream" in self.headers.get("Accept", ""):
                self.send_response(HTTPStatus.OK)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                for name, value in app.events(body):
                    self.wfile.write(f"event: {name}\ndata: {json.dumps(value, default=str)}\n\n".encode())
                    self.wfile.flush()
                return None
            return self._send(*app.respond(self.command, self.path, body, self.client_address[0]))

        def _send(self, status: HTTPStatus, value: object) -> None:
            data = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _reply  # noqa: N815

        def log_message(self, format: str, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
