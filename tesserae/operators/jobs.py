"""One long evaluation at a time, in a thread of the driver, that can be watched and cancelled."""

from __future__ import annotations

import datetime as dt
import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from tesserae.operators.spending import Meter

IDLE, RUNNING, DONE, FAILED, CANCELLED = "idle", "running", "done", "failed", "cancelled"


@dataclass(frozen=True)
class Status:
    state: str = IDLE
    run_id: str = ""
    step: str = ""
    completed: int = 0
    total: int = 0
    started_at: str = ""
    finished_at: str = ""
    result: str = ""
    error: str = ""
    calls: int = 0


class Job:
    """At most one run. All of its Spark jobs are in one job group, so that a cancel also stops the one that is under way."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._lock, self._status = spark, threading.Lock(), Status()
        self._cancelled = threading.Event()
        self._thread: threading.Thread | None = None
        self._meter: Meter | None = None

    def status(self) -> Status:
        with self._lock:
            return replace(self._status, calls=self._meter.calls if self._meter else 0)

    def watch(self, meter: Meter) -> None:
        """Tell the calls that tasks have reported to ``meter`` in the status, while they go on."""
        with self._lock:
            self._meter = meter

    def start(self, run_id: str, total: int, work: Callable[[Job], str]) -> bool:
        """Run ``work(self)``, which returns where its result is; False if a run is under way. Whatever happens, the run ends in a last state."""
        with self._lock:
            if self._status.state == RUNNING:
                return False
            self._cancelled.clear()
            self._meter = None
            self._status = Status(RUNNING, run_id, total=total, started_at=_now())
        self._thread = InheritableThread(target=self._run, args=(f"run-{run_id}", work), daemon=True)
        self._thread.start()
        return True

    def step(self, completed: int, name: str) -> None:
        """Tell what comes next; raises if the run was cancelled."""
        if self._cancelled.is_set():
            raise InterruptedError(f"cancelled before {name}")
        with self._lock:
            self._status = replace(self._status, completed=completed, step=name)

    def cancel(self) -> bool:
        """Stop the run under way; False if there is none."""
        with self._lock:
            if self._status.state != RUNNING:
                return False
            group = f"run-{self._status.run_id}"
        self._cancelled.set()
        self._spark.sparkContext.cancelJobGroup(group)
        return True

    def wait(self, seconds: float | None = None) -> Status:
        if self._thread:
            self._thread.join(seconds)
        return self.status()

    def _run(self, group: str, work: Callable[[Job], str]) -> None:
        try:
            self._spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
            end = {"state": DONE, "result": work(self)}
        except Exception as e:  # noqa: BLE001  the status tells what went wrong
            logging.getLogger("tesserae").warning("run %s ended: %s", group, e)
            end = {"state": CANCELLED if self._cancelled.is_set() else FAILED, "error": f"{type(e).__name__}: {e}"}
        with self._lock:
            self._status = replace(self._status, finished_at=_now(), **end)


def _now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
