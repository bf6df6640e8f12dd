"""Job events: an append-only table of snapshots, its latest state, retention, and metrics."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round

STATUSES = ("queued", "running", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
CONCURRENCY, RETAINED, RETAINED_LEAST = 2, 200, 10
ERROR_CHARS = 500


def latest(events: DataFrame) -> DataFrame:
    """The last snapshot of each job."""
    cols = [c for c in events.columns if c != "job_id"]
    return events.groupBy("job_id").agg(F.max(F.struct("event_seq", *[c for c in cols if c != "event_seq"])).alias("s")).select("job_id", *[F.col(f"s.{c}") for c in cols])


def listing(events: DataFrame) -> DataFrame:
    return latest(events).orderBy(F.desc("created_at"), "job_id")


def active_count(events: DataFrame) -> DataFrame:
    return latest(events).agg(F.count_if(F.col("status").isin("queued", "running")).alias("active"))


def pruned(events: DataFrame, retained: int = RETAINED) -> DataFrame:
    """The jobs that stay: over `retained`, the oldest finished ones go (by finished_at, unknown first); active ones never.

    Only the surplus, a top-k of the finished jobs, is ranked.
    """
    jobs = latest(events)
    total = jobs.count()
    surplus = max(0, total - max(retained, RETAINED_LEAST))
    gone = jobs.filter(F.col("status").isin(*TERMINAL)).orderBy(F.coalesce("finished_at", F.lit(0)), "created_at", "job_id").limit(surplus).select("job_id")
    return jobs.join(gone, "job_id", "left_anti")


def durations(events: DataFrame) -> DataFrame:
    """(job_id, attempt, event_seq, status, duration): the first terminal snapshot of each started attempt."""
    done = events.filter(F.col("status").isin(*TERMINAL) & (F.col("attempt") >= 1))
    first = done.groupBy("job_id", "attempt").agg(F.min(F.struct("event_seq", "status", "finished_at", "started_at", "created_at")).alias("x"))
    taken = F.col("x.finished_at") - F.coalesce("x.started_at", "x.created_at")
    return first.select("job_id", "attempt", "x.event_seq", "x.status", F.greatest(F.lit(0).cast("long"), taken).alias("duration"))


def metrics(events: DataFrame) -> DataFrame:
    """One row: jobs by status (all five), total ever queued, finished attempts, last, average (rounded) and longest duration."""
    by = latest(events).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    total = events.filter("status = 'queued'").agg(F.count_distinct("job_id").alias("total"))
    d = durations(events).agg(F.count("*").alias("finished"), F.max_by("duration", "event_seq").alias("last_ms"), js_round(F.avg("duration")).alias("average_ms"), F.max("duration").alias("max_ms"))
    return by.crossJoin(total).crossJoin(d)  # three single rows


def progress(fraction: Column) -> Column:
    return js_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * 100)


class Queue:
    """A first-in first-out queue of driver-side jobs with bounded concurrency; snapshots go to listeners, whose errors are ignored."""

    def __init__(self, concurrency: int = CONCURRENCY, retained: int = RETAINED, clock: Callable[[], float] = time.time):
        self._pool = ThreadPoolExecutor(max(1, concurrency))
        self._retained, self._clock = max(RETAINED_LEAST, retained), clock
        self._jobs: dict[str, dict] = {}
        self._work: dict[str, Callable] = {}
        self._stop: dict[str, threading.Event] = {}
        self._listeners: list[Callable[[dict], None]] = []
        self._lock = threading.RLock()

    def on_update(self, listener: Callable[[dict], None]) -> None:
        self._listeners.append(listener)

    def _emit(self, job: dict) -> None:
        for listener in self._listeners:
            try:
                listener(dict(job))
            except Exception:  # a listener's fault is its own
                pass

    def _now(self) -> int:
        return int(self._clock() * 1000)

    def enqueue(self, repo_id: str, work: Callable[[Callable[[float], None], threading.Event], dict | None], repo_url: str = "", ref: str | None = None) -> dict:
        """work(progress, stop) gives the job's stats."""
        job = {"job_id": f"job_{uuid.uuid4().hex[:12]}", "repo_id": repo_id, "repo_url": repo_url, "ref": ref, "status": "queued", "stage": "queued", "progress": 0, "message": "", "created_at": self._now(), "started_at": None, "finished_at": None, "attempt": 0, "error": None, "stats": None}
        with self._lock:
            self._jobs[job["job_id"]] = job
            self._work[job["job_id"]] = work
            self._prune()
        self._submit(job)
        return dict(job)

    def _submit(self, job: dict) -> None:
        self._stop[job["job_id"]] = threading.Event()
        self._emit(job)
        self._pool.submit(self._execute, job)

    def _execute(self, job: dict) -> None:
        stop = self._stop[job["job_id"]]
        with self._lock:
            if job["status"] != "queued":
                return
            job.update(status="running", started_at=self._now(), attempt=job["attempt"] + 1)
        self._emit(job)

        def step(fraction: float) -> None:
            job["progress"] = int(max(0.0, min(1.0, fraction)) * 100 + 0.5)
            self._emit(job)

        try:
            stats = self._work[job["job_id"]](step, stop)
            state = {"status": "cancelled"} if stop.is_set() else {"status": "completed", "progress": 100, "stats": stats}
        except Exception as e:
            state = {"status": "cancelled"} if stop.is_set() else {"status": "failed", "error": str(e)[:ERROR_CHARS]}
        with self._lock:
            job.update(state, stage="done", finished_at=self._now())
        self._emit(job)

    def cancel(self, job_id: str) -> bool:
        with self._lock:
            job = self._jobs.get(job_id)
            if job is None or job["status"] in TERMINAL:
                return False
            self._stop[job_id].set()
            if job["status"] == "queued":
                job.update(status="cancelled", finished_at=self._now())
        self._emit(job)
        return True

    def retry(self, job_id: str) -> dict | None:
        with self._lock:
            job = self._jobs.get(job_id)
            if job is None or job["status"] not in TERMINAL:
                return dict(job) if job else None
            job.update(status="queued", stage="queued", progress=0, error=None, finished_at=None)
        self._submit(job)
        return dict(job)

    def get(self, job_id: str) -> dict | None:
        job = self._jobs.get(job_id)
        return dict(job) if job else None

    def jobs(self) -> list[dict]:
        return sorted(map(dict, self._jobs.values()), key=lambda j: -j["created_at"])

    def active(self) -> int:
        return sum(j["status"] in ("queued", "running") for j in self._jobs.values())

    def _prune(self) -> None:
        surplus = len(self._jobs) - self._retained
        done = sorted((j for j in self._jobs.values() if j["status"] in TERMINAL), key=lambda j: j["finished_at"] or 0)
        for j in done[: max(0, surplus)]:
            for table in (self._jobs, self._work, self._stop):
                table.pop(j["job_id"], None)

    def close(self) -> None:
        self._pool.shutdown(wait=True)
