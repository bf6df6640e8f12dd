"""What the HTTP routes of a service over the store would call: one function a route, and the job queue behind analysis."""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import jobs, store, validate
from ..sources.parsers import registry
from .analysis import Repository


class BadRequest(ValueError):
    """A request that says what it may not; `faults` by parameter."""

    def __init__(self, faults: dict[str, str]):
        super().__init__("; ".join(f"{k} {v}" for k, v in faults.items()))
        self.faults = faults


class Service:
    """fetch(clone_url, ref) gives files(path, content) of a repository; it stands for the clone."""

    def __init__(self, spark: SparkSession, folder: str, fetch: Callable[[str, str | None], DataFrame], concurrency: int = jobs.CONCURRENCY):
        self.spark, self.repository, self.fetch = spark, Repository(spark, folder), fetch
        self.queue, self.started, self.events = jobs.Queue(concurrency), time.time(), []
        self.queue.on_update(self._record)

    def _record(self, job: dict) -> None:
        self.events.append((len(self.events), job["job_id"], job["status"], job["attempt"], job["created_at"], job["started_at"], job["finished_at"]))

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "uptime_s": round(time.time() - self.started)}

    def capabilities(self) -> dict:
        return {"languages": sorted(registry.LANGUAGES), "extensions": sorted(registry.extensions())}

    def metrics(self) -> dict:
        rows = self.spark.createDataFrame(list(self.events), "event_seq long, job_id string, status string, attempt int, created_at long, started_at long, finished_at long")
        return jobs.metrics(rows).first().asDict() | {"uptime_s": round(time.time() - self.started)}

    def validate(self, url: str) -> dict:
        row = self.spark.createDataFrame([(url,)], "url string")
        return row.select(validate.parse_repo_url(row["url"]).alias("r")).select("r.*").first().asDict()

    def analyze(self, url: str, ref: str | None = None, force: bool = False) -> dict:
        """The queued job."""
        found = self.validate(url)
        if found["error"]:
            raise BadRequest({"url": found["error"]})
        repo = f"{found['owner']}/{found['repo']}".lower()

        def work(step, stop):
            step(0.05)
            files = self.fetch(found["clone_url"], ref)
            step(0.15)
            return None if stop.is_set() else self.repository.analyse(files, repo, force)

        return self.queue.enqueue(repo, work, found["clone_url"], ref)

    def job(self, job_id: str) -> dict | None:
        self._check(job_id=job_id)
        return self.queue.get(job_id)

    def jobs(self) -> list[dict]:
        return self.queue.jobs()

    def cancel(self, job_id: str) -> bool:
        return self.queue.cancel(job_id)

    def wait(self, job_id: str, timeout_s: float = 600, every_s: float = 0.2) -> dict | None:
        """Polls a job until it ends."""
        end = time.time() + timeout_s
        while (job := self.queue.get(job_id)) and job["status"] not in jobs.TERMINAL and time.time() < end:
            time.sleep(every_s)
        return self.queue.get(job_id)

    def graph(self, repo: str, limit: str | None = None, kinds: str | None = None, edge_kinds: str | None = None, path_prefix: str | None = None, language: str | None = None, search: str | None = None) -> dict:
        self._check(limit=limit)
        items = lambda text: [x.strip() for x in (text or "").split(",") if x.strip()] or None
        nodes, edges = self._tables(repo)
        n, e, t = store.fetch_graph(nodes, edges, repo, int(limit) if limit else None, items(edge_kinds), kinds=items(kinds), path_prefix=path_prefix, language=language, search=search)
        return {"nodes": [r.asDict() for r in n.collect()], "edges": [r.asDict() for r in e.collect()], "truncated": t.first()["truncated"]}  # a slice

    def stats(self, repo: str) -> dict[str, int]:
        return {r["kind"]: r["n"] for r in store.stats(*self._tables(repo), repo).collect()}

    def neighbors(self, repo: str, node_id: str, depth: str | None = None) -> tuple[DataFrame, DataFrame]:
        self._check(node_id=node_id, depth=depth)
        return store.neighborhood(*self._tables(repo), repo, node_id, int(depth or 1))

    def search(self, repo: str, q: str, limit: str | None = None) -> list[dict]:
        self._check(q=q, limit=limit)
        return [r.asDict() for r in store.search(self._tables(repo)[0], repo, q, int(limit) if limit else store.SEARCH_LIMIT).collect()]

    def repositories(self) -> DataFrame:
        return store.repositories(self.spark.read.parquet(f"{self.repository.folder}/nodes"))

    def delete(self, repo: str) -> None:
        self.repository.clear(repo)

    def _tables(self, repo: str) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.repository.read("nodes", repo), self.repository.read("edges", repo)
        if nodes is None:
            raise BadRequest({"repo": "is not analysed"})
        return nodes, edges

    @staticmethod
    def _check(**params) -> None:
        if faults := validate.check_params(**params):
            raise BadRequest(faults)


def log_entry(level: str, component: str, message: str, context: dict | None = None, now: float | None = None) -> str:
    """A structured log line; an empty context is left out, an exception in it becomes its name, message and trace."""
    clean = {k: {"name": type(v).__name__, "message": str(v), "stack": "".join(traceback.format_exception(v))} if isinstance(v, BaseException) else v for k, v in (context or {}).items()}
    at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(time.time() if now is None else now))
    return json.dumps({"timestamp": at, "level": level, "component": component, "message": message} | ({"context": clean} if clean else {}))
