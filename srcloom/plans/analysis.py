"""The analysis of a repository from files to a stored graph, and the service functions over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import materialise
from ..operators import resolve as R
from ..operators import store as S
from ..sources import files as source
from ..sources.parsers import registry

TABLES = ("parsed", "fingerprints", "nodes", "edges")


class Repository:
    """Tables of analysed repositories in a folder, each partitioned by repo_id and version.

    An analysis writes a new version of all tables and then marks it as done; the latest done version counts, so a run that
    fails on the way leaves what was there before. Older versions are removed after that.

    Parsed facts are kept, so that an incremental run resolves the whole repository from old and new facts together: edges
    from unchanged files are as fresh as those from changed ones.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _repo(self, table: str, repo: str) -> str:
        return f"{self.folder}/{table}/repo_id={repo.replace('/', '%2F')}"

    def version(self, repo: str) -> int:
        """The latest version that is done; 0 without any."""
        fs, marks = self._fs(self._repo("done", repo))
        return max((int(x.getPath().getName()) for x in fs.listStatus(marks)), default=0) if fs.exists(marks) else 0

    def read(self, table: str, repo: str, version: int | None = None) -> DataFrame | None:
        version = self.version(repo) if version is None else version
        return self.spark.read.parquet(f"{self._repo(table, repo)}/version={version}").withColumn("repo_id", F.lit(repo)) if version else None

    def _write(self, table: str, repo: str, version: int, df: DataFrame) -> None:
        df.drop("repo_id").write.mode("overwrite").parquet(f"{self._repo(table, repo)}/version={version}")

    def _done(self, repo: str, version: int) -> None:
        fs, mark = self._fs(f"{self._repo('done', repo)}/{version}")
        fs.create(mark, True).close()
        for old in range(1, version):
            for place in (f"{self._repo('done', repo)}/{old}", *(f"{self._repo(t, repo)}/version={old}" for t in TABLES)):
                gone, path = self._fs(place)
                gone.delete(path, True)

    def analyse(self, files: DataFrame, repo: str, force: bool = False, version: str = source.PARSER_VERSION) -> dict:
        """Brings the tables of a repository up to date with its files(path, content); counts of files by change, and the graph's statistics."""
        files = materialise(source.describe(files.select("path", "content"), repo), "files")
        old = self.read("fingerprints", repo)
        if old is None:
            old = self.spark.createDataFrame([], "path string, content_hash string, parser_version string, size_bytes long, updated_at long, repo_id string")
        change = materialise(S.changed_files(old, files, version), "change")
        todo = files.join(change.filter("change <> 'deleted'" if force else "change = 'changed'").select("path"), "path", "left_semi")
        parsed = registry.parse(todo)
        before = self.read("parsed", repo)
        if before is not None:
            gone = change.filter("change = 'deleted'").select("path").union(todo.select("path"))
            parsed = before.join(gone, "path", "left_anti").unionByName(parsed)
        version_now = self.version(repo) + 1
        self._write("parsed", repo, version_now, parsed)
        parsed = self.read("parsed", repo, version_now)
        good = parsed.filter("error IS NULL").select("path")
        self._write("fingerprints", repo, version_now, source.fingerprints(files.join(good, "path", "left_semi"), version))
        nodes, edges, stats = R.resolve(*registry.facts(parsed))
        nodes, edges = materialise(nodes, "nodes"), materialise(edges, "edges")
        kept_nodes, kept_edges = S.store_graph(nodes.limit(0), edges.limit(0), nodes, edges, repo)
        self._write("nodes", repo, version_now, kept_nodes)
        self._write("edges", repo, version_now, kept_edges)
        self._done(repo, version_now)
        counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
        return {k: counts.get(k, 0) for k in ("changed", "unchanged", "deleted")} | {"errors": parsed.filter("error IS NOT NULL").count()} | stats.first().asDict()

    def clear(self, repo: str) -> None:
        for table in ("done", *TABLES):
            fs, path = self._fs(self._repo(table, repo))
            fs.delete(path, True)


def main(argv: list[str] | None = None) -> int:
    """scan <path> [--id name] [--store folder] [--force]"""
    import argparse
    import json
    import os

    p = argparse.ArgumentParser(prog="srcloom scan")
    p.add_argument("path")
    p.add_argument("--id")
    p.add_argument("--store", default="srcloom-store")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("srcloom").getOrCreate()
    repo = (a.id or os.path.basename(os.path.abspath(a.path))).lower()
    files = source.read(spark, os.path.abspath(a.path), repo)
    print(json.dumps(Repository(spark, a.store).analyse(files, repo, a.force)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
