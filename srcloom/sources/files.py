"""Files of a repository as a table, their fingerprints, and the incremental run."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from .parsers import registry

#: Folders that are no source, and the size above which files are generated.
IGNORED = (
    "node_modules .git .hg .svn dist build out coverage .next .nuxt .svelte-kit .cache __pycache__ .venv venv vendor target bin obj .vscode .idea .gradle Pods"
).split()
LARGEST = 1_500_000
PARSER_VERSION = "1"


def listing(spark: SparkSession, root: str) -> list[tuple[str, int, str]]:
    """(relative path, size, location) of supported files of at most LARGEST bytes; ignored folders aren't entered, links aren't followed.

    Folders are listed through Hadoop's file system: Spark's own file index would leave out names that begin with _ or a dot.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root if ":" in root else os.path.abspath(root) if spark.sparkContext.master.startswith("local") else root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, work = [], [(fs.makeQualified(base), "")]
    supported = {e.lower() for e in registry.extensions()}
    while work:
        folder, prefix = work.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            place = status.getPath().toUri()
            if status.isSymlink() or (place.getScheme() == "file" and os.path.islink(place.getPath())):  # the local file system doesn't tell links
                continue
            if status.isDirectory():
                if name not in IGNORED:
                    work.append((status.getPath(), f"{prefix}{name}/"))
            elif status.getLen() <= LARGEST and os.path.splitext("x" + name)[1].lower() in supported:
                out.append((prefix + name, int(status.getLen()), status.getPath().toString()))
    return sorted(out)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes) of the files of a repository."""
    return spark.createDataFrame([(p, n) for p, n, _ in listing(spark, root)], "path string, size_bytes long")


def _load(batches):
    import re

    import pyarrow as pa
    import pyarrow.fs as pafs

    for b in batches:
        content = []
        for place in b.column(1).to_pylist():
            fs, path = pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?=[^/])", "file:///", place.replace("%", "%25").replace(" ", "%20"))))
            with fs.open_input_file(path) as f:
                content.append(f.read())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], ["path", "content"])


def read(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """(repo_id, path, name, extension, language, content, size_bytes, content_hash) of a repository.

    Files are dealt out by place and read in tasks. Text is decoded before it is hashed; what isn't UTF-8 becomes U+FFFD.
    """
    places = spark.createDataFrame([(p, place) for p, _, place in listing(spark, root)], "path string, place string")
    raw = places.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(_load, "path string, content binary")
    return describe(raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")), repo_id)


def describe(df: DataFrame, repo_id: str) -> DataFrame:
    """Files from (path, content)."""
    ext = ids.extname(F.col("path"))
    language = F.lit(None).cast("string")
    for name, exts in registry.LANGUAGES.items():
        language = F.when(ext.isin(*exts), name).otherwise(language)
    return df.select(
        F.lit(repo_id).alias("repo_id"), "path", ids.basename(F.col("path")).alias("name"), ext.alias("extension"), language.alias("language"), "content",
        F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"),
    )


def fingerprints(files: DataFrame, version: str = PARSER_VERSION, now_ms: int | None = None) -> DataFrame:
    now = int(time.time() * 1000) if now_ms is None else now_ms
    return files.select("repo_id", "path", "content_hash", F.lit(version).alias("parser_version"), "size_bytes", F.lit(now).cast("long").alias("updated_at"))


def only(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("path").distinct(), "path", "left_semi")


def clean_old(workspace: str, max_age_s: float, now: float | None = None) -> list[str]:
    """Removes folders of a workspace last changed more than max_age_s ago; their names."""
    import shutil

    now = time.time() if now is None else now
    gone = []
    for e in sorted(os.scandir(workspace), key=lambda e: e.name):
        if e.is_dir(follow_symlinks=False) and now - e.stat().st_mtime > max_age_s:
            shutil.rmtree(e.path)
            gone.append(e.name)
    return gone
