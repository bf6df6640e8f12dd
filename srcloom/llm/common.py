"""What the corpus operators share: bounded Arrow batches, fold buckets, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import drop, materialise, new_path, shared_dir  # noqa: F401
from ..functions.skew import HOT_SHARE, join_by_share  # noqa: F401

#: Most rows, and bytes (beyond one row), of an Arrow batch that reaches a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def batched(spark: SparkSession) -> None:
    """Bounds the rows and bytes of Arrow batches, so that long texts don't fill a Python worker.

    The settings are the session's (Spark reads them when a lazy plan runs), the same for all operators, and only ever lowered.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def crc_bucket(doc_id, mod: int):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def connected(edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v), root being the smallest node reachable.

    Alternates large-star and small-star steps; each is an aggregation of minima, added up before its shuffle, and one
    equi-join in which a hub with many edges meets its minimum by broadcast. Steps are written to the shared folder, and
    removed when the next is there, so neither links nor components ever pass through the driver.
    """
    edges = materialise(edges.filter("u <> v").select("u", "v").distinct(), name)
    seen, size = None, edges.count()
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_by_share(both, least, "u", "n", 2 * size).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_by_share(large, least, "u", "n", size)
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialise(small, name)
        drop(edges, large)
        edges = small
        size, now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (size, now) == seen:
            break
        seen = size, now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n points (the smallest index connected to it) for links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        keep = low < high
        if not keep.any():
            break
        a, b, low, high = a[keep], b[keep], low[keep], high[keep]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label
