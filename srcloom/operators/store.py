"""The graph store: reads of a repository's graph, and keyed writes, as functions over nodes, edges and fingerprints.

nodes(repo_id, id, kind, name, path, language, start_line, ...) and edges(repo_id, id, kind, from_id, to_id, resolution,
confidence, line). Every read is scoped to one repository; a null option is no filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialise

#: Slices: default and greatest number of nodes; the same for searches; greatest depth of a neighbourhood; rows of a write batch.
SLICE_LIMIT, SLICE_MOST = 300, 2000
SEARCH_LIMIT, SEARCH_MOST = 50, 200
DEPTH_MOST = 3
BATCH = 500


def in_repo(df: DataFrame, repo: str) -> DataFrame:
    return df.filter(F.col("repo_id") == repo)


def clamp_limit(limit: int | None) -> int:
    return min(max(SLICE_LIMIT if limit is None else limit, 1), SLICE_MOST)


def matches_term(term: str) -> Column:
    """Case-insensitive, literal match in a name or path."""
    low = F.lower(F.lit(term))
    return F.contains(F.lower("name"), low) | F.contains(F.lower(F.coalesce("path", F.lit(""))), low)


def slice_nodes(nodes: DataFrame, repo: str, limit: int | None = None, kinds: list[str] | None = None, path_prefix: str | None = None, language: str | None = None, search: str | None = None) -> DataFrame:
    """The first nodes of a repository by kind, path (null last), start line and id."""
    df = in_repo(nodes, repo)
    if kinds:
        df = df.filter(F.col("kind").isin(kinds))
    if path_prefix is not None:
        df = df.filter(F.col("path").startswith(path_prefix))
    if language is not None:
        df = df.filter(F.col("language") == language)
    if search is not None:
        df = df.filter(matches_term(search))
    order = [F.col(c).asc_nulls_last() for c in ("kind", "path", "start_line")]
    return df.orderBy(*order, "id").limit(clamp_limit(limit))


def induced_edges(edges: DataFrame, nodes: DataFrame, repo: str, edge_kinds: list[str] | None = None) -> DataFrame:
    """Edges with both ends among nodes (a slice: at most SLICE_MOST rows, so its ids are broadcast)."""
    df = in_repo(edges, repo)
    if edge_kinds:
        df = df.filter(F.col("kind").isin(edge_kinds))
    ids = F.broadcast(nodes.select("id"))
    df = df.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return df.withColumns({"resolution": F.coalesce("resolution", F.lit("unknown")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def fetch_graph(nodes: DataFrame, edges: DataFrame, repo: str, limit: int | None = None, edge_kinds: list[str] | None = None, **filters) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one row `truncated`) of a slice; truncated also when exactly `limit` nodes exist."""
    part = slice_nodes(nodes, repo, limit, **filters)
    return part, induced_edges(edges, part, repo, edge_kinds), part.agg((F.count("*") == clamp_limit(limit)).alias("truncated"))


def fetch_node(nodes: DataFrame, repo: str, node_id: str) -> DataFrame:
    return in_repo(nodes, repo).filter(F.col("id") == node_id)


def neighborhood(nodes: DataFrame, edges: DataFrame, repo: str, node_id: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) on undirected paths of 1 .. depth edges (held to 1 .. 3) from a node; nothing for a node without edges."""
    depth = min(max(depth, 1), DEPTH_MOST)
    own = in_repo(edges, repo)
    ids = in_repo(nodes, repo).select("id")
    own = own.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    both = own.select(F.explode(F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))).alias("x")).select("x.*")
    reached = [own.sparkSession.createDataFrame([(node_id,)], "id string")]
    for _ in range(depth - 1):
        reached.append(both.join(reached[-1], both["a"] == reached[-1]["id"], "left_semi").select(F.col("b").alias("id")).distinct())
    near = materialise(reduce(DataFrame.union, reached).distinct(), "near")  # an edge at one of these is on a path
    at = F.explode(F.array_distinct(F.array("from_id", "to_id")))
    on_path = materialise(own.withColumn("end", at).join(near.withColumnRenamed("id", "end"), "end", "left_semi").drop("end").dropDuplicates(["id"]), "paths")
    ends = on_path.select(F.col("from_id").alias("id")).union(on_path.select(F.col("to_id").alias("id"))).distinct()
    return in_repo(nodes, repo).join(ends, "id", "left_semi"), on_path


def search(nodes: DataFrame, repo: str, term: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Nodes whose name or path has the term: files first, then shorter names."""
    found = in_repo(nodes, repo).filter(matches_term(term))
    return found.orderBy((F.col("kind") == "File").desc(), F.length("name"), "id").limit(min(limit, SEARCH_MOST))


def stats(nodes: DataFrame, edges: DataFrame, repo: str) -> DataFrame:
    """(kind, n): nodes by kind and edges by kind (with both ends in the repository), added up by name."""
    own = in_repo(nodes, repo)
    ids = own.select("id")
    inner = in_repo(edges, repo).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    both = own.groupBy("kind").agg(F.count("*").alias("n")).union(inner.groupBy("kind").agg(F.count("*").alias("n")))
    return both.groupBy("kind").agg(F.sum("n").alias("n"))


def repositories(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'File'").groupBy("repo_id").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "repo_id")


def changed_files(stored: DataFrame, current: DataFrame, parser_version: str) -> DataFrame:
    """(path, change) of stored(path, content_hash, parser_version) against current(path, content_hash): changed, unchanged or deleted."""
    s = stored.select("path", F.col("content_hash").alias("old_hash"), "parser_version", F.lit(True).alias("was"))
    c = current.select("path", "content_hash", F.lit(True).alias("now"))
    same = F.col("old_hash").eqNullSafe(F.col("content_hash")) & F.col("parser_version").eqNullSafe(F.lit(parser_version))
    change = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull() | ~same, "changed").otherwise("unchanged")
    return s.join(c, "path", "full_outer").select("path", change.alias("change"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *last: Column) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of rows in new with one key the last by `last` wins, or by their order in new."""
    if last:
        new = first_by(new, keys, *[c.desc() for c in last])
    else:
        new = first_by(new.withColumn("_at", F.monotonically_increasing_id()), keys, F.col("_at").desc()).drop("_at")
    same = reduce(lambda a, b: a & b, [old[k].eqNullSafe(new[k]) for k in keys])
    return old.join(new, same, "left_anti").unionByName(new)


def linkable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes of the same repository; others are dropped."""
    a = nodes.select("repo_id", F.col("id").alias("from_id"))
    b = nodes.select("repo_id", F.col("id").alias("to_id"))
    return edges.join(a, ["repo_id", "from_id"], "left_semi").join(b, ["repo_id", "to_id"], "left_semi")


def dedupe_edges(edges: DataFrame, *order: Column) -> DataFrame:
    """The first edge of each (from, kind, to)."""
    return first_by(edges, ["repo_id", "from_id", "kind", "to_id"], *order)


def batches(df: DataFrame, *order: Column, size: int = BATCH) -> DataFrame:
    """df with `batch`: consecutive groups of `size` rows. Row numbers come from a range partitioning and per-partition counts, so no task sees all rows."""
    spark = df.sparkSession
    sorted_rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "batches")
    counts = sorted_rows.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()  # a row a partition
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["_p"], total))
        total += r["n"]
    start = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "_p int, _start long"))
    index = F.col("_start") + F.row_number().over(Window.partitionBy("_p").orderBy("_at")) - 1
    return sorted_rows.join(start, "_p").withColumn("batch", F.floor(index / size)).drop("_p", "_at", "_start")


def delete_paths(nodes: DataFrame, edges: DataFrame, repo: str, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of a repository under the paths, and without their edges; nodes without a path stay."""
    gone = in_repo(nodes, repo).join(paths.select("path").distinct(), "path", "left_semi").select("repo_id", "id")
    left = nodes.join(gone, ["repo_id", "id"], "left_anti")
    for end in ("from_id", "to_id"):
        edges = edges.join(gone.withColumnRenamed("id", end), ["repo_id", end], "left_anti")
    return left, edges


def store_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, repo: str, replace_paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The store after a graph is written: replaced paths go first, then nodes by (repo_id, id), then edges with both ends by (from, kind, to).

    Of new rows with one key the last wins.
    """
    if replace_paths is not None:
        nodes, edges = delete_paths(nodes, edges, repo, replace_paths)
    nodes = upsert(nodes, new_nodes, ["repo_id", "id"])
    return nodes, upsert(edges, linkable(new_edges, nodes), ["repo_id", "from_id", "kind", "to_id"])


def save_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["repo_id", "path"])


def clear_repository(df: DataFrame, repo: str) -> DataFrame:
    return df.filter(~F.col("repo_id").eqNullSafe(F.lit(repo)))
