"""Change impact by bounded breadth-first search, and dependency cycles."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialise

#: Edge kinds that carry an impact, and those that make a cycle.
IMPACT_KINDS = ("CALLS", "IMPORTS", "REEXPORTS", "EXTENDS", "IMPLEMENTS")
CYCLE_KINDS = ("IMPORTS", "REEXPORTS")
DEPTH, DEPTH_MOST = 3, 8
NODES, NODES_MOST = 500, 5000
CYCLE_MOST = 50
#: Edges left after trimming up to which components are found on the driver; beyond, by joins. Both ways give the same components.
LOCAL_EDGES = 200_000


def _steps(nodes: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, ok, edge): one step of an impact, a -> b; edges with a missing end are dropped."""
    ids = nodes.select("id")
    e = edges.filter(F.col("kind").isin(*IMPACT_KINDS))
    e = e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    a, b = ("from_id", "to_id") if direction == "downstream" else ("to_id", "from_id")
    return e.select(F.col(a).alias("a"), F.col(b).alias("b"), F.coalesce(F.col("resolution") == "resolved", F.lit(False)).alias("ok"), F.col("id").alias("edge"))


def impact(nodes: DataFrame, edges: DataFrame, origins: list[str], direction: str = "upstream", max_depth: int = DEPTH, max_nodes: int = NODES) -> DataFrame:
    """(origin, node_id, depth, pos, path, certain, truncated): what a change of each origin reaches.

    Downstream follows outgoing edges (callees), upstream incoming ones (callers). A node is reached once, at its least
    depth, from the parent found first, over the edge with the smallest id; it is certain if all edges on that path are
    resolved. Depth is held to 1 .. 8, nodes to 1 .. 5000 an origin; no more than that is ever ranked in one place.
    """
    spark = nodes.sparkSession
    depth, most = min(max(max_depth, 1), DEPTH_MOST), min(max(max_nodes, 1), NODES_MOST)
    steps = materialise(_steps(nodes, edges, direction), "steps")
    names = nodes.select(F.col("id").alias("b"), F.col("name").alias("b_name"))
    known = nodes.filter(F.col("id").isin(origins)).select("id", "name")
    seen = known.select(F.col("id").alias("origin"), F.col("id").alias("node_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pos"), F.array("name").alias("path"), F.lit(True).alias("certain"))
    seen = materialise(seen, "seen")
    level = seen
    for d in range(1, depth + 1):
        reached = level.join(steps, level["node_id"] == steps["a"])
        reached = reached.join(seen.select("origin", F.col("node_id").alias("b")), ["origin", "b"], "left_anti")
        best = reached.groupBy("origin", "b").agg(F.min(F.struct("pos", "edge", F.col("path").alias("path"), (F.col("certain") & F.col("ok")).alias("certain"))).alias("x"))
        counts = seen.groupBy("origin").agg((F.count("*") - 1).alias("have"), F.max("pos").alias("last"))
        best = best.join(F.broadcast(counts), "origin").join(names, "b")  # a row an origin
        rank = F.row_number().over(Window.partitionBy("origin").orderBy("x.pos", "x.edge"))
        winners = best.withColumn("_rank", rank).filter(F.col("_rank") <= most - F.col("have"))  # per-origin top-k
        level = winners.select("origin", F.col("b").alias("node_id"), F.lit(d).alias("depth"), (F.col("last") + F.col("_rank")).alias("pos"), F.concat(F.col("x.path"), F.array("b_name")).alias("path"), F.col("x.certain").alias("certain"))
        level = materialise(level, "level")
        if level.isEmpty():
            break
        seen = materialise(seen.unionByName(level), "seen")
    found = seen.filter("depth > 0")
    return found.withColumn("truncated", F.count("*").over(Window.partitionBy("origin")) >= most)


def impact_rollups(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row an origin: sorted distinct files, modules, tests and exports among what it reaches, and counts by certainty."""
    n = nodes.select(F.col("id").alias("node_id"), "name", "kind", F.col("path").alias("file"), F.coalesce("is_test", F.lit(False)).alias("is_test"), F.coalesce("is_exported", F.lit(False)).alias("is_exported"))
    j = found.join(n, "node_id")
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    return j.groupBy("origin").agg(
        F.count_if("certain").alias("impacted"), F.count_if(~F.col("certain")).alias("uncertain"),
        F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_set(F.when(F.col("file").isNotNull(), folder))).alias("modules"),
        F.array_sort(F.collect_set(F.when(F.col("is_test"), F.coalesce("file", "name")))).alias("tests"),
        F.array_sort(F.collect_set(F.when(F.col("is_exported") & (F.col("kind") != "File"), F.col("name")))).alias("exports"),
    )


def impact_union(found: DataFrame) -> DataFrame:
    """What any origin reaches: the least depth of each node, of the smallest origin at that depth."""
    return found.groupBy("node_id").agg(F.min(F.struct("depth", "origin", "pos", "path", "certain")).alias("x")).select("node_id", "x.*")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, scc): the strongly connected components of edges (a, b) with more than one node; scc is the smallest node."""
    spark = edges.sparkSession
    rest = materialise(edges.filter("a <> b").select("a", "b").distinct(), "scc")
    size = rest.count()
    while size:  # nodes without a way in or out are components of their own
        trimmed = rest.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(rest.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        trimmed = materialise(trimmed.select("a", "b"), "scc")
        now = trimmed.count()
        rest = trimmed
        if now == size or now <= local_edges:
            break
        size = now
    if size <= local_edges or rest.count() <= local_edges:
        pairs = [(r["a"], r["b"]) for r in rest.collect()]  # at most local_edges rows
        return spark.createDataFrame(_tarjan(pairs), f"node {dict(edges.dtypes)['a']}, scc {dict(edges.dtypes)['a']}")
    found = None
    while not rest.isEmpty():
        colour = materialise(rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:  # the greatest node that reaches each
            best = rest.join(colour, rest["a"] == colour["node"]).groupBy("b").agg(F.max("colour").alias("m"))
            new = materialise(colour.join(best, colour["node"] == best["b"], "left").select("node", F.greatest("colour", "m").alias("colour")), "colour")
            moved = new.join(colour.withColumnRenamed("colour", "old"), "node").filter("colour <> old").isEmpty()
            colour = new
            if moved:
                break
        inner = rest.join(colour.withColumnRenamed("node", "a"), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b").filter("colour = other").select("a", "b", "colour")
        back = materialise(colour.filter("node = colour"), "back")
        while True:
            new = inner.join(back.select(F.col("node").alias("b"), F.col("colour").alias("c")), "b").filter("colour = c").select(F.col("a").alias("node"), "colour").distinct()
            new = materialise(new.join(back, "node", "left_anti"), "back")
            if new.isEmpty():
                break
            back = materialise(back.union(new), "back")
        part = back.join(back.groupBy("colour").agg(F.min("node").alias("scc"), F.count("*").alias("n")), "colour")
        got = part.filter("n > 1").select("node", "scc")
        found = materialise(got if found is None else found.union(got), "found")
        rest = materialise(rest.join(back.select(F.col("node").alias("a")), "a", "left_anti").join(back.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "scc")
    return found


def _tarjan(pairs: list[tuple]) -> list[tuple]:
    """Strongly connected components with more than one node, by two depth-first passes without recursion."""
    ahead, back = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        ahead[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for start in list(ahead):
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(ahead[start]))]
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(ahead.get(step, ()))))
    out, done = [], set()
    for start in reversed(order):
        if start in done:
            continue
        done.add(start)
        group, stack = [], [start]
        while stack:
            node = stack.pop()
            group.append(node)
            for x in back.get(node, ()):
                if x not in done:
                    done.add(x)
                    stack.append(x)
        if len(group) > 1:
            out += [(x, min(group)) for x in group]
    return out


def cycles(nodes: DataFrame, edges: DataFrame, cross_file_only: bool = False, max_size: int = CYCLE_MOST, kinds: tuple[str, ...] = CYCLE_KINDS) -> DataFrame:
    """(size, node_ids, labels, paths) of the dependency cycles: strongly connected components over imports, and self-imports.

    Components above max_size are left out; cross_file_only keeps those over more than one path. Largest first.
    """
    ids = nodes.select("id")
    e = edges.filter(F.col("kind").isin(*kinds)).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    e = e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    e = materialise(e.distinct(), "cycle_edges")
    many = components(e)
    loops = e.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("scc")).join(many.select("node"), "node", "left_anti")
    member = many.select("node", "scc").unionByName(loops)
    sizes = member.groupBy("scc").agg(F.count("*").alias("size")).filter(F.col("size") <= max_size)
    n = nodes.select(F.col("id").alias("node"), "name", "path")
    groups = member.join(sizes, "scc").join(n, "node").groupBy("scc", "size")  # at most max_size rows each
    out = groups.agg(F.array_sort(F.collect_list(F.struct("node", "name", "path"))).alias("x"), F.count_distinct("path").alias("files"))
    if cross_file_only:
        out = out.filter("files > 1")
    return out.select("size", F.col("x.node").alias("node_ids"), F.col("x.name").alias("labels"), F.array_sort(F.array_distinct(F.filter("x.path", lambda p: p.isNotNull()))).alias("paths")).orderBy(F.desc("size"), "node_ids")
