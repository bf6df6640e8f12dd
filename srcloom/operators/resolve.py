"""Resolution of parsed facts into a property graph: modules, imports and calls, each edge with a tier of confidence.

Facts are tables: files(repo_id, path, name, language), imports(repo_id, path, seq, specifier, bindings, namespace_binding,
default_binding, is_reexport, line), symbols(repo_id, path, seq, name, qualified_name, kind, ...) and calls(repo_id, path, seq,
callee_name, caller_qualified_name, line). seq is the ordinal in the file; (path, seq) orders whatever is taken first or last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from .store import dedupe_edges, first_by

#: Extensions tried for a specifier without one, by language, and names of a folder's index file.
EXTENSIONS = {
    "javascript": [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"],
    "typescript": [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py", ".pyi"], "java": [".java"], "go": [".go"], "ruby": [".rb"], "rust": [".rs"], "csharp": [".cs"],
}
INDEX_FILES = "index.ts index.tsx index.js index.jsx index.py index.go index.rb index.rs __init__.py mod.rs lib.rs".split()
#: Confidence by the way a call was resolved.
SAME_FILE, BOUND, EXPORTED, UNIQUE = 1.0, 0.95, 0.6, 0.5
KEYS = ["repo_id", "path"]


def specifier_candidates(spec: Column, path: Column, language: Column, dot_style: bool = False) -> Column:
    """array<struct<prio, target, folder>>: the paths a relative specifier may mean, in order; `folder` is set where it must hold files itself."""
    folder = ids.dirname(path)
    base = ids.join_path(folder, spec)
    if dot_style:
        base = F.when(spec == ".", folder).otherwise(base)
    exts = F.array(*map(F.lit, EXTENSIONS["javascript"]))
    for name, own in EXTENSIONS.items():
        exts = F.when(language == name, F.array(*map(F.lit, own))).otherwise(exts)
    none = F.lit(None).cast("string")
    item = lambda p, t, f=none: F.struct(p.cast("int").alias("prio"), t.alias("target"), f.alias("folder"))
    stem = F.regexp_replace(base, r"\.(js|jsx|mjs|cjs)$", "")
    plain = F.array(item(F.lit(0), base))
    with_ext = F.transform(exts, lambda e, i: item(i + 1, F.concat(base, e)))
    inside = F.transform(F.array(*map(F.lit, INDEX_FILES)), lambda n, i: item(i + 100, F.when(base == "", n).otherwise(F.concat(base, F.lit("/"), n)), base))
    source = F.when(stem != base, F.transform(exts, lambda e, i: item(i + 200, F.concat(stem, e)))).otherwise(F.array().cast("array<struct<prio:int,target:string,folder:string>>"))
    return F.concat(plain, with_ext, inside, source)


def resolve_specifiers(imports: DataFrame, files: DataFrame, dot_style: bool = False) -> DataFrame:
    """imports with `target`: the file a relative specifier means, null for packages and missing files."""
    rel = imports.filter(ids.is_relative(F.col("specifier"))).join(files.select(*KEYS, "language"), KEYS)
    cand = rel.select("repo_id", F.col("path").alias("at"), "seq", F.explode(specifier_candidates(F.col("specifier"), F.col("path"), F.col("language"), dot_style)).alias("c"))
    cand = cand.select("repo_id", "at", "seq", "c.*")
    hit = cand.join(files.select("repo_id", F.col("path").alias("target")), ["repo_id", "target"])
    folders = files.select("repo_id", ids.dirname(F.col("path")).alias("folder")).distinct()
    hit = hit.filter("folder IS NULL").unionByName(hit.filter("folder IS NOT NULL").join(folders, ["repo_id", "folder"], "left_semi"))
    best = hit.groupBy("repo_id", F.col("at").alias("path"), "seq").agg(F.min_by("target", "prio").alias("target"))
    return imports.join(best, [*KEYS, "seq"], "left")


def build_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """File nodes and symbol nodes; of symbols with one id the last stays."""
    f = files.select(
        "repo_id", ids.file_id(F.col("repo_id"), F.col("path")).alias("id"), F.lit("File").alias("kind"), F.coalesce("name", ids.basename(F.col("path"))).alias("name"), "path", "language",
        F.lit(None).cast("string").alias("qualified_name"), F.lit(None).cast("array<string>").alias("parameters"), *[F.lit(None).cast("int").alias(c) for c in ("start_line", "end_line", "complexity")],
        *[F.lit(None).cast("boolean").alias(c) for c in ("is_exported", "is_test")], ids.dirname(F.col("path")).alias("module_path"),
    )
    s = symbols.join(files.select(*KEYS, "language"), KEYS).select(
        "repo_id", ids.symbol_id(F.col("repo_id"), F.col("path"), F.col("qualified_name"), F.col("start_line")).alias("id"), "kind", "name", "path", "language", "qualified_name", "parameters",
        "start_line", "end_line", "complexity", "is_exported", ids.is_test_path(F.col("path")).alias("is_test"), ids.dirname(F.col("path")).alias("module_path"), "seq",
    )
    s = first_by(s, ["repo_id", "id"], F.desc("seq")).drop("seq")
    return f.unionByName(s)


def _edge(kind: Column, source: Column, target: Column, resolution, confidence, line: Column, order: Column) -> list[Column]:
    return [
        F.col("repo_id"), ids.edge_id(source, kind, target).alias("id"), kind.alias("kind"), source.alias("from_id"), target.alias("to_id"),
        resolution.alias("resolution"), confidence.cast("double").alias("confidence"), line.cast("int").alias("line"), order.alias("at"),
    ]


def define_edges(symbols: DataFrame) -> DataFrame:
    repo, path = F.col("repo_id"), F.col("path")
    sid = ids.symbol_id(repo, path, F.col("qualified_name"), F.col("start_line"))
    return symbols.select(*_edge(F.lit("DEFINES"), ids.file_id(repo, path), sid, F.lit("resolved"), F.lit(1.0), F.col("start_line"), F.struct("path", "seq")))


def import_edges(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes of external modules): one edge a resolved import or package; unresolved relative imports give none."""
    repo = F.col("repo_id")
    package = F.when(~ids.is_relative(F.col("specifier")), ids.package_name(F.col("specifier")))
    df = resolved.withColumn("package", package).filter("target IS NOT NULL OR package IS NOT NULL")
    target = F.when(F.col("target").isNotNull(), ids.file_id(repo, F.col("target"))).otherwise(ids.external_id(repo, F.col("package")))
    kind = F.when(F.col("is_reexport"), "REEXPORTS").otherwise("IMPORTS")
    edges = df.select(*_edge(kind, ids.file_id(repo, F.col("path")), target, F.lit("resolved"), F.lit(1.0), F.col("line"), F.struct("path", "seq")))
    packages = df.filter("target IS NULL").select("repo_id", "package").distinct()
    return edges, packages.select("repo_id", ids.external_id(repo, F.col("package")).alias("id"), F.lit("ExternalModule").alias("kind"), F.col("package").alias("name"))


def bindings(resolved: DataFrame) -> DataFrame:
    """(repo_id, path, local, target, imported): what a local name of a file is bound to; the last binding of a name wins."""
    item = lambda local, imported, n: F.struct(local.alias("local"), imported.alias("imported"), n.cast("int").alias("n"))
    own = F.transform(F.coalesce("bindings", F.array().cast("array<struct<local:string,imported:string>>")), lambda b, i: item(b["local"], b["imported"], i))
    rest = F.array(item(F.col("default_binding"), F.lit("default"), F.lit(1_000_000)), item(F.col("namespace_binding"), F.lit("*"), F.lit(1_000_001)))
    df = resolved.filter("target IS NOT NULL").select(*KEYS, "seq", "target", F.explode(F.concat(own, rest)).alias("b")).filter("b.local IS NOT NULL AND b.local <> ''")
    return first_by(df.select(*KEYS, "b.local", "target", "b.imported", "seq", "b.n"), [*KEYS, "local"], F.desc("seq"), F.desc("n")).drop("seq", "n")


def resolve_calls(calls: DataFrame, symbols: DataFrame, bound: DataFrame) -> DataFrame:
    """calls with target (symbol id or null), tier, confidence and caller id.

    In order: a symbol of the same file named like the head of the callee; the file the head is bound to, by the wanted name;
    for undotted callees a name that one symbol in the repository has, in another file.
    """
    repo = F.col("repo_id")
    sym = symbols.select(*KEYS, "seq", "name", "qualified_name", F.coalesce("is_exported", F.lit(False)).alias("is_exported"), ids.symbol_id(repo, F.col("path"), F.col("qualified_name"), F.col("start_line")).alias("sid"))
    head = F.substring_index("callee_name", ".", 1)
    dotted = F.contains(F.col("callee_name"), F.lit("."))
    c = calls.select(*KEYS, F.col("seq").alias("call_seq"), "callee_name", "caller_qualified_name", "line", head.alias("head"), dotted.alias("dotted"))
    same = sym.groupBy(*KEYS, F.col("name").alias("head")).agg(F.min_by("sid", "seq").alias("same_id"))
    c = c.join(same, [*KEYS, "head"], "left").join(bound.withColumnRenamed("local", "head"), [*KEYS, "head"], "left")
    want = F.when(F.col("dotted"), F.substring_index("callee_name", ".", -1)).otherwise(F.col("imported"))
    c = c.withColumn("want", F.when(want.isin("", "*", "default"), F.lit(None)).otherwise(want))
    module = sym.groupBy("repo_id", F.col("path").alias("target"), F.col("name").alias("want")).agg(
        F.count("*").alias("n"), F.count_if("is_exported").alias("n_exported"), F.min_by("sid", "seq").alias("one"), F.min_by(F.when(F.col("is_exported"), F.col("sid")), F.when(F.col("is_exported"), F.col("seq"))).alias("one_exported")
    )
    c = c.join(module, ["repo_id", "target", "want"], "left")
    unique = sym.groupBy("repo_id", F.col("name").alias("callee_name")).agg(F.count("*").alias("everywhere"), F.min("sid").alias("only_id"), F.min("path").alias("only_path")).filter("everywhere = 1")
    c = c.join(unique, ["repo_id", "callee_name"], "left")
    single, exported = F.col("n") == 1, (F.col("n") > 1) & (F.col("n_exported") == 1)
    alone = ~F.col("dotted") & F.col("only_id").isNotNull() & (F.col("only_path") != F.col("path"))
    pick = lambda a, b, d, e: F.when(F.col("same_id").isNotNull(), a).when(single, b).when(exported, d).when(alone, e)
    callers = first_by(sym.select(*KEYS, F.col("qualified_name").alias("caller_qualified_name"), F.col("sid").alias("caller_sid"), "seq"), [*KEYS, "caller_qualified_name"], F.col("seq")).drop("seq")
    c = c.join(callers, [*KEYS, "caller_qualified_name"], "left")
    return c.select(
        *KEYS, F.col("call_seq").alias("seq"), "callee_name", "line", F.coalesce("caller_sid", ids.file_id(repo, F.col("path"))).alias("caller_id"),
        pick(F.col("same_id"), F.col("one"), F.col("one_exported"), F.col("only_id")).alias("target_id"),
        F.coalesce(pick(F.lit("resolved"), F.lit("resolved"), F.lit("inferred"), F.lit("inferred")), F.lit("unknown")).alias("tier"),
        pick(F.lit(SAME_FILE), F.lit(BOUND), F.lit(EXPORTED), F.lit(UNIQUE)).alias("confidence"),
    )


def call_edges(resolved: DataFrame) -> DataFrame:
    df = resolved.filter("target_id IS NOT NULL")
    return df.select(*_edge(F.lit("CALLS"), F.col("caller_id"), F.col("target_id"), F.col("tier"), F.col("confidence"), F.col("line"), F.struct("path", "seq")))


def resolve(files: DataFrame, imports: DataFrame, symbols: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one row of statistics) of a whole repository's facts."""
    linked = resolve_specifiers(imports, files)
    imp, external = import_edges(linked)
    sites = resolve_calls(calls, symbols, bindings(linked))
    nodes = build_nodes(files, symbols).unionByName(external, allowMissingColumns=True)
    edges = dedupe_edges(define_edges(symbols).unionByName(imp).unionByName(call_edges(sites)), F.col("at")).drop("at")
    kind = F.col("kind")
    s = symbols.agg(F.count_if(kind.isin("Function", "Method")).alias("functions"), F.count_if(kind.isin("Class", "Interface")).alias("classes"))
    t = sites.agg(*[F.count_if(F.col("tier") == x).alias(f"{x}_calls") for x in ("resolved", "inferred", "unknown")])
    stats = files.agg(F.count("*").alias("files")).crossJoin(s).crossJoin(imp.agg(F.count("*").alias("imports"))).crossJoin(t).crossJoin(external.agg(F.count("*").alias("external_modules")))
    return nodes, edges, stats.withColumn("calls", F.col("resolved_calls") + F.col("inferred_calls"))


def renumber(df: DataFrame) -> DataFrame:
    """seq anew, for facts whose ordinal is an array position."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*KEYS).orderBy("seq")))
