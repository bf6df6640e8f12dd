"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import assistant, graph, jobs, quality, resolve, retrieval, secrets, store, validate, views
from ..sources import files as source
from ..sources.parsers import registry
from ..streaming import jobs as stream
from . import adapters as A
from . import fixtures as X
from . import oracle as O

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


SLICE = ("repo_id", "id", "kind", "name", "path", "start_line")


# graph store


@query(O.graph("SELECT repo_id, id, kind, name, path, start_line FROM nodes WHERE repo_id = 'r1' ORDER BY kind NULLS LAST, path NULLS LAST, start_line NULLS LAST, id LIMIT 300"))
def graph_slice(spark: SparkSession, sf: str) -> DataFrame:
    return store.slice_nodes(A.nodes(spark, sf), "r1").select(*SLICE)


@query(O.graph("SELECT repo_id, id, kind, name, path, start_line FROM nodes WHERE repo_id = 'r1' AND kind IN ('Function', 'Method') AND starts_with(path, 'r1/') AND language = 'typescript' AND (contains(lower(name), '7') OR contains(lower(coalesce(path, '')), '7')) ORDER BY kind, path NULLS LAST, start_line NULLS LAST, id LIMIT 50"))
def graph_slice_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return store.slice_nodes(A.nodes(spark, sf), "r1", 50, ["Function", "Method"], "r1/", "typescript", "7").select(*SLICE)


@query(O.graph("SELECT repo_id, id, kind, name, path, start_line FROM nodes WHERE repo_id = 'r1' AND starts_with(path, '') ORDER BY kind, path, start_line NULLS LAST, id LIMIT 2000"))
def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return store.slice_nodes(A.nodes(spark, sf), "r1", 5000, path_prefix="").select(*SLICE)


@query(O.graph("s AS (SELECT id FROM nodes WHERE repo_id = 'r1' AND kind IN ('File', 'Function', 'ExternalModule') ORDER BY kind, path NULLS LAST, start_line NULLS LAST, id LIMIT 900)", "SELECT e.id, e.kind, from_id, to_id, coalesce(resolution, 'unknown') AS resolution, coalesce(confidence, 0) AS confidence, line FROM edges e WHERE repo_id = 'r1' AND from_id IN (SELECT id FROM s) AND to_id IN (SELECT id FROM s)"))
def graph_slice_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, e, _ = store.fetch_graph(A.nodes(spark, sf), A.edges(spark, sf), "r1", 900, kinds=["File", "Function", "ExternalModule"])
    return e.select("id", "kind", "from_id", "to_id", "resolution", "confidence", "line")


@query(O.graph("SELECT (SELECT count(*) FROM (SELECT 1 FROM nodes WHERE repo_id = 'r1' LIMIT 300)) = 300 AS truncated"))
def graph_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return store.fetch_graph(A.nodes(spark, sf), A.edges(spark, sf), "r1")[2]


@query(O.graph("SELECT id, kind, name FROM nodes WHERE repo_id = 'r1' AND id = 'fn:42'"))
def fetch_node(spark: SparkSession, sf: str) -> DataFrame:
    return store.fetch_node(A.nodes(spark, sf), "r1", "fn:42").select("id", "kind", "name")


@query(O.graph("SELECT id, kind, name, path FROM nodes WHERE repo_id = 'r1' AND (contains(lower(name), 'a') OR contains(lower(coalesce(path, '')), 'a')) ORDER BY kind = 'File' DESC, length(name), id LIMIT 50"))
def node_search(spark: SparkSession, sf: str) -> DataFrame:
    return store.search(A.nodes(spark, sf), "r1", "A").select("id", "kind", "name", "path")


@query(O.graph("SELECT kind, sum(n)::BIGINT AS n FROM (SELECT kind, count(*) AS n FROM nodes WHERE repo_id = 'r1' GROUP BY kind UNION ALL SELECT e.kind, count(*) FROM edges e JOIN nodes a ON a.repo_id = 'r1' AND a.id = from_id JOIN nodes b ON b.repo_id = 'r1' AND b.id = to_id WHERE e.repo_id = 'r1' GROUP BY e.kind) GROUP BY kind"))
def kind_stats(spark: SparkSession, sf: str) -> DataFrame:
    return store.stats(A.nodes(spark, sf), A.edges(spark, sf), "r1")


@query(O.graph("SELECT repo_id, count(*) AS files FROM nodes WHERE kind = 'File' GROUP BY repo_id"))
def repo_counts(spark: SparkSession, sf: str) -> DataFrame:
    return store.repositories(A.nodes(spark, sf))


def _near(depth: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return store.neighborhood(A.nodes(spark, sf), A.edges(spark, sf), "r1", "if:3", depth)[0].select("id", "kind", "name")

    return run


def _near_edges(spark: SparkSession, sf: str) -> DataFrame:
    return store.neighborhood(A.nodes(spark, sf), A.edges(spark, sf), "r1", "if:3", 2)[1].select("id", "kind", "from_id", "to_id")


for _d in (1, 2, 3):
    QUERIES[f"neighborhood_d{_d}"] = _near(_d)
    ORACLES[f"neighborhood_d{_d}"] = O.neighborhood(_d, "SELECT n.id, n.kind, n.name FROM nodes n WHERE repo_id = 'r1' AND id IN (SELECT from_id FROM hit UNION SELECT to_id FROM hit)")
QUERIES["neighborhood_edges"] = _near_edges
ORACLES["neighborhood_edges"] = O.neighborhood(2, "SELECT id, kind, from_id, to_id FROM hit")


@query(O.CHANGE)
def fingerprint_diff(spark: SparkSession, sf: str) -> DataFrame:
    f = A.files(spark, sf)
    old = f.select(F.when(F.col("doc_id") % 7 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, "0").otherwise("1").alias("parser_version"))
    return store.changed_files(old, f.select("path", "content_hash"), "1")


@query(O.graph("SELECT id, kind, CASE WHEN kind = 'Interface' AND id LIKE '%7' THEN 'renamed' ELSE name END AS name FROM nodes UNION ALL SELECT 'new:1', 'Interface', 'fresh'"))
def upsert_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = A.nodes(spark, sf)
    new = n.filter("kind = 'Interface' AND id LIKE '%7'").withColumn("name", F.lit("renamed"))
    fresh = new.sparkSession.range(1).select(*[F.lit({"repo_id": "r1", "id": "new:1", "kind": "Interface", "name": "fresh"}.get(c)).cast(t).alias(c) for c, t in n.dtypes])
    return store.upsert(n, new.unionByName(fresh), ["repo_id", "id"]).select("id", "kind", "name")


@query(O.graph(
    "both_in AS (SELECT e.repo_id, e.id FROM edges e JOIN nodes a ON a.repo_id = e.repo_id AND a.id = e.from_id JOIN nodes b ON b.repo_id = e.repo_id AND b.id = e.to_id WHERE e.kind = 'IMPORTS')",
    "SELECT id, kind, CASE WHEN kind = 'Interface' AND id LIKE '%7' THEN 'last' ELSE name END AS value FROM nodes UNION ALL SELECT e.id, e.kind, CASE WHEN b.id IS NOT NULL THEN 'inferred' ELSE e.resolution END FROM edges e LEFT JOIN both_in b ON b.repo_id = e.repo_id AND b.id = e.id",
))
def store_graph(spark: SparkSession, sf: str) -> DataFrame:
    """New nodes come twice, the second row of each is stored; new edges replace old ones where both ends are nodes of the repository."""
    n, e = A.nodes(spark, sf), A.edges(spark, sf)
    some = n.filter("kind = 'Interface' AND id LIKE '%7'")
    twice = some.withColumn("name", F.lit("first")).union(some.withColumn("name", F.lit("last")))
    imports = e.filter("kind = 'IMPORTS'").withColumn("resolution", F.lit("inferred"))
    loose = imports.limit(1).withColumn("to_id", F.lit("nowhere")).withColumn("id", F.lit("loose"))
    nodes, edges = store.store_graph(n, e, twice, imports.union(loose), "r1")
    return nodes.select("id", "kind", F.col("name").alias("value")).union(edges.select("id", "kind", "resolution"))


@query(O.graph("g AS (SELECT id FROM nodes WHERE repo_id = 'r1' AND path = 'r1/n1.ts')", "SELECT kind, count(*) AS n FROM (SELECT kind FROM nodes WHERE NOT (repo_id = 'r1' AND id IN (SELECT id FROM g)) UNION ALL SELECT kind FROM edges WHERE NOT (repo_id = 'r1' AND (from_id IN (SELECT id FROM g) OR to_id IN (SELECT id FROM g)))) GROUP BY kind"))
def delete_paths(spark: SparkSession, sf: str) -> DataFrame:
    n = A.nodes(spark, sf)
    left, rest = store.delete_paths(n, A.edges(spark, sf), "r1", n.filter("path = 'r1/n1.ts'").select("path"))
    return left.select("kind").unionByName(rest.select("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(O.graph("SELECT kind, count(*) AS n FROM edges e WHERE EXISTS (SELECT 1 FROM nodes a WHERE a.repo_id = e.repo_id AND a.id = e.from_id) AND EXISTS (SELECT 1 FROM nodes b WHERE b.repo_id = e.repo_id AND b.id = e.to_id) GROUP BY kind"))
def edge_endpoint_filter(spark: SparkSession, sf: str) -> DataFrame:
    return store.linkable(A.edges(spark, sf), A.nodes(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT from_id, to_id, arg_min(line, seq) AS line FROM (SELECT 'm:' || l_orderkey AS from_id, 's:' || l_suppkey % 10 AS to_id, l_linenumber * 10 AS line, l_partkey * 100 + l_linenumber AS seq FROM lineitem) GROUP BY ALL")
def edge_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "lineitem").select(F.lit("r1").alias("repo_id"), F.concat(F.lit("m:"), "l_orderkey").alias("from_id"), F.lit("CALLS").alias("kind"), F.concat(F.lit("s:"), F.col("l_suppkey") % 10).alias("to_id"), (F.col("l_linenumber") * 10).alias("line"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return store.dedupe_edges(e, F.col("seq")).select("from_id", "to_id", "line")


@query(O.graph("SELECT batch::BIGINT AS batch, count(*) AS n FROM (SELECT floor((row_number() OVER (ORDER BY id) - 1) / 500) AS batch FROM nodes) GROUP BY batch"))
def write_batches(spark: SparkSession, sf: str) -> DataFrame:
    return store.batches(A.nodes(spark, sf), F.col("id")).groupBy("batch").agg(F.count("*").alias("n"))


@query(O.graph("SELECT repo_id, count(*) AS n FROM nodes WHERE repo_id <> 'r2' GROUP BY repo_id"))
def clear_repository(spark: SparkSession, sf: str) -> DataFrame:
    return store.clear_repository(A.nodes(spark, sf), "r2").groupBy("repo_id").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT 'p' || doc_id AS path, 'old' AS content_hash FROM documents), n AS (SELECT 'p' || 2 * doc_id AS path, sha256(text) AS content_hash FROM documents) SELECT * FROM n UNION ALL SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)")
def save_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    d = A.files(spark, sf)
    row = lambda n, h: d.select(F.lit("r1").alias("repo_id"), F.concat(F.lit("p"), n).alias("path"), h.alias("content_hash"))
    return store.save_fingerprints(row(F.col("doc_id"), F.lit("old")), row(F.col("doc_id") * 2, F.col("content_hash"))).select("path", "content_hash")


# impact and cycles


def _impact(origin: str, direction: str, depth: int = 3):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = graph.impact(A.nodes(spark, sf).filter("repo_id = 'r1'"), A.edges(spark, sf).filter("repo_id = 'r1'"), [origin], direction, depth)
        return found.select("node_id", "depth")

    return run


for _name, _origin, _way, _depth in (("impact_up", "if:7", "upstream", 3), ("impact_down", "fn:6", "downstream", 3), ("impact_depth1", "if:7", "upstream", 1)):
    QUERIES[_name] = _impact(_origin, _way, _depth)
    ORACLES[_name] = O.impact([_origin], _way, _depth, "SELECT node_id, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY node_id")


@query(O.impact(["if:7", "if:8"], "upstream", 2, "SELECT node_id, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY node_id"))
def impact_multi(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.impact(A.nodes(spark, sf).filter("repo_id = 'r1'"), A.edges(spark, sf).filter("repo_id = 'r1'"), ["if:7", "if:8"], "upstream", 2)
    return graph.impact_union(found).select("node_id", "depth")


@query(O.impact(["if:7"], "upstream", 3, "SELECT r.origin, count(DISTINCT n.path)::INT AS files, count(DISTINCT CASE WHEN n.is_test THEN n.path END)::INT AS tests, count(DISTINCT CASE WHEN n.is_exported AND n.kind <> 'File' THEN n.name END)::INT AS exports FROM (SELECT DISTINCT origin, node_id FROM reach WHERE depth > 0) r JOIN nodes n ON n.id = r.node_id AND n.repo_id = 'r1' GROUP BY r.origin"))
def impact_rollups(spark: SparkSession, sf: str) -> DataFrame:
    n = A.nodes(spark, sf).filter("repo_id = 'r1'")
    found = graph.impact(n, A.edges(spark, sf).filter("repo_id = 'r1'"), ["if:7"], "upstream", 3)
    r = graph.impact_rollups(found, n)
    return r.select("origin", *[F.size(c).alias(c) for c in ("files", "tests", "exports")])


@query(O.CERTAIN)
def impact_certainty(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.impact(A.nodes(spark, sf).filter("repo_id = 'r1'"), A.edges(spark, sf).filter("repo_id = 'r1'"), ["if:7"], "upstream", 2)
    return found.select("node_id", "depth", "certain", F.array_join("path", ">").alias("path"))


def _supplier_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = A.table(spark, sf, "supplier")
    total = s.agg(F.count("*").alias("n"))
    both = s.crossJoin(F.broadcast(total))  # one row
    k, n = F.col("s_suppkey"), F.col("n")
    e = both.select(k.alias("a"), F.pmod(k * k + 1, n).alias("b")).union(both.select(k.alias("a"), F.pmod(3 * k + 7, n).alias("b")))
    nodes = s.select(F.lpad(k.cast("string"), 6, "0").alias("id"), F.lit("File").alias("kind"), F.col("s_name").alias("name"), F.concat(F.lit("s/"), k % 3).alias("path"))
    text = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    edges = e.distinct().select(text("a").alias("from_id"), text("b").alias("to_id"), F.lit("IMPORTS").alias("kind"))
    return nodes, edges.union(edges.limit(1).select(F.lit("000001"), F.lit("000001"), F.lit("IMPORTS")))


@query(O.SCC)
def scc_cycles(spark: SparkSession, sf: str) -> DataFrame:
    c = graph.cycles(*_supplier_graph(spark, sf))
    return c.select("size", F.array_join("node_ids", ",").alias("ids"))


@query("SELECT count(*) AS n FROM (SELECT s_suppkey AS a FROM supplier, (SELECT count(*) AS n FROM supplier) WHERE (s_suppkey * s_suppkey + 1) % n = s_suppkey OR (3 * s_suppkey + 7) % n = s_suppkey OR s_suppkey = 1)")
def self_loops(spark: SparkSession, sf: str) -> DataFrame:
    _, e = _supplier_graph(spark, sf)
    return e.filter("from_id = to_id").select("from_id").distinct().agg(F.count("*").alias("n"))


# files


@query(O.files("SELECT path, content_hash, '1' AS parser_version, strlen(content) AS size_bytes FROM files"))
def file_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    files = source.describe(A.files(spark, sf).select("path", "content"), "r1")
    return source.fingerprints(files, "1", 0).select("path", "content_hash", "parser_version", "size_bytes")


@query(O.files("SELECT path, array_to_string(regexp_split_to_array(content, '\\r?\\n')[2:4], chr(10)) AS body FROM files"))
def line_slices(spark: SparkSession, sf: str) -> DataFrame:
    return A.files(spark, sf).select("path", T.slice_lines(F.col("content"), F.lit(2), F.lit(4)).alias("body"))


@query(O.values("v", X.CLONE_ERRORS, "message, expected", "SELECT message, expected AS friendly FROM v"))
def clone_errors(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame(spark, X.CLONE_ERRORS, "message string, expected string").select("message", validate.clone_error(F.col("message")).alias("friendly"))


@query("SELECT doc_id, floor(greatest(0, least(1, (n_chars - 500) / 4000)) * 100 + 0.5)::BIGINT AS progress FROM documents")
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", jobs.progress((F.col("n_chars") - 500) / 4000).alias("progress"))


# resolution


@query(O.values("specifiers", X.SPECIFIERS, "path, seq, specifier, expected", "SELECT path, seq, expected AS target FROM specifiers"))
def specifier_resolve(spark: SparkSession, sf: str) -> DataFrame:
    imports = X.frame(spark, X.SPECIFIERS, "path string, seq int, specifier string, expected string").withColumn("repo_id", F.lit("r1"))
    files = X.frame(spark, X.FILES, "path string, language string").withColumn("repo_id", F.lit("r1"))
    return resolve.resolve_specifiers(imports, files).select("path", "seq", "target")


@query("SELECT doc_id, array_to_string(list_filter(string_split(source || '/' || lang, '/'), lambda x: x <> ''), '/') || '/x' || doc_id % 7 AS joined, source AS parent FROM documents")
def path_join(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents")
    folder = F.concat(F.col("source"), F.lit("/"), F.col("lang"))
    return d.select("doc_id", ids.join_path(folder, F.concat(F.lit("./a/../"), F.lit("x"), F.col("doc_id") % 7)).alias("joined"), ids.join_path(folder, F.lit("..")).alias("parent"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '@' || source || '/' || lang ELSE source END AS package FROM documents")
def package_name(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents")
    spec = F.concat(F.when(F.col("doc_id") % 2 == 0, "@").otherwise(""), "source", F.lit("/"), "lang", F.lit("/sub/x"))
    return d.select("doc_id", ids.package_name(spec).alias("package"))


@query("SELECT doc_id, lower(CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.' || lang END) AS ext, CASE WHEN doc_id % 3 = 0 THEN '.' || lang ELSE 'f' || doc_id || '.' || upper(lang) END AS base, source AS folder, doc_id % 5 = 0 AS test FROM documents")
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents")
    base = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("."), "lang")).otherwise(F.concat(F.lit("f"), "doc_id", F.lit("."), F.upper("lang")))
    path = F.concat("source", F.lit("/"), base)
    marked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a/tests/"), path)).otherwise(path)
    return d.select("doc_id", ids.extname(path).alias("ext"), ids.basename(path).alias("base"), ids.dirname(path).alias("folder"), ids.is_test_path(marked).alias("test"))


@query(O.values("expected", X.EXPECTED_CALLS, "path, seq, callee_name, target_id, tier, confidence", "SELECT path, seq, target_id, tier, confidence::DOUBLE AS confidence FROM expected"))
def call_resolution(spark: SparkSession, sf: str) -> DataFrame:
    files, imports, symbols, calls = X.facts(spark)
    bound = resolve.bindings(resolve.resolve_specifiers(imports, files))
    return resolve.resolve_calls(calls, symbols, bound).select("path", "seq", "target_id", "tier", F.col("confidence").cast("double").alias("confidence"))


@query(O.values("expected", X.EXPECTED_BINDINGS, "path, local, target, imported", "SELECT * FROM expected"))
def binding_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    files, imports, _, _ = X.facts(spark)
    return resolve.bindings(resolve.resolve_specifiers(imports, files)).select("path", "local", "target", "imported")


@query(O.values("expected", X.EXPECTED_EDGES, "kind, from_id, to_id, line", "SELECT kind, from_id, to_id, line::INT AS line FROM expected"))
def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    files, imports, symbols, calls = X.facts(spark)
    _, edges, _ = resolve.resolve(files, imports, symbols, calls)
    return edges.filter("kind <> 'DEFINES'").select("kind", "from_id", "to_id", "line")


@query(O.values("expected", X.EXPECTED_STATS, "files, functions, classes, imports, calls, resolved_calls, inferred_calls, unknown_calls, external_modules", "SELECT * FROM expected"))
def resolve_stats(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve(*X.facts(spark))[2].select("files", "functions", "classes", "imports", "calls", "resolved_calls", "inferred_calls", "unknown_calls", "external_modules")


@query(O.values("expected", X.EXPECTED_SYMBOLS, "path, qualified_name, kind, start_line, end_line, is_exported, complexity", "SELECT * FROM expected"))
def parse_sources(spark: SparkSession, sf: str) -> DataFrame:
    files = source.describe(X.frame(spark, X.SOURCES, "path string, content string"), "sample")
    _, _, symbols, _ = registry.facts(registry.parse(files))
    return symbols.select("path", "qualified_name", "kind", "start_line", "end_line", "is_exported", "complexity")


@query(O.values("expected", X.EXPECTED_GRAPH, "kind, from_id, to_id, resolution, confidence, line", "SELECT * REPLACE (confidence::DOUBLE AS confidence) FROM expected"))
def parse_graph(spark: SparkSession, sf: str) -> DataFrame:
    files = source.describe(X.frame(spark, X.SOURCES, "path string, content string"), "sample")
    nodes, edges, _ = resolve.resolve(*registry.facts(registry.parse(files)))
    return edges.select("kind", "from_id", "to_id", "resolution", "confidence", "line")


# retrieval


@query(O.files(f"SELECT doc_id, array_to_string(list_sort(list_distinct({O.tokens('content')})), ' ') AS terms FROM files"))
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return A.files(spark, sf).select("doc_id", F.array_join(F.array_sort(T.tokens(F.col("content"))), " ").alias("terms"))


@query(O.files(f"t AS (SELECT DISTINCT unnest({O.tokens('content')}) AS term FROM files)", f"SELECT term, {O.stem('term')} AS stem FROM t"))
def stem(spark: SparkSession, sf: str) -> DataFrame:
    t = A.files(spark, sf).select(F.explode(T.tokens(F.col("content"))).alias("term")).distinct()
    return t.select("term", T.stem(F.col("term")).alias("stem"))


@query(O.windows("SELECT id, start_line, end_line, length(text) AS chars FROM chunks"))
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.window_chunks(A.files(spark, sf), window=O.WINDOW).select("id", "start_line", "end_line", F.length("text").cast("long").alias("chars"))


@query(O.windows(O.POSTINGS, "SELECT count(*) AS postings, count(DISTINCT id) AS chunks, count(DISTINCT term) AS terms FROM postings"))
def postings(spark: SparkSession, sf: str) -> DataFrame:
    p = retrieval.postings(retrieval.index(retrieval.window_chunks(A.files(spark, sf), window=O.WINDOW)))
    return p.agg(F.count("*").alias("postings"), F.count_distinct("id").alias("chunks"), F.count_distinct("term").alias("terms"))


@query(O.windows(O.POSTINGS, "SELECT term, count(*) AS df FROM postings GROUP BY term"))
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.document_frequency(retrieval.postings(retrieval.index(retrieval.window_chunks(A.files(spark, sf), window=O.WINDOW))))


@query(O.windows(O.POSTINGS, f"SELECT stem, id, count(*) AS tf FROM (SELECT {O.stem('term')} AS stem, term, id FROM postings) WHERE stem <> term GROUP BY stem, id"))
def stem_postings(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.stem_postings(retrieval.postings(retrieval.index(retrieval.window_chunks(A.files(spark, sf), window=O.WINDOW))))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of searches: benchmark items whose id is divisible by 100."""
    return A.table(spark, sf, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


@query(O.bm25("SELECT query_id, id, round(score, 6) AS score, matched::BIGINT AS matched, rank FROM ranked WHERE rank <= 8"))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    idx = retrieval.index(retrieval.window_chunks(A.files(spark, sf), window=O.WINDOW), "path", "symbol_name")
    return retrieval.bm25(idx, _questions(spark, sf)).select("query_id", "id", F.round("score", 6).alias("score"), "matched", F.col("rank").cast("long").alias("rank"))


@query(O.bm25("SELECT query_id, count(*) AS hits, round(sum(score), 3) AS score FROM ranked GROUP BY query_id"))
def bm25_all(spark: SparkSession, sf: str) -> DataFrame:
    idx = retrieval.index(retrieval.window_chunks(A.files(spark, sf), window=O.WINDOW), "path", "symbol_name")
    return retrieval.bm25(idx, _questions(spark, sf), None).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.sum("score"), 3).alias("score"))


@query(O.bm25("SELECT query_id, id, round(score, 6) AS score, rank, matched || '/' || (SELECT len(q.terms) FROM q WHERE q.query_id = ranked.query_id) || ' query terms matched' || CASE WHEN by_name THEN '; symbol name matches a query term' ELSE '' END || CASE WHEN by_path THEN '; file path matches a query term' ELSE '' END AS reasons FROM ranked WHERE rank <= 8", O.SYMBOL))
def bm25_boosted(spark: SparkSession, sf: str) -> DataFrame:
    parts = retrieval.window_chunks(A.files(spark, sf), window=O.WINDOW).withColumn("symbol_name", F.regexp_extract("text", "[A-Za-z]+", 0))
    parts = parts.withColumn("searchable", retrieval.searchable(F.col("path"), F.lit(None).cast("string"), F.col("symbol_name"), F.col("text")))
    ranked = retrieval.bm25(retrieval.index(parts, "path", "symbol_name"), _questions(spark, sf))
    return ranked.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), F.array_join("reasons", "; ").alias("reasons"))


@query(O.windows(O.POSTINGS, "SELECT (SELECT count(*) FROM chunks) AS chunks, round((SELECT count(*) FROM postings) / (SELECT count(*) FROM chunks), 6) AS average_length, (SELECT count(DISTINCT term) FROM postings) AS terms"))
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    idx = retrieval.index(retrieval.window_chunks(A.files(spark, sf), window=O.WINDOW))
    return retrieval.index_stats(idx).select("chunks", F.round("average_length", 6).alias("average_length"), "terms")


@query("SELECT vec_id, label, len(embedding)::BIGINT AS n FROM embeddings")
def with_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings")
    parts = e.select(F.col("vec_id").alias("id"), "label")
    return retrieval.with_embeddings(parts, e.select(F.col("vec_id").alias("id"), "embedding")).select(F.col("id").alias("vec_id"), "label", F.size("embedding").cast("long").alias("n"))


@query(O.values("pairs", X.TERM_PAIRS, "a, b, expected", "SELECT a, b, expected AS hit FROM pairs"))
def term_match(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame(spark, X.TERM_PAIRS, "a string, b string, expected boolean").select("a", "b", T.terms_match(F.col("a"), F.col("b")).alias("hit"))


@query(O.COSINE + "SELECT query_id, vec_id, round(similarity, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 20")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    v, q = _vectors(spark, sf)
    best = retrieval.top(retrieval.similar(v, q).withColumnRenamed("similarity", "score"), 20)
    return best.select("query_id", F.col("id").alias("vec_id"), F.round("score", 5).alias("similarity"))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those that are queries: every row whose id is divisible by 100."""
    v = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return v, v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding", F.col("label").alias("q_label"))


@query(O.COSINE + ", lex AS (SELECT query_id, vec_id, 1 + vec_id % 7 AS score FROM embeddings JOIN q ON label = q_label), m AS (SELECT query_id, max(score) AS most FROM lex GROUP BY query_id), b AS (SELECT query_id, vec_id, CASE WHEN score IS NOT NULL THEN score / most + 0.35 * similarity WHEN similarity > 0.2 THEN 0.35 * similarity END AS score FROM s LEFT JOIN lex USING (query_id, vec_id) JOIN m USING (query_id)) SELECT query_id, vec_id, round(score, 5) AS score FROM b WHERE score IS NOT NULL")
def hybrid_blend(spark: SparkSession, sf: str) -> DataFrame:
    v, q = _vectors(spark, sf)
    lex = v.join(F.broadcast(q.select("query_id", F.col("q_label").alias("label"))), "label").select("query_id", "id", (1 + F.col("id") % 7).cast("double").alias("score"))  # hits: vectors with the query's label
    return retrieval.blend(lex, v, q).select("query_id", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


@query(O.bm25("SELECT query_id, rank, path, start_line, end_line, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || chr(10) || '... (truncated)' ELSE text END AS excerpt FROM ranked JOIN chunks USING (id) WHERE rank <= 6"))
def assistant_citations(spark: SparkSession, sf: str) -> DataFrame:
    parts = retrieval.window_chunks(A.files(spark, sf), window=O.WINDOW)
    hits = retrieval.bm25(retrieval.index(parts, "path", "symbol_name"), _questions(spark, sf), assistant.clamp(None))
    return assistant.citations(hits, parts).select("query_id", F.col("rank").cast("long").alias("rank"), "path", "start_line", "end_line", "excerpt")


# quality


@query(O.files("SELECT doc_id, " + O.complexity("content") + " AS complexity FROM files"))
def complexity_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.files(spark, sf).select("doc_id", T.complexity(F.col("content")).cast("long").alias("complexity"))


@query(O.files("SELECT doc_id, md5(" + O.normalized("content") + ") AS norm FROM files"))
def normalize_body(spark: SparkSession, sf: str) -> DataFrame:
    return A.files(spark, sf).select("doc_id", F.md5(T.normalize_body(F.col("content")).cast("binary")).alias("norm"))


_FINDING = ("id", "kind", "severity", "metric")


@query(O.metrics("SELECT 'complexity:' || id AS id, 'high-complexity' AS kind, CASE WHEN complexity > 30 THEN 'high' ELSE 'medium' END AS severity, complexity::DOUBLE AS metric FROM n WHERE complexity > 15"))
def q_high_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return quality.high_complexity(A.metrics_nodes(spark, sf)).select(*_FINDING)


@query(O.metrics("SELECT 'length:' || id AS id, 'long-function' AS kind, CASE WHEN lines > 160 THEN 'high' ELSE 'low' END AS severity, lines::DOUBLE AS metric FROM n WHERE lines > 80"))
def q_long(spark: SparkSession, sf: str) -> DataFrame:
    return quality.long_functions(A.metrics_nodes(spark, sf)).select(*_FINDING)


@query(O.metrics("c AS (SELECT 'p' || l_partkey AS id, count(*) AS d FROM lineitem GROUP BY l_partkey HAVING count(*) > 25)", "SELECT 'coupling:' || id AS id, 'high-coupling' AS kind, 'medium' AS severity, d::DOUBLE AS metric FROM n JOIN c USING (id)"))
def q_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return quality.high_coupling(A.metrics_nodes(spark, sf), _part_edges(spark, sf)).select(*_FINDING)


def _part_edges(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), F.lit("CALLS").alias("kind"))


@query(O.metrics("u AS (SELECT DISTINCT 'p' || l_partkey AS id FROM lineitem WHERE l_quantity < 5)", "SELECT 'dead:' || id AS id, 'dead-code' AS kind, 'low' AS severity, CAST(NULL AS DOUBLE) AS metric FROM n ANTI JOIN u USING (id) WHERE NOT is_exported AND NOT is_test"))
def q_dead(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem")
    e = li.select(F.concat(F.lit("o"), "l_orderkey").alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), F.when(F.col("l_quantity") < 5, "CALLS").otherwise("DEFINES").alias("kind"))
    return quality.dead_code(A.metrics_nodes(spark, sf), e).select(*_FINDING)


@query("SELECT 'fanout:f' || s_nationkey AS id, 'many-dependencies' AS kind, 'medium' AS severity, n::DOUBLE AS metric FROM (SELECT s_nationkey, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey HAVING count(DISTINCT l_partkey) > 30)")
def q_fanout(spark: SparkSession, sf: str) -> DataFrame:
    s = A.table(spark, sf, "supplier")
    e = A.table(spark, sf, "lineitem").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.select(F.concat(F.lit("f"), "s_nationkey").alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), F.lit("IMPORTS").alias("kind")).distinct()
    nodes = s.select("s_nationkey").distinct().select(F.concat(F.lit("f"), "s_nationkey").alias("id"), F.lit("File").alias("kind"), F.col("s_nationkey").cast("string").alias("name"), F.col("s_nationkey").cast("string").alias("path"))
    return quality.many_dependencies(nodes, e).select(*_FINDING)


@query(O.DUPLICATES)
def q_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as bodies; those of one source lie in one path, and never pair."""
    d = A.files(spark, sf).select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), F.element_at(F.split("path", "/"), 1).alias("path"), F.col("content").alias("body"))
    return quality.duplicates(d).select("a", "b", F.round("score", 6).alias("score"))


@query(f"SELECT 'cycle:' || replace(ids, ',', '|') AS id, 'circular-import' AS kind, CASE WHEN size > 3 THEN 'high' ELSE 'medium' END AS severity, size::DOUBLE AS metric FROM ({O.SCC})")
def q_circular(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _supplier_graph(spark, sf)
    return quality.circular_imports(graph.cycles(nodes, edges)).select(*_FINDING)


@query(O.HOTSPOTS)
def q_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    n = A.metrics_nodes(spark, sf)
    found = quality.high_complexity(n).unionByName(quality.long_functions(n))
    return quality.hotspots(found).select("path", "score", F.array_join("kinds", ",").alias("kinds"))


@query(O.SUMMARY)
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = A.metrics_nodes(spark, sf)
    return quality.summary(n, quality.high_complexity(n).unionByName(quality.long_functions(n)))


# secrets


@query(O.SECRETS)
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(A.files(spark, sf)).select("path", F.col("line").cast("long").alias("line"), "kind", "severity", "fingerprint")


@query(O.files("SELECT doc_id, " + O.redacted("content") + " AS text FROM files"))
def secret_redact(spark: SparkSession, sf: str) -> DataFrame:
    return A.files(spark, sf).select("doc_id", secrets.redact(F.col("content")).alias("text"))


@query(O.values("v", X.PLACEHOLDERS, "value, expected", "SELECT value, expected AS placeholder FROM v"))
def placeholder_filter(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame(spark, X.PLACEHOLDERS, "value string, expected boolean").select("value", secrets.is_placeholder(F.col("value")).alias("placeholder"))


@query(O.values("v", X.SECRET_HITS, "path, line, kind", "SELECT path, line::INT AS line, kind FROM v"))
def secret_rules(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(X.frame(spark, X.SECRET_FILES, "path string, content string")).select("path", "line", "kind")


# jobs


@query(O.jobs("SELECT job_id, event_seq, status, attempt FROM latest"))
def job_latest(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.latest(A.job_events(spark, sf)).select("job_id", "event_seq", "status", "attempt")


@query(O.jobs("SELECT job_id, created_at FROM latest ORDER BY created_at DESC, job_id"))
def job_list(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.listing(A.job_events(spark, sf)).select("job_id", "created_at")


@query(O.jobs("t AS (SELECT greatest(0, count(*) - 100) AS surplus FROM latest), g AS (SELECT job_id, row_number() OVER (ORDER BY coalesce(finished_at, 0), created_at, job_id) AS n FROM latest WHERE status IN ('completed', 'failed', 'cancelled'))", "SELECT job_id FROM latest WHERE job_id NOT IN (SELECT job_id FROM g, t WHERE n <= surplus)"))
def job_prune(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.pruned(A.job_events(spark, sf), 100).select("job_id")


@query(O.jobs("SELECT job_id, attempt, event_seq, status, duration FROM durations"))
def job_durations(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.durations(A.job_events(spark, sf))


@query(O.jobs("SELECT status, count(*) AS n FROM latest GROUP BY status"))
def job_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.latest(A.job_events(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


_TOTALS = "(SELECT count(*) FROM durations) AS finished, (SELECT arg_max(duration, event_seq) FROM durations) AS last_ms, (SELECT floor(avg(duration) + 0.5)::BIGINT FROM durations) AS average_ms, (SELECT max(duration) FROM durations) AS max_ms"


@query(O.jobs("SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, (SELECT count(DISTINCT job_id) FROM jobs WHERE status = 'queued') AS total, " + _TOTALS + " FROM latest"))
def job_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.metrics(A.job_events(spark, sf))


@query(O.jobs("SELECT count(*) FILTER (status IN ('queued', 'running')) AS active FROM latest"))
def job_active(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.active_count(A.job_events(spark, sf))


@query(O.jobs("SELECT " + _TOTALS))
def job_stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return stream.run_to_end(spark, f"{sf}/events.parquet", A.adapt_events)


# requests and views


@query(O.URLS)
def url_validate(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "pages")
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    known = F.when(host.rlike(r"\.example\.(com|org|net)$"), F.regexp_replace("url", "^([a-z]+)://[^/?#]*", "$1://github.com")).otherwise(F.col("url"))
    return p.select("page_id", validate.parse_repo_url(known).alias("r")).select("page_id", "r.owner", "r.repo", "r.error")


@query(O.values("v", X.URLS, "url, repo_id, error", "SELECT * FROM v"))
def url_rules(spark: SparkSession, sf: str) -> DataFrame:
    r = X.frame(spark, X.URLS, "url string, repo_id string, error string").select("url", validate.parse_repo_url(F.col("url")).alias("r"))
    return r.select("url", F.when(F.col("r.error").isNull(), validate.repo_id(F.col("r.owner"), F.col("r.repo"))).alias("repo_id"), "r.error")


@query("SELECT doc_id, source || '|' || lang AS items FROM documents")
def csv_list(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit(" "), "source", F.lit(" , ,"), "lang", F.lit(","))
    return A.table(spark, sf, "documents").select("doc_id", F.array_join(validate.split_list(text), "|").alias("items"))


@query(O.graph("s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT id FROM nodes WHERE repo_id = 'r1' ORDER BY kind, path NULLS LAST, start_line NULLS LAST, id LIMIT 300))", "SELECT id, (i % 5 * 250)::BIGINT AS x, (i // 5 * 150)::BIGINT AS y FROM s"))
def view_grid(spark: SparkSession, sf: str) -> DataFrame:
    return views.grid(store.slice_nodes(A.nodes(spark, sf), "r1")).select("id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(O.graph("SELECT direction, e.kind, other, coalesce(n.name, other) AS label FROM (SELECT 'outgoing' AS direction, kind, to_id AS other FROM edges WHERE from_id = 'file:3' UNION ALL SELECT 'incoming', kind, from_id FROM edges WHERE to_id = 'file:3') e LEFT JOIN nodes n ON n.id = other"))
def view_details(spark: SparkSession, sf: str) -> DataFrame:
    return views.details(A.nodes(spark, sf), A.edges(spark, sf), "file:3")


@query(O.graph("s AS (SELECT id FROM nodes WHERE repo_id = 'r1' AND kind IN ('File', 'Function') ORDER BY kind, path NULLS LAST, start_line NULLS LAST, id LIMIT 900)", "SELECT e.id, CASE WHEN from_id = 'file:3' OR to_id = 'file:3' THEN 1.0 ELSE 0.2 END::DOUBLE AS opacity, CASE WHEN kind = 'IMPORTS' THEN '#3b82f6' ELSE '#10b981' END AS colour FROM edges e WHERE from_id IN (SELECT id FROM s) AND to_id IN (SELECT id FROM s)"))
def view_edges(spark: SparkSession, sf: str) -> DataFrame:
    n = store.slice_nodes(A.nodes(spark, sf), "r1", 900, ["File", "Function"])
    return views.highlight(n, views.present_edges(A.edges(spark, sf), n), "file:3")[1].select("id", "opacity", "colour")
