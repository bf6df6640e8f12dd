"""The driver's tables seen as files, a graph, function metrics and job events; each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import materialise

REPO = "r1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: (repo_id, path, language, content, content_hash)."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.lit(REPO).alias("repo_id"), path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), "doc_id")


FILES_SQL = "files AS (SELECT 'r1' AS repo_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS language, text AS content, sha256(text) AS content_hash, doc_id FROM documents)"


NODE_COLUMNS = ("repo_id", "id", "kind", "name", "path", "language", "qualified_name", "start_line", "end_line", "complexity", "is_exported", "is_test")

#: One SELECT for each kind of node; both engines read them.
_NODES = (
    "SELECT CASE WHEN n_regionkey = 4 THEN 'r2' ELSE 'r1' END AS repo_id, concat('file:', n_nationkey) AS id, 'File' AS kind, n_name AS name, concat('r', n_regionkey, '/n', n_nationkey, '.ts') AS path, 'typescript' AS language, "
    "CAST(NULL AS VARCHAR(1)) AS qualified_name, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, CAST(NULL AS INT) AS complexity, CAST(NULL AS BOOLEAN) AS is_exported, CAST(NULL AS BOOLEAN) AS is_test FROM nation",
    "SELECT CASE WHEN n_regionkey = 4 THEN 'r2' ELSE 'r1' END, concat('class:', s_suppkey), 'Class', s_name, concat('r', n_regionkey, '/n', n_nationkey, '.ts'), 'typescript', s_name, 1, 10, 1, s_acctbal > 0, false FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "SELECT CASE WHEN n_regionkey = 4 THEN 'r2' ELSE 'r1' END, concat('fn:', c_custkey), 'Function', c_name, concat('r', n_regionkey, '/n', n_nationkey, '.ts'), 'typescript', c_name, CAST(c_custkey % 500 + 1 AS INT), "
    "CAST(c_custkey % 500 + 1 + c_custkey % 200 AS INT), CAST(c_custkey % 40 AS INT), c_mktsegment = 'BUILDING', c_acctbal < 0 FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "SELECT CASE WHEN n_regionkey = 4 THEN 'r2' ELSE 'r1' END, concat('m:', o_orderkey), 'Method', concat('order', o_orderkey), concat('r', n_regionkey, '/n', n_nationkey, '.ts'), 'typescript', concat(c_name, '.order', o_orderkey), CAST(o_orderkey % 1000 + 1 AS INT), "
    "CAST(o_orderkey % 1000 + 20 AS INT), CAST(o_orderkey % 25 AS INT), o_orderstatus = 'F', false FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "SELECT 'r1', concat('if:', p_partkey), 'Interface', p_name, concat('parts/', p_brand, '.ts'), 'typescript', p_name, 1, CAST(p_size AS INT), 1, true, false FROM part",
    "SELECT DISTINCT 'r1', concat('external:', p_type), 'ExternalModule', p_type, CAST(NULL AS VARCHAR(1)), CAST(NULL AS VARCHAR(1)), CAST(NULL AS VARCHAR(1)), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN) FROM part",
)
_REPO = "CASE WHEN n_regionkey = 4 THEN 'r2' ELSE 'r1' END"
_EDGES = (
    f"SELECT {_REPO} AS repo_id, 'DEFINES' AS kind, concat('file:', n_nationkey) AS from_id, concat('fn:', c_custkey) AS to_id, 'resolved' AS resolution, 1.0 AS confidence, 1 AS line FROM customer JOIN nation ON c_nationkey = n_nationkey",
    f"SELECT {_REPO}, 'DEFINES', concat('file:', n_nationkey), concat('class:', s_suppkey), 'resolved', 1.0, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    f"SELECT {_REPO}, 'CALLS', concat('fn:', c_custkey), concat('m:', o_orderkey), 'resolved', 0.95, CAST(o_orderkey % 100 AS INT) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "SELECT 'r1', 'CALLS', concat('m:', l_orderkey), concat('if:', l_partkey), CASE WHEN f = 'N' THEN 'resolved' WHEN f = 'A' THEN 'inferred' ELSE CAST(NULL AS VARCHAR(1)) END, CASE WHEN f = 'N' THEN 1.0 WHEN f = 'A' THEN 0.5 ELSE CAST(NULL AS DOUBLE) END, n "
    "FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_partkey) AS l",
    "SELECT 'r1', 'IMPORTS', concat('file:', l_suppkey % 25), concat('external:', p_type), 'resolved', 1.0, 1 FROM (SELECT DISTINCT s_suppkey AS l_suppkey, p_type FROM supplier JOIN part ON p_partkey % 10 = s_suppkey % 10) AS x GROUP BY l_suppkey % 25, p_type",
)


_stored: dict[tuple[str, str, str], DataFrame] = {}


def _store(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    """The graph is stored once a session, as queries expect to find it, ordered by what they filter on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = materialise(_sql(spark, sf_dir, text).sortWithinPartitions("repo_id", "kind"), name)
    return _stored[key]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "nodes", " UNION ALL ".join(_NODES).replace("VARCHAR(1)", "STRING"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = " UNION ALL ".join(_EDGES).replace("VARCHAR(1)", "STRING")
    return _store(spark, sf_dir, "edges", f"SELECT repo_id, concat(from_id, '-', kind, '->', to_id) AS id, kind, from_id, to_id, resolution, CAST(confidence AS DOUBLE) AS confidence, CAST(line AS INT) AS line FROM ({text})")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL over the driver's tables; each name in it is replaced by its own table, so that nothing is registered in the session."""
    import re

    used = [n for n in ("nation", "supplier", "customer", "orders", "part", "lineitem", "events", "documents", "pages") if re.search(rf"\b{n}\b", text)]
    text = re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in used})


GRAPH_SQL = (
    "nodes AS (" + " UNION ALL ".join(_NODES).replace("VARCHAR(1)", "VARCHAR") + "), "
    "edges AS (SELECT repo_id, concat(from_id, '-', kind, '->', to_id) AS id, kind, from_id, to_id, resolution, CAST(confidence AS DOUBLE) AS confidence, CAST(line AS INT) AS line FROM (" + " UNION ALL ".join(_EDGES).replace("VARCHAR(1)", "VARCHAR") + "))"
)


def metrics_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as functions: complexity p_size, lines from the price, flags from brand and type."""
    return _sql(spark, sf_dir, METRICS_SELECT)


METRICS_SELECT = (
    "SELECT 'r1' AS repo_id, concat('p', p_partkey) AS id, 'Function' AS kind, p_name AS name, concat('src/', p_brand, '.ts') AS path, CAST(p_size AS INT) AS complexity, 1 AS start_line, "
    "CAST(floor((p_retailprice - 900) * 2) AS INT) AS end_line, p_brand LIKE '%1' AS is_exported, p_type LIKE 'S%' AS is_test FROM part"
)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_events(table(spark, sf_dir, "events"))


def adapt_events(events: DataFrame) -> DataFrame:
    """events as snapshots of jobs: a user is a job, an event a snapshot."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "view", "running").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("cancelled")
    taken = F.floor(F.col("value") * 10).cast("long")
    base = F.col("event_id") * 1000
    return events.select(
        F.col("event_id").alias("event_seq"), F.col("user_id").alias("job_id"), status.alias("status"), F.pmod("event_id", F.lit(3)).cast("int").alias("attempt"), base.alias("created_at"),
        F.when(F.col("event_id") % 5 > 0, base + 10).alias("started_at"), F.when(kind.isin("purchase", "error", "click"), base + taken).alias("finished_at"),
    )


JOBS_SQL = (
    "jobs AS (SELECT event_id AS event_seq, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status, "
    "(event_id % 3)::INT AS attempt, event_id * 1000 AS created_at, CASE WHEN event_id % 5 > 0 THEN event_id * 1000 + 10 END AS started_at, "
    "CASE WHEN event_type IN ('purchase', 'error', 'click') THEN event_id * 1000 + floor(value * 10)::BIGINT END AS finished_at FROM events)"
)
