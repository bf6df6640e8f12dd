"""Chunks of source files, an inverted index, BM25 ranking with boosts, and a blend with vector similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import materialise

#: BM25, floor of the inverse document frequency, boosts, and the weight and floor of vectors.
K1, B = 1.5, 0.75
IDF_FLOOR = 0.05
SYMBOL_BOOST, PATH_BOOST = 1.6, 1.2
VECTOR_WEIGHT, VECTOR_FLOOR = 0.35, 0.2
WINDOW, TOP = 120, 8
CHUNK_KINDS = ("Function", "Method", "Class", "Interface")


def searchable(path: Column, qualified: Column, name: Column, text: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (path, qualified, name, text)])


def symbol_chunks(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """A chunk for each symbol with a path and lines in a (non-empty) file."""
    n = nodes.filter(F.col("kind").isin(*CHUNK_KINDS) & (F.length("path") > 0) & (F.col("start_line") > 0) & (F.col("end_line") > 0))
    j = n.join(files.filter(F.length("content") > 0).select("repo_id", "path", "content", F.col("language").alias("file_language")), ["repo_id", "path"])
    end = F.least("end_line", F.size(T.lines(F.col("content"))))
    body = T.slice_lines(F.col("content"), F.col("start_line"), F.col("end_line"))
    return j.filter(end > F.col("start_line") - 1).select(
        F.concat("id", F.lit("#chunk")).alias("id"), "repo_id", "path", F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"), "kind", "start_line", F.col("end_line"), F.coalesce("language", "file_language").alias("language"),
        body.alias("text"), searchable(F.col("path"), F.col("qualified_name"), F.col("name"), body).alias("searchable"),
    )


def window_chunks(files: DataFrame, covered: DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """Windows of `window` lines of files that no symbol chunk covers; blank windows are left out."""
    f = files.select("repo_id", "path", "content")
    if covered is not None:
        f = f.join(covered.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")
    f = f.filter(F.length("content") > 0).withColumn("rows", T.lines(F.col("content")))
    f = f.select("repo_id", "path", "rows", F.explode(F.sequence(F.lit(0), F.size("rows") - 1, F.lit(window))).alias("at"))
    f = f.withColumn("text", F.array_join(F.slice("rows", F.col("at") + 1, window), "\n")).filter(~F.col("text").rlike(rf"^[{T.SPACE}]*$"))
    none = F.lit(None).cast("string")
    return f.select(
        F.concat(F.lit("file:"), "repo_id", F.lit(":"), "path", F.lit(":"), F.col("at") + 1).alias("id"), "repo_id", "path", none.alias("symbol_id"), none.alias("symbol_name"), F.lit("File").alias("kind"),
        (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + window, F.size("rows")).alias("end_line"), none.alias("language"), "text", searchable(F.col("path"), none, none, F.col("text")).alias("searchable"),
    )


def chunks(nodes: DataFrame, files: DataFrame, window: int = WINDOW) -> DataFrame:
    own = symbol_chunks(nodes, files)
    return own.unionByName(window_chunks(files, own, window))


def index(parts: DataFrame, *keep: str) -> DataFrame:
    """(id, keep..., terms): the distinct search terms of each chunk; stored, since every search reads it several times."""
    return materialise(parts.select("id", *keep, T.tokens(F.col("searchable")).alias("terms")), "index")


def postings(idx: DataFrame) -> DataFrame:
    """(term, id, tf, length): terms of chunks are distinct, so tf is 1."""
    return idx.select(F.explode("terms").alias("term"), "id", F.lit(1).alias("tf"), F.size("terms").alias("length"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def stem_postings(posts: DataFrame) -> DataFrame:
    """(stem, id, tf): how many terms of a chunk reduce to a stem other than themselves."""
    s = posts.select(T.stem(F.col("term")).alias("stem"), "term", "id").filter("stem <> term")
    return s.groupBy("stem", "id").agg(F.count("*").alias("tf"))


def index_stats(idx: DataFrame) -> DataFrame:
    one = idx.agg(F.count("*").alias("chunks"), F.coalesce(F.avg(F.size("terms")), F.lit(1.0)).alias("average_length"))
    terms = idx.select(F.explode("terms").alias("term")).agg(F.count_distinct("term").alias("terms"))
    return one.crossJoin(terms)  # two single rows


def bm25(idx: DataFrame, queries: DataFrame, limit: int | None = TOP) -> DataFrame:
    """(query_id, id, score, matched, terms, rank): chunks by BM25 with boosts. idx: (id, path, symbol_name, terms); queries: (query_id, text), a stated set.

    A query term hits a chunk that has it or, failing that, terms that reduce to its stem. Only terms of the queries are
    read from the postings: they meet them by equi-join, and scores are added up map-side before the shuffle.
    """
    q = queries.select("query_id", T.tokens(F.col("text")).alias("q_terms")).filter(F.size("q_terms") > 0)
    each = q.select("query_id", F.explode("q_terms").alias("term")).withColumn("stem", T.stem(F.col("term")))
    posts = postings(idx)
    total = idx.agg(F.count("*").alias("total"), F.coalesce(F.avg(F.size("terms")), F.lit(1.0)).alias("mean"))
    wanted = each.select("term").distinct()
    df = posts.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    raw = posts.join(each.select("query_id", "term"), "term").select("query_id", "term", "id", "length", "tf", F.lit(True).alias("raw"))
    stems = each.select("stem").distinct()
    by_stem = posts.select(T.stem(F.col("term")).alias("stem"), F.col("term").alias("own"), "id", "length").filter("stem <> own").join(stems, "stem", "left_semi")
    by_stem = by_stem.groupBy("stem", "id", "length").agg(F.count("*").alias("tf"))
    loose = by_stem.join(each, "stem").select("query_id", "term", "id", "length", F.col("tf").cast("int").alias("tf"), F.lit(False).alias("raw"))
    hits = raw.unionByName(loose).groupBy("query_id", "term", "id", "length").agg(F.max(F.struct("raw", "tf")).alias("x"))
    hits = hits.select("query_id", "term", "id", "length", "x.tf").join(df, "term", "left").crossJoin(F.broadcast(total))  # one row
    d = F.coalesce("df", F.lit(1))
    idf = F.greatest(F.lit(IDF_FLOOR), F.log(1 + (F.col("total") - d + 0.5) / (d + 0.5)))
    norm = 1 - B + B * F.col("length") / F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * norm)
    scored = hits.groupBy("query_id", "id").agg(F.sum(part).alias("base"), F.count("*").alias("matched")).filter("base > 0")
    stems_of = lambda c: F.transform(T.tokens(F.coalesce(c, F.lit(""))), T.stem)
    names = idx.select("id", stems_of("symbol_name").alias("name_stems"), stems_of("path").alias("path_stems"))
    terms = q.select("query_id", "q_terms", F.transform("q_terms", T.stem).alias("q_stems"), F.exists("q_terms", lambda t: F.length(t) >= 3).alias("strong"))
    full = scored.join(names, "id").join(terms, "query_id")
    by_name = T.any_stem_matches(F.col("name_stems"), F.col("q_stems"))
    by_path = F.col("strong") & T.any_stem_matches(F.col("path_stems"), F.col("q_stems"))
    full = full.withColumns({"by_name": by_name, "by_path": by_path})
    score = F.col("base") * F.when(F.col("by_name"), SYMBOL_BOOST).otherwise(1.0) * F.when(F.col("by_path"), PATH_BOOST).otherwise(1.0)
    reasons = F.array_compact(F.array(F.concat("matched", F.lit("/"), F.size("q_terms"), F.lit(" query terms matched")), F.when(F.col("by_name"), F.lit("symbol name matches a query term")), F.when(F.col("by_path"), F.lit("file path matches a query term"))))
    full = full.select("query_id", "id", score.alias("score"), "matched", F.size("q_terms").alias("terms"), reasons.alias("reasons"))
    return full if limit is None else top(full, limit)


def top(scored: DataFrame, limit: int = TOP) -> DataFrame:
    """The best `limit` rows of each query, with their rank; ties by id."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)  # Spark cuts each task to the group's limit first


def with_embeddings(parts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with the embedding of their id; an error if counts differ."""
    counts = parts.agg(F.count("*").alias("n")).crossJoin(vectors.agg(F.count("*").alias("v")))
    checked = counts.filter(F.assert_true(F.col("n") == F.col("v"), F.lit("embeddings and chunks differ in number")).isNull()).select(F.lit(True).alias("ok"))
    return parts.join(vectors, "id", "left").crossJoin(F.broadcast(checked)).filter("ok").drop("ok")  # one row


#: Query vectors that meet all vectors at once.
QUERY_BLOCK = 500


def similar(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, similarity) of every vector to each of a stated set of queries(query_id, embedding), which is taken in blocks."""
    v = vectors.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = queries.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    parts = [q] if blocks == 1 else [q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]
    return reduce(DataFrame.unionByName, [v.crossJoin(F.broadcast(part)).select("query_id", "id", T.cosine(F.col("v"), F.col("q")).alias("similarity")) for part in parts])


def blend(lexical: DataFrame, vectors: DataFrame, queries: DataFrame | None, weight: float = VECTOR_WEIGHT) -> DataFrame:
    """(query_id, id, score): lexical(query_id, id, score) over its query's maximum plus weighted similarity; vectors alone count from a similarity of 0.2.

    A lexical hit without a vector keeps its raw score; so does a query without a vector.
    """
    lexical = lexical.select("query_id", "id", "score")
    if queries is None:
        return lexical
    most = lexical.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(1e-9)).alias("most"))
    both = lexical.join(similar(vectors, queries), ["query_id", "id"], "full_outer").join(F.broadcast(most), "query_id", "left")  # a row for each query
    score = F.when(F.col("similarity").isNull(), F.col("score")).when(F.col("score").isNotNull(), F.col("score") / F.col("most") + weight * F.col("similarity")).when(F.col("similarity") > VECTOR_FLOOR, weight * F.col("similarity"))
    return both.select("query_id", "id", score.alias("score")).filter("score IS NOT NULL")
