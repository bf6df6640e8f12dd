"""SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

from ..functions.text import STOP_WORDS, SUFFIXES
from . import adapters as A

WINDOW = 20


def _with(*parts: str) -> str:
    *ctes, last = parts
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + last


def graph(*parts: str) -> str:
    return _with(A.GRAPH_SQL, *parts)


def files(*parts: str) -> str:
    return _with(A.FILES_SQL, *parts)


def metrics(*parts: str) -> str:
    n = f"n AS (SELECT *, CASE WHEN start_line > 0 AND end_line > 0 THEN greatest(1, end_line - start_line + 1) ELSE 0 END AS lines FROM ({A.METRICS_SELECT}))"
    return _with(n, *parts)


def jobs(*parts: str) -> str:
    latest = "latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_seq DESC) = 1)"
    done = (
        "durations AS (SELECT job_id, attempt, event_seq, status, greatest(0, finished_at - coalesce(started_at, created_at)) AS duration FROM jobs "
        "WHERE status IN ('completed', 'failed', 'cancelled') AND attempt >= 1 QUALIFY row_number() OVER (PARTITION BY job_id, attempt ORDER BY event_seq) = 1)"
    )
    return _with(A.JOBS_SQL, latest, done, *parts)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(name: str, rows: list[tuple], columns: str, select: str) -> str:
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"WITH {name}({columns}) AS (VALUES {body}) {select}"


def neighborhood(depth: int, select: str) -> str:
    inner = "e AS (SELECT x.* FROM edges x JOIN nodes a ON a.repo_id = 'r1' AND a.id = x.from_id JOIN nodes b ON b.repo_id = 'r1' AND b.id = x.to_id WHERE x.repo_id = 'r1')"
    both = "both_ways AS (SELECT from_id AS a, to_id AS b FROM e UNION SELECT to_id, from_id FROM e)"
    steps = ["d0 AS (SELECT 'if:3' AS id)"] + [f"d{i} AS (SELECT DISTINCT b AS id FROM both_ways JOIN d{i - 1} ON a = d{i - 1}.id)" for i in range(1, depth)]
    near = "near AS (" + " UNION ".join(f"SELECT id FROM d{i}" for i in range(depth)) + ")"
    return graph(inner, both, *steps, near, "hit AS (SELECT DISTINCT id, kind, from_id, to_id FROM e WHERE from_id IN (SELECT id FROM near) OR to_id IN (SELECT id FROM near))", select)


def impact(origins: list[str], direction: str, depth: int, select: str) -> str:
    a, b = ("from_id", "to_id") if direction == "downstream" else ("to_id", "from_id")
    e = f"steps AS (SELECT x.{a} AS a, x.{b} AS b FROM edges x JOIN nodes m ON m.repo_id = 'r1' AND m.id = x.from_id JOIN nodes n ON n.repo_id = 'r1' AND n.id = x.to_id WHERE x.repo_id = 'r1' AND x.kind IN ('CALLS', 'IMPORTS', 'REEXPORTS', 'EXTENDS', 'IMPLEMENTS'))"
    seed = " UNION ".join(f"SELECT '{o}' AS origin, '{o}' AS node_id, 0 AS depth" for o in origins)
    reach = f"reach AS ({seed} UNION SELECT r.origin, s.b, r.depth + 1 FROM reach r JOIN steps s ON s.a = r.node_id WHERE r.depth < {depth})"
    text = graph(e, reach, select)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


CHANGE = files(
    "o AS (SELECT path || CASE WHEN doc_id % 7 = 0 THEN '.old' ELSE '' END AS path, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE content_hash END AS h, CASE WHEN doc_id % 11 = 0 THEN '0' ELSE '1' END AS v FROM files)",
    "c AS (SELECT path, content_hash FROM files)",
    "SELECT coalesce(o.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN o.path IS NULL OR o.h <> c.content_hash OR o.v <> '1' THEN 'changed' ELSE 'unchanged' END AS change FROM o FULL JOIN c ON o.path = c.path",
)

CERTAIN = graph(
    "s AS (SELECT x.to_id AS a, x.from_id AS b, coalesce(x.resolution = 'resolved', false) AS ok, x.id AS edge, n.name FROM edges x JOIN nodes n ON n.repo_id = 'r1' AND n.id = x.from_id JOIN nodes m ON m.repo_id = 'r1' AND m.id = x.to_id WHERE x.repo_id = 'r1' AND x.kind IN ('CALLS', 'IMPORTS'))",
    "l1 AS (SELECT b, ok, o.name || '>' || s.name AS path, row_number() OVER (ORDER BY edge) AS pos FROM s JOIN nodes o ON o.id = 'if:7' AND o.repo_id = 'r1' WHERE a = 'if:7' QUALIFY row_number() OVER (PARTITION BY b ORDER BY edge) = 1)",
    "l2 AS (SELECT s.b, l1.ok AND s.ok AS ok, l1.path || '>' || s.name AS path FROM l1 JOIN s ON s.a = l1.b WHERE s.b <> 'if:7' AND s.b NOT IN (SELECT b FROM l1) QUALIFY row_number() OVER (PARTITION BY s.b ORDER BY pos, edge) = 1)",
    "SELECT b AS node_id, 1 AS depth, ok AS certain, path FROM l1 UNION ALL SELECT b, 2, ok, path FROM l2",
)

SCC = (
    "WITH RECURSIVE t AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS a, (s_suppkey * s_suppkey + 1) % n AS b FROM supplier, t UNION SELECT s_suppkey, (3 * s_suppkey + 7) % n FROM supplier, t UNION SELECT 1, 1), "
    "r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), "
    "m AS (SELECT x.a AS node, min(x.b) AS scc, count(*) AS size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) "
    "SELECT count(*) AS size, string_agg(lpad(node::VARCHAR, 6, '0'), ',' ORDER BY lpad(node::VARCHAR, 6, '0')) AS ids FROM m GROUP BY scc HAVING count(*) <= 50"
)


def tokens(text: str) -> str:
    """A list of search terms (with repeats)."""
    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    raw = f"list_filter(regexp_split_to_array({text}, '[^A-Za-z0-9_]+'), lambda t: t <> '')"
    parts = "list_concat(list_concat([t], list_filter(regexp_split_to_array(t, '_+'), lambda p: length(p) >= 2)), string_split(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '))"
    return f"list_filter(list_transform(flatten(list_transform({raw}, lambda t: {parts})), lambda x: lower(x)), lambda x: length(x) >= 2 AND NOT list_contains({stop}, x))"


def stem(term: str) -> str:
    whens = " ".join(f"WHEN {term} LIKE '%{s}' AND length({term}) >= {5 + len(s)} THEN substr({term}, 1, length({term}) - {len(s)})" for s in SUFFIXES)
    return f"CASE WHEN length({term}) <= 5 THEN {term} {whens} ELSE {term} END"


def windows(*parts: str) -> str:
    chunks = (
        "r AS (SELECT path, regexp_split_to_array(content, '\\r?\\n') AS rows FROM files WHERE length(content) > 0), "
        f"w AS (SELECT path, rows, unnest(range(0, len(rows), {WINDOW})) AS base FROM r), "
        f"chunks AS (SELECT 'file:r1:' || path || ':' || (base + 1) AS id, path, (base + 1)::INT AS start_line, least(base + {WINDOW}, len(rows))::INT AS end_line, array_to_string(rows[base + 1 : base + {WINDOW}], chr(10)) AS text FROM w WHERE NOT regexp_full_match(array_to_string(rows[base + 1 : base + {WINDOW}], chr(10)), '\\s*'))"
    )
    return files(chunks, *parts)


POSTINGS = f"postings AS (SELECT id, unnest(terms) AS term, len(terms) AS size FROM (SELECT id, list_distinct({tokens(chr(112) + 'ath || ' + chr(39) + ' ' + chr(39) + ' || text')}) AS terms FROM chunks))"


#: The name of a window's symbol in bm25_boosted: its first word of letters.
SYMBOL = "regexp_extract(text, '[A-Za-z]+', 0)"


def bm25(select: str, symbol: str = "''") -> str:
    """Ranked windows; with a symbol, an expression over a chunk's text, names count as text and boost."""
    posts = POSTINGS.replace("path || ' ' || text", f"path || ' ' || {symbol} || ' ' || text")
    names = f"namehit AS (SELECT c.id, q.query_id FROM (SELECT id, list_distinct({tokens(symbol)}) AS pt FROM chunks) c, q WHERE EXISTS (SELECT 1 FROM (SELECT unnest(pt) AS x) a, (SELECT unnest(q.terms) AS y) b WHERE {_match('x', 'y')}))"
    return windows(
        posts,
        f"q AS (SELECT item_id AS query_id, list_distinct({tokens('text')}) AS terms FROM benchmark WHERE item_id % 100 = 0)",
        f"qt AS (SELECT query_id, term, {stem('term')} AS stem, {stem('term')} AS key FROM (SELECT query_id, unnest(terms) AS term FROM q))",
        "total AS (SELECT count(DISTINCT id) AS n FROM chunks), mean AS (SELECT sum(size) / count(*) AS m FROM (SELECT DISTINCT id, size FROM postings)), "
        "blank AS (SELECT count(*) AS z FROM chunks WHERE id NOT IN (SELECT id FROM postings)), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)",
        f"sp AS (SELECT stem, id, size, count(*) AS tf FROM (SELECT {stem('term')} AS stem, term, id, size FROM postings) WHERE stem <> term GROUP BY ALL)",
        "hits AS (SELECT query_id, qt.term, p.id, p.size, 1 AS tf FROM qt JOIN postings p ON p.term = qt.term UNION ALL SELECT query_id, qt.term, sp.id, sp.size, sp.tf FROM qt JOIN sp ON sp.stem = qt.stem WHERE NOT EXISTS (SELECT 1 FROM postings p WHERE p.term = qt.term AND p.id = sp.id))",
        "parts AS (SELECT query_id, id, greatest(0.05, ln(1 + (n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5))) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * size / (m * (n - z) / n))) AS part FROM hits LEFT JOIN df USING (term), total, mean, blank)",
        f"pathhit AS (SELECT c.id, q.query_id FROM (SELECT id, list_distinct({tokens('path')}) AS pt FROM chunks) c, q WHERE len(list_filter(q.terms, lambda t: length(t) >= 3)) > 0 AND EXISTS (SELECT 1 FROM (SELECT unnest(pt) AS x) a, (SELECT unnest(q.terms) AS y) b WHERE {_match('x', 'y')}))",
        names,
        "scored AS (SELECT p.query_id, p.id, sum(part) * CASE WHEN max(g.id) IS NOT NULL THEN 1.6 ELSE 1 END * CASE WHEN max(h.id) IS NOT NULL THEN 1.2 ELSE 1 END AS score, count(*) AS matched, max(g.id) IS NOT NULL AS by_name, max(h.id) IS NOT NULL AS by_path "
        "FROM parts p LEFT JOIN pathhit h ON h.id = p.id AND h.query_id = p.query_id LEFT JOIN namehit g ON g.id = p.id AND g.query_id = p.query_id GROUP BY p.query_id, p.id)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0)",
        select,
    )


def _match(a: str, b: str) -> str:
    x, y = stem(a), stem(b)
    short, long = f"CASE WHEN length({x}) <= length({y}) THEN {x} ELSE {y} END", f"CASE WHEN length({x}) <= length({y}) THEN {y} ELSE {x} END"
    return f"({a} = {b} OR ({x}) = ({y}) OR (length({short}) >= 5 AND starts_with({long}, {short})) OR (length({short}) >= 4 AND ({long}) = ({short}) || 's'))"


COSINE = (
    "WITH q AS (SELECT vec_id AS query_id, label AS q_label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), "
    "s AS (SELECT query_id, vec_id, CASE WHEN len(embedding) <> len(v) OR len(v) = 0 OR list_dot_product(v, v) = 0 OR list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 0 ELSE list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) END AS similarity FROM embeddings, q) "
)

_SPACE = "\\t\\n\\v\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def complexity(text: str) -> str:
    patterns = [f"\\bif[{_SPACE}]*\\(", f"\\bfor[{_SPACE}]*\\(", f"\\bwhile[{_SPACE}]*\\(", "\\bcase\\b", f"\\bcatch[{_SPACE}]*\\(", f"\\?[^:.\\n]+[{_SPACE}]*:", "(?:&&|\\|\\|)"]
    return "1 + " + " + ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in patterns)


def normalized(text: str) -> str:
    s = f"regexp_replace({text}, '//[^\\n\\r\\x{{2028}}\\x{{2029}}]*', '', 'g')"
    s = f"regexp_replace({s}, '/\\*(?s:.)*?\\*/', '', 'g')"
    s = f"regexp_replace({s}, '\"[^\"]*\"|''[^'']*''|`[^`]*`', '\"\"', 'g')"
    s = f"regexp_replace({s}, '[{_SPACE}]+', ' ', 'g')"
    return f"regexp_replace({s}, '^ | $', '', 'g')"


DUPLICATES = files(
    f"s AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, string_split(path, '/')[1] AS path, list_sort(list_distinct(list_filter(string_split({normalized('content')}, ' '), lambda t: t <> ''))) AS tokens FROM files WHERE length({normalized('content')}) > 120)",
    "g AS (SELECT tokens, len(tokens) AS size, min(id) AS first, arg_min(path, id) AS first_path FROM s WHERE len(tokens) > 0 GROUP BY tokens)",
    "reps AS (SELECT g.*, (SELECT min(id) FROM s WHERE s.tokens = g.tokens AND s.path <> g.first_path) AS second FROM g)",
    # every body is paired with the first of its class that lies in another path
    "copies AS (SELECT DISTINCT least(s.id, o) AS a, greatest(s.id, o) AS b FROM (SELECT s.id, CASE WHEN s.path <> r.first_path THEN r.first ELSE r.second END AS o FROM s JOIN reps r USING (tokens)) s WHERE o IS NOT NULL)",
    "p AS (SELECT first AS id, size, unnest(tokens) AS token FROM reps)",
    "c AS (SELECT x.id AS x, y.id AS y, count(*) / (x.size + y.size - count(*)) AS score FROM p x JOIN p y ON x.token = y.token AND x.id < y.id AND least(x.size, y.size) >= 0.85 * greatest(x.size, y.size) GROUP BY x.id, y.id, x.size, y.size)",
    "k AS (SELECT score, x.first AS xf, y.first AS yf, x.second AS xs, y.second AS ys, x.first_path <> y.first_path AS apart FROM c JOIN reps x ON x.first = c.x JOIN reps y ON y.first = c.y WHERE score >= 0.85)",
    "u AS (SELECT score, xf AS m, yf AS n FROM k WHERE apart UNION ALL SELECT score, xf, ys FROM k WHERE NOT apart UNION ALL SELECT score, xs, yf FROM k WHERE NOT apart)",
    "SELECT least(m, n) AS a, greatest(m, n) AS b, round(score, 6) AS score FROM u WHERE m IS NOT NULL AND n IS NOT NULL UNION ALL SELECT a, b, 1.0 FROM copies",
)

HOTSPOTS = metrics(
    "f AS (SELECT path, 'high-complexity' AS kind, CASE WHEN complexity > 30 THEN 3 ELSE 2 END AS w FROM n WHERE complexity > 15 UNION ALL SELECT path, 'long-function', CASE WHEN lines > 160 THEN 3 ELSE 1 END FROM n WHERE lines > 80)",
    "SELECT path, sum(w)::BIGINT AS score, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM f GROUP BY path ORDER BY score DESC, path LIMIT 20",
)

SUMMARY = metrics(
    "f AS (SELECT CASE WHEN complexity > 30 THEN 'high' ELSE 'medium' END AS s FROM n WHERE complexity > 15 UNION ALL SELECT CASE WHEN lines > 160 THEN 'high' ELSE 'low' END FROM n WHERE lines > 80)",
    "SELECT 0 AS files, count(*) AS functions, floor(avg(complexity) * 10 + 0.5) / 10 AS average_complexity, max(complexity) AS max_complexity, max(lines) AS longest_function, (SELECT count(*) FROM f) AS findings, "
    "(SELECT count(*) FROM f WHERE s = 'high') AS high, (SELECT count(*) FROM f WHERE s = 'medium') AS medium, (SELECT count(*) FROM f WHERE s = 'low') AS low, greatest(0, floor(100 - 3 * (SELECT count(*) FROM f WHERE s = 'high') + 0.5))::BIGINT AS health FROM n",
)

_ASSIGN = "(?i)(?:password|secret|token|api[_-]?key)[ \\t]*[:=][ \\t]*[\"''][^\"'']{8,}[\"'']"
SECRETS = files(
    "l AS (SELECT path, unnest(regexp_split_to_array(content, '\\r?\\n')) AS row, generate_subscripts(regexp_split_to_array(content, '\\r?\\n'), 1) AS line FROM files)",
    f"h AS (SELECT path, line, 'assignment' AS kind, 'medium' AS severity, unnest(regexp_extract_all(row, '{_ASSIGN}')) AS value FROM l WHERE length(row) < 4000 "
    "UNION ALL SELECT path, line, 'aws-access-key', 'high', unnest(regexp_extract_all(row, '\\bAKIA[A-Z0-9]{16}\\b')) FROM l WHERE length(row) < 4000)",
    "SELECT path, line::BIGINT AS line, kind, severity, substr(sha256(value), 1, 12) AS fingerprint FROM h WHERE NOT regexp_matches(value, '(?i)example|change[-_]?me|your[-_]|placeholder|xxx')",
)


def redacted(text: str) -> str:
    s = f"regexp_replace({text}, '\\bAKIA[A-Z0-9]{{16}}\\b', '[REDACTED aws-access-key]', 'g')"
    return f"regexp_replace({s}, '{_ASSIGN}', '[REDACTED assignment]', 'g')"


URLS = (
    "WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages), "
    "v AS (SELECT page_id, p[1] AS owner, regexp_replace(p[2], '(?i)\\.git$', '') AS repo, CASE WHEN scheme <> 'https' THEN 'Repository URL must use https' WHEN len(p) < 2 THEN 'Repository URL must include an owner and a repository name' "
    "WHEN len(p) > 2 AND coalesce(CASE p[3] WHEN 'tree' THEN 4 WHEN 'blob' THEN 5 WHEN 'commit' THEN 4 WHEN 'commits' THEN 4 WHEN 'releases' THEN 3 WHEN 'pull' THEN 4 WHEN 'issues' THEN 3 END, 0) <> len(p) THEN 'Repository URL must point at the repository root' "
    "WHEN NOT regexp_full_match(p[1], '[A-Za-z0-9][A-Za-z0-9-]{0,38}') THEN 'Repository owner contains invalid characters' WHEN NOT regexp_full_match(regexp_replace(p[2], '(?i)\\.git$', ''), '[A-Za-z0-9._-]{1,100}') THEN 'Repository name contains invalid characters' END AS error FROM u) "
    "SELECT page_id, CASE WHEN error IS NULL THEN owner END AS owner, CASE WHEN error IS NULL THEN repo END AS repo, error FROM v"
)
