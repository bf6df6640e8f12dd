"""Operators on small fixtures: parsing, resolution, incremental runs, cycles, retrieval, the queue."""

import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcloom.functions import text as T
from srcloom.operators import assistant, graph, jobs, quality, retrieval, secrets, store, validate, views
from srcloom.plans import fixtures as X
from srcloom.plans.analysis import Repository
from srcloom.sources import files as source
from srcloom.sources.parsers import registry


def parse(language, text):
    return registry.parse_text(language, "x", text)


def names(parsed):
    return [s["qualified_name"] for s in parsed["symbols"]]


def test_javascript_symbols():
    p = parse("javascript", "export class A extends B {\n  constructor(x) { super(x); }\n  static async go({ a }, [b], c = 1, ...d) { return this.run(c).map(f); }\n  h = () => call();\n}\nconst v = function () {};\nexport { v };\n")
    assert names(p) == ["A", "A.constructor", "A.go", "A.h", "v"]
    go = p["symbols"][2]
    assert go["parameters"] == ["{...}", "[...]", "c", "...d"] and go["is_async"] and go["is_exported"] and go["kind"] == "Method"
    assert not p["symbols"][4]["is_exported"]
    assert [(c["callee_name"], c["caller_qualified_name"]) for c in p["calls"]] == [("run", "A.go"), ("map", "A.go"), ("call", "A.h")]


def test_javascript_imports():
    p = parse("javascript", "import d, { a as b } from './m';\nimport * as n from 'pkg';\nimport 'node:fs';\nexport * from './all';\nconst q = require('q');\nimport type { T } from './t';\n")
    assert [(i["specifier"], i["default_binding"], i["namespace_binding"], i["is_reexport"], i["is_require"], i["is_type_only"]) for i in p["imports"]] == [
        ("./m", "d", None, False, False, False), ("pkg", None, "n", False, False, False), ("./all", None, None, True, False, False), ("q", None, None, False, True, False), ("./t", None, None, False, False, True),
    ]
    assert p["imports"][0]["bindings"] == [{"local": "b", "imported": "a"}]


def test_javascript_text_is_no_code():
    p = parse("javascript", "// f()\n/* g() */\nconst s = 'h()' + `i() ${j(1)} ${`${k()}`}`;\nconst r = /l()/g;\n")
    assert sorted(c["callee_name"] for c in p["calls"]) == ["j", "k"]


def test_broken_file_is_an_error_row(spark):
    rows = registry.parse(source.describe(X.frame(spark, X.SOURCES, "path string, content string"), "r")).select("path", "error").collect()
    assert {r["path"] for r in rows if r["error"]} == {"broken.js"}


@pytest.mark.parametrize(
    "language, text, want, specs",
    [
        ("python", "import os\nfrom .db import x as y\nclass Auth:\n    async def login(self, a, *b, **c):\n        pass\n", ["Auth", "Auth.login"], ["os", ".db"]),
        ("go", 'package m\nimport "fmt"\nfunc Add(a int) int { return fmt.Sum(a) }\nfunc (s *S) Greet() {}\n', ["Add", "Greet"], ["fmt", "fmt"]),
        ("java", "import a.B;\npublic class Service {\n  public String greet(String n) { return x.y(n); }\n}\n", ["Service", "Service.greet"], []),
        ("ruby", "require 'json'\nclass A\n  def b(x)\n    x if y\n  end\nend\n", ["A", "A.b"], ["json"]),
        ("rust", "pub struct S;\ntrait T { fn q(&self); }\nfn main() { go(); }\n", ["S", "T", "T.q", "main"], []),
        ("csharp", "using System;\nclass P { public void Run(int a) { W.L(a); } }\n", ["P", "P.Run"], []),
    ],
)
def test_other_languages(language, text, want, specs):
    p = parse(language, text)
    assert p["error"] is None and names(p) == want and [i["specifier"] for i in p["imports"]] == specs


def test_registry():
    assert registry.language_of(".TS") == "javascript" and registry.language_of("a/b.py") == "python"
    assert registry.language_of("a/.gitignore") is None and not registry.supports("x.json")


def test_discover(spark, tmp_path):
    for p, size in (("src/a.ts", 3), ("node_modules/x.js", 3), ("mybuild/b.py", 3), ("c.txt", 3), ("big.js", 1_500_001), ("at.js", 1_500_000)):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * size)
    assert {r["path"] for r in source.discover(spark, str(tmp_path)).collect()} == {"src/a.ts", "mybuild/b.py", "at.js"}


def test_read_files_as_they_are(spark, tmp_path):
    """Names that begin with _ or a dot, blanks and signs in names, and bytes that aren't UTF-8."""
    good = {"pkg/__init__.py": b"x = 1\n", "__tests__/a.js": b"f();\n", "_app.tsx": b"export const a = 1;\n", ".eslintrc.js": b"module.exports = {};\n", "a b/c%20d.js": b"g();\n", "bad.js": b"let a = '\xff\xfe';\n", "empty.js": b""}
    for p, text in {**good, ".git/hook.js": b"no();", "src/node_modules/x.js": b"no();"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text)
    (tmp_path / "link.js").symlink_to(tmp_path / "bad.js")
    got = {r["path"]: r for r in source.read(spark, str(tmp_path), "r").collect()}
    assert set(got) == set(good) == {r["path"] for r in source.discover(spark, str(tmp_path)).collect()}
    for p, text in good.items():
        assert got[p]["content"] == text.decode("utf-8", "replace")
    assert got["bad.js"]["content"] == "let a = '\ufffd\ufffd';\n"
    assert source.read(spark, str(tmp_path / ".git"), "r").count() == 1


def test_javascript_as_it_is_written():
    p = parse("javascript", "class A {\n  static { init(); }\n  one() { identity<string>(x); a < b; this.m.get<Map<string, number[]>>('k'); }\n  two() {}\n}\n")
    assert names(p) == ["A", "A.one", "A.two"] and [c["callee_name"] for c in p["calls"]] == ["init", "identity", "m.get"]
    text = "export function App() {\n  const [n] = useState(0);\n  return (\n    <div className=\"it's\" onClick={() => go(n)}>\n      <p>it's {label(n)} & more</p>\n      <Item {...rest} /> don't\n      <>{n ? <b>can't</b> : null}</>\n    </div>\n  );\n}\nexport function after() { last(); }\n"
    p = registry_parse("a.jsx", text)
    assert p["error"] is None and names(p) == ["App", "after"] and [(c["callee_name"], c["line"]) for c in p["calls"]] == [("useState", 2), ("go", 4), ("label", 5), ("last", 11)]
    assert names(registry_parse("a.tsx", "const id = <T extends object>(x: T) => x;\nconst two = <T,>(x: T) => f(x);\n")) == ["id", "two"]
    assert [c["callee_name"] for c in registry_parse("a.ts", "const y = <Foo>bar(x);\nif (a < b && c > (d)) { e(); }\n")["calls"]] == ["bar", "e"]


def registry_parse(path, text):
    return registry.parse_text("javascript", path, text)


def test_incremental_run(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/store")
    v1 = [("a.js", "export function one() {}\n"), ("b.js", "import { one } from './a.js';\nexport function two() { one(); }\n"), ("c.js", "export function three() {}\n")]
    frame = lambda rows: X.frame(spark, rows, "path string, content string")
    first = repo.analyse(frame(v1), "r")
    assert (first["changed"], first["resolved_calls"], first["imports"]) == (3, 1, 1)
    again = repo.analyse(frame(v1), "r")
    assert (again["changed"], again["unchanged"], again["calls"]) == (0, 3, 1)
    v2 = [("a.js", "export function uno() {}\n"), v1[1], ("d.js", "function ( {\n")]
    second = repo.analyse(frame(v2), "r")  # the unchanged importer is resolved anew
    assert (second["changed"], second["unchanged"], second["deleted"], second["errors"], second["resolved_calls"], second["unknown_calls"]) == (2, 1, 1, 1, 0, 1)
    third = repo.analyse(frame(v2), "r")  # a deletion is reported once; the broken file is tried again
    assert (third["deleted"], third["changed"]) == (0, 1)
    assert repo.analyse(frame(v2), "r", version="2")["unchanged"] == 0
    assert not repo.read("nodes", "r").filter("path = 'c.js'").collect()
    repo.clear("r")
    assert repo.read("nodes", "r") is None


def _graph(spark, edges, kind="IMPORTS"):
    ids = sorted({x for e in edges for x in e[:2]})
    n = X.frame(spark, [(i, i, "File", i, None, None) for i in ids], "id string, name string, kind string, path string, is_test boolean, is_exported boolean")
    e = X.frame(spark, [(f"{a}-{b}", a, b, kind, r[0] if r else "resolved") for a, b, *r in edges], "id string, from_id string, to_id string, kind string, resolution string")
    return n, e


def test_impact_directions_and_caps(spark):
    n, e = _graph(spark, [("b", "a", "resolved"), ("c", "b", "inferred"), ("d", "b", "resolved")], "CALLS")
    up = {r["node_id"]: (r["depth"], r["certain"]) for r in graph.impact(n, e, ["a"], "upstream").collect()}
    assert up == {"b": (1, True), "c": (2, False), "d": (2, True)}
    assert [r["node_id"] for r in graph.impact(n, e, ["c"], "downstream").orderBy("pos").collect()] == ["b", "a"]
    capped = graph.impact(n, e, ["a"], "upstream", max_nodes=2).collect()
    assert len(capped) == 2 and all(r["truncated"] for r in capped)
    assert graph.impact(n, e, ["zz"], "upstream").count() == 0


@pytest.mark.parametrize("local", [0, 1000])
def test_cycles(spark, local):
    pairs = [("x", "y"), ("y", "x"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("s", "s"), ("y", "a")]
    n, e = _graph(spark, pairs)
    assert [r["node_ids"] for r in graph.cycles(n, e).collect()] == [["a", "b", "c"], ["x", "y"], ["s"]]
    got = graph.components(e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), local)
    assert {(r["node"], r["scc"]) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert graph.cycles(n, e, cross_file_only=True).count() == 2 and graph.cycles(n, e, max_size=2).count() == 2


def test_quality_rules(spark):
    n = X.frame(spark, [("f", "f", "Function", "a.ts", 1, 200, 31, False, False), ("g", "g", "Method", "a.ts", 0, 5, None, True, None), ("h", "h", "Function", "t.ts", 1, 81, 16, None, None), ("file", "a.ts", "File", "a.ts", None, None, None, None, None)],
                "id string, name string, kind string, path string, start_line int, end_line int, complexity int, is_exported boolean, is_test boolean")
    e = X.frame(spark, [("f", "h", "CALLS")], "from_id string, to_id string, kind string")
    found = quality.ordered(quality.findings(n, e)).select("id", "severity").collect()
    assert [(r["id"], r["severity"]) for r in found] == [("complexity:f", "high"), ("length:f", "high"), ("complexity:h", "medium"), ("length:h", "low"), ("dead:f", "low")]
    s = quality.summary(n, quality.findings(n, e)).first()
    assert (s["files"], s["functions"], s["average_complexity"], s["longest_function"], s["high"]) == (1, 3, 16.0, 200, 2) and s["health"] == 34


def test_duplicates_are_exact(spark):
    import random

    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghij") * r.randint(8, 12) + str(r.randint(0, 3)) for _ in range(30)) for _ in range(12)]
    rows = [(f"{i:03}", f"p{i % 9}", base[i % 12] + (" extra" + str(i)) * (i % 3)) for i in range(40)]
    got = {(a, b): round(s, 6) for a, b, s in quality.duplicates(X.frame(spark, rows, "id string, path string, body string")).collect()}
    sets = {i: frozenset(t.split()) for i, _, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    path = {i: p for i, p, _ in rows}
    want = {}
    reps = sorted(first.values())
    for x in reps:
        for y in reps:
            s = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
            if x < y and s >= 0.85 and path[x] != path[y]:
                want[x, y] = round(s, 6)
    for i in sorted(sets):  # each member of a class with the first of it in another path
        others = [j for j in sorted(sets) if sets[j] == sets[i] and path[j] != path[i]]
        if others:
            want[min(i, others[0]), max(i, others[0])] = 1.0
    assert got == want and want


def test_bm25_by_hand(spark):
    nodes, files = X.code(spark)
    parts = retrieval.chunks(nodes, files)
    assert {r["id"] for r in parts.select("id").collect()} == {"symbol:r1:src/auth.ts#authenticateUser@1#chunk", "symbol:r1:src/auth.ts#renderPage@6#chunk", "file:r1:docs/readme.ts:1"}
    a = assistant.ask(nodes, files, "Where is user authentication implemented?")
    assert a["citations"][0]["symbol_name"] == "authenticateUser" and a["mode"] == "retrieval" and not a["no_match"]
    assert assistant.ask(nodes, files, "blockchain teleportation")["no_match"]
    model = assistant.ask(nodes, files, "authenticate", model=lambda p: "by model" if "[1] src/auth.ts" in p else "?")
    assert (model["answer"], model["mode"]) == ("by model", "model")

    def broken(prompt):
        raise RuntimeError("down")

    assert assistant.ask(nodes, files, "authenticate", model=broken)["mode"] == "fallback"


def test_tokens_and_stems(spark):
    r = spark.range(1).select(T.tokens(F.lit("export function getUserById(validate_user_name) ")).alias("t"), T.tokens(F.lit("   ")).alias("e"), T.stem(F.lit("authentication")).alias("s")).first()
    assert {"getuserbyid", "get", "user", "by"} & set(r["t"]) == {"getuserbyid", "get", "user"} and r["e"] == [] and r["s"] == "authentic"


def test_vectors(spark):
    v = X.frame(spark, [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("z", [0.0, 0.0])], "id string, embedding array<double>")
    lex = X.frame(spark, [(1, "b", 2.0), (1, "c", 5.0), (2, "a", 3.0)], "query_id long, id string, score double")
    queries = X.frame(spark, [(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    rows = retrieval.blend(lex, v, queries).collect()
    got = {r["id"]: round(r["score"], 4) for r in rows if r["query_id"] == 1}
    assert [tuple(r) for r in rows if r["query_id"] == 2] == [(2, "a", 3.0)] and retrieval.blend(lex, v, None).count() == 3
    assert retrieval.similar(v, v.select(F.col("id").alias("query_id"), "embedding")).count() == 9
    assert got["c"] == 5.0 and got["a"] == 0.35 and abs(got["b"] - (0.4 + 0.35 * 0.9939)) < 1e-3 and "z" not in got
    with pytest.raises(Exception, match="differ in number"):
        retrieval.with_embeddings(X.frame(spark, [("a",)], "id string"), v).collect()


def test_secrets_never_show(spark):
    f = X.frame(spark, X.SECRET_FILES, "path string, content string")
    text = str(secrets.scan(f).collect()) + str(f.select(secrets.redact(F.col("content"))).filter("path <> 'd.js'").collect())
    for value in (X._KEY, X._TOKEN, "hunter2pass", "correct-horse-9"):
        assert value not in text


def test_upsert_and_store(spark):
    schema = "repo_id string, id string, name string"
    old, new = X.frame(spark, [("r", "1", "a"), ("r", "2", "b")], schema), X.frame(spark, [("r", "2", "x"), ("q", "1", "y")], schema)
    assert sorted(map(tuple, store.upsert(old, new, ["repo_id", "id"]).collect())) == [("q", "1", "y"), ("r", "1", "a"), ("r", "2", "x")]
    twice = X.frame(spark, [("r", "9", "first"), ("r", "9", "last")], schema)
    assert ("r", "9", "last") in set(map(tuple, store.upsert(old, twice, ["repo_id", "id"]).collect())) and store.upsert(old, twice, ["repo_id", "id"]).count() == 3
    nodes = X.frame(spark, [(i, i) for i in range(1200)], "id int, k int")
    assert sorted(r["count"] for r in store.batches(nodes, F.col("id")).groupBy("batch").count().collect()) == [200, 500, 500]


def test_queue():
    q = jobs.Queue(concurrency=1)
    seen, gate = [], threading.Event()
    q.on_update(lambda j: seen.append((j["job_id"], j["status"])))
    q.on_update(lambda j: 1 / 0)
    a = q.enqueue("r", lambda step, stop: (gate.wait(5), step(0.5), {"n": 1})[-1])
    b = q.enqueue("r", lambda step, stop: None)
    c = q.enqueue("r", lambda step, stop: 1 / 0)
    assert q.cancel(b["job_id"]) and not q.cancel("nope")
    gate.set()
    q.close()
    assert [q.get(x["job_id"])["status"] for x in (a, b, c)] == ["completed", "cancelled", "failed"]
    assert q.get(a["job_id"])["stats"] == {"n": 1} and q.get(c["job_id"])["error"] == "division by zero" and q.active() == 0
    assert (a["job_id"], "queued") in seen and q.retry("nope") is None


def test_params_and_views(spark):
    assert validate.check_params(limit="10", depth="999", q="x" * 201) == {"depth": "must be a number", "q": "must have 1 to 200 characters"}
    assert validate.within_root("/a/b", "c") and not validate.within_root("/a/b", "../x")
    n, e = _graph(spark, [("a", "b")])
    hn, he = views.highlight(n, e, "a")
    assert {r["opacity"] for r in hn.collect()} == {1.0} and he.first()["colour"] == views.IMPORT_COLOUR
    assert views.ui_graph(n.selectExpr("*", "'x' language", "1 start_line", "2 end_line"), e)[1].columns == ["id", "source", "target", "type"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_components_are_mutual_reachability(pairs):
    reach = {(a, b) for a, b in pairs}
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
        if not more:
            break
        reach |= more
    want = {(x, min(y for y in range(8) if (x, y) in reach and (y, x) in reach)) for x in range(8) if any(x != y and (x, y) in reach and (y, x) in reach for y in range(8))}
    assert set(graph._tarjan([p for p in pairs if p[0] != p[1]])) == {(x, min(x, y)) for x, y in want}


def test_service(spark, tmp_path):
    from srcloom.plans.service import BadRequest, Service, log_entry

    s = Service(spark, f"file://{tmp_path}/svc", lambda url, ref: X.frame(spark, X.SOURCES, "path string, content string"), 1)
    job = s.wait(s.analyze("https://github.com/Owner/Name")["job_id"])
    assert job["status"] == "completed" and job["stats"]["changed"] == 4 and job["stats"]["errors"] == 1
    assert s.stats("owner/name")["CALLS"] == 5 and s.search("owner/name", "CHECK")[0]["name"] == "check"
    g = s.graph("owner/name", "50", "File")
    assert len(g["nodes"]) == 3 and {e["kind"] for e in g["edges"]} == {"IMPORTS"} and not g["truncated"]
    n, e = s.neighbors("owner/name", "file:owner/name:app.js", "1")
    assert n.count() == 4 and e.count() == 3
    assert s.metrics()["completed"] == 1 and s.repositories().first()["files"] == 3 and s.health()["status"] == "ok" and "go" in s.capabilities()["languages"]
    for bad in (lambda: s.analyze("http://github.com/a/b"), lambda: s.graph("owner/name", "many"), lambda: s.search("owner/name", "x" * 201), lambda: s.stats("none/such")):
        with pytest.raises(BadRequest):
            bad()
    s.delete("owner/name")
    s.queue.close()
    line = log_entry("error", "db", "failed", {"error": ValueError("x")}, 0)
    assert '"timestamp": "1970-01-01T00:00:00Z"' in line and '"name": "ValueError"' in line and "context" not in log_entry("info", "a", "b")


def test_window_chunks_and_bodies(spark):
    files = X.frame(spark, [("r1", "a.txt", "\n".join(["x"] * 250), None), ("r1", "b.txt", "  \n\t\n", None), ("r1", "c.txt", "", None)], "repo_id string, path string, content string, language string")
    got = retrieval.window_chunks(files).orderBy("start_line").select("id", "start_line", "end_line").collect()
    assert [tuple(r) for r in got] == [("file:r1:a.txt:1", 1, 120), ("file:r1:a.txt:121", 121, 240), ("file:r1:a.txt:241", 241, 250)]
    n = X.frame(spark, [("r1", "f", "f", "Function", "a.txt", 249, 400), ("r1", "g", "g", "Function", "a.txt", 300, 310), ("r1", "h", "h", "Class", "a.txt", 1, 2)], "repo_id string, id string, name string, kind string, path string, start_line int, end_line int").withColumn("complexity", F.lit(1))
    assert [tuple(r) for r in quality.bodies(n, files).select("id", "body").collect()] == [("f", "x\nx")]


def test_duplicates_across_files_with_the_same_variants(spark):
    from srcloom.operators import quality

    f = " ".join(f"token{i:03d}" for i in range(40))
    g = f + " extra"
    rows = [("A.f", "A", f), ("A.g", "A", g), ("B.f", "B", f), ("B.g", "B", g)]
    got = {(r["a"], r["b"]) for r in quality.duplicates(spark.createDataFrame(rows, "id string, path string, body string")).collect()}
    assert got == {("A.f", "B.f"), ("A.g", "B.g"), ("A.f", "B.g"), ("A.g", "B.f")}
    rows3 = [("1", "p", f), ("2", "q", f), ("3", "p", g), ("4", "p", f)]  # every member has a partner in another path
    got = {(r["a"], r["b"]) for r in quality.duplicates(spark.createDataFrame(rows3, "id string, path string, body string")).collect()}
    assert got == {("1", "2"), ("2", "4"), ("2", "3")}
    one_file = [(i, "A", b) for i, _, b in rows]
    assert quality.duplicates(spark.createDataFrame(one_file, "id string, path string, body string")).count() == 0


def test_stream_takes_the_first_event_in_any_order(spark, tmp_path):
    from srcloom.streaming import jobs as stream

    schema = "event_seq long, job_id string, status string, attempt int, created_at long, started_at long, finished_at long"
    late, early = [(9, "j", "failed", 1, 0, 10, 500)], [(2, "j", "completed", 1, 0, 10, 110), (3, "k", "completed", 1, 0, None, 50)]
    folder = str(tmp_path / "in.parquet")
    for rows in (late, early):  # the later event arrives first
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    got = stream.run_to_end(spark, folder, lambda df: df).first()
    assert tuple(got) == (2, 50, 75, 100)


def test_findings_of_cycles_and_prune(spark):
    from srcloom.operators import quality

    cycles = X.frame(spark, [(["a", "b"], ["a.ts", "b.ts"], 2), (list("abcd"), list("abcd"), 4)], "node_ids array<string>, paths array<string>, size int")
    got = {r["id"]: r for r in quality.circular_imports(cycles).collect()}
    assert got["cycle:a|b"]["severity"] == "medium" and got["cycle:a|b|c|d"]["severity"] == "high" and got["cycle:a|b"]["metric"] == 2.0


def test_a_failed_analysis_leaves_the_store(spark, tmp_path, monkeypatch):
    from srcloom.operators import resolve

    repo = Repository(spark, f"file://{tmp_path}/store")
    frame = lambda text: X.frame(spark, [("a.js", text)], "path string, content string")
    repo.analyse(frame("export function one() {}\n"), "r")
    before = sorted(map(str, repo.read("nodes", "r").collect()))
    monkeypatch.setattr(resolve, "resolve", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        repo.analyse(frame("export function two() {}\n"), "r")
    assert sorted(map(str, repo.read("nodes", "r").collect())) == before and repo.version("r") == 1
    monkeypatch.undo()
    repo.analyse(frame("export function two() {}\n"), "r")
    assert repo.version("r") == 2 and repo.read("nodes", "r").filter("name = 'two'").count() == 1


def test_materialise_leaves_no_shuffle_files(spark):
    from srcloom.functions.lineage import _CLEANUP, materialise

    def shuffle_files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    grouped = spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count()
    before, setting = shuffle_files(), spark.conf.get(_CLEANUP, None)
    first, second = materialise(grouped), materialise(grouped)
    assert not {x for x in shuffle_files() - before if x.startswith("shuffle_")}
    assert first.count() == second.count() == grouped.count() == 100
    assert spark.conf.get(_CLEANUP, None) == setting
