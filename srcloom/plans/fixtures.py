"""Small fixed inputs with their expected rows, for operators that the driver's tables don't exercise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


FILES = [("src/a.ts", "javascript"), ("src/b.ts", "javascript"), ("src/lib/index.ts", "javascript"), ("src/util.tsx", "javascript"), ("src/main.ts", "javascript"), ("pkg/m.py", "python"), ("pkg/n.py", "python"), ("pkg/sub/__init__.py", "python"), ("index.js", "javascript")]

SPECIFIERS = [
    ("src/main.ts", 1, "./a", "src/a.ts"), ("src/main.ts", 2, "./lib", "src/lib/index.ts"), ("src/main.ts", 3, "./b.js", "src/b.ts"), ("src/main.ts", 4, "express", None), ("src/main.ts", 5, "./nope", None),
    ("src/main.ts", 6, "./util", "src/util.tsx"), ("src/main.ts", 7, "../index", "index.js"), ("src/main.ts", 8, "..", "index.js"), ("src/main.ts", 9, "./a.ts", "src/a.ts"), ("src/lib/index.ts", 1, "../a", "src/a.ts"),
    ("pkg/m.py", 1, "./n", "pkg/n.py"), ("pkg/m.py", 2, "./sub", "pkg/sub/__init__.py"), ("pkg/m.py", 3, ".db", None), ("src/main.ts", 10, "/lib", "src/lib/index.ts"), ("src/main.ts", 11, "@scope/pkg/sub", None),
]

_FACT_FILES = [("src/app.ts", "app.ts"), ("src/util.ts", "util.ts"), ("src/other.ts", "other.ts"), ("src/third.ts", "third.ts")]
_IMPORTS = [
    ("src/app.ts", 0, "./util", [("validate", "validate"), ("fmt", "format")], None, None, False, 1), ("src/app.ts", 1, "./other", [("fmt", "render")], "ns", "dflt", False, 2), ("src/app.ts", 2, "express/lib", [("router", "Router")], None, None, False, 3),
    ("src/app.ts", 3, "express", [], None, "express", False, 4), ("src/app.ts", 4, "./missing", [("gone", "gone")], None, None, False, 5), ("src/util.ts", 0, "./other", [], None, None, True, 1), ("src/app.ts", 5, "./util", [], None, None, False, 9),
]
#: path, seq, name, qualified name, kind, line, exported
_SYMBOLS = [
    ("src/app.ts", 0, "run", "run", "Function", 10, True), ("src/app.ts", 1, "helper", "helper", "Function", 20, False), ("src/app.ts", 2, "helper", "Box.helper", "Method", 30, False), ("src/app.ts", 3, "Box", "Box", "Class", 29, True),
    ("src/util.ts", 0, "validate", "validate", "Function", 1, True), ("src/util.ts", 1, "format", "format", "Function", 5, True), ("src/util.ts", 2, "only", "only", "Function", 9, False),
    ("src/other.ts", 0, "render", "render", "Function", 1, True), ("src/other.ts", 1, "render", "A.render", "Method", 4, False), ("src/other.ts", 2, "deep", "deep", "Function", 9, True),
    ("src/third.ts", 0, "render", "render", "Function", 2, True), ("src/third.ts", 1, "default", "default", "Function", 8, True),
]
#: path, seq, callee, caller, line
_CALLS = [
    ("src/app.ts", 0, "helper", "run", 11), ("src/app.ts", 1, "validate", "run", 12), ("src/app.ts", 2, "fmt", "run", 13), ("src/app.ts", 3, "ns.deep", "run", 14), ("src/app.ts", 4, "only", "run", 15), ("src/app.ts", 5, "dflt", "run", 16),
    ("src/app.ts", 6, "x.only", "run", 17), ("src/app.ts", 7, "gone", None, 18), ("src/third.ts", 0, "render", "nobody", 3), ("src/util.ts", 0, "render", "validate", 2), ("src/app.ts", 8, "validate", "run", 40), ("src/app.ts", 9, "router", "run", 41),
]
_S = "symbol:r1:"
EXPECTED_CALLS = [
    ("src/app.ts", 0, _S + "src/app.ts#helper@20", "resolved", 1.0), ("src/app.ts", 1, _S + "src/util.ts#validate@1", "resolved", 0.95), ("src/app.ts", 2, _S + "src/other.ts#render@1", "inferred", 0.6), ("src/app.ts", 3, _S + "src/other.ts#deep@9", "resolved", 0.95),
    ("src/app.ts", 4, _S + "src/util.ts#only@9", "inferred", 0.5), ("src/app.ts", 5, None, "unknown", None), ("src/app.ts", 6, None, "unknown", None), ("src/app.ts", 7, None, "unknown", None), ("src/third.ts", 0, _S + "src/third.ts#render@2", "resolved", 1.0),
    ("src/util.ts", 0, None, "unknown", None), ("src/app.ts", 8, _S + "src/util.ts#validate@1", "resolved", 0.95), ("src/app.ts", 9, None, "unknown", None),
]
EXPECTED_CALLS = [(p, s, {r[:2]: r[2] for r in _CALLS}[(p, s)], t, tier, c) for p, s, t, tier, c in EXPECTED_CALLS]
EXPECTED_BINDINGS = [("src/app.ts", "validate", "src/util.ts", "validate"), ("src/app.ts", "fmt", "src/other.ts", "render"), ("src/app.ts", "ns", "src/other.ts", "*"), ("src/app.ts", "dflt", "src/other.ts", "default")]
_F = "file:r1:"
EXPECTED_EDGES = [
    ("IMPORTS", _F + "src/app.ts", _F + "src/util.ts", 1), ("IMPORTS", _F + "src/app.ts", _F + "src/other.ts", 2), ("IMPORTS", _F + "src/app.ts", "external:r1:express", 3), ("REEXPORTS", _F + "src/util.ts", _F + "src/other.ts", 1),
    ("CALLS", _S + "src/app.ts#run@10", _S + "src/app.ts#helper@20", 11), ("CALLS", _S + "src/app.ts#run@10", _S + "src/util.ts#validate@1", 12), ("CALLS", _S + "src/app.ts#run@10", _S + "src/other.ts#render@1", 13),
    ("CALLS", _S + "src/app.ts#run@10", _S + "src/other.ts#deep@9", 14), ("CALLS", _S + "src/app.ts#run@10", _S + "src/util.ts#only@9", 15), ("CALLS", _F + "src/third.ts", _S + "src/third.ts#render@2", 3),
]
EXPECTED_STATS = [(4, 11, 1, 6, 7, 5, 2, 5, 1)]


def facts(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    repo = F.lit("r1").alias("repo_id")
    files = frame(spark, _FACT_FILES, "path string, name string").select(repo, "*", F.lit("javascript").alias("language"))
    imports = frame(spark, _IMPORTS, "path string, seq int, specifier string, bindings array<struct<local:string,imported:string>>, namespace_binding string, default_binding string, is_reexport boolean, line int").select(repo, "*")
    symbols = frame(spark, _SYMBOLS, "path string, seq int, name string, qualified_name string, kind string, start_line int, is_exported boolean")
    symbols = symbols.select(repo, "*", (F.col("start_line") + 2).alias("end_line"), F.array().cast("array<string>").alias("parameters"), F.lit(1).alias("complexity"))
    calls = frame(spark, _CALLS, "path string, seq int, callee_name string, caller_qualified_name string, line int").select(repo, "*")
    return files, imports, symbols, calls


SOURCES = [
    ("app.js", "import { check, total } from './util.js';\n\nexport function main(items) {\n  if (check(items)) {\n    return total(items);\n  }\n  return helper();\n}\n\nfunction helper() {\n  return unknownThing();\n}\n"),
    ("util.js", "export function check(x) {\n  return x && x.length > 0;\n}\n\nexport const total = (xs) => xs.reduce((a, b) => a + b, 0);\n\nexport class Store {\n  save(v) { return check(v); }\n}\n"),
    ("lib/auth.py", "from .db import Session as S\nimport os\n\nclass Auth:\n    def login(self, user):\n        return os.path.join(user)\n\ndef main():\n    Auth().login('x')\n"),
    ("broken.js", "function ( {\n"),
]

EXPECTED_SYMBOLS = [
    ("app.js", "main", "Function", 3, 8, True, 2), ("app.js", "helper", "Function", 10, 12, False, 1), ("util.js", "check", "Function", 1, 3, True, 2), ("util.js", "total", "Function", 5, 5, True, 1), ("util.js", "Store", "Class", 7, 9, True, 1),
    ("util.js", "Store.save", "Method", 8, 8, True, 1), ("lib/auth.py", "Auth", "Class", 4, 6, False, 1), ("lib/auth.py", "Auth.login", "Method", 5, 6, False, 1), ("lib/auth.py", "main", "Method", 8, 9, False, 1),
]
_G, _H = "symbol:sample:", "file:sample:"
EXPECTED_GRAPH = [("DEFINES", _H + p, f"{_G}{p}#{q}@{a}", "resolved", 1.0, a) for p, q, _, a, _, _, _ in EXPECTED_SYMBOLS] + [
    ("IMPORTS", _H + "app.js", _H + "util.js", "resolved", 1.0, 1), ("IMPORTS", _H + "lib/auth.py", "external:sample:.db", "resolved", 1.0, 1), ("IMPORTS", _H + "lib/auth.py", "external:sample:os", "resolved", 1.0, 2),
    ("CALLS", _G + "app.js#main@3", _G + "util.js#check@1", "resolved", 0.95, 4), ("CALLS", _G + "app.js#main@3", _G + "util.js#total@5", "resolved", 0.95, 5), ("CALLS", _G + "app.js#main@3", _G + "app.js#helper@10", "resolved", 1.0, 7),
    ("CALLS", _G + "util.js#Store.save@8", _G + "util.js#check@1", "resolved", 1.0, 8), ("CALLS", _G + "lib/auth.py#main@8", _G + "lib/auth.py#Auth@4", "resolved", 1.0, 9),
]

_AUTH = "export function authenticateUser(name, password) {\n  const session = createSession(name);\n  return session;\n}\n\nexport function renderPage(html) {\n  return html.trim();\n}\n"


def code(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, files) of a small code base about authentication."""
    files = frame(spark, [("r1", "src/auth.ts", _AUTH, "javascript"), ("r1", "docs/readme.ts", "// quantum notes\n\nlet x = 1;\n", "javascript")], "repo_id string, path string, content string, language string")
    nodes = frame(
        spark,
        [("r1", "symbol:r1:src/auth.ts#authenticateUser@1", "Function", "authenticateUser", "src/auth.ts", "authenticateUser", 1, 4, "javascript"), ("r1", "symbol:r1:src/auth.ts#renderPage@6", "Function", "renderPage", "src/auth.ts", "renderPage", 6, 8, "javascript")],
        "repo_id string, id string, kind string, name string, path string, qualified_name string, start_line int, end_line int, language string",
    )
    return nodes, files


TERM_PAIRS = [
    ("authentication", "authenticate", True), ("sessions", "session", True), ("login", "logout", False), ("add", "address", False), ("user", "users", True), ("work", "works", True), ("user", "user", True), ("implemented", "implementation", True), ("cat", "cats", False), ("storage", "store", False),
]

CLONE_ERRORS = [("fatal: Authentication failed for x", "private or needs authentication"), ("remote: Repository not found.", "not found"), ("Could not resolve host: x", "network unreachable"), ("disk full", "clone failed")]
PLACEHOLDERS = [("AKIA" + "IOSFODNN7" + "EXAMPLE", True), ("change-me", True), ("your_password_here", True), ("AKIA" + "QZ3T7RWK2LMN8PV5", False), ("changeme", True), ("s3cr3t-value-9", False)]
_KEY, _TOKEN = "AKIA" + "QZ3T7RWK2LMN8PV5", "ghp_" + "a1B2c3D4e5" * 3 + "f6G7h8"
SECRET_FILES = [
    ("a.env", f"x = 1\nkey = {_KEY}\r\ntoken: '{_TOKEN}'\n"), ("b.pem", "-----BEGIN RSA " + "PRIVATE KEY-----\nabc"), ("c.cfg", "url = https://user:" + "hunter2pass@db.internal/x\npassword = \"change-me-now\"\n"),
    ("d.js", "y" * 4000 + _KEY), ("e.yml", "password: \"correct-horse-9\"\n"),
]
SECRET_HITS = [("a.env", 2, "aws-access-key"), ("a.env", 3, "github-token"), ("a.env", 3, "assignment"), ("b.pem", 1, "private-key"), ("c.cfg", 1, "basic-auth-url"), ("e.yml", 1, "assignment")]

_HOST, _ROOT = "Only github.com repositories are supported", "Repository URL must point at the repository root"
URLS = [
    ("https://github.com/facebook/react", "facebook/react", None), ("github.com/Facebook/React.git", "facebook/react", None), (" https://www.github.com/a/b/ ", "a/b", None), ("https://github.com/a/b/tree/main", "a/b", None), ("https://github.com/a/b/tree/main/src", None, _ROOT),
    ("https://github.com/a/b/blob/main/x.js", "a/b", None), ("https://github.com/a/b/releases", "a/b", None), ("https://gitlab.com/a/b", None, _HOST), ("https://evil.github.com/a/b", None, _HOST), ("http://github.com/a/b", None, "Repository URL must use https"),
    ("https://user:pw@github.com/a/b", None, "Repository URL must not contain credentials"), ("https://github.com/a", None, "Repository URL must include an owner and a repository name"), ("", None, "Repository URL is required"), (None, None, "Repository URL is required"),
    ("https://github.com/a;b/c", None, "Repository owner contains invalid characters"), ("https://github.com/a/b;rm -rf", None, "Repository URL is not a valid URL"), ("https://github.com/a/b$c", None, "Repository name contains invalid characters"), ("ftp://github.com/a/b", None, _HOST),
]
