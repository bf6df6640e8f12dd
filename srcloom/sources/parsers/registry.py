"""Which parser reads which file, and the table function that applies them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions of each language.
LANGUAGES = {
    "javascript": [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"],
    "python": [".py", ".pyi"], "java": [".java"], "go": [".go"], "ruby": [".rb"], "rust": [".rs"], "csharp": [".cs"],
}
ERROR_CHARS = 300
_parsers: dict[str, Callable] = {}

BINDING = "struct<local:string,imported:string>"
IMPORT = f"struct<specifier:string,bindings:array<{BINDING}>,namespace_binding:string,default_binding:string,is_type_only:boolean,is_require:boolean,is_reexport:boolean,line:int>"
SYMBOL = "struct<name:string,qualified_name:string,kind:string,parameters:array<string>,start_line:int,end_line:int,is_exported:boolean,is_async:boolean,complexity:int>"
CALL = "struct<callee_name:string,caller_qualified_name:string,caller_start_line:int,line:int>"
PARSED = f"repo_id string, path string, name string, extension string, language string, error string, imports array<{IMPORT}>, symbols array<{SYMBOL}>, calls array<{CALL}>"


def register(language: str, extensions: list[str], parse: Callable[[str, str], dict]) -> None:
    """parse(path, content) gives {"imports", "symbols", "calls"}; a later registration of an extension replaces an earlier one."""
    for other, exts in LANGUAGES.items():
        if other != language:
            LANGUAGES[other] = [e for e in exts if e not in extensions]
    LANGUAGES[language] = list(extensions)
    _parsers[language] = parse


def extensions() -> list[str]:
    return [e for exts in LANGUAGES.values() for e in exts]


def language_of(value: str) -> str | None:
    """The language of a path or of a bare extension."""
    value = value.strip().lower()
    base = value.rsplit("/", 1)[-1]
    ext = value if value.startswith(".") and "/" not in value else ("." + base.rsplit(".", 1)[1] if "." in base[1:] else "")
    return next((name for name, exts in LANGUAGES.items() if ext in exts), None)


def supports(value: str) -> bool:
    return language_of(value) is not None


def _parser(language: str) -> Callable:
    if language not in _parsers:
        from . import braces, javascript, python

        _parsers.setdefault("javascript", javascript.parse)
        _parsers.setdefault("python", python.parse)
        for name in ("java", "go", "ruby", "rust", "csharp"):
            _parsers.setdefault(name, braces.parser(name))
    return _parsers[language]


def parse_text(language: str, path: str, content: str) -> dict:
    """Facts of one file; a failure becomes `error`, with no facts."""
    try:
        return {"error": None, **_parser(language)(path, content)}
    except Exception as e:
        return {"error": (str(e) or type(e).__name__)[:ERROR_CHARS], "imports": [], "symbols": [], "calls": []}


def parse(files: DataFrame) -> DataFrame:
    """A parsed row for each file of a supported language; files are dealt out, so that a few large ones don't share a task."""
    src = files.select("repo_id", "path", "name", "extension", "language", "content").filter("language IS NOT NULL")
    schema = T._parse_datatype_string(PARSED)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            out = [{**{k: r[k] for k in ("repo_id", "path", "name", "extension", "language")}, **parse_text(r["language"], r["path"], r["content"] or "")} for r in rows]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return src.mapInArrow(run, PARSED)


def facts(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, imports, symbols, calls) of the parsed rows without an error."""
    good = parsed.filter("error IS NULL")
    each = lambda c: good.select("repo_id", "path", F.posexplode(c).alias("seq", "x")).select("repo_id", "path", "seq", "x.*")
    return good.select("repo_id", "path", "name", "language"), each("imports"), each("symbols"), each("calls")
