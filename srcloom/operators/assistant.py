"""Questions about a code base: ranked citations, related symbols, and an optional model that answers from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval, secrets

LIMIT, LIMIT_MOST = 6, 12
EXCERPT = 1200
SYMBOLS, HINTS, SUGGESTIONS = 10, 8, 5


def clamp(limit: int | None) -> int:
    return min(max(LIMIT if limit is None else limit, 1), LIMIT_MOST)


def citations(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, rank, path, symbol_name, start_line, end_line, score, reasons, excerpt) of ranked chunks; long excerpts are cut."""
    cut = F.when(F.length("text") > EXCERPT, F.concat(F.substring("text", 1, EXCERPT), F.lit("\n... (truncated)"))).otherwise(F.col("text"))
    j = hits.join(parts.select("id", "path", "symbol_name", "start_line", "end_line", "text"), "id")
    return j.select("query_id", "rank", "path", "symbol_name", "start_line", "end_line", "score", "reasons", cut.alias("excerpt"))


def related_symbols(nodes: DataFrame, question: str, most: int = SYMBOLS) -> DataFrame:
    """The first symbols (by id) whose name matches a term of the question with three characters or more."""
    terms = F.filter(T.tokens(F.lit(question)), lambda t: F.length(t) >= 3)
    named = nodes.filter(~F.col("kind").isin("File", "ExternalModule"))
    return named.filter(T.any_term_matches(T.tokens(F.col("name")), terms)).orderBy("id").limit(most)


def prompt(question: str, cited: list[dict], symbols: list[dict]) -> str:
    """What a model is asked: numbered sources without secrets, symbol hints, and the question."""
    parts = [f"[{i}] {c['path']}:{c['start_line']}-{c['end_line']}\n{c['excerpt']}" for i, c in enumerate(cited, 1)]
    hints = ", ".join(f"{s['name']} ({s['kind']})" for s in symbols[:HINTS])
    return "Answer from these sources and cite them by number.\n\n" + "\n\n".join(parts) + (f"\n\nSymbols: {hints}" if hints else "") + f"\n\nQuestion: {question}"


def summary(cited: list[dict], symbols: list[dict]) -> str:
    lines = [f"{c['path']}:{c['start_line']}" + (f" ({c['symbol_name']})" if c["symbol_name"] else "") for c in cited[:3]]
    return "Most relevant: " + "; ".join(lines) + (". Related symbols: " + ", ".join(s["name"] for s in symbols[:HINTS]) if symbols else "")


def suggestions(cited: list[dict]) -> list[str]:
    out: list[str] = []
    for c in cited[:2]:
        own = [f"What calls {c['symbol_name']}?", f"What does {c['symbol_name']} depend on?"] if c["symbol_name"] else []
        out += [x for x in (*own, f"What else is in {c['path']}?") if x not in out]
    return out[:SUGGESTIONS]


def ask(nodes: DataFrame, files: DataFrame, question: str, limit: int | None = None, model: Callable[[str], str] | None = None) -> dict:
    """The answer to one question; at most twelve citations and ten symbols come to the driver. A model's failure falls back to what was found."""
    parts = retrieval.chunks(nodes, files)
    spark = nodes.sparkSession
    queries = spark.createDataFrame([(0, question)], "query_id long, text string")
    idx = retrieval.index(parts, "path", "symbol_name")
    safe = parts.withColumn("text", secrets.redact(F.col("text")))
    cited = [r.asDict() for r in citations(retrieval.bm25(idx, queries, clamp(limit)), safe).orderBy("rank").collect()]
    symbols = [r.asDict() for r in related_symbols(nodes, question).select("id", "name", "kind").collect()]
    if not cited:
        return {"answer": "Nothing in the code matches the question.", "no_match": True, "mode": "none", "citations": [], "symbols": symbols, "suggestions": []}
    answer, mode = summary(cited, symbols), "retrieval"
    if model is not None:
        try:
            answer, mode = model(prompt(question, cited, symbols)), "model"
        except Exception as e:
            answer, mode = f"{answer} (the model failed: {str(e)[:200]})", "fallback"
    return {"answer": answer, "no_match": False, "mode": mode, "citations": cited, "symbols": symbols, "suggestions": suggestions(cited)}
