"""Secrets in source text: line by line, with non-reversible fingerprints instead of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, severity and pattern of each rule; the last group, if any, is the value.
RULES = (
    ("aws-access-key", "high", r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])"),
    ("github-token", "high", r"(?<![A-Za-z0-9_])ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("private-key", "high", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("basic-auth-url", "high", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"']+:[^\s:/@\"']+@"),
    ("assignment", "medium", r"""(?i)(?:password|secret|token|api[_-]?key)[ \t]*[:=][ \t]*["'][^"']{8,}["']"""),
)
PLACEHOLDER = r"(?i)example|change[-_]?me|your[-_]|placeholder|xxx"
#: Fixed value: from this length on, lines are generated code and aren't scanned.
LONGEST_LINE = 4000


def is_placeholder(value: Column) -> Column:
    return value.rlike(PLACEHOLDER)


def fingerprint(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def scan(files: DataFrame) -> DataFrame:
    """(path, line, kind, severity, fingerprint, preview) of every match in files(path, content); lines count from 1."""
    rows = files.select("path", F.posexplode(F.split("content", r"\r?\n", -1)).alias("line", "row")).filter(F.length("row") < LONGEST_LINE)
    any_rule = reduce(lambda a, b: a | b, [F.col("row").rlike(p) for _, _, p in RULES])
    rows = rows.filter(any_rule)
    hits = F.flatten(F.array(*[_tagged(*rule) for rule in RULES]))
    found = rows.select("path", (F.col("line") + 1).alias("line"), F.explode(hits).alias("h")).filter(~is_placeholder(F.col("h.value")))
    return found.select("path", "line", "h.kind", "h.severity", fingerprint(F.col("h.value")).alias("fingerprint"), F.concat(F.substring("h.value", 1, 4), F.lit("...")).alias("preview"))


def _tagged(kind: str, severity: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("row", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), m.alias("value")))


def redact(text: Column) -> Column:
    """A text with every secret replaced by its kind."""
    for kind, _, pattern in RULES:
        text = F.regexp_replace(text, pattern, f"[REDACTED {kind}]")
    return text
