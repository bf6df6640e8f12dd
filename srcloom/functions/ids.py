"""Identifiers of the property graph, and paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings of a lower-cased path that mark a test file.
TEST_HINTS = ("__tests__", "/test/", "/tests/", "/spec/", ".test.", ".spec.", "test_")
TEST_SUFFIX = "_test.go"


def repository_id(repo: Column) -> Column:
    return F.concat(F.lit("repo:"), repo)


def file_id(repo: Column, path: Column) -> Column:
    return F.concat(F.lit("file:"), repo, F.lit(":"), path)


def module_id(repo: Column, module_path: Column) -> Column:
    return F.concat(F.lit("module:"), repo, F.lit(":"), F.translate(module_path, "\\", "/"))


def symbol_id(repo: Column, path: Column, qualified: Column, line: Column) -> Column:
    return F.concat(F.lit("symbol:"), repo, F.lit(":"), path, F.lit("#"), qualified, F.lit("@"), line.cast("string"))


def external_id(repo: Column, package: Column) -> Column:
    return F.concat(F.lit("external:"), repo, F.lit(":"), package)


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit("-"), kind, F.lit("->"), target)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extname(path: Column) -> Column:
    """Lower-case extension with its dot; none for dotfiles and names without a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def repo_relative(path: Column, root: str) -> Column:
    """The path below a root, with forward slashes and none in front."""
    plain = F.translate(path, "\\", "/")
    base = root.replace("\\", "/").rstrip("/")
    return F.regexp_replace(F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(plain), "^/+", "")


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    hit = low.endswith(TEST_SUFFIX)
    for hint in TEST_HINTS:
        hit = hit | F.contains(low, F.lit(hint))
    return hit


def is_relative(spec: Column) -> Column:
    return spec.rlike(r"^(\./|\.\./|/|[a-zA-Z]:[\\/])") | spec.isin(".", "..")


def package_name(spec: Column) -> Column:
    """The first segment, or two for a scope."""
    parts = F.split(spec, "/", -1)
    return F.when(spec.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def join_path(folder: Column, spec: Column) -> Column:
    """The path of a specifier seen from a folder: '.' and empty segments vanish, '..' drops one."""
    start = F.filter(F.split(folder, "/", -1), lambda p: p != "")

    def step(acc, p):
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when((p == ".") | (p == ""), acc).when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(F.split(F.translate(spec, "\\", "/"), "/", -1), start, step), "/")
