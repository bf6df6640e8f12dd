"""Personal data: base patterns, and further spans proposed by generators and selected by gradient-boosted trees.

Everything on the data runs as Spark SQL functions. The base patterns are matched leftmost and without overlap, kind by kind,
then validated. High-recall generators propose further, overlapping candidates (written-out addresses, national phone
numbers, IPv6, identity numbers); boosted trees over format and context features score them, and per kind a threshold
calibrated on held-out examples selects. Trees and thresholds come from the labelled examples below, and are compiled to SQL.
Added spans never touch a base span; of overlapping added spans the leftmost, then longest, stays.

The patterns use possessive groups and start only where a match can begin, so that long runs cost linear time and no stack.
Edge cases: a null or empty text has no spans, and the SHA-256 of the empty string; repeated rows give equal rows.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted

#: Base kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "length(regexp_replace({m}, '[^0-9]', ''))"
_LUHN = (
    "aggregate(transform(split(reverse(regexp_replace({m}, '[^0-9]', '')), ''), (d, i) -> "
    "CASE WHEN d = '' THEN 0 WHEN i % 2 = 0 THEN CAST(d AS INT) ELSE CAST(translate(d, '0123456789', '0246813579') AS INT) END), 0, (a, b) -> a + b) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": f"{{m}} RLIKE '^(?:{_OCTET}[.]){{{{3}}}}{_OCTET}$'",
    "card": f"CASE WHEN {_DIGITS} BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"{_DIGITS} BETWEEN 9 AND 15",
}
#: What a text must contain before a pattern is tried.
GUARD = {"email": "contains({t}, '@')", "ip": "{t} RLIKE '[0-9][.][0-9]'", "card": "{t} RLIKE '[0-9]'", "phone": "contains({t}, '+')"}

#: Generators of further candidates: kind, guard, pattern.
_AT, _DOT = r"(?:\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s)", r"(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)"
GENERATORS = (
    ("email", "lower({t}) RLIKE 'at' AND ({t} RLIKE '[(\\\\[{{<] ?(?:at|AT|@) ?[)\\\\]}}>]' OR {t} RLIKE ' (?:dot|DOT) ')", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]{2,}+)++"),
    ("phone", "{t} RLIKE '[0-9]{{3}}[^0-9A-Za-z]{{1,2}}[0-9]{{3}}'", r"(?<![0-9A-Za-z+.,/-])(?:00[0-9]{1,3}[ ./-])?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z]|[-.,/:][0-9])"),
    ("ip", "{t} RLIKE '[0-9A-Fa-f]:[0-9A-Fa-f:]'", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])"),
    ("id", "{t} RLIKE '[0-9]{{2}}'", r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])"),
)
ADDED = tuple(dict.fromkeys(k for k, _, _ in GENERATORS))
#: Features of a candidate m of kind number k with the text before and after it.
FEATURES = {
    "k": "k",
    "length": "length(m)",
    "digits": _DIGITS.format(m="m"),
    "letters": "length(regexp_replace(m, '[^A-Za-z]', ''))",
    "upper": "length(regexp_replace(m, '[^A-Z]', ''))",
    "groups": "size(split(m, '[^0-9A-Za-z]+'))",
    "last_group": "length(regexp_extract(m, '([0-9A-Za-z]+)$', 1))",
    "first_group": "length(regexp_extract(m, '^[^0-9A-Za-z]*([0-9A-Za-z]+)', 1))",
    "parens": "CAST(m RLIKE '[(]' AS INT)",
    "brackets": "CAST(m RLIKE '[(\\\\[{<] ?(?:at|AT|@)' AS INT)",
    "spelled_dot": "CAST(m RLIKE '(?i)\\\\bdot\\\\b' AS INT)",
    "slashes": "CAST(m RLIKE '/' AS INT)",
    "colons": "length(regexp_replace(m, '[^:]', ''))",
    "date": "CAST(m RLIKE '^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)?[0-9]{2})' AS INT)",
    "even": "CAST(m RLIKE '^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$' AS INT)",
    "zero": "CAST(m RLIKE '^[(]?0' AS INT)",
    "domain": "CAST(lower(m) RLIKE '(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$' AS INT)",
    "call": "CAST(lower(before) RLIKE '(?:phone|tel|telefon|teléfono|téléphone|call|mobile|cell|fax|whatsapp|ring|contact|rufnummer|appel)[^0-9]{0,14}$' AS INT)",
    "mail": "CAST(lower(before) RLIKE '(?:mail|write|contact|reach|address|courriel|correo)[^0-9]{0,14}$' AS INT)",
    "identity": "CAST(lower(before) RLIKE '(?:ssn|social security|iban|account|konto|passport|tax id|steuer)[^0-9]{0,16}$' AS INT)",
    "count": "CAST(lower(before) RLIKE '(?:isbn|issn|version|order|invoice|page|pages|section|score|ratio|chapter|part|no[.]|art[.]|vol[.]|between|from|date|on|at|time)[^0-9]{0,8}$' AS INT)",
    "unit": "CAST(lower(after) RLIKE '^ ?(?:%|kg|km|cm|mm|mb|gb|eur|usd|euro|dollar|pages|times|units|am|pm|[*x=]|[$€])' AS INT)",
}
_FORBID = 0.99
BEFORE, AFTER = 30, 12
#: Matches in a chunk of a text's list of matches.
CHUNK = 256


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, guard: str, valid: str) -> str:
    """SQL for array<struct<s:int,e:int>> of a pattern's valid matches in a text; positions are code points, ends exclusive."""
    p = _quote(pattern)
    step = "named_struct('s', CAST(a.pos + x.gap AS INT), 'e', CAST(a.pos + x.gap + length(x.m) AS INT))"
    none = "CAST(array() AS ARRAY<STRUCT<s:INT,e:INT>>)"
    ok = f"x.m IS NOT NULL AND {valid.format(m='x.m')}"
    # matches are appended to chunks, and full chunks to a list, so that texts with very many stay cheap
    return (
        f"CASE WHEN {guard.format(t=text)} THEN aggregate(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) -> named_struct('gap', length(g), 'm', m)), "
        f"named_struct('pos', 0, 'now', {none}, 'full', CAST(array() AS ARRAY<ARRAY<STRUCT<s:INT,e:INT>>>)), "
        f"(a, x) -> named_struct('pos', CAST(a.pos + x.gap + coalesce(length(x.m), 0) AS INT), "
        f"'now', CASE WHEN {ok} THEN CASE WHEN size(a.now) >= {CHUNK} THEN array({step}) ELSE concat(a.now, array({step})) END ELSE a.now END, "
        f"'full', CASE WHEN size(a.now) >= {CHUNK} AND {ok} THEN concat(a.full, array(a.now)) ELSE a.full END), "
        f"a -> CASE WHEN size(a.full) = 0 THEN a.now ELSE concat(flatten(a.full), a.now) END) ELSE {none} END"
    )


def _examples(seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(kind, before, candidate, after, label): candidates as generators propose them, in and out of the contexts they mean something in."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    filler = lambda: " ".join(word() for _ in range(4)) + " "
    pick = r.choice
    out = []
    for _ in range(160):
        sep = pick("- .")
        area = f"({d(3)}) " if r.random() < 0.5 else d(3) + sep
        out.append(("phone", filler() + pick(["", "", "call ", "phone: ", "tel. ", "Tel: ", "mobile "]), f"{area}{d(3)}{sep}{d(4)}", pick([" ", ".", ", "]) + word(), 1))
        out.append(("phone", filler() + pick(["phone ", "Tel.: ", "Telefon ", "appel ", "fax "]), f"0{d(2)}{pick(' /-')}{d(3)} {d(4)}", " " + word(), 1))
        out.append(("phone", filler() + pick(["", "on ", "date "]), f"{pick(['19', '20'])}{d(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", " " + word(), 0))
        out.append(("phone", filler() + pick(["", "on "]), f"{r.randint(1, 28):02}{(s := pick('./'))}{r.randint(1, 12):02}{s}{pick(['19', '20'])}{d(2)}", " " + word(), 0))
        out.append(("phone", filler() + pick(["isbn ", "order ", "version ", "pages ", "no. ", ""]), f"{d(r.randint(2, 4))}{(s := pick('-./ '))}{d(r.randint(2, 5))}{s * (r.random() < 0.5)}{d(r.randint(2, 4))}", pick([" units", " kg", "% ", " " + word()]), 0))
        out.append(("phone", filler() + pick(["", "from "]), " ".join(d(r.randint(2, 4)) for _ in range(r.randint(2, 5))), " " + word(), 0))
        out.append(("phone", filler(), f"{d(4)} {d(4)} {d(4)} {d(4)}", " " + word(), 0))
        name, host = word() + pick(["", ".", "_"]) + word(), word() + pick(["", "-"]) + word()
        tld = pick(["com", "org", "net", "de", "fr"])
        at = pick([" (at) ", "(at)", " [at] ", "[at]", " at ", " {at} ", "(@)"])
        dot = pick([" (dot) ", "(dot)", "[dot]", " dot ", " [dot] "]) if at == " at " else pick([" (dot) ", "(dot)", "[dot]", " dot ", "."])
        out.append(("email", filler() + pick(["", "mail ", "write to ", "contact "]), f"{name}{at}{host}{dot}{tld}", " " + word(), 1))
        out.append(("email", filler(), f"{word()} at {word()}.{word()}", " " + word(), 0))
        out.append(("email", filler(), f"{word()} at {word()} dot {word()}", " " + word(), 0))
        out.append(("email", filler(), f"{word()} (at) {word()}.{word()}", " " + word(), 0))
        out.append(("ip", filler(), ":".join(f"{r.randrange(65536):x}" for _ in range(8)), " " + word(), 1))
        out.append(("ip", filler(), f"{r.randrange(4096, 65536):x}:{r.randrange(65536):x}::{r.randrange(65536):x}:{r.randrange(65536):x}", " " + word(), 1))
        out.append(("ip", filler() + pick(["at ", "time "]), f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", pick([" ", " pm "]) + word(), 0))
        out.append(("ip", filler() + pick(["ratio ", ""]), f"{d(1)}:{d(1)}:{d(2)}", " " + word(), 0))
        out.append(("id", filler() + pick(["ssn ", "SSN: ", "social security ", ""]), f"{d(3)}-{d(2)}-{d(4)}", " " + word(), 1))
        out.append(("id", filler() + pick(["iban ", "account ", "IBAN: ", ""]), f"{pick(['DE', 'FR', 'ES'])}{d(2)} " + " ".join(d(4) for _ in range(4)) + f" {d(2)}", " " + word(), 1))
        out.append(("id", filler() + pick(["part ", "order ", ""]), f"{pick(['AB', 'XK', 'QT'])}{d(2)}{d(4)}{d(4)}", " " + word(), 0))
    return [(k, b[-BEFORE:], m, a[:AFTER], y) for k, b, m, a, y in out]


_models: dict[str, tuple[str, dict[str, float]]] = {}


def _feature_sql() -> str:
    return ", ".join(f"CAST({sql} AS DOUBLE) AS f_{name}" for name, sql in FEATURES.items())


def model(spark: SparkSession) -> tuple[str, dict[str, float]]:
    """(SQL of the margin over f_<name>, threshold by kind). The examples' features are computed by the very SQL that scores candidates."""
    if not _models:
        rows = _examples()
        values = ", ".join(f"({i}, {ADDED.index(k)}, {_quote(b)}, {_quote(m)}, {_quote(a)}, {y})" for i, (k, b, m, a, y) in enumerate(rows))
        got = spark.sql(f"SELECT i, y, {_feature_sql()} FROM VALUES {values} AS t(i, k, before, m, after, y)").toPandas().sort_values("i")
        x, y = got.iloc[:, 2:].to_numpy(float), got["y"].to_numpy(float)
        held = np.arange(len(y)) // len(GENERATORS) % 4 == 0
        trained = Boosted(x[~held], y[~held])
        margin = trained.margin(x[held])
        kind = x[held][:, 0]
        thresholds = {}
        for i, name in enumerate(ADDED):
            of, good = margin[kind == i], y[held][kind == i]
            thresholds[name] = next((float(t) for t in sorted(set(of.tolist())) if good[of >= t].mean() >= _FORBID), 99.0)
        _models["pii"] = (trained.sql([f"c.f_{n}" for n in FEATURES]), thresholds)
    return _models["pii"]


def _added(text: str, margin: str, thresholds: dict[str, float]) -> str:
    """SQL for array<struct<s,e,kind>> of the candidates that the trees select."""
    parts = []
    for kind, guard, pattern in GENERATORS:
        spans = _spans(text, pattern, guard, "true")
        k = ADDED.index(kind)
        inner = ", ".join(f"'f_{name}', CAST({sql} AS DOUBLE)" for name, sql in FEATURES.items())
        lifted = (
            f"transform(transform({spans}, c -> named_struct('s', c.s, 'e', c.e, 'k', {k}, 'm', substring({text}, c.s + 1, c.e - c.s), "
            f"'before', substring({text}, greatest(1, c.s + 1 - {BEFORE}), least({BEFORE}, c.s)), 'after', substring({text}, c.e + 1, {AFTER}))), "
            f"c -> named_struct('s', c.s, 'e', c.e, {_with_prefix(inner)}))"
        )
        parts.append(f"transform(filter({lifted}, c -> {margin} >= {thresholds[kind]:.6f}D), c -> named_struct('s', c.s, 'e', c.e, 'kind', '{kind}'))")
    return f"concat({', '.join(parts)})"


def _with_prefix(sql: str) -> str:
    """The features' columns k, m, before and after as fields of c."""
    import re

    return re.sub(r"(?<![\w'.])(k|m|before|after)(?=[,)\s])", r"c.\1", sql)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs under `d`, and base and all spans as arrays of struct(s, kind number, e) and struct(s, e, kind)."""
    margin, thresholds = model(docs.sparkSession)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    df = df.select("d", "t", *[F.expr(_spans("t", BASE[k], GUARD[k], VALID[k])).alias(k) for k in KINDS], F.expr(_added("t", margin, thresholds)).alias("more"))
    parts = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(KINDS))
    df = df.select("*", F.expr(f"array_sort(concat({parts}))").alias("base"))
    free = "filter(more, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e))"
    chosen = (
        f"aggregate(array_sort({free}, (a, b) -> CASE WHEN a.s <> b.s THEN a.s - b.s ELSE b.e - a.e END), "
        "CAST(array() AS ARRAY<STRUCT<s:INT,e:INT,kind:STRING>>), (o, x) -> CASE WHEN size(o) > 0 AND element_at(o, -1).e > x.s THEN o ELSE concat(o, array(x)) END)"
    )
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    order = f"CASE kind {' '.join(f'WHEN {_quote(k)} THEN {i}' for i, k in enumerate(dict.fromkeys([*KINDS, *ADDED])))} END"
    df = df.select("d", "t", *KINDS, "base", F.expr(f"CASE WHEN size(more) = 0 THEN CAST(array() AS ARRAY<STRUCT<s:INT,e:INT,kind:STRING>>) ELSE {chosen} END").alias("added"))
    every = f"array_sort(concat(transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', element_at({names}, x.k + 1))), transform(added, x -> named_struct('s', x.s, 'k', {order.replace('kind', 'x.kind', 1)}, 'e', x.e, 'kind', x.kind))))"
    return df.select("d", "t", *KINDS, "base", "added", F.expr(every).alias("spans"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans ("kind:start:end" in order)."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    base = F.expr(f"array_join(transform(base, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')")
    every = F.expr("array_join(transform(spans, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")
    return detect(docs, id_col, text_col).select(
        F.col("d")[id_col].alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans")
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; n_chars, where there is one, follows. Null stays null."""
    found = detect(docs, id_col, text_col)
    text = (
        "aggregate(spans, named_struct('pos', 0, 'out', ''), (a, x) -> CASE WHEN x.s >= a.pos THEN named_struct('pos', x.e, 'out', concat(a.out, substring(t, a.pos + 1, x.s - a.pos), '[', upper(x.kind), ']')) "
        "ELSE named_struct('pos', greatest(a.pos, x.e), 'out', a.out) END, a -> concat(a.out, substring(t, a.pos + 1)))"
    )
    new = F.when(F.col("d")[text_col].isNull(), F.lit(None)).when(F.size("spans") == 0, F.col("t")).otherwise(F.expr(text))
    out = found.select("d", new.alias("new"))
    columns = []
    for c in docs.columns:
        value = F.col("new") if c == text_col else F.length("new").cast(dict(docs.dtypes)[c]) if c == "n_chars" else F.col("d")[c]
        columns.append(value.alias(c))
    return out.select(*columns)
