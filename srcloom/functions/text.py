"""Text functions of retrieval and quality analysis, as Column expressions without Python UDFs.

Regular expressions keep to ASCII word borders and spell white space out, so that they mean the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no search terms.
STOP_WORDS = (
    "the a an and or but if then else for while of to in on at by with from as is are was were be been this that these those it its "
    "import export const let var function return class def func fn public private static void null nil true false self"
).split()
#: Endings that a stem loses; the first that leaves five characters counts.
SUFFIXES = "ization isation ation ition ating ement ments ment ness able ible ance ence ings ing ies ion ate ity ers er ed es s e".split()
#: White space of the parsed languages.
SPACE = r"\x09-\x0D\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: What adds a branch to a function.
BRANCHES = (
    rf"(?<![A-Za-z0-9_])if[{SPACE}]*\(", rf"(?<![A-Za-z0-9_])for[{SPACE}]*\(", rf"(?<![A-Za-z0-9_])while[{SPACE}]*\(",
    r"(?<![A-Za-z0-9_])case(?![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])catch" + rf"[{SPACE}]*\(", rf"\?[^:.\n]+[{SPACE}]*:", r"(&&|\|\|)",
)


def js_round(x: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x + 0.5)


def lines(content: Column) -> Column:
    return F.split(content, r"\r?\n", -1)


def slice_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines start .. end (from 1), joined by newlines; the end is held to the last line."""
    rows = lines(content)
    last = F.least(end, F.size(rows))
    return F.array_join(F.slice(rows, start, F.greatest(F.lit(0), last - start + 1)), "\n")


def complexity(body: Column) -> Column:
    """1 and the branches of a body; 1 for no body."""
    total = F.lit(1)
    for pattern in BRANCHES:
        total = total + F.coalesce(F.regexp_count(body, F.lit(pattern)), F.lit(0))
    return total


def tokens(text: Column) -> Column:
    """Search terms of a text: words, their snake_case and camelCase parts, lower case, without stop words; distinct, in order."""
    raw = F.filter(F.split(text, "[^A-Za-z0-9_]+", -1), lambda t: t != "")
    joined = lambda t: t.rlike("_|[a-z0-9][A-Z]")
    split = lambda t: F.concat(F.array(t), F.filter(F.split(t, "_+", -1), lambda p: F.length(p) >= 2), F.split(t, "(?<=[a-z0-9])(?=[A-Z])", -1))
    parts = F.flatten(F.transform(raw, lambda t: F.when(joined(t), split(t)).otherwise(F.array(t))))
    low = F.filter(F.transform(parts, lambda t: F.lower(t)), lambda t: F.length(t) >= 2)
    return F.array_except(low, F.array(*map(F.lit, STOP_WORDS)))  # distinct, in order, through a hash set


def stem(token: Column) -> Column:
    out = token
    for suffix in reversed(SUFFIXES):
        fits = token.endswith(suffix) & (F.length(token) >= 5 + len(suffix))
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return F.when(F.length(token) <= 5, token).otherwise(out)


def stems_match(a: Column, b: Column) -> Column:
    """Whether two stems mean the same: equal, one a prefix of five characters or more, or a plural."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(short) >= 5) & long.startswith(short)) | ((F.length(short) >= 4) & (long == F.concat(short, F.lit("s"))))


def terms_match(a: Column, b: Column) -> Column:
    return (a == b) | stems_match(stem(a), stem(b))


def any_term_matches(left: Column, right: Column) -> Column:
    """Whether any term of one array matches any of the other; stems are taken once."""
    return any_stem_matches(F.transform(left, stem), F.transform(right, stem))


def any_stem_matches(left: Column, right: Column) -> Column:
    return F.exists(left, lambda a: F.exists(right, lambda b: stems_match(a, b)))


def normalize_body(body: Column) -> Column:
    """A body without comments, string contents and surplus white space."""
    s = F.regexp_replace(body, r"//[^\n\r\u2028\u2029]*", "")
    s = F.regexp_replace(s, r"/\*(?s:.)*?\*/", "")
    s = F.regexp_replace(s, "\"[^\"]*\"|'[^']*'|`[^`]*`", '""')
    s = F.regexp_replace(s, rf"[{SPACE}]+", " ")
    return F.regexp_replace(s, "^ | $", "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 for unequal lengths, empty or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (size == 0), 0.0).otherwise(dot / size)
