"""A tokenizer for C-like languages, and helpers shared by the parsers."""

from __future__ import annotations

import re
from dataclasses import dataclass

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "`(": "`)"}, {")", "]", "}", "`)"}
_NAME = re.compile(r"[A-Za-z_$ª-￿][\w$ª-￿]*")
_NUMBER = re.compile(r"\.?\d(?:[\w.]|[eE][+-])*")
_PUNCT = re.compile(r"=>|\?\.(?!\d)|\.\.\.|::|->|&&|\|\||\?\?|[=!]==?|[<>]=|\+\+|--|:=|<-|.", re.S)
#: After these a slash begins a regular expression.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => && || ?? == === != !== + - * % < > ~ ^ return typeof case in of delete void throw new await yield else do".split())

#: What adds a branch to a function, with ASCII word borders.
BRANCHES = [re.compile(p, re.A) for p in (r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcase\b", r"\bcatch\s*\(", r"\?[^:.\n]+\s*:", r"(?:&&|\|\|)")]


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, regex, punct
    text: str
    line: int
    at: int
    newline: bool  # whether a line break stands before it


#: What begins an element of markup in an expression, rather than a comparison or a type parameter.
_ELEMENT = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?!\s*,|\s+extends\b)(?=\s*/?>|\s+[A-Za-z_{$/]|\s*\{))")


def tokenize(src: str, *, regex: bool = False, template: bool = False, hash_comments: bool = False, char_quotes: bool = True, markup: bool = False, _line: int = 1, _at: int = 0, _end: int | None = None) -> list[Token]:
    """Tokens of a text. Template literals, and elements of markup, give a string token and, in brackets of their own, the tokens of their expressions."""
    out: list[Token] = []
    _scan(src, out, _at, len(src) if _end is None else _end, _line, {"regex": regex, "template": template, "hash_comments": hash_comments, "char_quotes": char_quotes, "markup": markup})
    return out


def _scan(src: str, out: list[Token], i: int, end: int, line: int, how: dict, inner: bool = False) -> tuple[int, int]:
    """Appends the tokens from i on; (index, line) of the end or, for an inner expression, of the brace that closes it."""
    regex, template, hash_comments, char_quotes, markup = how["regex"], how["template"], how["hash_comments"], how["char_quotes"], how["markup"]
    fresh, depth = True, 0
    while i < end:
        c = src[i]
        if inner and c in "{}":
            depth += 1 if c == "{" else -1
            if depth < 0:
                return i, line
        if c == "\n":
            line, i, fresh = line + 1, i + 1, True
        elif c.isspace() or c == "﻿":
            i += 1
        elif src.startswith("//", i) or (hash_comments and c == "#"):
            stop = src.find("\n", i, end)
            i = end if stop < 0 else stop
        elif src.startswith("/*", i):
            stop = src.find("*/", i + 2, end)
            stop = end if stop < 0 else stop + 2
            fresh |= "\n" in src[i:stop]
            line, i = line + src.count("\n", i, stop), stop
        elif c == '"' or (c == "'" and char_quotes):
            j = i + 1
            while j < end and src[j] != c and src[j] != "\n":
                j += 2 if src[j] == "\\" else 1
            out.append(Token("string", src[i + 1 : j], line, i, fresh))
            line += src.count("\n", i, min(j + 1, end))
            i, fresh = j + 1, False
        elif c == "`":
            i, line = _template(src, i, end, line, fresh, out, how)
            fresh = False
        elif markup and c == "<" and (not out or out[-1].text in _BEFORE_REGEX) and _ELEMENT.match(src, i, end):
            i, line = _element(src, i, end, line, fresh, out, how)
            fresh = False
        elif regex and c == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*").match(src, i, end)):
            out.append(Token("regex", m[0], line, i, fresh))
            i, fresh = m.end(), False
        else:
            m = _NAME.match(src, i, end)
            kind = "name"
            if not m:
                m, kind = _NUMBER.match(src, i, end), "number"
            if not m or (kind == "number" and m[0] == "."):
                m, kind = _PUNCT.match(src, i, end), "punct"
            out.append(Token(kind, m[0], line, i, fresh))
            i, fresh = m.end(), False
    return i, line


def _braced(src, i, end, line, out, how) -> tuple[int, int]:
    """The expression in the braces that open at i, in brackets of its own."""
    out.append(Token("punct", "`(", line, i, False))
    i, line = _scan(src, out, i + 1, end, line, how, inner=True)
    out.append(Token("punct", "`)", line, i, False))
    return min(i + 1, end), line


def _element(src, i, end, line, fresh, out, how) -> tuple[int, int]:
    """An element of markup with all that it holds: names, attributes and text are no tokens, expressions in braces are."""
    out.append(Token("string", "", line, i, fresh))
    depth = 0
    while i < end:
        if src.startswith("</", i):
            stop = src.find(">", i, end)
            stop = end if stop < 0 else stop + 1
            line, i, depth = line + src.count("\n", i, stop), stop, depth - 1
        elif src[i] == "<":
            i, depth = i + 1, depth + 1
            while i < end:
                c = src[i]
                if src.startswith("/>", i):
                    i, depth = i + 2, depth - 1
                    break
                if c == ">":
                    i += 1
                    break
                if c in "'\"":
                    stop = src.find(c, i + 1, end)
                    stop = end if stop < 0 else stop + 1
                    line, i = line + src.count("\n", i, stop), stop
                elif c == "{":
                    i, line = _braced(src, i, end, line, out, how)
                else:
                    line += c == "\n"
                    i += 1
        elif src[i] == "{":
            i, line = _braced(src, i, end, line, out, how)
        else:
            line += src[i] == "\n"
            i += 1
        if depth <= 0:
            break
    # what follows an element isn't a regular expression
    out.append(Token("string", "", line, min(i, end) - 1, False))
    return i, line


def _template(src, i, end, line, fresh, out, how) -> tuple[int, int]:
    start, j = i, i + 1
    out.append(Token("string", "", line, start, fresh))
    while j < end and src[j] != "`":
        if src[j] == "\\":
            j += 2
        elif how["template"] and src.startswith("${", j):
            depth, k = 1, j + 2
            while k < end and depth:
                if src[k] == "`":
                    k = _skip_template(src, k, end)
                    continue
                if src[k] in "'\"":
                    q = k + 1
                    while q < end and src[q] != src[k] and src[q] != "\n":
                        q += 2 if src[q] == "\\" else 1
                    k = q
                depth += (src[k : k + 1] == "{") - (src[k : k + 1] == "}")
                k += 1
            inner = line + src.count("\n", start, j)
            out.append(Token("punct", "`(", inner, j, False))
            _scan(src, out, j + 2, k - 1, inner, how)
            out.append(Token("punct", "`)", line + src.count("\n", start, k), k - 1, False))
            j = k
        else:
            j += 1
    stop = min(j + 1, end)
    return stop, line + src.count("\n", start, stop)


def _skip_template(src, i, end) -> int:
    j = i + 1
    while j < end and src[j] != "`":
        if src[j] == "\\":
            j += 2
        elif src.startswith("${", j):
            depth, j = 1, j + 2
            while j < end and depth:
                if src[j] == "`":
                    j = _skip_template(src, j, end)
                    continue
                depth += (src[j] == "{") - (src[j] == "}")
                j += 1
        else:
            j += 1
    return j + 1


def matches(tokens: list[Token]) -> list[int]:
    """For each bracket the index of its partner (the end of the file for an open one); -1 for what is no bracket."""
    out, stack = [-1] * len(tokens), []
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in OPEN:
            stack.append(i)
            out[i] = len(tokens) - 1
        elif t.text in CLOSE:
            while stack:
                j = stack.pop()
                if OPEN[tokens[j].text] == t.text:
                    out[j], out[i] = i, j
                    break
    return out


def complexity(lines: list[str], start: int, end: int) -> int:
    body = "\n".join(lines[start - 1 : end])
    return 1 + sum(len(p.findall(body)) for p in BRANCHES) if body else 1


def symbol(name, qualified, kind, parameters, start, end, exported=False, is_async=False) -> dict:
    return {"name": name, "qualified_name": qualified, "kind": kind, "parameters": parameters, "start_line": start, "end_line": end, "is_exported": exported, "is_async": is_async, "complexity": 1}


def import_row(specifier, line, bindings=(), namespace=None, default=None, type_only=False, require=False, reexport=False) -> dict:
    seen, kept = set(), []
    for local, imported in bindings:
        if local and local not in seen:
            seen.add(local)
            kept.append({"local": local, "imported": imported})
    return {"specifier": specifier, "bindings": kept, "namespace_binding": namespace, "default_binding": default, "is_type_only": type_only, "is_require": require, "is_reexport": reexport, "line": line}


def finish(content: str, imports: list, symbols: list, calls: list) -> dict:
    """Adds complexity, and each call's caller line: that of the first symbol with the caller's name."""
    lines = re.split(r"\r?\n", content)
    first: dict[str, int] = {}
    for s in symbols:
        s["complexity"] = complexity(lines, s["start_line"], s["end_line"])
        first.setdefault(s["qualified_name"], s["start_line"])
    for c in calls:
        c["caller_start_line"] = first.get(c["caller_qualified_name"])
    return {"imports": imports, "symbols": symbols, "calls": calls}
