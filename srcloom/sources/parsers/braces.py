"""Java, C#, Go, Rust and Ruby: declarations and calls by keywords and brackets."""

from __future__ import annotations

from .lexer import Token, finish, import_row, matches, symbol, tokenize

#: Words that open a class or an interface, and words before a parenthesis that are no call.
CLASSES = {"java": {"class", "record"}, "csharp": {"class"}, "go": set(), "rust": {"struct", "enum"}, "ruby": {"class", "module"}}
INTERFACES = {"java": {"interface"}, "csharp": {"interface"}, "go": set(), "rust": {"trait"}, "ruby": set()}
_KEYWORDS = frozenset("if for while switch catch return new throw func fn match loop else try using lock foreach sizeof typeof synchronized super this in go defer select case unless until elsif when and or not end def do begin yield".split())
_OPENS = frozenset("class module def if unless while until case begin do for".split())


class _Scan:
    def __init__(self, language: str, content: str):
        self.language = language
        self.tokens: list[Token] = tokenize(content, hash_comments=language == "ruby", char_quotes=language != "rust")
        self.match = matches(self.tokens)
        self.imports: list[dict] = []
        self.symbols: list[dict] = []
        self.calls: list[dict] = []

    def text(self, i):
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i):
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def line(self, i):
        return self.tokens[min(max(i, 0), len(self.tokens) - 1)].line

    def params(self, a: int) -> list[str]:
        out, part, depth = [], [], 0
        for i in range(a + 1, self.match[a]):
            t = self.text(i)
            depth += (t in "([{<") - (t in ")]}>")
            if t == "," and depth == 0:
                out.append(part)
                part = []
            else:
                part.append(t)
        out.append(part)
        names = []
        for p in out:
            for stop in ("=", ":"):
                if stop in p:
                    p = p[: p.index(stop)]
            if p:
                names.append(" ".join(p))
        return names

    def add(self, name, scope, kind, params, a, z, is_async=False) -> str:
        qualified = f"{scope}.{name}" if scope and kind in ("Function", "Method") else name
        self.symbols.append(symbol(name, qualified, kind, params, self.line(a), self.line(z), False, is_async))
        return qualified

    def first_of_line(self, i: int) -> int:
        """Where the declaration that has token i begins: after the last end of a statement or block."""
        while i > 0 and self.text(i - 1) not in (";", "{", "}") and not (self.text(i - 1) == ")" and self.text(self.match[i - 1] - 2) == "@"):
            i -= 1
        return i

    def chain(self, i: int) -> tuple[int, str]:
        """(start, dotted name) of the names that end at i."""
        name = self.text(i)
        while self.text(i - 1) == "." and self.kind(i - 2) == "name":
            i -= 2
            name = f"{self.text(i)}.{name}"
        return i, name

    def call(self, i: int, scope) -> None:
        start, name = self.chain(i)
        if self.text(start - 1) in (".", "::", "?."):
            name = None if self.language != "rust" or self.text(start - 1) != "::" else None
        if name and self.language in ("java", "ruby") and "." in name and self.text(start - 1) != "new":
            name = name.rpartition(".")[0]  # what the call is made on stands first
        if name:
            self.calls.append({"callee_name": name, "caller_qualified_name": scope, "line": self.line(start)})

    def walk(self, i: int, end: int, scope: str | None, in_class: bool) -> None:
        classes, interfaces = CLASSES[self.language], INTERFACES[self.language]
        while i < end:
            t = self.text(i)
            if self.kind(i) == "name" and self.text(i - 1) != ".":
                if t in classes | interfaces and self.kind(i + 1) == "name":
                    j = i + 2
                    while j < end and self.text(j) not in ("{", ";"):
                        j = self.match[j] + 1 if self.match[j] > j and self.text(j) != "{" else j + 1
                    a = i if self.language in ("rust", "go") else self.first_of_line(i)
                    if self.language == "rust" and self.text(i - 1) == "pub":
                        a = i - 1
                    last = self.match[j] if self.text(j) == "{" else min(j, end - 1)
                    name = self.add(self.text(i + 1), None, "Class" if t in classes else "Interface", [], a, last)
                    if self.text(j) == "{":
                        self.walk(j + 1, last, name, True)
                    i = last + 1
                    continue
                if self.language == "go" and t == "import":
                    i = self.go_import(i, end)
                    continue
                if self.language == "go" and t == "func" and (self.kind(i + 1) == "name" or self.text(i + 1) == "(" and self.kind(self.match[i + 1] + 1) == "name" and self.text(self.match[i + 1] + 2) in ("(", "[")):
                    method = self.text(i + 1) == "("
                    n = self.match[i + 1] + 1 if method else i + 1
                    i = self.function(i, n, n + 1, end, scope, "Method" if method else "Function")
                    continue
                if self.language == "rust" and t == "fn" and self.kind(i + 1) == "name":
                    a = i
                    while self.text(a - 1) in ("pub", "async", "const", "unsafe", "extern"):
                        a -= 1
                    i = self.function(a, i + 1, i + 2, end, scope, "Method")
                    continue
                if self.language in ("java", "csharp") and in_class and self.text(i + 1) == "(" and self.match[i + 1] > i and t not in _KEYWORDS and (self.kind(i - 1) == "name" and self.text(i - 1) not in ("new", "return") or self.text(i - 1) in (">", "]", "?", "{", "}", ";")):
                    k = self.match[i + 1] + 1
                    while self.text(k) in ("throws", ",") or self.kind(k) == "name" or self.text(k) == ".":
                        k += 1
                    if self.text(k) in ("{", ";", "=>", ":"):
                        i = self.function(self.first_of_line(i), i, i + 1, end, scope, "Method")
                        continue
                if t == "new" and self.kind(i + 1) == "name":
                    j = i + 1
                    while self.text(j + 1) == "." and self.kind(j + 2) == "name":
                        j += 2
                    name = ".".join(self.text(k) for k in range(i + 1, j + 1, 2))
                    self.calls.append({"callee_name": name, "caller_qualified_name": scope, "line": self.line(i)})
                    i = j + 1
                    continue
            if self.kind(i) == "name" and (self.text(i + 1) == "(" or self.language == "rust" and self.text(i + 1) == "!" and self.text(i + 2) in ("(", "[", "{")) and t not in _KEYWORDS:
                self.call(i, scope)
            i += 1

    def function(self, a: int, name: int, p: int, end: int, scope, kind: str) -> int:
        """A function from its first token; p is at or before its parameters. The index after it."""
        while p < end and self.text(p) != "(":
            p += 1
        if p >= end or self.match[p] <= p:
            return name + 1
        j = self.match[p] + 1
        while j < end and self.text(j) not in ("{", ";", "=>"):
            j = self.match[j] + 1 if self.match[j] > j and self.text(j) != "{" else j + 1
        last = self.match[j] if self.text(j) == "{" else min(j, end - 1)
        if self.text(j) == "=>":
            while last < end - 1 and self.text(last) != ";":
                last += 1
        is_async = any(self.text(k) == "async" for k in range(a, name))
        own = self.add(self.text(name), scope, kind, self.params(p), a, last, is_async)
        self.walk(j + 1, last, own, False)
        return last + 1

    def go_import(self, i: int, end: int) -> int:
        j = i + 1
        stop = self.match[j] if self.text(j) == "(" else j + 1 + (self.kind(j) != "string")
        found = [k for k in range(j, min(stop, end) + 1) if self.kind(k) == "string"]
        if found:  # the declaration counts once, by its last path, and each of its lines once more
            alias = lambda k: [(self.text(k - 1), self.text(k - 1))] if self.kind(k - 1) == "name" and self.text(k - 1) != "import" else []
            self.imports.append(import_row(self.text(found[-1]), self.line(i), [b for k in found for b in alias(k)]))
            self.imports += [import_row(self.text(k), self.line(k), alias(k)) for k in found]
        return (max(found) if found else j) + 1

    def ruby(self) -> None:
        """Ruby's blocks end with a word."""
        stack: list[tuple[str, int, str | None]] = []  # (word, symbol index or -1, scope before)
        scope = None
        i, n = 0, len(self.tokens)
        while i < n:
            t, tok = self.text(i), self.tokens[i]
            if tok.kind == "name" and self.text(i - 1) != ".":
                modifier = t in ("if", "unless", "while", "until") and not tok.newline and self.text(i - 1) not in ("=", ";", "(", "then", "else", "do")
                if t in ("class", "module") and self.kind(i + 1) == "name" and tok.newline:
                    stack.append((t, len(self.symbols), scope))
                    scope = self.add(self.text(i + 1), None, "Class", [], i, i)
                    i += 2
                    continue
                if t == "def":
                    k = i + 3 if self.text(i + 2) == "." else i + 1
                    params = self.params(k + 1) if self.text(k + 1) == "(" and self.match[k + 1] > k else []
                    stack.append((t, len(self.symbols), scope))
                    scope = self.add(self.text(k), scope, "Method", params, i, i)
                    i = self.match[k + 1] + 1 if params or self.text(k + 1) == "(" else k + 1
                    continue
                if t == "do" and stack and stack[-1][0] in ("while", "until", "for") and self.line(i) == stack[-1][1]:
                    i += 1
                    continue
                if t in _OPENS and not modifier:
                    stack.append((t, tok.line if t in ("while", "until", "for") else -1, scope))
                elif t == "end" and stack:
                    word, at, before = stack.pop()
                    if word in ("class", "module", "def"):
                        self.symbols[at]["end_line"] = tok.line
                        scope = before
                elif t not in _KEYWORDS and (self.text(i + 1) == "(" or self.kind(i + 1) == "string" and not self.tokens[i + 1].newline):
                    last = i
                    while self.text(last + 1) == "." and self.kind(last + 2) == "name":
                        last += 2
                    if self.kind(i + 1) == "string" or self.kind(i + 2) == "string":
                        s = i + 1 if self.kind(i + 1) == "string" else i + 2
                        self.imports.append(import_row(self.text(s), tok.line, [(t, t)]))
                    self.call(i, scope)
            elif tok.kind == "name" and self.text(i + 1) == "(":
                self.call(i, scope)
            i += 1


def parser(language: str):
    def parse(path: str, content: str) -> dict:
        s = _Scan(language, content)
        if s.tokens:
            s.ruby() if language == "ruby" else s.walk(0, len(s.tokens), None, False)
        return finish(content, s.imports, s.symbols, s.calls)

    return parse
