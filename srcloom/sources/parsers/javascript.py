"""JavaScript and TypeScript: one pass over the tokens, recursing into function and class bodies."""

from __future__ import annotations

from .lexer import CLOSE, Token, finish, import_row, matches, symbol, tokenize

_NOT_CALLED = frozenset("if for while switch catch with function return typeof await yield void delete in of instanceof case throw else do new super import this class extends async".split())
_MODIFIERS = frozenset("static async get set public private protected readonly abstract override declare accessor".split())
_ENDS = frozenset("; ,".split())
#: Files in which < is never markup.
_PLAIN = (".ts", ".mts", ".cts")
_TYPE_WORDS = frozenset(". , | & [ ] ? : ; ... => { } ( )".split())


class _File:
    def __init__(self, content: str, markup: bool = False):
        self.tokens: list[Token] = tokenize(content, regex=True, template=True, markup=markup)
        self.match = matches(self.tokens)
        self.imports: list[dict] = []
        self.symbols: list[dict] = []
        self.calls: list[dict] = []

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return self.tokens[min(max(i, 0), len(self.tokens) - 1)].line if self.tokens else 1

    def params(self, a: int) -> list[str]:
        """Names of the parameters in the parentheses that open at a."""
        out, i, end, fresh = [], a + 1, self.match[a], True
        while i < end:
            t = self.text(i)
            if fresh:
                while self.text(i) in _MODIFIERS and self.kind(i + 1) == "name":
                    i += 1
                t = self.text(i)
                if t == "...":
                    out.append(f"...{self.text(i + 1)}" if self.kind(i + 1) == "name" else "...rest")
                elif t == "{":
                    out.append("{...}")
                elif t == "[":
                    out.append("[...]")
                elif self.kind(i) == "name":
                    out.append(t)
                fresh = False
            if t in ("(", "[", "{") and self.match[i] > i:
                i = self.match[i]
            elif t == ",":
                fresh = True
            i += 1
        return out

    def body_after(self, i: int, end: int) -> int | None:
        """The brace that opens the body of a function whose parameters close just before i, past a return type."""
        if self.text(i) == ":":
            i += 1
            while i < end and not (self.text(i) == "{" and self.text(i - 1) not in (":", "|", "&", "<", ",", "=>")) and self.text(i) not in (";", "=>"):
                i = self.match[i] + 1 if self.match[i] > i else i + 1
        return i if i < end and self.text(i) == "{" else None

    def arrow(self, i: int, end: int) -> tuple[list[str], int, bool] | None:
        """(parameters, index after =>, async) if an arrow function starts at i."""
        is_async = self.text(i) == "async" and self.text(i + 1) != "=>" and not self.tokens[min(i + 1, len(self.tokens) - 1)].newline
        j = i + is_async
        if self.text(j) == "<":
            while j < end and self.text(j) != "(":
                j += 1
        if self.text(j) == "(" and self.match[j] > j:
            k = self.match[j] + 1
            if self.text(k) == ":":
                k += 1
                while k < end and self.text(k) not in ("=>", ";", ",", ")", "="):
                    k = self.match[k] + 1 if self.match[k] > k else k + 1
            return (self.params(j), k + 1, is_async) if self.text(k) == "=>" else None
        if self.kind(j) == "name" and self.text(j + 1) == "=>":
            return [self.text(j)], j + 2, is_async
        return None

    def expression_end(self, i: int, end: int) -> int:
        """The index after an expression that starts at i."""
        while i < end:
            t = self.tokens[i]
            if t.text in _ENDS or (t.kind == "punct" and t.text in CLOSE):
                break
            i = self.match[i] + 1 if self.match[i] > i else i + 1
            if i < end and self.tokens[i].newline and self.kind(i) in ("name", "string", "number") and self.text(i - 1) not in ("=>", "=", "+", "-", "*", "/", "&&", "||", "??", "?", ":", ".", ",", "(", "?."):
                break
        return i

    def function_value(self, i: int, end: int) -> tuple[list[str], int, int, bool] | None:
        """(parameters, body start, body end, async) of a function or arrow expression at i; the body excludes its braces."""
        is_async = self.text(i) == "async" and self.text(i + 1) == "function"
        if self.text(i + is_async) == "function":
            j = i + is_async + 1
            while j < end and self.text(j) != "(":
                j += 1
            if self.match[j] > j and (b := self.body_after(self.match[j] + 1, end)) is not None:
                return self.params(j), b + 1, self.match[b], is_async
            return None
        if (a := self.arrow(i, end)) is not None:
            names, b, is_async = a
            if self.text(b) == "{":
                return names, b + 1, self.match[b], is_async
            return names, b, self.expression_end(b, end), is_async
        return None

    def callee(self, i: int) -> str | None:
        """The dotted name that a call's parenthesis at i + 1 applies to; what isn't a name adds nothing."""
        parts: list[str] = []
        while True:
            if self.kind(i) == "name":
                if self.text(i) not in ("this", "super"):
                    parts.append(self.text(i))
            elif self.text(i) == "]" and self.match[i] >= 0:
                a = self.match[i]
                if i - a == 2 and self.kind(a + 1) == "string":
                    parts.append(self.text(a + 1))
                i = a - 1
                continue
            else:
                break
            if self.text(i - 1) == "?.":
                return None
            if self.text(i - 1) != ".":
                break
            i -= 2
            if self.text(i) == "?.":
                return None
        return ".".join(reversed(parts)) or None

    def walk(self, i: int, end: int, caller: str | None, cls: str | None, exported: bool) -> None:
        """exported: whether a function declared here counts as exported."""
        mark = False
        while i < end:
            t, kind = self.text(i), self.kind(i)
            start = i
            if kind == "name" and self.text(i - 1) not in (".", "?."):
                if t == "import" and self.text(i + 1) not in ("(", "."):
                    i = self.import_statement(i, end)
                    continue
                if t == "export":
                    j = self.export_list(i, end)
                    if j is not None:
                        i = j
                        continue
                    mark, i = True, i + 1
                    if self.text(i) == "default":
                        i += 1
                    continue
                if t in ("async", "declare", "abstract") and self.text(i + 1) in ("function", "class"):
                    i += 1
                    continue
                if t == "function":
                    i = self.function(i, end, caller, cls, mark or exported)
                    mark = False
                    continue
                if t == "class" and self.text(i - 1) not in ("=", "(", ",", "return", ":") and (self.kind(i + 1) == "name" or mark):
                    i = self.class_declaration(i, end, caller, mark or exported)
                    mark = False
                    continue
                if t == "interface" and self.kind(i + 1) == "name" and self.text(i + 2) in ("{", "extends", "<"):
                    j = i + 2
                    while j < end and self.text(j) != "{":
                        j += 1
                    last = self.match[j] if j < end else i
                    self.symbols.append(symbol(self.text(i + 1), self.text(i + 1), "Interface", [], self.line(i), self.line(last), mark or exported))
                    mark, i = False, last + 1
                    continue
                if t in ("const", "let", "var") and self.kind(i + 1) == "name":
                    i, mark = self.variable(i + 1, end, caller, mark), mark
                    continue
                if self.text(i + 1) == "(" and self.match[i + 1] > i and t not in _NOT_CALLED and self.text(self.match[i + 1] + 1) == "{" and self.text(i - 1) in ("{", ",", "async", "get", "set", "*"):
                    b = self.match[i + 1] + 1
                    self.symbols.append(symbol(t, t, "Function", self.params(i + 1), self.line(i), self.line(self.match[b]), False, self.text(i - 1) == "async"))
                    self.walk(i + 2, self.match[i + 1], caller, cls, False)
                    self.walk(b + 1, self.match[b], t, cls, False)
                    i = self.match[b] + 1
                    continue
            if t == ";" or (kind == "punct" and t == "}"):
                mark = False
            if kind == "name" and self.text(i + 1) == "(" and (t not in _NOT_CALLED or self.text(i - 1) in (".", "?.")):
                self.call(i, caller)
            elif t == "]" and self.text(i + 1) == "(":
                self.call(i, caller)
            elif kind == "name" and self.text(i + 1) == "<" and (t not in _NOT_CALLED or self.text(i - 1) in (".", "?.")) and self.type_arguments(i + 1, end):
                self.call(i, caller)
            i = max(i + 1, start + 1)

    def type_arguments(self, i: int, end: int) -> bool:
        """Whether type arguments open at i, with a call's parenthesis behind them."""
        depth = 0
        while i < end:
            t, kind = self.text(i), self.kind(i)
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return self.text(i + 1) == "("
            if kind == "punct" and t not in _TYPE_WORDS and t not in ("<", ">"):
                return False
            if t in (";", "}") or (t == ")" and self.match[i] < 0):
                return False
            i = self.match[i] + 1 if t in ("(", "[", "{") and self.match[i] > i else i + 1
        return False

    def call(self, i: int, caller: str | None) -> None:
        if self.text(i) == "require" and self.text(i - 1) != "." and self.kind(i + 2) == "string" and self.text(i + 3) == ")":
            self.imports.append(import_row(self.text(i + 2), self.line(i), require=True))
            return
        name = self.callee(i)
        if name:
            k = i
            while self.text(k - 1) == "." and self.kind(k - 2) == "name":
                k -= 2
            self.calls.append({"callee_name": name, "caller_qualified_name": caller, "line": self.line(k)})

    def function(self, i: int, end: int, caller, cls, exported) -> int:
        is_async = self.text(i - 1) == "async"
        j = i + 1 + (self.text(i + 1) == "*")
        name = self.text(j) if self.kind(j) == "name" else None
        while j < end and self.text(j) != "(":
            j += 1
        if j >= end or self.match[j] <= j:
            return i + 1
        b = self.body_after(self.match[j] + 1, end)
        self.walk(j + 1, self.match[j], caller, cls, False)
        if b is None:
            return self.match[j] + 1
        inner = caller
        declared = name is not None and self.text(i - 1 - is_async) not in ("=", "(", ",", "return", ":", "?", "&&", "||", "=>")
        if declared:
            inner = f"{cls}.{name}" if cls else name
            self.symbols.append(symbol(name, inner, "Function", self.params(j), self.line(i - is_async), self.line(self.match[b]), exported, is_async))
        top = exported and declared and self.text(i - 1 - is_async) in ("export", "default")
        self.walk(b + 1, self.match[b], inner, cls, top)
        return self.match[b] + 1

    def variable(self, i: int, end: int, caller, mark: bool) -> int:
        """One declarator from its name on; further ones follow in the ordinary walk."""
        name, j = self.text(i), i + 1
        if self.text(j) == ":":
            while j < end and self.text(j) not in ("=", ";") and not self.tokens[j].newline:
                j = self.match[j] + 1 if self.match[j] > j else j + 1
        if self.text(j) != "=":
            return i + 1
        got = self.function_value(j + 1, end)
        if got is None:
            return j + 1
        params, a, z, is_async = got
        last = z if self.text(z) == "}" and self.text(a - 1) == "{" else z - 1
        self.symbols.append(symbol(name, name, "Function", params, self.line(i), self.line(last), mark, is_async))
        self.walk(a, z, name, None, False)
        return z + (self.text(z) == "}" and self.text(a - 1) == "{")

    def class_declaration(self, i: int, end: int, caller, exported) -> int:
        name = self.text(i + 1) if self.kind(i + 1) == "name" and self.text(i + 1) != "extends" else "AnonymousClass"
        j = i + 1
        while j < end and self.text(j) != "{":
            j = self.match[j] + 1 if self.match[j] > j else j + 1
        if j >= end:
            return i + 1
        close = self.match[j]
        self.symbols.append(symbol(name, name, "Class", [], self.line(i), self.line(close), exported))
        k = j + 1
        while k < close:
            if self.text(k) in (";", ","):
                k += 1
                continue
            head, is_async = k, False
            if self.text(k) == "static" and self.text(k + 1) == "{":  # a block that runs once
                self.walk(k + 2, self.match[k + 1], caller, name, False)
                k = self.match[k + 1] + 1
                continue
            while self.text(k) in _MODIFIERS and self.text(k + 1) not in ("(", "=", ";", ":"):
                is_async |= self.text(k) == "async"
                k += 1
            if self.text(k) == "@":  # a decorator
                k += 2
                if self.text(k) == "(":
                    self.walk(k + 1, self.match[k], caller, name, False)
                    k = self.match[k] + 1
                continue
            if self.text(k) == "*":
                k += 1
            private = self.text(k) == "#"
            k += private
            member = self.text(k) if self.kind(k) in ("name", "string", "number") else "method"
            p = self.match[k] + 1 if self.text(k) == "[" else k + 1
            if self.text(p) in ("?", "!"):
                p += 1
            if self.text(p) == "<":
                while p < close and self.text(p) != "(":
                    p += 1
            if self.text(p) == "(" and self.match[p] > p:
                b = self.body_after(self.match[p] + 1, close)
                stop = self.match[b] if b is not None else self.expression_end(self.match[p] + 1, close)
                inner = caller
                if not private and b is not None:
                    inner = f"{name}.{member}"
                    self.symbols.append(symbol(member, inner, "Method", self.params(p), self.line(head), self.line(stop), exported, is_async))
                self.walk(p + 1, self.match[p], inner, name, False)
                if b is not None:
                    self.walk(b + 1, stop, inner, name, False)
                k = stop + 1
                continue
            if self.text(p) == ":":
                while p < close and self.text(p) not in ("=", ";") and not (self.tokens[p].newline and p > k + 1):
                    p = self.match[p] + 1 if self.match[p] > p else p + 1
            if self.text(p) == "=" and (got := self.function_value(p + 1, close)) is not None and not private:
                params, a, z, value_async = got
                own = f"{name}.{member if self.kind(k) == 'name' else 'field'}"
                last = z if self.text(a - 1) == "{" else z - 1
                self.symbols.append(symbol(own.split(".")[-1], own, "Method", params, self.line(head), self.line(last), exported, value_async))
                self.walk(a, z, own, name, False)
                k = z + (self.text(a - 1) == "{")
                continue
            stop = self.expression_end(p + (self.text(p) == "="), close)
            self.walk(p, stop, caller, name, False)
            k = max(stop + (self.text(stop) in (";", ",")), k + 1)
        return close + 1

    def import_statement(self, i: int, end: int) -> int:
        line, j = self.line(i), i + 1
        type_only = self.text(j) == "type" and self.text(j + 1) not in ("from", ",")
        j += type_only
        if self.kind(j) == "string":
            self.imports.append(import_row(self.text(j), line))
            return j + 1
        default = namespace = None
        names: list[tuple[str, str]] = []
        while j < end and self.text(j) != "from" and self.text(j) != ";":
            if self.text(j) == "{":
                names = self.names(j)
                j = self.match[j] + 1
            elif self.text(j) == "*" and self.text(j + 1) == "as":
                namespace, j = self.text(j + 2), j + 3
            elif self.text(j) == "=":  # import x = require("y")
                return j + 1
            else:
                if self.kind(j) == "name":
                    default = self.text(j)
                j += 1
        if self.text(j) == "from" and self.kind(j + 1) == "string":
            self.imports.append(import_row(self.text(j + 1), line, names, namespace, default, type_only))
            return j + 2
        return j + 1

    def names(self, a: int) -> list[tuple[str, str]]:
        """(local, imported) of a list in braces that opens at a."""
        out, i = [], a + 1
        while i < self.match[a]:
            if self.text(i) == "type" and self.kind(i + 1) == "name" and self.text(i + 1) != "as":
                i += 1
            if self.kind(i) in ("name", "string"):
                imported = local = self.text(i)
                if self.text(i + 1) == "as":
                    local, i = self.text(i + 2), i + 2
                out.append((local, imported))
            i += 1
        return out

    def export_list(self, i: int, end: int) -> int | None:
        """The index after `export {...}`, `export {...} from` or `export * from`; None for other exports."""
        j = i + 1 + (self.text(i + 1) == "type" and self.text(i + 2) in ("{", "*"))
        type_only = j > i + 1
        if self.text(j) == "{" and self.match[j] > j:
            k = self.match[j] + 1
            if self.text(k) == "from" and self.kind(k + 1) == "string":
                self.imports.append(import_row(self.text(k + 1), self.line(i), [(imported, imported) for _, imported in self.names(j)], type_only=type_only, reexport=True))
                return k + 2
            return k
        if self.text(j) == "*":
            k = j + 1 + 2 * (self.text(j + 1) == "as")
            if self.text(k) == "from" and self.kind(k + 1) == "string":
                self.imports.append(import_row(self.text(k + 1), self.line(i), type_only=type_only, reexport=True))
                return k + 2
        return None


def parse(path: str, content: str) -> dict:
    f = _File(content, not path.lower().endswith(_PLAIN))
    if sum(t.text in ("{", "(", "[") for t in f.tokens if t.kind == "punct") != sum(t.text in ("}", ")", "]") for t in f.tokens if t.kind == "punct"):
        raise SyntaxError("unbalanced brackets")
    f.walk(0, len(f.tokens), None, None, False)
    imports = [x for x in f.imports if not x["specifier"].startswith("node:")]
    return finish(content, imports, f.symbols, f.calls)
