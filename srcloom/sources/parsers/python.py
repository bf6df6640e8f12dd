"""Python, by the standard library's syntax tree."""

from __future__ import annotations

import ast

from .lexer import finish, import_row, symbol


def _dotted(node: ast.expr) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(parts)])


class _Visitor(ast.NodeVisitor):
    def __init__(self):
        self.imports: list[dict] = []
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.scopes: list[str] = []

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for d in node.decorator_list:
            self.visit(d)
        self.symbols.append(symbol(node.name, node.name, "Class", [], node.lineno, node.end_lineno))
        self.scopes.append(node.name)
        for child in [*node.bases, *node.keywords, *node.body]:
            self.visit(child)
        self.scopes.pop()

    def _function(self, node) -> None:
        for d in node.decorator_list:
            self.visit(d)
        name = f"{self.scopes[-1]}.{node.name}" if self.scopes else node.name
        a = node.args
        params = [x.arg for x in [*a.posonlyargs, *a.args]] + ([f"*{a.vararg.arg}"] if a.vararg else ["*"] if a.kwonlyargs else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
        self.symbols.append(symbol(node.name, name, "Method", params, node.lineno, node.end_lineno, False, isinstance(node, ast.AsyncFunctionDef)))
        self.scopes.append(name)
        for child in [a, *([node.returns] if node.returns else []), *node.body]:
            self.visit(child)
        self.scopes.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Call(self, node: ast.Call) -> None:
        if name := _dotted(node.func):
            self.calls.append({"callee_name": name, "caller_qualified_name": self.scopes[-1] if self.scopes else None, "line": node.lineno})
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        plain = [x.name for x in node.names if not x.asname]
        if plain:
            rest = [(x.asname or x.name, x.name) for x in node.names if x.asname or x.name != plain[0]]
            self.imports.append(import_row(plain[0], node.lineno, rest))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        names = [(x.asname or x.name, x.name) for x in node.names if x.name != "*"]
        spec = "." * node.level + (node.module or "")
        if spec == "__future__":  # the statement names no module
            spec, names = names[0][1], names[1:]
        star = "*" if any(x.name == "*" for x in node.names) else None
        self.imports.append(import_row(spec, node.lineno, names, star))


def parse(path: str, content: str) -> dict:
    v = _Visitor()
    v.visit(ast.parse(content.removeprefix("﻿")))
    return finish(content, v.imports, v.symbols, v.calls)
