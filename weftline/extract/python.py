"""Python: the syntax tree of the standard library; lines of declarations where a text does not parse."""

from __future__ import annotations

import ast
import re
from functools import lru_cache

from weftline.extract.registry import LanguageAdapter, Node, register

_LINE = re.compile(r"^[ \t]*(?:(?:async\s+)?(def)\s+(\w+)|(class)\s+(\w+)|(import)\s+([\w.]+)|(from)\s+([\w.]+)\s+import\b)[^\n]*", re.M)


class _Walk(ast.NodeVisitor):
    def __init__(self, text: str):
        self.text, self.starts = text, [0]
        self.lines = text.split("\n")
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.symbols: list[Node] = []
        self.found: list[Node] = []
        self.calls: list[Node] = []

    def at(self, line: int, col: int) -> int:
        own = self.lines[line - 1]
        return self.starts[line - 1] + (col if own.isascii() else len(own.encode()[:col].decode(errors="ignore")))

    def span(self, n: ast.AST) -> tuple[int, int]:
        return self.at(n.lineno, n.col_offset), self.at(n.end_lineno, n.end_col_offset)

    def source(self, n: ast.AST) -> str:
        a, b = self.span(n)
        return self.text[a:b]

    def definition(self, n, kind: str) -> None:
        a, b = self.span(n)
        if n.decorator_list:
            first = n.decorator_list[0]
            start = self.text.rfind("@", 0, self.at(first.lineno, first.col_offset))
            self.symbols.append(Node("decorated", n.name, start, b))
        self.symbols.append(Node(kind, n.name, a, b))
        self.generic_visit(n)

    def visit_FunctionDef(self, n):
        self.definition(n, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, n):
        self.definition(n, "class")

    def visit_Lambda(self, n):
        self.symbols.append(Node("function", "lambda", *self.span(n)))
        self.generic_visit(n)

    def visit_Assign(self, n):
        a, b = self.span(n)
        left = self.text[a : self.span(n.targets[0])[1]]
        self.symbols.append(Node("variable", left, a, b))
        self.generic_visit(n)

    def visit_AnnAssign(self, n):
        self.symbols.append(Node("variable", self.source(n.target), *self.span(n)))
        self.generic_visit(n)

    def visit_Import(self, n):
        self.symbols.append(Node("import", n.names[0].name, *self.span(n)))
        self.found.append(Node("import", n.names[0].name, *self.span(n)))

    def visit_ImportFrom(self, n):
        name = "." * n.level + (n.module or "")
        self.symbols.append(Node("import", name, *self.span(n)))
        self.found.append(Node("import", name, *self.span(n)))

    def visit_Call(self, n):
        callee = self.source(n.func)
        self.calls.append(Node("dynamic" if "." in callee else "static", callee, *self.span(n)))
        self.generic_visit(n)


@register("python")
class Python(LanguageAdapter):
    @lru_cache(maxsize=1)
    def _walk(self, text: str) -> _Walk:
        w = _Walk(text)
        try:
            w.visit(ast.parse(text))
        except (SyntaxError, ValueError):
            w.symbols = [Node(*self._line(m), m.start() + len(m[0]) - len(m[0].lstrip()), m.end()) for m in _LINE.finditer(text)]
            w.found = [n for n in w.symbols if n.kind == "import"]
        return w

    @staticmethod
    def _line(m: re.Match) -> tuple[str, str]:
        return ("function", m[2]) if m[1] else ("class", m[4]) if m[3] else ("import", m[6] or m[8])

    def symbols(self, text):
        return self._walk(text).symbols

    def imports(self, text):
        return self._walk(text).found

    def calls(self, text):
        return sorted(self._walk(text).calls, key=lambda n: (n.start, -n.end))
