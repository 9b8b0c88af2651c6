"""Scanners for the brace languages: Rust, TypeScript and JavaScript, Java, Go.

Comments and strings are blanked, so that offsets stay; declarations are then found by patterns and ended by their matching
bracket or semicolon. Known gaps against a grammar: declarations inside macro bodies count as such, a chained call's callee starts
after the last closing bracket, and generics with comparison signs inside can end a pattern early."""

from __future__ import annotations

import re
from functools import lru_cache

from weftline.extract.registry import LanguageAdapter, Node, register

_LITERAL = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.[^'\n]*|[^'\\\n]{2,})'(?![\w])", re.S
)
_CHAIN = r"(?:[A-Za-z_$][\w$]*(?:\s*(?:\?\.|\.|::)\s*(?:<[^<>()]*>|[A-Za-z_$][\w$]*)|\[[^\[\]()]*\])*)"
_CALL = re.compile(rf"({_CHAIN})(?:::<[^<>()]*>|<[\w\s,<>]*>)?\s*\(")
_WORDS = {"if", "while", "for", "match", "switch", "return", "catch", "function", "fn", "func", "in", "loop", "else", "typeof", "await", "new", "super", "constructor", "let", "const", "var", "import", "synchronized", "try"}


_STOP = re.compile(r"[(){}\[\];,\n]")
_DECLARES = re.compile(r"\s*(?:default\s+)?(?:abstract\s+|async\s+)?(?:function|class|interface|enum)\b")
_GOES_ON = re.compile(r"\s*[.=?:&|+*/]")
_BRACKET = re.compile(r"[(){}\[\]]")
_ENDS = re.compile(r"[(){}\[\];]")
#: A text's symbols, imports and calls are asked for one after the other, and share what was made of it last.
last = lru_cache(maxsize=1)


def _before(masked: str, at: int) -> str:
    """What stands shortly before an offset."""
    return masked[max(0, at - 200) : at]


@last
def blank(text: str, lifetimes: bool = False) -> str:
    """The text with comments and the insides of strings as spaces."""

    def cover(m: re.Match) -> str:
        s = m[0]
        if s[0] == "'" and lifetimes and not (len(s) == 3 or s[1] == "\\"):
            return s
        keep = s[0] not in "/"
        return (s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]) if keep and len(s) > 1 else re.sub(r"[^\n]", " ", s)

    return _LITERAL.sub(cover, text)


def end_of(masked: str, at: int, brace: bool = True) -> tuple[int, bool]:
    """(end, has body) of a declaration from ``at``: its matching brace, or its semicolon, or the line's end outside brackets."""
    depth = 0
    for m in _ENDS.finditer(masked, at):
        c = m[0]
        if c == "{" and depth == 0 and brace:
            return close_of(masked, m.start()), True
        if c in "([{":
            depth += 1
        elif c == ";":
            if depth == 0:
                return m.end(), False
        elif depth == 0:
            return m.start(), False
        else:
            depth -= 1
    return len(masked), False


def close_of(masked: str, at: int) -> int:
    depth = 0
    for m in _BRACKET.finditer(masked, at):
        if m[0] in "([{":
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                return m.end()
    return len(masked)


def _calls(text: str, masked: str, declared: set[int]) -> list[tuple[str, int, int]]:
    out = []
    for m in _CALL.finditer(masked):
        name = text[m.start(1) : m.end(1)].strip()
        if name.split(".")[0].split("::")[0] in _WORDS or m.start(1) in declared:
            continue
        opening = m.end() - 1
        out.append((name, m.start(1), close_of(masked, opening)))
    return out


@register("rust")
class Rust(LanguageAdapter):
    sets_scope = False
    _VIS = r"(?:\bpub(?:\s*\([^)]*\))?\s+)?"
    _ITEM = re.compile(
        _VIS + r"(?:(?P<f>(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*\bfn\s+(?P<fn>\w+))|\b(?P<k>struct|enum|mod)\s+(?P<n>\w+)|(?:unsafe\s+)?\btrait\s+(?P<t>\w+)"
        r"|(?:unsafe\s+)?(?P<impl>\bimpl\b)|(?P<use>\buse)\s|\bconst\s+(?P<c>\w+)\s*:|\bstatic\s+(?:mut\s+)?(?P<s>\w+)\s*:)"
    )

    @last
    def _items(self, text: str) -> list[tuple[str, str, int, int, int]]:
        masked, out = blank(text, True), []
        for m in self._ITEM.finditer(masked):
            if m["impl"] and re.search(r"[:(,<>&=]\s*$", _before(masked, m.start())):
                continue
            kind, name, braces = (
                ("function", m["fn"], True) if m["f"] else (m["k"], m["n"], True) if m["k"] else ("trait", m["t"], True) if m["t"] else ("impl", "unknown", True) if m["impl"]
                else ("use", "unknown", False) if m["use"] else ("const", m["c"], False) if m["c"] else ("static", m["s"], False)
            )
            end, body = end_of(masked, m.end(), braces)
            if kind == "function" and not body:
                continue
            out.append((kind, name, m.start(), end, m.start("fn") if m["f"] else -1))
        return out

    def symbols(self, text):
        return [Node(k, n, s, e) for k, n, s, e, _ in self._items(text)]

    def imports(self, text):
        return [Node("import", n, s, e) for k, n, s, e, _ in self._items(text) if k == "use"]

    def calls(self, text):
        masked = blank(text, True)
        declared = {m.start(1) for m in re.finditer(r"\bfn\s+(\w+)", masked)}
        out = [Node("dynamic" if "[" in n or "{" in n else "static", n, s, e) for n, s, e in _calls(text, masked, declared)]
        for m in re.finditer(r"([A-Za-z_][\w:]*)!\s*(?=[(\[{])", masked):
            out.append(Node("static", m[1], m.start(), close_of(masked, m.end())))
        return sorted(out, key=lambda n: n.start)


@register("typescript", "javascript")
class TypeScript(LanguageAdapter):
    _ITEM = re.compile(
        r"\b(?:async\s+)?function\b\s*\*?\s*(?P<f>[\w$]+)|\b(?:abstract\s+)?class\s+(?P<c>[\w$]+)|\b(?:const\s+)?enum\s+(?P<e>[\w$]+)|\binterface\s+(?P<i>[\w$]+)|\btype\s+(?P<t>[\w$]+)[^=;\n]*=|"
        r"(?P<imp>\bimport)\b(?!\s*\()|(?P<exp>\bexport)\b|\b(?:const|let|var)\s+(?P<v>[\w$]+|[\[{])"
    )
    _METHOD = re.compile(r"(?<=[{};\n])\s*(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*\*?\s*(?P<m>#?[\w$]+)\s*(?:<[^>(]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{};=]+)?\{")
    _ARROW = re.compile(r"(?:\basync\s+)?(?:\([^()]*\)|\b(?P<p>[\w$]+))\s*(?::\s*[\w<>\[\]| ]+)?=>")

    @last
    def symbols(self, text):
        masked, out = blank(text), []
        for m in self._ITEM.finditer(masked):
            if m["imp"]:
                end = self._statement(masked, m.end())
                q = re.search(r"[\"'][^\"']*[\"']", text[m.start() : end])
                first = re.match(r"import\s+([\w$]+)", text[m.start() : end])
                out.append(Node("import", q[0] if q else first[1] if first else "import", m.start(), end))
                continue
            if m["exp"]:
                inner = _DECLARES.match(masked, m.end())
                end = end_of(masked, m.end())[0] if inner else self._statement(masked, m.end())
                out.append(Node("export", "export_statement", m.start(), end))
            elif m["v"]:
                out.append(Node("variable", m["v"] if m["v"] not in "[{" else "variable", m.start(), self._statement(masked, m.start("v"))))
            else:
                kind = next(k for k, g in (("function", "f"), ("class", "c"), ("enum", "e"), ("interface", "i"), ("type", "t")) if m[g])
                end = self._statement(masked, m.end()) if kind == "type" else end_of(masked, m.end())[0]
                out.append(Node(kind, next(x for x in m.groups() if x), m.start(), end))
        classes = [n for n in out if n.kind == "class"]
        for m in self._METHOD.finditer(masked):
            at = m.start("m")
            if m["m"] not in _WORDS - {"constructor"} and any(n.start < at < n.end for n in classes):
                out.append(Node("method", m["m"], m.start() + len(m[0]) - len(m[0].lstrip()), close_of(masked, m.end() - 1)))
        for m in self._ARROW.finditer(masked):
            body = re.compile(r"\s*").match(masked, m.end()).end()
            end = close_of(masked, body) if masked[body : body + 1] == "{" else self._statement(masked, body, False)
            out.append(Node("function", m["p"] or "arrow_function", m.start(), end))
        return out

    @staticmethod
    def _statement(masked: str, at: int, semicolon: bool = True) -> int:
        depth, last = 0, ""  # last: the last character that is no white space
        for m in _STOP.finditer(masked, at):
            i, c = m.start(), m[0]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                if depth == 0:
                    return i
                depth -= 1
            elif depth == 0 and c == ";":
                return i + semicolon
            elif depth == 0 and c == "," and not semicolon:
                return i
            elif depth == 0 and c == "\n":
                back = i - 1
                while back >= at and masked[back].isspace():
                    back -= 1
                last = masked[back] if back >= at else ""
                if last and last not in "=(,&|+?:" and not _GOES_ON.match(masked, i):
                    return i
        return len(masked)

    def imports(self, text):
        return [Node("import", n.name, n.start, n.end) for n in self.symbols(text) if n.kind == "import"]

    def calls(self, text):
        masked = blank(text)
        declared = {m.start("m") for m in self._METHOD.finditer(masked)} | {m.start(1) for m in re.finditer(r"\bfunction\b\s*\*?\s*([\w$]+)", masked)}
        out = []
        for name, s, e in _calls(text, masked, declared):
            new = re.search(r"\bnew\s+$", _before(masked, s))
            full = text[s:e]
            kind = "dynamic" if not new and ("import(" in full or "?.(" in full) else "static"
            out.append(Node(kind, re.split(r"[.:?]", name)[-1].strip(), s - (len(new[0]) if new else 0), e))
        return out


@register("java")
class Java(LanguageAdapter):
    _MOD = r"(?:(?:@\w+(?:\([^)]*\))?|public|private|protected|static|final|abstract|synchronized|native|default|transient|volatile|strictfp)\s+)*"
    _TYPE = re.compile(_MOD + r"(?P<a>@)?\b(?P<k>class|enum|interface)\s+(?P<n>\w+)")
    _MEMBER = re.compile(r"(?<=[{};])\s*(?P<all>" + _MOD + r"(?:<[^>]*>\s*)?(?:(?P<t>[\w.]+(?:<[^;(){}]*>)?(?:\[\])*)\s+)?(?P<n>\w+)\s*(?P<x>\(|=|;|,))")
    _IMPORT = re.compile(r"\bimport\s+[^;]*;")
    _NO_TYPE = ("return", "new", "throw", "else", "package", "import", "case", "assert", "yield")

    def symbols(self, text):
        masked = blank(text)
        out = [Node("import", "import_declaration", m.start(), m.end()) for m in self._IMPORT.finditer(masked)]
        for n in out:
            path = re.match(r"import\s+(?:static\s+)?(\w+)\s*;", text[n.start : n.end])
            n.name = path[1] if path else "import_declaration"
        types = [Node("annotation" if m["a"] else m["k"], m["n"], m.start() if m.start() == m.end() else m.start(), end_of(masked, m.end())[0]) for m in self._TYPE.finditer(masked)]
        out += types
        at = 0
        while m := self._MEMBER.search(masked, at):
            start = m.start("all")
            at = m.end() - 1 if m["x"] == ";" else m.end()
            inside = [t for t in types if t.start < start < t.end]
            if not inside or m["n"] in _WORDS or m["t"] in self._NO_TYPE:
                continue
            owner = min(inside, key=lambda t: t.end - t.start)
            if self._depth(masked, owner, start) != 1:
                continue
            if m["x"] == "(":
                after, body = end_of(masked, close_of(masked, m.end() - 1))
                out.append(Node("constructor" if m["t"] is None else "method", m["n"], start, after))
                at = max(at, m.end())
            elif m["t"]:
                out.append(Node("field", m["n"], start, end_of(masked, m.end() - 1, False)[0]))
        return out

    @staticmethod
    def _depth(masked: str, owner: Node, at: int) -> int:
        return masked.count("{", owner.start, at) - masked.count("}", owner.start, at)

    def imports(self, text):
        return [Node("import", "import", m.start(), m.end()) for m in self._IMPORT.finditer(blank(text))]

    def calls(self, text):
        masked = blank(text)
        declared = {m.start("n") for m in self._MEMBER.finditer(masked) if (m["t"] and m["t"] not in self._NO_TYPE) or (not m["t"] and m["n"][:1].isupper())}
        out = []
        for name, s, e in _calls(text, masked, declared):
            if not re.search(r"\bnew\s+$|@$", _before(masked, s)):
                out.append(Node("static", re.findall(r"[A-Za-z_]\w*", name)[-1], s, e))
        return out


@register("go")
class Go(LanguageAdapter):
    _ITEM = re.compile(r"^(?P<f>func)\s+(?P<r>\([^)]*\)\s*)?(?P<n>\w+)|^(?P<t>type)\b|^(?P<i>import)\b|\b(?P<v>var|const)\s+(?P<vn>\w+)?", re.M)

    @last
    def symbols(self, text):
        masked, out = blank(text), []
        for m in self._ITEM.finditer(masked):
            if m["f"]:
                out.append(Node("method" if m["r"] else "function", m["n"], m.start(), end_of(masked, m.end())[0]))
            else:
                kind = "type" if m["t"] else "import" if m["i"] else m["v"]
                name = f"{kind}_declaration" if m["t"] or m["i"] else m["vn"] or "variable"
                out.append(Node(kind, name, m.start(), TypeScript._statement(masked, m.end())))
        return out

    def imports(self, text):
        return [Node("import", n.name, n.start, n.end) for n in self.symbols(text) if n.kind == "import"]

    def calls(self, text):
        masked = blank(text)
        declared = {m.start("n") for m in self._ITEM.finditer(masked) if m["f"]}
        return [Node("dynamic" if re.search(r"[\[&*]", n) else "static", n, s, e) for n, s, e in _calls(text, masked, declared)]
