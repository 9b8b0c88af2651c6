"""Import normalisation: raw statement to module, symbol, alias, kind and whether it is local, one native expression a language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import let, strip_prefix, trim



def _edge(module: Column, symbol: Column | None, alias: Column | None, kind: Column | str, resolved: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        module.alias("to_module"), (null if symbol is None else symbol).alias("imported_symbol"), (null if alias is None else alias).alias("alias"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("import_kind"), resolved.alias("resolved"),
    )


def _cut_semicolons(c: Column) -> Column:
    return trim(F.regexp_replace(trim(c), ";+$", ""))


def _last(c: Column, sep: str, group: int) -> Column:
    """Before (1) or after (2) the last ``sep``."""
    return F.regexp_extract(c, f"(?s)^(.*){sep}(.*)$", group)


def _relative(c: Column) -> Column:
    return F.startswith(c, F.lit("./")) | F.startswith(c, F.lit("../"))


def rust(raw: Column) -> Column:
    return let(trim(raw), lambda t: let(F.startswith(t, F.lit("pub")), lambda again: let(_rust_body(t, again), lambda body: _rust(raw, body, again))))


def _rust_body(t: Column, again: Column) -> Column:
    return let(F.when(again, strip_prefix(t, "pub ")).otherwise(t), lambda use: _cut_semicolons(strip_prefix(use, "use ")))


def _rust(raw: Column, body: Column, again: Column) -> Column:
    local = F.lit(False)
    for part in ("crate::", "self::", "super::", "./"):
        local = local | F.contains(raw, F.lit(part))
    glob = _edge(trim(F.regexp_replace(body, r"::\*$", "")), None, None, "namespace", local)
    named = let(trim(_last(body, " as ", 1)), lambda before: _edge(before, F.element_at(F.split(before, "::", -1), -1), trim(_last(body, " as ", 2)), "named", local))
    kind = F.when(again, "reexport").otherwise("named")
    path = _edge(_last(body, "::", 1), _last(body, "::", 2), None, kind, local)
    return F.when(F.endswith(body, F.lit("::*")), glob).when(F.contains(body, F.lit(" as ")), named).when(F.contains(body, F.lit("::")), path).otherwise(_edge(body, None, None, kind, local))


def _unquote(c: Column, quotes: str) -> Column:
    out = c
    for q in quotes:
        out = F.when(F.startswith(c, F.lit(q)) & F.endswith(c, F.lit(q)), F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(out)
    return out


def typescript(raw: Column) -> Column:
    return let(trim(raw), lambda t: _typescript(raw, t))


def _typescript(raw: Column, t: Column) -> Column:
    """Parts that later ones are made of are computed once: the statement's content, then both sides of ``from``."""
    same = _edge(raw, None, None, "named", F.lit(False))
    fits = F.startswith(t, F.lit("import ")) & F.endswith(t, F.lit(";")) & (F.length(t) >= 8)
    content = trim(F.substr(t, F.lit(8), F.greatest(F.length(t) - 8, F.lit(0))))
    return F.when(~fits, same).otherwise(let(content, lambda c: _content(raw, c)))


def _content(raw: Column, content: Column) -> Column:
    quoted = (F.startswith(content, F.lit('"')) & F.endswith(content, F.lit('"'))) | (F.startswith(content, F.lit("'")) & F.endswith(content, F.lit("'")))
    side = lambda n: F.regexp_extract(content, "(?s)^(.*?) from (.*)$", n)
    parts = F.struct(trim(side(1)).alias("left"), _cut_semicolons(side(2)).alias("right"))
    return F.when(quoted, _edge(_unquote(content, "\"'"), None, None, "side_effect", F.lit(False))).otherwise(
        let(parts, lambda p: let(_unquote(p["right"], "\"'"), lambda module: _clause(raw, content, p["left"], module))))


def _clause(raw: Column, content: Column, left: Column, module: Column) -> Column:
    has_from, local = F.contains(content, F.lit(" from ")), _relative(module)
    space = _edge(module, None, trim(strip_prefix(left, "* as ")), "namespace", local)
    inner = trim(F.substr(left, F.lit(2), F.greatest(F.length(left) - 2, F.lit(0))))
    braces = F.startswith(left, F.lit("{")) & F.endswith(left, F.lit("}"))
    named = lambda i: F.when(F.contains(i, F.lit(" as ")), _edge(module, trim(_last(i, " as ", 1)), trim(_last(i, " as ", 2)), "named", local)).otherwise(_edge(module, F.when(i != "", i), None, "named", local))
    # "* as" binds what follows up to the first " from " after it
    starred = F.startswith(content, F.lit("* as ")) & F.contains(strip_prefix(content, "* as "), F.lit(" from "))
    return (
        F.when(starred, space).when(has_from & ~F.startswith(left, F.lit("{")) & ~F.startswith(left, F.lit("*")), _edge(module, F.lit("default"), left, "default", local))
        .when(has_from & braces, let(inner, named)).otherwise(_edge(raw, None, None, "named", F.lit(False)))
    )


def java(raw: Column) -> Column:
    return let(_cut_semicolons(strip_prefix(trim(raw), "import ")), lambda x: let(strip_prefix(x, "static "), _java))


def _java(body: Column) -> Column:
    dotted = F.contains(body, F.lit("."))
    return F.when(dotted, _edge(_last(body, r"\.", 1), _last(body, r"\.", 2), None, "named", F.lit(False))).otherwise(_edge(body, None, None, "named", F.lit(False)))


def go(raw: Column) -> Column:
    return let(_cut_semicolons(strip_prefix(trim(raw), "import ")), lambda x: let(_unquote(x, '"`'), lambda module: _edge(module, None, None, "named", _relative(module))))


def normalize_import(raw: Column, language: Column) -> Column:
    """By language; what no rule covers, Python among it, stays as it is."""
    same = _edge(raw, None, None, "named", F.lit(False))
    return F.when(language == "rust", rust(raw)).when(language.isin("typescript", "javascript"), typescript(raw)).when(language == "java", java(raw)).when(language == "go", go(raw)).otherwise(same)
