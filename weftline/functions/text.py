"""Scalar expressions on texts and paths; all of them built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
LANGUAGES = {"rs": "rust", "go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java"}
#: In the order in which capabilities list them.
LANGUAGE_LIST = ("rust", "typescript", "javascript", "java", "go", "python")
BOUNDARY_KINDS = ("function", "struct", "enum", "trait", "impl", "class", "method", "constructor", "mod")


def trim(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def lines(text: Column) -> Column:
    """Lines without their ends; one empty last line is no line."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_range(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based, each ended by a newline; what lies outside the file is left out."""
    first = F.greatest(start, F.lit(1))
    n = F.greatest(F.least(end, F.size(all_lines)) - first + 1, F.lit(0))
    return F.when(n > 0, F.concat(F.array_join(F.slice(all_lines, first, F.greatest(n, F.lit(1))), "\n"), F.lit("\n"))).otherwise(F.lit(""))


def n_lines(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0)) + 1


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def language_of(path: Column, fold_case: bool) -> Column:
    """The language by extension, null if there is none; the scanner folds case, the indexer does not."""
    e = extension(path)
    e = F.lower(e) if fold_case else e
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), e)


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def digest(c: Column, kind: str) -> Column:
    """A hex digest: sha256 and md5 natively, blake3 by an Arrow function."""
    if kind == "sha256":
        return F.sha2(c.cast("binary"), 256)
    if kind == "md5":
        return F.md5(c.cast("binary"))
    if kind == "blake3":
        from weftline.functions.blake3 import blake3_hex

        return blake3_hex(c.cast("binary"))
    raise ValueError(f"unknown digest {kind!r}")


def qualified_name(name: Column, scope: Column) -> Column:
    return F.when(scope.isNull() | (scope == ""), name).otherwise(F.concat(F.regexp_replace(trim(scope), r"(::)+$", ""), F.lit("::"), name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunk_label(start: Column, end: Column, id_: Column) -> Column:
    """How a chunk is shown."""
    return F.format_string("Chunk %s (%d-%d)", id_.cast("string"), start, end)


def chunk_kind(c: Column) -> Column:
    """Exact, then by lower case, else Contextual."""
    low = F.lower(c)
    return F.when(low == "fullfile", "FullFile").when(low == "symbol", "Symbol").otherwise("Contextual")
