"""Globs as regular expressions: ``*`` crosses ``/``, ``**/`` may match nothing."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The files of ignore globs, themselves ignored.
IGNORE_FILES = (".gitignore", ".crushignore")


def glob_regex(pattern: str) -> str:
    """An anchored expression that Java and Python read alike; ValueError for a pattern that is none."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {pattern!r}")
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternation in glob {pattern!r}")
    return "(?s)^(?:" + "".join(out) + ")$"


def matches_any(path: Column, patterns: Iterable[str]) -> Column | None:
    """Whether any glob matches; None without globs."""
    out = None
    for rx in map(glob_regex, patterns):
        out = path.rlike(rx) if out is None else out | path.rlike(rx)
    return out


def ignore_patterns(lines: Iterable[str]) -> list[str]:
    """The globs of an ignore file: trimmed, without blanks and comments, taken as they are."""
    return [x for x in map(str.strip, lines) if x and not x.startswith("#")]


def scan_filter(path: Column, include: Iterable[str] = (), ignore: Iterable[str] = ()) -> Column:
    keep = F.lit(True)
    if (bad := matches_any(path, [*ignore, *IGNORE_FILES])) is not None:
        keep = keep & ~bad
    if (good := matches_any(path, include)) is not None:
        keep = keep & good
    return keep
