"""Language adapters by name, and extraction as one narrow pass over a corpus.

A file is parsed once and gives one row with three arrays; symbols, import edges and call edges are exploded from it. Reference
identifiers keep the literal ``<source>`` for the file (``compat_ids``), and every row has the real file_path and an ordinal."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.functions.imports import normalize_import
from weftline.operators.dealing import dealt, tasks
from weftline.schemas import LOCATION

#: Texts whose results are held at once.
ROWS = 1_000
_NEWLINE = re.compile("\n")


@dataclass
class Node:
    """A symbol, import or call: offsets into the text, kind and name."""

    kind: str
    name: str
    start: int
    end: int


class LanguageAdapter(ABC):
    """What a language needs to give. Offsets are characters; the registry turns them into rows and byte columns."""

    sets_scope = True

    @abstractmethod
    def symbols(self, text: str) -> list[Node]: ...

    def imports(self, text: str) -> list[Node]:
        return []

    def calls(self, text: str) -> list[Node]:
        """kind is the call kind, name the callee."""
        return []


_adapters: dict[str, LanguageAdapter] = {}


def register(*names: str):
    def add(cls):
        for n in names:
            _adapters[n] = cls()
        return cls

    return add


def _load() -> None:
    if not _adapters:
        from weftline.extract import braces, python  # noqa: F401


def get(language: str) -> LanguageAdapter | None:
    _load()
    return _adapters.get(language)


def languages() -> list[str]:
    _load()
    return sorted(_adapters)


class Positions:
    """Rows and byte columns of character offsets."""

    def __init__(self, text: str):
        self.text, self.starts = text, [0, *(m.end() for m in _NEWLINE.finditer(text))]

    def at(self, offset: int) -> tuple[int, int]:
        row = bisect_right(self.starts, offset) - 1
        return row, len(self.text[self.starts[row] : offset].encode())

    def location(self, n: Node) -> dict:
        (a, b), (c, d) = self.at(n.start), self.at(n.end)
        return {"start_line": a, "start_col": b, "end_line": c, "end_col": d}


class Enclosing:
    """The innermost node around a span, for spans that come in order of their start: one sweep with the nodes that are open."""

    def __init__(self, nodes: list[Node]):
        """``nodes`` by start, longer ones first."""
        self.nodes, self.next, self.open = nodes, 0, []

    def around(self, start: int, end: int, own: Node | None = None) -> Node | None:
        """Of several the shortest, of equal ones the last; for a node's own parent a longer one than itself."""
        while self.next < len(self.nodes) and self.nodes[self.next].start <= start:
            n = self.nodes[self.next]
            while self.open and self.open[-1].end <= n.start:
                self.open.pop()
            self.open.append(n)
            self.next += 1
        while self.open and self.open[-1].end < start:
            self.open.pop()
        best = None
        for n in reversed(self.open):
            if n is not own and end <= n.end and (own is None or n.end - n.start > end - start) and (best is None or n.end - n.start < best.end - best.start):
                best = n
        return best


def extract_text(language: str, text: str, imports: bool = True, calls: bool = True, file_id: str = "<source>", symbols_too: bool = True) -> tuple[list | None, list, list]:
    """(symbols, imports, calls) as dictionaries; symbols None where there is no adapter or the parse fails, empty without ``symbols_too``."""
    adapter = get(language)
    if adapter is None:
        return None, [], []
    try:
        nodes, at = sorted(adapter.symbols(text), key=lambda n: (n.start, -n.end)), Positions(text)
        symbols, parents = [], Enclosing(nodes)
        for i, n in enumerate(nodes if symbols_too else ()):
            parent = parents.around(n.start, n.end, n) if adapter.sets_scope else None
            place = at.location(n)
            symbols.append({"ord": i, "id": f"{file_id}:{n.name}", "name": n.name, "kind": n.kind, "scope": parent.name if parent else None, "start_line": place["start_line"], "end_line": place["end_line"], "signature": text[n.start : n.end]})
        edges = []
        for i, n in enumerate(adapter.imports(text) if imports else []):
            place = at.location(n)
            edges.append({"ord": i, "id": f"ie:{file_id}:{place['start_line']}:{place['start_col']}", "raw": text[n.start : n.end].strip(), "location": place})
        found, callers, made = [], Enclosing(nodes), adapter.calls(text) if calls else []
        within = {j: callers.around(made[j].start, made[j].end) for j in sorted(range(len(made)), key=lambda j: made[j].start)}
        for i, n in enumerate(made):
            place, caller = at.location(n), within[i]
            found.append({"ord": i, "id": f"ce:{file_id}:{place['start_line']}:{place['start_col']}", "caller_symbol_id": f"{file_id}:{caller.name}" if caller else None, "callee_name": n.name, "call_kind": n.kind, "location": place})
        return symbols, edges, found
    except (ValueError, IndexError, RecursionError):
        return None, [], []


_SYMBOL = "array<struct<ord int, id string, name string, kind string, scope string, start_line int, end_line int, signature string>>"
_IMPORT = f"array<struct<ord int, id string, raw string, location {LOCATION}>>"
_CALL = f"array<struct<ord int, id string, caller_symbol_id string, callee_name string, call_kind string, location {LOCATION}>>"


def extract(files: DataFrame, imports: bool = True, calls: bool = True, compat_ids: bool = True, symbols: bool = True) -> DataFrame:
    """file_path, language, and those of symbols, imports and calls that are asked for, of each file of (file_path, text, language)."""
    asked = {"symbols": (symbols, _SYMBOL), "imports": (imports, _IMPORT), "calls": (calls, _CALL)}
    schema = StructType.fromDDL(", ".join(["file_path string, language string", *(f"{n} {t}" for n, (there, t) in asked.items() if there)]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                path, language, text = (b.column(n).to_pylist() for n in ("file_path", "language", "text"))
                got = [extract_text(x, t or "", imports, calls, "<source>" if compat_ids else p, symbols) for p, x, t in zip(path, language, text, strict=True)]
                found = [[g[i] for g in got] for i, (there, _) in enumerate(asked.values()) if there]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([path, language, *found], arrow, strict=True)], schema=arrow)

    # a text takes time to parse whatever its share of a file's bytes: many small or alike texts would be one or two tasks
    return dealt(files.select("file_path", "language", "text"), tasks(files), "file_path").mapInArrow(run, schema)


def symbols_of(extracted: DataFrame) -> DataFrame:
    return extracted.select("file_path", F.inline("symbols"))


def import_edges_of(extracted: DataFrame) -> DataFrame:
    e = extracted.select("file_path", "language", F.inline("imports"))
    e = e.withColumn("n", normalize_import(F.col("raw"), F.col("language")))
    return e.select("file_path", "ord", "id", F.lit("<source>").alias("from_file"), "n.to_module", "n.imported_symbol", "n.alias", "n.import_kind", "location", "n.resolved")


def call_edges_of(extracted: DataFrame) -> DataFrame:
    c = extracted.select("file_path", F.inline("calls"))
    return c.select("file_path", "ord", "id", "caller_symbol_id", "callee_name", F.lit(None).cast("string").alias("callee_symbol_id"), "call_kind", "location", F.lit(False).alias("resolved"))
