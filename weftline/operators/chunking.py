"""Chunking: boundary, size-limited, line-limited and semantic chunks, overlap and context.

Files are (file_path, text, language), symbols (file_path, ord, id, name, kind, scope, start_line, end_line, signature). Folds
decide the groups on the light symbol rows; content is cut once per chunk afterwards, from the file's lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import digest, line_range, lines, n_lines, trim
from weftline.operators.dealing import dealt, tasks
from weftline.operators.folds import ordered_fold
from weftline.operators.symbols import symbol_index
from weftline.options import ChunkingOptions
from weftline.schemas import CHUNKS, METADATA

GAP = 3
_META = [x.strip().split(" ") for x in METADATA[len("struct<") : -1].split(",")]
ORDER = ("start_line", "end_line", "id", "ord")
#: What a fold and the cutting of its groups need of a symbol.
LIGHT = ("file_path", "ord", "id", "start_line", "end_line")


def metadata(**values) -> Column:
    return F.struct(*[(values.get(n, F.lit(None))).cast(t).alias(n) for n, t in _META])


def merge_metadata(now: Column, **values) -> Column:
    return F.struct(*[(values[n] if n in values else now[n]).cast(t).alias(n) for n, t in _META])


def token_count(content: Column) -> Column:
    """Null, as without a vocabulary; :func:`with_token_counts` counts."""
    return F.lit(None).cast("long")


def with_token_counts(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """``chunks`` with the tokens of their content by the tokenizer file ``tokenizer``, which every executor can read, in the metadata."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        for b in batches:
            yield pd.Series([len(e.ids) for e in tok.encode_batch_fast(b.fillna("").tolist(), add_special_tokens=False)])

    return chunks.withColumn("_tokens", count("content")).withColumn("metadata", merge_metadata(F.col("metadata"), token_count=F.col("_tokens"))).drop("_tokens")


def _finish(df: DataFrame) -> DataFrame:
    """The columns of chunks, and where a chunk stands among those that its file was cut into (ordinal)."""
    more = ["ordinal"] if "ordinal" in df.columns else [F.lit(0).cast("long").alias("ordinal")]
    return df.withColumn("text", F.col("content")).select(*CHUNKS, *more)


def full_file_chunks(files: DataFrame, prefix: str = "chk-", kind: str = "md5", strategy: str | None = None, max_lines: int | None = None) -> DataFrame:
    """One chunk for each file; for files without boundary symbols and for library calls without any."""
    d = digest(F.col("content"), kind)
    meta = F.lit(None).cast(METADATA) if strategy is None else metadata(chunk_strategy=F.lit(strategy), max_line_limit=F.lit(max_lines), token_count=token_count(F.col("content")))
    out = files.select("file_path", F.col("text").alias("content"), "language", F.greatest(F.size(lines(F.col("text"))), F.lit(1)).alias("end_line")).withColumn("md5", d)
    return _finish(out.withColumns({
        "id": F.concat(F.lit(prefix), F.col("md5")), "start_line": F.lit(1), "size": F.octet_length("content"), "symbol_id": F.lit(None).cast("string"),
        "symbol_ids": F.array().cast("array<string>"), "chunk_kind": F.lit("FullFile"), "metadata": meta,
    }))


def _file_lines(files: DataFrame) -> DataFrame:
    """Never broadcast: the size of texts that a plan makes from a few columns is not known."""
    return files.select("file_path", "language", lines(F.col("text")).alias("all_lines")).hint("merge")


def _without(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return files.join(symbols.select("file_path").distinct().hint("merge"), "file_path", "left_anti")


def _path_id(*parts: Column) -> Column:
    return F.concat_ws("-", F.concat(F.lit("chk-"), F.translate("file_path", "/", "_")), *[p.cast("string") for p in parts])


def boundary_chunks(files: DataFrame, symbols: DataFrame, max_lines: int = 0) -> DataFrame:
    """A chunk for each symbol, none for symbols of more than ``max_lines`` lines."""
    s = symbols.where(n_lines(F.col("start_line"), F.col("end_line")) <= max_lines) if max_lines else symbols
    cut = s.join(_file_lines(files), "file_path").withColumn("content", line_range(F.col("all_lines"), F.col("start_line"), F.col("end_line")))
    cut = cut.withColumnRenamed("id", "symbol_id").withColumns({
        "id": _path_id(F.col("start_line"), F.col("end_line")), "md5": F.md5(F.col("content").cast("binary")), "size": n_lines(F.col("start_line"), F.col("end_line")),
        "symbol_ids": F.array("symbol_id"), "chunk_kind": F.lit("Symbol"), "metadata": F.lit(None).cast(METADATA), "ordinal": F.col("ord").cast("long"),
    })
    return _finish(cut).unionByName(full_file_chunks(_without(files, symbols)))


def pack_step(max_lines: int):
    """Greedy packing: (chunk number, opens) for a symbol, from the group that is open."""

    def step(state: dict, start: int, end: int) -> tuple[int]:
        size = max(end - start, 0) + 1
        if state["open"] and not (max_lines > 0 and (max(state["e"] - state["s"], 0) + 1 > max_lines or max(max(state["e"], end) - state["s"], 0) + 1 > max_lines)):
            state["e"] = max(state["e"], end)
        else:
            state.update(cid=state["cid"] + 1, s=start, e=end, open=not (max_lines > 0 and size > max_lines))
        return (state["cid"],)

    return step


def pack_groups(symbols: DataFrame, max_lines: int) -> DataFrame:
    """What places ``symbols``, with cid, the number of the chunk in its file; a symbol's text stays out of the fold."""
    return ordered_fold(symbols.select(*LIGHT), "file_path", ORDER, ("start_line", "end_line"), lambda: {"cid": 0, "s": 0, "e": 0, "open": False}, pack_step(max_lines), "cid long")


def _norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(trim(c), r"(::)+$", ""))


def impl_target(signature: Column) -> Column:
    s = trim(signature)
    head = F.substring_index(F.regexp_replace(F.substr(s, F.lit(5)), r"(?U)^\s+", ""), "{", 1)
    head = F.substring_index(head, " where ", 1)
    target = trim(F.when(F.contains(head, F.lit(" for ")), F.regexp_extract(head, "(?s)^.* for (.*)$", 1)).otherwise(head))
    word = F.split(target, r"(?U)\s+", 2)[0]
    return F.when(F.startswith(s, F.lit("impl")) & (target != ""), F.lower(F.regexp_replace(word, r"^[<>{}(),;]+|[<>{}(),;]+$", "")))


def semantic_keys(symbols: DataFrame) -> DataFrame:
    """``symbols`` with own_key (null: inherits), reopen_key, is_anchor and is_member."""
    kind, name = F.lower("kind"), _norm(F.col("name"))
    scope = _norm(F.element_at(F.split("scope", "::", -1), -1))
    own = (
        F.when(kind.isin("struct", "class", "trait", "enum", "type", "mod"), name)
        .when(kind == "impl", F.coalesce(impl_target(F.coalesce("signature", "name")), name))
        .when(kind == "function", F.coalesce(scope, F.concat(F.lit("fn:"), name))).otherwise(scope)
    )
    return symbols.withColumns({
        "own_key": own, "reopen_key": F.concat(kind, F.lit(":"), name), "is_anchor": kind.isin("struct", "class", "trait", "enum", "type", "mod", "impl"),
        "is_member": kind.isin("method", "constructor", "function", "field"),
    })


def semantic_step(max_lines: int, gap: int = GAP):
    def step(st: dict, start: int, end: int, own, reopen: str, anchor: bool, member: bool) -> tuple[int, str]:
        if st["cid"]:
            if own is None and start >= st["s"] and end <= st["e"]:
                own = st["key"]
            last = max(st["e"], end)
            joins = (own is not None and own == st["key"]) or (st["anchor"] is not None and member and end <= st["anchor"])
            if joins and start <= st["e"] + gap and (not max_lines or max(last - st["s"], 0) + 1 <= max_lines):
                st["e"] = last
                if st["anchor"] is not None:
                    st["anchor"] = max(st["anchor"], end)
                return st["cid"], st["key"]
        st.update(cid=st["cid"] + 1, s=start, e=end, key=reopen if own is None else own, anchor=end if anchor else None)
        return st["cid"], st["key"]

    return step


def semantic_groups(symbols: DataFrame, max_lines: int, gap: int = GAP) -> DataFrame:
    """What places ``symbols``, with cid and semantic_key of their chunk."""
    start = lambda: {"cid": 0, "s": 0, "e": 0, "key": None, "anchor": None}
    keyed = semantic_keys(symbols).select(*LIGHT, "own_key", "reopen_key", "is_anchor", "is_member")
    out = ordered_fold(keyed, "file_path", ORDER, ("start_line", "end_line", "own_key", "reopen_key", "is_anchor", "is_member"), start, semantic_step(max_lines, gap), "cid long, semantic_key string")
    return out.drop("own_key", "reopen_key", "is_anchor", "is_member")


def flush_groups(files: DataFrame, grouped: DataFrame, strategy: str, max_lines: int, kind: str) -> DataFrame:
    """One chunk for each (file_path, cid), its symbols in order."""
    key = F.first("semantic_key").alias("semantic_key") if "semantic_key" in grouped.columns else F.lit(None).cast("string").alias("semantic_key")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("id").alias("i"), F.col("ord").alias("o"))))
    g = grouped.groupBy("file_path", "cid").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.transform(ordered, lambda x: x["i"]).alias("symbol_ids"), key)
    g = g.withColumn("symbol_id", F.element_at("symbol_ids", 1)).join(_file_lines(files), "file_path").withColumn("content", line_range(F.col("all_lines"), F.col("start_line"), F.col("end_line")))
    if strategy == "size":
        g = g.withColumns({"md5": digest(F.col("content"), kind), "id": _path_id(F.col("start_line"), F.col("end_line")), "metadata": F.lit(None).cast(METADATA)})
    else:
        named = digest(F.concat_ws(":", "file_path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.array_join("symbol_ids", "|")), kind)
        more = {"semantic_key": F.col("semantic_key"), "symbol_count": F.size("symbol_ids")} if strategy == "semantic" else {"symbol_count": F.lit(None)}
        meta = metadata(chunk_strategy=F.lit(strategy), max_line_limit=F.lit(max_lines), token_count=token_count(F.col("content")), **more)
        g = g.withColumn("named", named).withColumn("md5", F.col("named") if strategy == "semantic" else digest(F.col("content"), kind))
        g = g.withColumn("id", F.concat(F.lit("chk-sem-" if strategy == "semantic" else "chk-line-"), F.col("named"))).withColumn("metadata", meta)
    return _finish(g.withColumns({"size": F.octet_length("content"), "chunk_kind": F.lit("Symbol"), "ordinal": F.col("cid").cast("long")}))


def size_limited_chunks(files: DataFrame, symbols: DataFrame, max_lines: int, kind: str = "blake3") -> DataFrame:
    return flush_groups(files, pack_groups(symbols, max_lines), "size", max_lines, kind).unionByName(full_file_chunks(_without(files, symbols), "chk-", kind))


def line_limited_chunks(files: DataFrame, symbols: DataFrame, max_lines: int, kind: str = "blake3") -> DataFrame:
    return flush_groups(files, pack_groups(symbols, max_lines), "line", max_lines, kind).unionByName(full_file_chunks(_without(files, symbols), "chk-line-", kind, "line", max_lines))


def semantic_chunks(files: DataFrame, symbols: DataFrame, max_lines: int, kind: str = "blake3") -> DataFrame:
    return flush_groups(files, semantic_groups(symbols, max_lines), "semantic", max_lines, kind).unionByName(full_file_chunks(_without(files, symbols), "chk-sem-", kind, "semantic", max_lines))


def overlap_chunks(files: DataFrame, chunks: DataFrame, n: int, kind: str = "blake3") -> DataFrame:
    """Chunks of files with two or more grow by ``n`` lines towards their neighbours and name them; others stay. Chunks of the same
    lines keep the order in which they were cut."""
    if not n:
        return chunks
    order = Window.partitionBy("file_path").orderBy("start_line", "end_line", *(["ordinal"] if "ordinal" in chunks.columns else []), "id")
    c = chunks.withColumn("prev", F.lag("id").over(order)).withColumn("next", F.lead("id").over(order))
    c = c.withColumn("moved", F.col("prev").isNotNull() | F.col("next").isNotNull())
    c = c.withColumn("start_line", F.when(F.col("prev").isNotNull(), F.greatest(F.col("start_line") - n, F.lit(0))).otherwise(F.col("start_line")))
    c = c.withColumn("end_line", F.when(F.col("next").isNotNull(), F.col("end_line") + n).otherwise(F.col("end_line")))
    c = c.join(_file_lines(files).drop("language"), "file_path")
    cut = F.when(F.col("moved"), line_range(F.col("all_lines"), F.col("start_line"), F.col("end_line"))).otherwise(F.col("content"))
    c = c.withColumn("content", cut).withColumn("d", digest(F.col("content"), kind))
    meta = merge_metadata(F.col("metadata"), overlap_lines=F.lit(n), previous_chunk_id=F.col("prev"), next_chunk_id=F.col("next"), chunk_strategy=F.coalesce(F.col("metadata.chunk_strategy"), F.lit("overlap")))
    out = c.withColumns({
        "metadata": F.when(F.col("moved"), meta).otherwise(F.col("metadata")), "id": F.when(F.col("moved"), F.concat(F.lit("chk-ov-"), F.col("d"))).otherwise(F.col("id")),
        "md5": F.when(F.col("moved"), F.col("d")).otherwise(F.col("md5")), "size": F.when(F.col("moved"), F.octet_length("content")).otherwise(F.col("size")),
    })
    return _finish(out)


#: The first import line of a file and the lines after it that are imports or blank.
_IMPORT_BLOCK = r"(?dmU)^[^\S\n]*(?:use |import )[^\n]*(?:\n(?:[^\S\n]*(?:use |import )[^\n]*|[^\S\n]*(?=\n)|[^\S\n]+\z))*+"


def leading_imports(text: Column) -> Column:
    """The imports before a file's first other line, each once, with the blank lines between. One search takes the block out of the
    text; only its few lines become arrays."""
    block = F.regexp_extract(text, _IMPORT_BLOCK, 0)
    body = F.transform(F.split(block, "\n", -1), trim)
    once = F.filter(body, lambda x, i: (x == "") | (F.array_position(body, x) == i + 1))
    return F.when(block != "", once).otherwise(F.array().cast("array<string>"))


def context_chunks(files: DataFrame, chunks: DataFrame, symbols: DataFrame, kind: str = "blake3", n_tasks: int | None = None) -> DataFrame:
    """Chunks with their file's imports and their symbols' scopes before the content; ids and lines stay. Files without symbols have no
    context, and their chunks stay as they are."""
    found = symbol_index(symbols, n_tasks).where("scope is not null").select("file_path", F.col("id").alias("sid"), trim(F.col("scope")).alias("scope"))
    own = ["file_path", "id", "start_line", "end_line", "symbol_ids"]  # two symbols of the same lines make two chunks of one id
    named = chunks.select(*own, F.explode(F.array_distinct(F.concat("symbol_ids", F.filter(F.array("symbol_id"), lambda x: x.isNotNull())))).alias("sid"))
    named, found = dealt(named, n_tasks, "file_path", "sid"), dealt(found, n_tasks, "file_path", "sid").hint("merge")
    scopes = dealt(named.join(found, ["file_path", "sid"]), n_tasks, *own).groupBy(*own).agg(F.sort_array(F.collect_set("scope")).alias("scopes"))
    imports = files.join(symbols.select("file_path").distinct().hint("merge"), "file_path", "left_semi").select("file_path", leading_imports(F.col("text")).alias("imports"))
    nothing = F.array().cast("array<string>")
    c = dealt(chunks.join(imports.hint("merge"), "file_path", "left"), n_tasks, *own).join(scopes.hint("merge"), own, "left").withColumns({"scopes": F.coalesce("scopes", nothing), "imports": F.coalesce("imports", nothing)})
    scope_lines = F.transform("scopes", lambda s: F.concat(F.lit("scope: "), s))
    between = F.when((F.size("imports") > 0) & (F.size("scopes") > 0), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    all_ = F.concat("imports", between, scope_lines)
    c = c.withColumn("block", F.when(F.size(all_) > 0, F.concat(F.array_join(all_, "\n"), F.lit("\n\n"))))
    c = c.withColumn("content", F.concat(F.coalesce("block", F.lit("")), F.col("content")))
    meta = merge_metadata(F.col("metadata"), has_context_prefix=F.lit(True), context_import_count=F.size(F.filter("imports", lambda x: x != "")), context_scope_count=F.size("scopes"), token_count=token_count(F.col("content")))
    there = F.col("block").isNotNull()
    return _finish(c.withColumns({
        "md5": F.when(there, digest(F.col("content"), kind)).otherwise(F.col("md5")), "size": F.when(there, F.octet_length("content")).otherwise(F.col("size")),
        "metadata": F.when(there, meta).otherwise(F.col("metadata")),
    }))


Strategy = Callable[[DataFrame, DataFrame, int, str], DataFrame]
STRATEGIES: dict[str, Strategy] = {
    "SymbolBoundary": lambda files, symbols, most, _: boundary_chunks(files, symbols, most), "SizeLimited": size_limited_chunks, "LineLimited": line_limited_chunks, "Semantic": semantic_chunks,
}


def chunk_pipeline(files: DataFrame, symbols: DataFrame | None, options: ChunkingOptions = ChunkingOptions(), kind: str = "blake3", strategies: Mapping[str, Strategy] | None = None, n_tasks: int | None = None) -> DataFrame:
    """Base strategy, then overlap, then context for files that have symbols, then token counts if a tokenizer is named.

    ``strategies`` are strategies of the caller's own: name to a function of files, symbols, the line limit and the digest. All steps
    are dealt to ``n_tasks``, by default in proportion to the files that are read."""
    if symbols is None:
        symbols = files.sparkSession.createDataFrame([], "file_path string, ord int, id string, name string, kind string, scope string, start_line int, end_line int, signature string")
    n = n_tasks or tasks(files, symbols)
    files, symbols = dealt(files, n, "file_path"), dealt(symbols, n, "file_path")
    base = {**STRATEGIES, **(strategies or {})}[options.strategy]
    out = overlap_chunks(files, dealt(base(files, symbols, options.max_lines, kind), n, "file_path"), options.overlap_lines, kind)
    out = context_chunks(files, out, symbols, kind, n) if options.include_context else out
    out = with_token_counts(out, options.tokenizer) if options.token_counting and options.tokenizer else out
    return out.select(*CHUNKS)


def chunk_error(start: Column, end: Column) -> Column:
    return F.when((start < 1) | (end < 1), "line numbers must be 1-based").when(start > end, "start line after end line")
