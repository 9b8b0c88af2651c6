"""Schemas of the five tables and of the event log."""

from __future__ import annotations

LOCATION = "struct<start_line int, start_col int, end_line int, end_col int>"
FILES = "path string, size long, mtime long, hash string, language string"
SYMBOLS = "file_path string, ord int, id string, name string, kind string, scope string, start_line int, end_line int, signature string"
IMPORT_EDGES = f"file_path string, ord int, id string, from_file string, to_module string, imported_symbol string, alias string, import_kind string, location {LOCATION}, resolved boolean"
CALL_EDGES = f"file_path string, ord int, id string, caller_symbol_id string, callee_name string, callee_symbol_id string, call_kind string, location {LOCATION}, resolved boolean"
METADATA = "struct<chunk_strategy string, max_line_limit long, semantic_key string, symbol_count long, token_count long, overlap_lines long, previous_chunk_id string, next_chunk_id string, has_context_prefix boolean, context_import_count long, context_scope_count long>"
CHUNKS = ["id", "file_path", "start_line", "end_line", "content", "text", "md5", "size", "language", "symbol_id", "symbol_ids", "chunk_kind", "metadata"]
PROTOCOL_VERSION = "1.0.0"
