"""The engine: jobs over folders, lists, version control or any corpus table; commands as JSON lines; JSON-RPC."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.extract.registry import call_edges_of, extract, import_edges_of, symbols_of
from weftline.functions.text import LANGUAGE_LIST, language_of
from weftline.operators import events
from weftline.operators.chunking import Strategy, chunk_pipeline
from weftline.operators.dealing import dealt, tasks
from weftline.operators.symbols import boundary_symbols
from weftline.options import ChunkingOptions, FlowOptions, IndexOptions
from weftline.scratch import written
from weftline.sources.scan import GitError, explicit_files, git_diff, git_tracked, invalid, read_texts, scan
from weftline.streaming.flow import flow_step, new_state

COMMAND = "protocol_version string, type string, command string, seq long, job_id string, payload string"


@dataclass
class IndexResult:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame | None
    calls: DataFrame | None
    chunks: DataFrame
    invalid: DataFrame | None = None

    def write(self, path: str) -> None:
        """The tables as Parquet, chunks partitioned by language."""
        for name in ("files", "symbols", "imports", "calls", "invalid"):
            if (df := getattr(self, name)) is not None:
                df.write.parquet(f"{path}/{name}")
        self.chunks.write.partitionBy("language").parquet(f"{path}/chunks")

    def ordered(self) -> IndexResult:
        """Files by path and chunks by file, lines and id, for a sink that wants an order; a sort of all rows by ranges."""
        return replace(self, files=self.files.orderBy("path"), chunks=self.chunks.orderBy("file_path", "start_line", "end_line", "id"))


@dataclass
class Monitor:
    """A job's queue: what its log left in it, counted when it is first asked for."""

    options: FlowOptions
    emitted: DataFrame
    state: dict | None = None

    def step(self, action: str, count: int | None = None) -> tuple:
        """(queue size, paused, event sent, its reason) after an ack or resume."""
        if self.state is None:
            self.state = new_state()
            self.state["size"] = self.emitted.first()["n"] % self.options.max_queue_size
        return flow_step(self.options)(self.state, action, count, None)


#: The tools that JSON-RPC clients may call.
TOOLS = (
    ("list_languages", "Returns the list of supported languages", {}),
    ("index_path", "Index a directory path", {"path": {"type": "string", "description": "Path to index"}, "options": {"type": "object", "description": "Indexing options", "properties": {"max_concurrency": {"type": "integer"}, "include": {"type": "array", "items": {"type": "string"}}, "exclude": {"type": "array", "items": {"type": "string"}}}}}),
    ("stop", "Stop the current indexing job", {}),
    ("status", "Get the current status of the indexer", {}),
)


def tool_schemas() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, d, p in TOOLS]


def new_job_id(prefix: str = "job_") -> str:
    return f"{prefix}{time.time_ns() // 1_000_000}"


def notification(method: str, **params) -> dict:
    return {"jsonrpc": "2.0", "method": method, "params": params}


class Engine:
    def __init__(self, spark: SparkSession, strategies: Mapping[str, Strategy] | None = None):
        """``strategies``: chunking strategies besides the four, by name."""
        self.spark, self.strategies = spark, dict(strategies or {})
        self.monitors: dict[str, Monitor] = {}
        self.notifications: list[dict] = []
        self.handlers: dict[str, Callable[[dict], object]] = {"list_languages": lambda _: self.languages(), "index_path": self._rpc_index, "stop": lambda _: {"status": "stopped"}, "status": lambda _: {"status": "idle"}}

    def languages(self) -> list[str]:
        return list(LANGUAGE_LIST)

    def index_corpus(self, corpus: DataFrame, options: IndexOptions = IndexOptions(), files: DataFrame | None = None) -> IndexResult:
        """Over any table (file_path, text[, language]). Each text is parsed and cut into chunks once: what was found is written, and all results read it."""
        language = F.coalesce("language", language_of(F.col("file_path"), False)) if "language" in corpus.columns else language_of(F.col("file_path"), False)
        corpus = corpus.withColumn("language", language).where(F.col("language").isNotNull())
        got = written(extract(corpus, options.extract_imports, options.extract_calls), "extracted")
        symbols, n = symbols_of(got), tasks(corpus, got, rows=got.count())  # rows of what was written are read from its footers
        bounds = boundary_symbols(dealt(symbols, n, "file_path"), options.line_base)
        chunks = written(chunk_pipeline(corpus, bounds, options.chunking, options.digest, self.strategies, n), "chunks")
        listed = files if files is not None else corpus.select(F.col("file_path").alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit("").alias("hash"), "language")
        return IndexResult(events.files_with_chunks(listed, chunks, n), symbols, import_edges_of(got) if options.extract_imports else None, call_edges_of(got) if options.extract_calls else None, chunks)

    def index_path(self, path: str, options: IndexOptions = IndexOptions()) -> IndexResult:
        found = written(scan(self.spark, path, options.scan, options.digest), "scanned")
        valid = found.where("hash is not null")
        result = self.index_corpus(valid.select(F.col("path").alias("file_path"), "text", "language"), options, valid.drop("text"))
        return replace(result, invalid=invalid(found))

    def index_path_serial(self, path: str, options: IndexOptions = IndexOptions()) -> DataFrame:
        """One full-file chunk a file, whatever the strategy, as the library call without symbols."""
        found = scan(self.spark, path, options.scan, options.digest).where("hash is not null")
        return chunk_pipeline(found.select(F.col("path").alias("file_path"), "text", "language"), None, options.chunking, options.digest, self.strategies)

    def incremental_index(self, path: str, options: IndexOptions = IndexOptions(), *, files: Sequence[str] = (), use_git: bool = False, git_range: str | None = None) -> IndexResult:
        """Changed files of a range ``a..b``, else tracked files, else the list, else all."""
        if use_git:
            ends = (git_range or "").split("..")
            paths = git_diff(path, *ends) if len(ends) == 2 and all(ends) else git_tracked(path)
        elif files:
            paths = list(files)
        else:
            return self.index_path(path, options)
        return self.index_corpus(written(read_texts(self.spark, path, paths), "listed"), options, explicit_files(self.spark, paths))

    def list_files(self, path: str, options: IndexOptions = IndexOptions()) -> DataFrame:
        return scan(self.spark, path, options.scan, contents_too=False)

    def event_log(self, result: IndexResult, job_id: str, flow: FlowOptions | None = None) -> DataFrame:
        """The job's events as JSON lines. With ``flow`` the job's start, files and chunks pass through its queue: pauses and resumes are
        in the log, and the job can be acknowledged and resumed; edges and the job's end are written past it."""
        started, files, chunks = events.job_started(self.spark, job_id), events.file_listed(result.files, job_id), events.chunk_emitted(result.chunks, job_id)
        parts = [started, files, chunks]
        if result.invalid is not None:
            parts.append(events.file_invalid(result.invalid, job_id))
        parts += [f(df, job_id) for f, df in ((events.import_edge, result.imports), (events.call_edge, result.calls)) if df is not None]
        if flow:
            passed = reduce(DataFrame.unionByName, [p.select(F.lit(1).alias("one")) for p in parts[: 4 if result.invalid is not None else 3]])
            emitted = passed.agg(F.count(F.lit(1)).alias("n"))
            parts.append(events.flow_of(emitted, flow, job_id))
            self.monitors[job_id] = Monitor(flow, emitted)
        return reduce(DataFrame.unionByName, [*parts, events.job_completed(result.chunks, job_id)])

    def commands(self, lines: DataFrame) -> DataFrame:
        """A command for each line of the column ``value`` that is not blank; nulls where a line is none."""
        return lines.select(F.trim("value").alias("value")).where("value <> ''").select("value", F.from_json("value", COMMAND).alias("c")).select("value", "c.*")

    def run(self, line: str) -> DataFrame:
        """The events that a command line leads to."""
        try:
            c = json.loads(line)
            name, payload, job = c["command"], c.get("payload") or {}, c.get("job_id") or new_job_id()
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return events.error(self.spark, "INVALID_COMMAND", str(e))
        if name == "list_languages":
            return events.capabilities(self.spark)
        if name in ("dry_run", "list_files"):
            return events.job_progress(self.spark, job) if name == "dry_run" or "path" not in payload else events.file_listed(self.list_files(payload["path"]), job)
        if name in ("resume", "ack"):
            return self._answer(name, c.get("job_id"), payload)
        if name not in ("index_path", "incremental_index"):
            return events.error(self.spark, "INVALID_COMMAND", f"unknown command: {name}", job)
        if not isinstance(payload.get("path"), str):
            return events.error(self.spark, "INVALID_PAYLOAD", "path is missing", job)
        if not os.path.isdir(payload["path"]):
            return events.error(self.spark, "WALKER_ERROR", "no such folder", job)
        try:
            options = self._options(payload)
        except ValueError as e:
            return events.error(self.spark, "BACKPRESSURE_CONFIG", str(e), job)
        try:
            if name == "index_path":
                result = self.index_path(payload["path"], options)
            else:
                result = self.incremental_index(payload["path"], options, files=payload.get("files") or (), use_git=bool(payload.get("use_git")), git_range=payload.get("git_range"))
        except GitError as e:
            return events.error(self.spark, "GIT_ERROR", str(e), job).unionByName(events.single(self.spark, "job_completed", job, processed=0, duration_ms=0, errors=1))
        return self.event_log(result, job, options.flow)

    def _answer(self, name: str, job: str | None, payload: dict) -> DataFrame:
        """ack and resume: the job's queue after it; nothing for a command without a job."""
        if job is None:
            return events.single(self.spark, name).limit(0)
        if job not in self.monitors:
            return events.error(self.spark, "JOB_NOT_FOUND", "no active monitor found for job_id", job)
        count = payload.get("count")
        count = count if isinstance(count, int) and not isinstance(count, bool) and count >= 0 else 1
        size, paused, sent, reason = self.monitors[job].step(name, count)
        said = events.ack(self.spark, job, count, size, paused) if name == "ack" else events.ack_resume(self.spark, job, size, paused)
        if not sent:
            return said
        options = self.monitors[job].options
        state = self.spark.range(1).select(F.lit(reason).alias("reason"), F.lit(options.resume_threshold).alias("threshold"), F.lit(size).alias("current_size"))
        return events.resume(state, job, True).unionByName(said)

    @staticmethod
    def _options(payload: dict) -> IndexOptions:
        try:
            chunking = ChunkingOptions(**payload["chunking"])
        except (KeyError, TypeError, ValueError):
            chunking = ChunkingOptions()
        flow = FlowOptions(**payload["backpressure"]) if payload.get("backpressure") else None
        return IndexOptions(chunking=chunking, flow=flow, extract_imports=payload.get("extract_imports", True), extract_calls=payload.get("extract_calls", True))

    def register_handler(self, method: str, handler: Callable[[dict], object]) -> None:
        self.handlers[method] = handler

    def _rpc_index(self, params: dict) -> dict:
        """Starts a job over the files of one folder and notes what there is to tell of it."""
        folder, job = params.get("path", "./src"), new_job_id()
        names = sorted(n for n in os.listdir(folder) if os.path.isfile(os.path.join(folder, n)))
        self.notifications += [notification("indexing/start", job_id=job, path=folder), *(notification("indexing/file", file=os.path.join(folder, n)) for n in names), notification("indexing/complete", files=len(names))]
        return {"job_id": job, "status": "started"}

    def rpc_lines(self, line: str) -> list[dict]:
        """The notifications that a request leads to, then its response."""
        self.notifications.clear()
        answer = self.rpc(line)
        return [*self.notifications, answer]

    def rpc(self, line: str) -> dict:
        """A JSON-RPC request's response."""
        try:
            r = json.loads(line)
            method, id_ = r["method"], r.get("id")
        except (ValueError, KeyError, TypeError) as e:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": str(e)}}
        if method not in self.handlers:
            return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"unknown method {method}"}}
        try:
            return {"jsonrpc": "2.0", "id": id_, "result": self.handlers[method](r.get("params") or {})}
        except Exception as e:  # noqa: BLE001 - a handler's failure is the answer
            return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32603, "message": str(e)}}


def main(argv: Sequence[str] | None = None) -> None:
    """Commands, or with --mcp JSON-RPC requests, from standard input; answers as lines."""
    import argparse
    import sys

    p = argparse.ArgumentParser()
    p.add_argument("-m", "--mcp", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    args, _ = p.parse_known_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate())
    if not args.mcp:
        print(events.capabilities(engine.spark).first()["value"], flush=True)
    for line in filter(None, map(str.strip, sys.stdin)):
        if args.mcp:
            for answer in engine.rpc_lines(line):
                print(json.dumps(answer), flush=True)
        else:
            for r in engine.run(line).toLocalIterator():
                print(r["value"], flush=True)


if __name__ == "__main__":
    main()
