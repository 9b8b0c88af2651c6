"""The event log: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import LANGUAGE_LIST, chunk_kind
from weftline.operators.dealing import dealt
from weftline.options import FlowOptions
from weftline.schemas import PROTOCOL_VERSION

#: Fixed values of the capabilities event.
ENGINE_VERSION = "0.1.0"
FEATURES = ("jsonl", "incremental_index", "git_diff", "pause_resume", "mcp_compatible")
KEEP_NULLS = {"ignoreNullFields": "false"}


def payload_of_chunk() -> Column:
    return F.struct(
        F.col("id").alias("chunk_id"), chunk_kind(F.col("chunk_kind")).alias("chunk_kind"), F.col("file_path").alias("file"), "language", "symbol_id", "start_line", "end_line", "text",
        F.col("md5").alias("chunk_md5"), "size",
    )


def event(df: DataFrame, name: str, payload: Column, job_id: str | Column | None = None) -> DataFrame:
    """Column ``value``: the event as a JSON line."""
    job = F.lit(job_id).cast("string") if not isinstance(job_id, Column) else job_id
    return df.select(F.to_json(F.struct(F.lit(PROTOCOL_VERSION).alias("protocol_version"), F.lit("event").alias("type"), F.lit(name).alias("event"), job.alias("job_id"), payload.alias("payload")), KEEP_NULLS).alias("value"))


def chunk_emitted(chunks: DataFrame, job_id: str | None = None) -> DataFrame:
    return event(chunks, "chunk_emitted", payload_of_chunk(), job_id)


def import_edge(edges: DataFrame, job_id: str | None = None) -> DataFrame:
    return event(edges, "import_edge", F.struct("id", "from_file", "to_module", "imported_symbol", "alias", "import_kind", "location", "resolved"), job_id)


def call_edge(edges: DataFrame, job_id: str | None = None) -> DataFrame:
    return event(edges, "call_edge", F.struct("id", "caller_symbol_id", "callee_name", "callee_symbol_id", "call_kind", "location", "resolved"), job_id)


def file_listed(files: DataFrame, job_id: str | None = None) -> DataFrame:
    return event(files, "file_listed", F.struct(F.struct("path", "size", "mtime", "hash", "language").alias("file")), job_id)


def file_invalid(files: DataFrame, job_id: str | None = None) -> DataFrame:
    return event(files, "file_invalid", F.struct("path", F.lit("io_error").alias("reason")), job_id)


def single(spark: SparkSession, name: str, job_id: str | None = None, **payload) -> DataFrame:
    fields = [F.array(*map(F.lit, v)).alias(k) if isinstance(v, (list, tuple)) else F.lit(v).alias(k) for k, v in payload.items()]
    return event(spark.range(1), name, F.struct(*fields) if fields else F.lit(None).cast("string"), job_id)


def capabilities(spark: SparkSession) -> DataFrame:
    return single(spark, "capabilities", version=ENGINE_VERSION, languages=list(LANGUAGE_LIST), features=list(FEATURES))


def pause(states: DataFrame, job_id: str | Column | None = None, payload: bool = False) -> DataFrame:
    """Flow events of rows (reason, threshold, current_size); their payload is null unless asked for."""
    return _flow(states, "pause", job_id, payload)


def resume(states: DataFrame, job_id: str | Column | None = None, payload: bool = False) -> DataFrame:
    return _flow(states, "resume", job_id, payload)


def _flow(states: DataFrame, name: str, job_id: str | Column | None, payload: bool) -> DataFrame:
    """On the wire the reason is a key of its own, without a value."""
    if not payload:
        return event(states, name, F.lit(None).cast("string"), job_id)
    out = event(states, name, F.struct("reason", "threshold", "current_size", F.lit(name == "pause").alias("backpressure_active")), job_id)
    return out.select(F.regexp_replace("value", '"reason":("[a-z_]+"),"threshold"', '$1:null,"threshold"').alias("value"))


def flow_of(emitted: DataFrame, options: FlowOptions, job_id: str | None = None) -> DataFrame:
    """Pause and resume events of a job whose log nobody acknowledges: the single row of ``emitted`` has n, the events that passed flow
    control. The event that fills the queue pauses, is held until the time is over, and the queue begins anew."""
    rounds = emitted.where(F.col("n") >= options.max_queue_size).select(F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / options.max_queue_size))).alias("round"))
    full = rounds.select(F.lit(options.reason(options.max_queue_size)).alias("reason"), F.lit(options.max_queue_size).alias("threshold"), F.lit(options.max_queue_size).alias("current_size"))
    over = rounds.select(F.lit("pause_timeout").alias("reason"), F.lit(options.resume_threshold).alias("threshold"), F.lit(0).alias("current_size"))
    return pause(full, job_id, True).unionByName(resume(over, job_id, True))


def ack(spark: SparkSession, job_id: str, count: int, size: int, paused: bool) -> DataFrame:
    return single(spark, "ack", job_id, status="ok", count=count, current_queue_size=size, paused=paused)


def ack_resume(spark: SparkSession, job_id: str, size: int, paused: bool) -> DataFrame:
    return single(spark, "ack_resume", job_id, status="ok", queue_size=size, paused=paused)


def job_started(spark: SparkSession, job_id: str) -> DataFrame:
    return single(spark, "job_started", job_id, total_files=0)


def job_completed(chunks: DataFrame, job_id: str) -> DataFrame:
    """``processed`` counts chunks; flow control lets it pass."""
    return event(chunks.agg(F.count(F.lit(1)).alias("n")), "job_completed", F.struct(F.col("n").alias("processed"), F.lit(0).alias("duration_ms")), job_id)


def job_progress(spark: SparkSession, job_id: str) -> DataFrame:
    return single(spark, "job_progress", job_id, processed=0, total=0)


def error(spark: SparkSession, code: str, message: str, job_id: str | None = None) -> DataFrame:
    return single(spark, "error", job_id, code=code, message=message) if code == "JOB_NOT_FOUND" else single(spark, "error", job_id, code=code, message=message, recoverable=False)


def write_jsonl(log: DataFrame, path: str) -> None:
    log.write.mode("append").text(path)


def files_with_chunks(files: DataFrame, chunks: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """Files that have a chunk, once each."""
    there = dealt(chunks.select(F.col("file_path").alias("path")), n_tasks, "path").distinct().hint("merge")
    return dealt(files, n_tasks, "path").join(there, "path", "left_semi").dropDuplicates(["path"])


def unchanged_removed(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files whose (path, hash) the snapshot does not have."""
    return files.join(snapshot.select("path", "hash").distinct(), ["path", "hash"], "left_anti")
