"""Plumbing shared by the training-data operators: shared-folder tables, hashing and small expressions."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay under this; the rows here are a few dozen bytes each.
BROADCAST_ROWS = 20_000
#: Rows of a range of :func:`sums_before`, at least.
RANGE_ROWS = 1000
#: Rows that one copy of a key's row serves in :func:`join_hot`.
PER_COPY = 2000
#: Rows that go to a Python worker at once.
BATCH_ROWS = 2000

_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder if driver and executors are
    one process; on a cluster each executor would write to a disk of its own, so that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
    return _own_dir[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    Rows go to Python BATCH_ROWS at a time, so that whole texts and what is made of them stay a few megabytes a worker."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    with configured(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
        df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no later step reads."""
    if path := getattr(df, "_weftline_path", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            _delete(spark, path)


@contextlib.contextmanager
def configured(spark: SparkSession, key: str, value: str):
    """A setting that holds within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffle_files_dropped(spark: SparkSession):
    """Within, Spark deletes a finished query's shuffle files at once instead of at some later garbage collection."""
    return configured(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def carried(c: Column) -> Column:
    """An id as text, for the way through pandas: integers beside a null would become floats there and lose their last digits."""
    return c.cast("string")


def join_hot(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, n_hot: int, per_copy: int = PER_COPY) -> DataFrame:
    """``rows`` joined with ``side``, one row a key, where the keys of ``hot`` (key, n), no more than ``n_hot``, hold over ``per_copy``
    rows each: those are dealt out by a salt as well, and side's row is there once for each salt."""
    if not n_hot:
        return rows.join(side, key)
    few = small(hot.select(key, F.ceil(F.col("n") / per_copy).cast("long").alias("_wl_copies")), n_hot)
    copies = F.coalesce("_wl_copies", F.lit(1).cast("long"))
    salted = rows.join(few, key, "left").withColumn("_wl_salt", F.pmod(F.monotonically_increasing_id(), copies)).drop("_wl_copies")
    copied = side.join(few, key, "left").withColumn("_wl_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_wl_copies")
    return salted.join(copied, [key, "_wl_salt"]).drop("_wl_salt")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its ``rows``, counted by the caller, are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def named(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def sums_before(rows: DataFrame, n: int, order: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """``rows``, about ``n``, plus for each of ``sums`` the sum over all rows before in ``order``, whose keys are added as columns.

    The rows are dealt into ranges of the order and added up in each; between ranges only one row a range meets the others."""
    ranges = max(1, min(partitions(rows.sparkSession), n // RANGE_ROWS))
    dealt = rows.withColumns({**order, **{f"{k}_part": v for k, v in sums.items()}})
    by = [F.col(k).asc_nulls_last() for k in order]
    dealt = materialize(dealt.repartitionByRange(ranges, *by).withColumn("_wl_range", F.spark_partition_id()), "ranges")
    whole = Window.orderBy("_wl_range")
    totals = dealt.groupBy("_wl_range").agg(*[F.sum(f"{k}_part").alias(f"{k}_all") for k in sums])
    starts = totals.select("_wl_range", *[(F.sum(f"{k}_all").over(whole) - F.col(f"{k}_all")).alias(f"{k}_start") for k in sums])
    inside = Window.partitionBy("_wl_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_wl_range")  # as many rows as ranges
    out = out.withColumns({k: F.col(f"{k}_start") + F.coalesce(F.sum(f"{k}_part").over(inside), F.lit(0)) for k in sums})
    return out.drop("_wl_range", *[f"{k}_{x}" for k in sums for x in ("part", "start")])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
