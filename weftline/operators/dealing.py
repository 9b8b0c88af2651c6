"""How many tasks a step is dealt to.

Left alone, Spark joins small partitions by the bytes that the shuffle wrote. Texts and symbols that are much alike compress twenty
to a hundred times, so few tasks get all rows, and what one holds grows with the input. A step that names its number of partitions
keeps them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Bytes of files and rows a task, tasks a core at least, and tasks at most (more are only longer, as a task streams or spills).
BYTES, ROWS, TASKS_A_CORE, MOST = 4 << 20, 20_000, 4, 10_000
#: Spark's size of a source that does not tell one.
UNKNOWN = 1 << 62


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, without running it; sources of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)


def tasks(*dfs: DataFrame, rows: int = 0) -> int:
    """In proportion to the input of ``dfs`` and to ``rows``, where they are known."""
    spark = dfs[0].sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return min(max(least, math.ceil(sum(map(source_bytes, dfs)) / BYTES), math.ceil(rows / ROWS)), max(least, MOST))


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``n`` tasks; as it is without ``n``."""
    return df.repartition(n, *keys) if n else df
