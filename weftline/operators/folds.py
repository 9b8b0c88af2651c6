"""Ordered folds: a state walks over the rows of each key in order.

Rows are dealt by key, sorted inside the partitions and streamed through Arrow batches, so a key of any size needs one state and
one batch of memory, and the rows come out with what the step returned for them. The reference operators that feed back on
themselves (greedy packing, semantic groups, flow control) cannot be window functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: Sequence, inputs: Sequence[str], start: Callable[[], object], step: Callable, outputs: str) -> DataFrame:
    """``df`` plus the columns ``outputs`` (a DDL list): step(state, *inputs) gives their values as a tuple."""
    names = [x.split()[0] for x in outputs.split(",")]
    fields = df.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = object(), None
        for b in batches:
            got = []
            for k, *values in zip(b[key], *[b[c] for c in inputs], strict=True):
                if k != held:
                    held, state = k, start()
                got.append(step(state, *values))
            for i, n in enumerate(names):
                b[n] = pd.Series([g[i] for g in got], index=b.index, dtype=object)
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + outputs
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
