"""BLAKE3 hex digests, from the published specification, many inputs of one call at once.

The compression function runs over numpy columns: all chunks of all rows of an Arrow batch advance together, then the levels of
their trees do, so Python steps are shared by the whole batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8


def _g(v, a, b, c, d, x, y):
    for shift_d, shift_b, word in ((16, 12, x), (8, 7, y)):
        v[a] = v[a] + v[b] + word
        t = v[d] ^ v[a]
        v[d] = t >> np.uint32(shift_d) | t << np.uint32(32 - shift_d)
        v[c] = v[c] + v[d]
        t = v[b] ^ v[c]
        v[b] = t >> np.uint32(shift_b) | t << np.uint32(32 - shift_b)


def _compress(h: np.ndarray, m: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """h: (8, n), m: (16, n); the new chaining values (8, n)."""
    n = h.shape[1]
    v = [h[i] for i in range(8)] + [np.full(n, IV[i], dtype=np.uint32) for i in range(4)]
    v += [(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    order = list(range(16))
    for _ in range(7):
        for i, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
            _g(v, a, b, c, d, m[order[2 * i]], m[order[2 * i + 1]])
        order = [order[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def blake3_many(inputs: list[bytes]) -> list[str]:
    if not inputs:
        return []
    owner, start, number = [], [], []
    for i, data in enumerate(inputs):
        for k in range(max(1, -(-len(data) // 1024))):
            owner.append(i)
            start.append(1024 * k)
            number.append(k)
    n = len(owner)
    sizes = np.array([min(1024, len(inputs[o]) - s) for o, s in zip(owner, start, strict=True)])
    padded = np.zeros((n, 1024), dtype=np.uint8)
    for row, (o, s, size) in enumerate(zip(owner, start, sizes, strict=True)):
        padded[row, :size] = np.frombuffer(inputs[o][s : s + size], dtype=np.uint8)
    words = padded.view("<u4").astype(np.uint32).reshape(n, 16, 16)
    counter = np.array(number, dtype=np.int64)
    owners = np.array(owner)
    single = np.bincount(owners, minlength=len(inputs))[owners] == 1
    h = np.repeat(np.array(IV, dtype=np.uint32)[:, None], n, axis=1)
    blocks = np.maximum(1, -(-sizes // 64))
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = CHUNK_START * (b == 0) + last * CHUNK_END + (last & single[live]) * ROOT
        length = np.minimum(64, sizes[live] - 64 * b)
        h[:, live] = _compress(h[:, live], words[live, b].T.copy(), counter[live], length, flags)
    nodes: list[list[int]] = [[] for _ in inputs]
    for row, o in enumerate(owner):
        nodes[o].append(row)
    values = [h[:, row] for row in range(n)]
    while todo := [x for x in nodes if len(x) > 1]:
        pairs = [(x, j) for x in todo for j in range(0, len(x) - 1, 2)]
        m = np.stack([np.concatenate([values[x[j]], values[x[j + 1]]]) for x, j in pairs], axis=1)
        k = len(pairs)
        flags = np.array([PARENT | (ROOT if len(x) == 2 else 0) for x, _ in pairs])
        out = _compress(np.repeat(np.array(IV, dtype=np.uint32)[:, None], k, axis=1), m, np.zeros(k, dtype=np.int64), np.full(k, 64), flags)
        merged: dict[int, list[int]] = {}
        for col, (x, _) in enumerate(pairs):
            values.append(out[:, col])
            merged.setdefault(id(x), []).append(len(values) - 1)
        for x in todo:
            x[:] = merged[id(x)] + (x[-1:] if len(x) % 2 else [])
    return [values[x[0]].astype("<u4").tobytes().hex() for x in nodes]


@F.pandas_udf(StringType())
def blake3_hex(data: pd.Series) -> pd.Series:
    out: list[str | None] = [None] * len(data)
    there = [i for i, x in enumerate(data) if x is not None]
    batch, weight = [], 0
    for i in [*there, None]:
        if i is None or weight > 4_000_000:
            for j, digest in zip(batch, blake3_many([bytes(data.iloc[j]) for j in batch]), strict=True):
                out[j] = digest
            batch, weight = [], 0
        if i is not None:
            batch.append(i)
            weight += len(data.iloc[i])
    return pd.Series(out)
