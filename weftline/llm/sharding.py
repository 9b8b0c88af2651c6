"""Sharding by k-d tree partitioning, DataFrame operations only.

Documents are points whose coordinates are metadata of the text (bytes, bytes per code point, lines), so equal texts share a
point. From the root down, the nodes of a level are split together along each node's widest dimension, at the weighted quantile that
divides the bytes in the proportion of the leaves on either side. A cut's goal counts from the beginning of all bytes, so that errors
of cuts do not add up. The quantile is found by radix descent: a level's first pass over the points gives histograms of the top
RADIX bits of all dimensions, from which the widest one is read; up to two more passes look into the bin that the goal falls into.
A histogram is summed up FAN bins at a time, so no task sees more bins of a node than that; one row per node reaches the driver. Ties
are ordered by text hash and, below that, by a hash of doc_id: a group of equal texts stays in one shard unless a cut must pass
through it, so even a group with a third of all rows is dealt out evenly.

Documents are not divisible: where single ones weigh much beside a shard, the leaves are uneven by up to half a document on either
side. Of each leaf up to EXCHANGE documents, chosen by hash, are candidates to change places with those of other leaves, by a search
on the driver that sees only these; a shard's excess is no more than a few documents, whatever the number of rows.

Defined results: a null text has no bytes (size 16) and the CRC-32 of the empty text; repeated rows are separate rows with slots
of their own; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, table, text_of

#: Bits of the key that the passes of a level look at: of all dimensions first, then of the bin that the cut falls into.
RADIX = (14, 21, 21)
#: Bins that are summed up together, as bits.
FAN = 7
COORD_BITS, TEXT_BITS, SALT_BITS = 16, 24, 16
KEY_BITS = COORD_BITS + TEXT_BITS + SALT_BITS
#: A cut is exact enough when the bin that it falls into holds less than this part of a leaf, or one row.
TOLERANCE = 0.001
#: Rows that one slot-numbering task gets, about.
SLOT_ROWS = 100_000
#: Documents of a leaf that may change places.
EXCHANGE = 64


def _pick(values: Sequence[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (index + 1).cast("int"))


def _crossing(bins: DataFrame, goal: Sequence[float], bits: int) -> list:
    """Of each node the bin, weight, rows and weight up to it of the bin of ``bins`` (node, bin, w, n) that the goal falls into.

    Sums of FAN bits of the bin's number at a time: a window sees at most 2 ^ FAN of them for each node."""
    at, before, shift = None, F.lit(0).cast("long"), bits
    while shift > 0:
        up, shift = shift, max(0, shift - FAN)
        own = bins.select("node", F.shiftright("bin", shift).alias("bin"), "w", "n", F.shiftright("bin", up).alias("above"))
        if at is not None:
            own = own.join(F.broadcast(at.select("node", F.col("bin").alias("above"), "before")), ["node", "above"])  # one row a node
            before = F.col("before")
        sums = own.groupBy("node", "bin", before.alias("before")).agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + F.col("before")
        over = sums.withColumn("upto", upto).where(F.col("upto") > _pick(goal, F.col("node")))
        at = over.groupBy("node").agg(F.min_by(F.struct("bin", "w", "n", "upto"), "bin").alias("x")).select("node", "x.*", (F.col("x.upto") - F.col("x.w")).alias("before"))
    return at.collect()


def kd_leaves(points: DataFrame, keys: Sequence[str], weight: str, leaves: int) -> Column:
    """The leaf number, 0 to leaves - 1, of each row of ``points`` (a materialized table) as a column.

    ``keys`` are long columns, one a dimension: the coordinate in the top COORD_BITS of KEY_BITS, tie-breaks below."""
    total = points.agg(F.sum(weight)).first()[0] or 0
    enough = max(1.0, TOLERANCE * total / leaves)
    sizes, levels, key_of = [leaves], [], F.array(*[F.col(k) for k in keys])

    def descend() -> Column:
        """Down the levels found so far, in one fold: children of node n are 2 n and 2 n + 1."""
        if not levels:
            return F.lit(0).cast("long")
        longs = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
        steps = F.array(*[F.struct(longs(d).alias("dims"), longs(c).alias("cuts")) for d, c in levels])
        side = lambda n, x: F.get(key_of, F.get(x["dims"], n.cast("int")).cast("int")) >= F.get(x["cuts"], n.cast("int"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n * 2 + side(n, x).cast("long"))

    while max(sizes) > 1:
        at = points.select(descend().alias("node"), F.col(weight).alias("w"), *keys)
        shift = KEY_BITS - RADIX[0]
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.shiftright(k, shift).alias("bin")) for i, k in enumerate(keys)]))
        count = lambda rows, *by: rows.groupBy(*by).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
        first = materialize(count(at.select("node", "w", each.alias("x")).select("node", "w", "x.*"), "node", "dim", "bin"), "kd-bins")
        ends = first.groupBy("node", "dim").agg(F.sum("w").alias("w"), (F.max("bin") - F.min("bin")).alias("wide")).collect()
        dims, goal, cuts = [0] * len(sizes), [0] * len(sizes), [1 << KEY_BITS] * len(sizes)
        held = {r["node"]: r["w"] for r in ends if r["dim"] == 0}
        before = done = 0
        for n, k in enumerate(sizes):
            if k > 1 and n in held:
                dims[n] = max((r["wide"], -r["dim"]) for r in ends if r["node"] == n)[1] * -1
                goal[n] = total * (done + k // 2) // leaves - before
            before, done = before + held.get(n, 0), done + k
        open_ = {n: (0, 0) for n, k in enumerate(sizes) if k > 1 and n in held}  # node: key prefix, weight left of it
        bins, shift, bits = first.where(F.col("dim") == _pick(dims, F.col("node"))), KEY_BITS, RADIX[0]
        keyed = at.withColumn("key", F.element_at(F.array(*keys), (_pick(dims, F.col("node")) + 1).cast("int"))).select("node", "w", "key")
        for radix in RADIX:
            up, shift, bits = shift, shift - radix, radix
            if up < KEY_BITS:
                within = F.col("node").isin([*open_]) & (F.shiftright("key", up) == _pick([open_.get(n, (-1, 0))[0] for n in range(len(sizes))], F.col("node")))
                bin_ = F.shiftright("key", shift).bitwiseAND((1 << radix) - 1)
                bins = count(keyed.where(within).select("node", bin_.alias("bin"), "w"), "node", "bin")  # its exchange is made once
            found = {r["node"]: r for r in _crossing(bins.where(F.col("node").isin([*open_])), [goal[n] - open_.get(n, (0, 0))[1] for n in range(len(sizes))], bits)}
            for n, (prefix, left) in list(open_.items()):
                if n not in found:  # the goal is the node's end
                    open_.pop(n)
                    continue
                b, w, upto = (prefix << radix) + found[n]["bin"], found[n]["w"], left + found[n]["upto"]
                open_[n] = (b, upto - w)
                if w <= enough or found[n]["n"] == 1 or shift == 0:
                    cuts[n] = (b if goal[n] - (upto - w) < upto - goal[n] else b + 1) << shift
                    open_.pop(n)
            if not open_:
                break
        levels.append((dims, cuts))
        sizes = [x for k in sizes for x in ((k // 2, k - k // 2) if k > 1 else (k, 0))]
    number, numbers = 0, []
    for k in sizes:
        numbers.append(number if k else -1)
        number += k
    return _pick(numbers, descend()).cast("int")


def exchanges(held: Sequence[float], free: Sequence[Sequence[int]], steps: int = 10) -> dict[tuple[int, int], int]:
    """Where to put some of the documents so that the leaves, of ``held`` bytes each, become more even: (leaf, number in ``free``, the
    sizes of its candidates) to the new leaf. Each step moves or exchanges one or two documents between the two leaves where that takes
    most off the greater deviation."""
    goal, now = sum(held) / max(len(held), 1), list(held)
    at = [{(k, i): s for i, s in enumerate(f)} for k, f in enumerate(free)]
    for _ in range(steps * len(held)):
        worst = max(range(len(now)), key=lambda k: abs(now[k] - goal))
        best = None
        for other in range(len(now)):
            heavy, light = (worst, other) if now[worst] > goal else (other, worst)
            if now[heavy] <= now[light] or not at[heavy]:
                continue
            # the best is to move as much as levels both; what moved nearest to that, against nothing or a document that comes back
            want = (now[heavy] - now[light]) / 2
            back = [(None, 0), *at[light].items()]
            given, taken = (np.array([s for _, s in x], dtype=float) for x in (at[heavy].items(), back))
            off = np.abs(given[:, None] - taken[None, :] - want)
            i, j = divmod(int(off.argmin()), len(back))
            moved = int(given[i] - taken[j])
            gain = max(abs(now[heavy] - goal), abs(now[light] - goal)) - max(abs(now[heavy] - moved - goal), abs(now[light] + moved - goal))
            if moved > 0 and (best is None or gain > best[0]):
                best = (gain, heavy, light, list(at[heavy])[i], back[j][0], moved)
        if best is None or best[0] <= goal * 1e-4:
            break
        _, heavy, light, x, y, moved = best
        now[heavy], now[light] = now[heavy] - moved, now[light] + moved
        at[light][x] = at[heavy].pop(x)
        if y is not None:
            at[heavy][y] = at[light].pop(y)
    return {x: k for k, there in enumerate(at) for x in there if x[0] != k}


def evened(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``rows`` (uid, size, shard, of ``n``) with the shards of a few documents changed so that the bytes are even."""
    held = {r["shard"]: r["w"] for r in rows.groupBy("shard").agg(F.sum("size").alias("w")).collect()}
    part = max(1, n // (shards * EXCHANGE * 4))
    some = rows.where(F.pmod(F.xxhash64("uid", F.lit("some")), F.lit(part)) == 0)
    nth = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("uid", F.lit("order"))))
    some = some.select("shard", "uid", "size", nth.alias("nth")).where(F.col("nth") <= EXCHANGE).orderBy("shard", "nth").collect()
    free: list[list] = [[] for _ in range(shards)]
    for r in some:
        free[r["shard"]].append(r)
    moved = exchanges([held.get(k, 0) for k in range(shards)], [[r["size"] for r in f] for f in free])
    if not moved:
        return rows
    to = rows.sparkSession.createDataFrame([(free[k][i]["uid"], new) for (k, i), new in moved.items()], "uid long, _to int")
    return rows.join(F.broadcast(to), "uid", "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_to")  # EXCHANGE rows a shard at most


def with_slots(rows: DataFrame, n: int, groups: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: ranks within hash cells, plus the rows of the cells before."""
    cells = max(16, n // (groups * SLOT_ROWS))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    count = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = count.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    # one row a cell: groups * cells, a fixed number up to SLOT_ROWS rows a cell and one row per SLOT_ROWS rows beyond
    starts = F.broadcast(starts) if groups * cells <= 100_000 else starts
    return rows.withColumn("rank", rank).join(starts, ["shard", "cell"]).withColumn("slot", (F.col("start") + F.col("rank")).cast("long"))


def kd_shards(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot; the shards' sizes are near equal."""
    text = text_of(text_col)
    bytes_, chars = F.octet_length(text).cast("long"), F.length(text).cast("long")
    lines = chars - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    log16 = lambda c: F.least(F.lit(65535), F.floor(F.log2(c + F.lit(1.0)) * 2048)).cast("long")
    coords = {"k_bytes": log16(bytes_), "k_script": F.floor(F.when(bytes_ > 0, chars / bytes_).otherwise(F.lit(1.0)) * 65535).cast("long"), "k_lines": log16(lines)}
    tie = F.shiftleft(F.pmod(F.xxhash64(text), F.lit(1 << TEXT_BITS)), SALT_BITS) + F.pmod(F.xxhash64(F.col(id_col), F.lit("salt")), F.lit(1 << SALT_BITS))
    light = docs.select(F.col(id_col).alias("doc_id"), (bytes_ + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), tie.alias("tie"), *[v.alias(k) for k, v in coords.items()])
    light = light.select("doc_id", "size", "text_crc32", *[(F.shiftleft(F.col(k), KEY_BITS - COORD_BITS) + F.col("tie")).alias(k) for k in coords])
    light = materialize(light.withColumn("uid", F.monotonically_increasing_id()), "kd-points")
    n = light.count()
    rows = light.select("uid", "doc_id", "size", "text_crc32", kd_leaves(light, [*coords], "size", shards).alias("shard"))
    return with_slots(evened(rows, n, shards), n, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def op3_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = kd_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
