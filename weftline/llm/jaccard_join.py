"""N-gram Jaccard join with Bayesian candidate pruning.

Documents that are equal after lower-casing and joining words by single spaces form a text; one row per text goes on. A text's set
of five-word shingles gives a MinHash signature. Texts that agree in all values of a band are candidates; a candidate pair's
signatures are compared a few values at a time, and it is dropped as soon as the posterior probability, after the matches seen, that its
similarity reaches the threshold is below the tolerance. The rest is verified exactly on the shingle sets of the whole texts.

Buckets of up to BUCKET texts give their pairs. The texts of larger buckets are dealt into blocks, first by a bucket that they have in
common, and two blocks meet in a task if a large bucket has texts of both: one job prunes on the signatures alone, a second gets the
whole texts of what is left, and gives back link counts and a spanning forest, never its pairs. A block holds up to BLOCK texts and
BLOCK_SHINGLES shingles, what a task's memory allows for two, and is compared PIECE by PIECE texts inside the task; so a group of N
different near copies is sent N / BLOCK times, while counting its links exactly takes comparisons that grow with the square of N.

Recall: a pair of similarity s shares no band with probability (1 - s^6)^30, 1.1e-4 at the threshold of 0.8 and 1e-10 at 0.9; the
pruning adds the tolerance, 1e-5. What is found is exact. Measured against an exact join: all links at sf0.01 and sf0.1.

Defined results: a null text is empty; texts without words are equal to each other and to nothing else; a text of one to four
words has one shingle, itself; repeated rows are copies; a null doc_id is carried and is lowest in order; an empty table gives no rows;
columns of the input that are not asked for are not read, and internal names of the stage start with ``_wl_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import PER_COPY, join_hot, materialize, named, small, table, text_of
from weftline.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 6
HASHES = BANDS * ROWS
STEP = 30
#: A pair is dropped when its similarity reaches the threshold with less than this probability.
TOLERANCE = 1e-5
BUCKET = 32
#: Texts and shingles of a block, and texts that a task compares at once.
BLOCK, BLOCK_SHINGLES, PIECE = 4096, 2_000_000, 512
#: A list of (id, key) rows is broadcast up to this many of them.
LISTED = 100_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(base)
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_words(text: str) -> bytes:
    """Lower case, words joined by single spaces."""
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def shingle_hashes(joined: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words; of the whole if there are fewer words.

    Prefix sums of the bytes times powers of an odd number give the hash of any run at once."""
    if not joined:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(joined + b" ", dtype=np.uint8)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    ends = np.flatnonzero(data == 32) + 1
    starts = np.concatenate([[0], ends[:-1]])
    k = min(SHINGLE, len(starts))
    first, last = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(_mix((sums[last] - sums[first]) * inverse[first]))


def shingles_of(text: str) -> np.ndarray:
    return shingle_hashes(joined_words(text))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each."""
    x = shingles.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024, None] * _A + _B).min(axis=0), out=out)
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the matches below which a pair is dropped: with a uniform prior the similarity after m
    matches of n is Beta(m + 1, n - m + 1), and its tail above the threshold is what must reach the tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                break
        out[n] = m
    return out


_LEAST = least_matches(THRESHOLD, TOLERANCE)


def survivors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices survive the incremental comparison."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int32)
    for n, least in _LEAST.items():
        matches = matches + (x[alive, n - STEP : n] == y[alive, n - STEP : n]).sum(axis=1)
        good = matches >= least
        alive, matches = alive[good], matches[good]
    return alive


def reaches(common: np.ndarray | int, union: np.ndarray | int, threshold: float = THRESHOLD):
    return common >= threshold * union - 1e-9


def _id(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(-(1 << 63)))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        joined = [joined_words(t) for t in b["text"]]
        sets = [shingle_hashes(j) for j in joined]
        keys = [hashlib.md5(j, usedforsecurity=False).digest() for j in joined]
        yield pd.DataFrame({"id": b["id"], "raw": b["raw"], "none": b["none"], "key": keys, "n": [len(s) for s in sets], "sig": [minhash(s).tobytes() for s in sets]})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), HASHES)


def _prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            keep = survivors(_matrix(b["sig_a"]), _matrix(b["sig_b"]))
            yield b.iloc[keep][["a", "b"]]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets: dict[int, np.ndarray] = {}
        good = []
        for i, j, s, t in zip(b["a"], b["b"], b["text_a"], b["text_b"], strict=True):
            for node, text in ((i, s), (j, t)):
                if node not in sets:
                    sets[node] = shingles_of(text)
            x, y = sets[i], sets[j]
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(bool(reaches(common, len(x) + len(y) - common)))
        yield b.loc[good, ["a", "b"]]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``left`` with each of ``right``: products of the incidence matrices, a few thousand
    shingles at a time."""
    x, y = np.concatenate(left), np.concatenate(right)
    values = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for sets, every in ((left, x), (right, y)):
        row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(values, every)
        there = (column < len(values)) & (values[np.minimum(column, len(values) - 1)] == every) if len(values) else np.zeros(len(every), dtype=bool)
        row, column = row[there], column[there]
        order = np.argsort(column, kind="stable")
        sides.append((len(sets), row[order], column[order]))
    for at in range(0, len(values), 4096):
        parts = []
        for n, row, column in sides:
            lo, hi = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((n, min(4096, len(values) - at)), dtype=np.float32)
            part[row[lo:hi], column[lo:hi] - at] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _alive(pdf: pd.DataFrame, one: int, two: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs between two blocks, or inside one, that survive the pruning; for PIECE by PIECE texts at a time."""
    sig, block = _matrix(pdf["sig"]), pdf["block"].to_numpy()
    sides = [np.flatnonzero(block == x) for x in (one, two)]
    left, right = ([side[at : at + PIECE] for at in range(0, len(side), PIECE)] for side in sides)
    for m, rows in enumerate(left):
        for columns in right[m:] if one == two else right:
            found_i, found_j = [], []
            for i in rows:
                others = columns[columns > i] if one == two else columns
                alive = others[survivors(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others])]
                found_i.append(np.full(len(alive), i))
                found_j.append(alive)
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            if len(i):
                yield i.astype(np.int64), j.astype(np.int64)


def _block_survivors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The texts of a task that have a partner left."""
    pdf = pdf.sort_values("node", ignore_index=True)
    used = np.zeros(len(pdf), dtype=bool)
    for i, j in _alive(pdf, *key):
        used[i] = used[j] = True
    return pd.DataFrame({"one": key[0], "two": key[1], "node": pdf["node"].to_numpy()[used]})


def _block_links(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of a task (or inside its one block): a count for each text, and a spanning forest."""
    pdf = pdf.sort_values("node", ignore_index=True)
    copies, node = pdf["copies"].to_numpy(), pdf["node"].to_numpy()
    sets = [shingles_of(t) for t in pdf["text"]]
    size = np.array([len(s) for s in sets])
    links, root = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf))
    for i, j in _alive(pdf, *key):
        (rows, at), (columns, to) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        common = _common([sets[x] for x in rows], [sets[x] for x in columns])[at, to]
        good = reaches(common, size[i] + size[j] - common)
        i, j = i[good], j[good]
        links += np.bincount(i, copies[j], len(pdf)).astype(np.int64) + np.bincount(j, copies[i], len(pdf)).astype(np.int64)
        while True:
            low = np.minimum(root[i], root[j])
            if (low == root[i]).all() and (low == root[j]).all():
                break
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while not (root[root] == root).all():
                root = root[root]
    out = pd.DataFrame({"node": node, "links": links, "root": node[root]})
    return out[(out["links"] > 0) | (out["root"] != out["node"])]


def jaccard_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, classes). rows: id, whether it is null (``none``) and key of every document; texts: one row per distinct text with
    key, copies, links (documents linked to each of its copies) and class node; classes: class node, and id and text hash (``raw``) of the
    class's least document."""
    src = docs.select(_id(id_col).alias("id"), F.col(id_col).isNull().alias("none"), text_of(text_col).alias("text")).withColumn("raw", F.xxhash64("text"))
    signed = materialize(src.mapInPandas(_sign, "id long, raw long, none boolean, key binary, n int, sig binary").withColumn("uid", F.monotonically_increasing_id()), "join-signatures")
    texts = materialize(signed.groupBy("key").agg(F.min("uid").alias("node"), F.min(F.struct("id", "raw")).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "join-texts")
    light = texts.select("node", "key", "first", "copies")
    reps = materialize(signed.select("uid", "sig").join(texts.where("n > 0").select(F.col("node").alias("uid"), "copies", "n"), "uid").withColumnRenamed("uid", "node"), "join-reps")

    keys = F.array(*[F.struct(F.lit(k).cast("byte").alias("band"), F.xxhash64(F.substring("sig", k * ROWS * 4 + 1, ROWS * 4)).alias("bucket")) for k in range(BANDS)])
    bands = reps.select("node", F.explode(keys).alias("x")).select("node", "x.band", "x.bucket")
    buckets = materialize(bands.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "join-buckets")
    shared = materialize(bands.join(buckets, ["band", "bucket"]), "join-shared")
    large = shared.where(F.col("size") > BUCKET)
    blocks = tasks = None
    if large.limit(1).count():
        blocks, tasks = _tasks(large, reps.select("node", "n"))
        dealt = materialize(reps.join(small(blocks, blocks.count()), "node").select("node", "block", "copies", "sig"), "join-dealt")

    members = shared.where(F.col("size") <= BUCKET).select("node", "band", "bucket")
    members = members.join(blocks, "node", "left") if blocks is not None else members.withColumn("block", F.lit(None).cast("long"))
    lists = members.groupBy("band", "bucket").agg(F.sort_array(F.collect_list(F.struct("node", "block"))).alias("m"))
    two = lists.select("m", F.explode("m").alias("x")).select("x", F.explode(F.filter("m", lambda y: y["node"] > F.col("x.node"))).alias("y"))
    pairs = two.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.least("x.block", "y.block").alias("one"), F.greatest("x.block", "y.block").alias("two"), (F.col("x.block").isNotNull() & F.col("y.block").isNotNull()).alias("both")).distinct()
    if tasks is not None:  # what a task of blocks compares needs no pair
        pairs = pairs.where("not both").unionByName(pairs.where("both").join(tasks, ["one", "two"], "left_anti").select(*pairs.columns))
    sig_of = lambda side: reps.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"))
    pruned = materialize(pairs.select("a", "b").join(sig_of("a"), "a").join(sig_of("b"), "b").mapInPandas(_prune, "a long, b long"), "join-pruned")

    wanted = pruned.select(F.explode(F.array("a", "b")).alias("node"))
    if tasks is not None:
        either = tasks.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
        inside = either.join(dealt.select("block", "node", "sig"), "block")
        left = materialize(inside.groupBy("one", "two").applyInPandas(_block_survivors, "one long, two long, node long"), "join-survivors")
        wanted = wanted.unionByName(left.select("node"))
    wanted = materialize(wanted.distinct().join(light, "node").select("node", "first.id", "first.raw"), "join-wanted")
    listed = F.broadcast(wanted) if wanted.count() <= LISTED else wanted
    sets = materialize(src.join(listed, ["id", "raw"]).select("node", "text").dropDuplicates(["node"]), "join-sets")
    text_at = lambda side: sets.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    links = materialize(pruned.join(text_at("a"), "a").join(text_at("b"), "b").mapInPandas(_verify, "a long, b long"), "join-links")

    copies = light.select("node", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("links"))
    edges = links
    if tasks is not None:
        whole = left.join(dealt.join(sets, "node"), "node")
        found = materialize(whole.groupBy("one", "two").applyInPandas(_block_links, "node long, links long, root long"), "join-blocks")
        counts = counts.unionByName(found.groupBy("node").agg(F.sum("links").alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
        edges = links.unionByName(found.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")))
    comps = components(edges)
    named = light.join(counts, "node", "left").join(comps, "node", "left").select("key", "first", "copies", F.coalesce("component", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    named = materialize(named, "join-classes")
    classes = named.groupBy("class").agg(F.min("first").alias("first"))
    return signed.select("id", "none", "key"), named.drop("first"), classes.select("class", F.col("first.id").alias("class_id"), F.col("first.raw").alias("class_raw"))


def _tasks(large: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, tasks) of rows (node, band, bucket) of large buckets and the shingles n of nodes. blocks: the block of each node; tasks:
    the pairs of blocks, one <= two, that some bucket has texts of both of.

    A node's home is its first bucket. Homes of many texts are blocks of their own, or several; small ones that buckets connect share
    blocks, so that blocks are full and a group's texts meet in few tasks."""
    home = large.groupBy("node").agg(F.min(F.struct("band", "bucket")).alias("x")).select("node", F.xxhash64("x.band", "x.bucket").alias("home"))
    home = materialize(home.join(sizes, "node"), "join-home")
    part = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    homes = materialize(home.groupBy("home").agg(part.alias("part")), "join-homes")
    n_homes = homes.count()
    at = materialize(large.join(home.select("node", "home"), "node").select("band", "bucket", "home").distinct(), "join-at")
    first = at.groupBy("band", "bucket").agg(F.min("home").alias("a"))
    found = components(at.join(first, ["band", "bucket"]).where("a <> home").select("a", F.col("home").alias("b")))
    homes = homes.join(small(found.withColumnRenamed("node", "home"), n_homes), "home", "left").withColumn("group", F.coalesce("component", "home"))
    shared = homes.where("part < 0.5").groupBy("group").agg(F.ceil(F.sum("part")).alias("pool"))
    homes = homes.join(small(shared, n_homes), "group", "left")
    own = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil("part")))
    block = F.when(F.col("part") < 0.5, F.xxhash64(F.lit("shared"), "group", F.pmod("home", F.col("pool")))).otherwise(own)  # should two get one number, they are one block
    blocks = materialize(home.join(small(homes, n_homes), "home").select("node", block.alias("block")), "join-blocked")
    held = materialize(large.join(blocks, "node").select("band", "bucket", "block").distinct(), "join-held")
    pairs = held.join(held.withColumnRenamed("block", "other"), ["band", "bucket"]).where("block <= other")
    return blocks, materialize(pairs.select(F.col("block").alias("one"), F.col("other").alias("two")).distinct(), "join-tasks")


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of the class) and n_links of every document."""
    rows, texts, classes = jaccard_links(docs, id_col=id_col, text_col=text_col)
    named = texts.join(classes, "class").select("key", "class_id", F.col("links").alias("n_links"))
    hot = materialize(texts.where(F.col("copies") > PER_COPY).select("key", F.col("copies").alias("n")), "join-copies")
    out = join_hot(rows, named, "key", hot, hot.count())
    return out.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "class_id", "n_links")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and the number of documents that it is linked to."""
    return jaccard_join(table(spark, sf_dir, "documents"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the least id stays."""
    _, _, classes = jaccard_links(docs)
    kept = classes.select(F.col("class_id").alias("_wl_id"), F.col("class_raw").alias("_wl_raw"))
    rows = docs.withColumn("_wl_id", _id("doc_id")).withColumn("_wl_raw", F.xxhash64(text_of("text")))
    nth = F.row_number().over(Window.partitionBy("_wl_id", "_wl_raw").orderBy(F.lit(0)))
    return rows.join(kept, ["_wl_id", "_wl_raw"]).withColumn("_wl_nth", nth).where("_wl_nth = 1").select(*named(docs.columns))


#: White space of str.split.
_BLANK = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ORACLE_OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_BLANK}'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT *, array_to_string(ws, ' ') AS key FROM d),
t AS (SELECT key, any_value(ws) AS ws, min(id) AS id, count(*) AS copies, row_number() OVER (ORDER BY key) AS n FROM k GROUP BY key),
s AS (SELECT DISTINCT n, unnest(CASE WHEN len(ws) >= {SHINGLE} THEN list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) ELSE [key] END) AS g FROM t WHERE key <> ''),
z AS (SELECT n, count(*) AS size FROM s GROUP BY n),
c AS (SELECT a.n AS a, b.n AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.n < b.n GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN z x ON x.n = c.a JOIN z y ON y.n = c.b WHERE common >= {THRESHOLD} * (x.size + y.size - common) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT n AS a, n AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
o AS (SELECT r.a AS n, min(t.id) AS class_id FROM r JOIN t ON t.n = r.b GROUP BY 1),
m AS (SELECT e.a AS n, CAST(sum(t.copies) AS BIGINT) AS linked FROM e JOIN t ON t.n = e.b GROUP BY 1)
SELECT k.doc_id, o.class_id, coalesce(m.linked, 0) + t.copies - 1 AS n_links FROM k JOIN t ON t.key = k.key JOIN o ON o.n = t.n LEFT JOIN m ON m.n = t.n"""
