"""URL filters by a Bloom filter cascade, DataFrame operations only.

A list of (host, path) keys is encoded without joins at query time: level 1 encodes the listed keys, level 2 those keys of the
corpus that level 1 wrongly lets through, level 3 the listed keys that level 2 lets through, and so on until a level lets through
none that it should not. A key of that universe is listed exactly if the first level that does not hold it is an even one. The
universe is every key that any page of the corpus can ask for, so the answers are exact for the corpus. A level is sized by the keys
that it encodes and the logarithm of those it must keep out, so the next holds about as many at most, however large the corpus.

A level of up to LITERAL_BITS enters the plan as one binary literal. A list that needs more is dealt into parts by the keys' hash, each
with a cascade of its own of about PART_KEYS keys; the parts' filters are the rows of a table, and the urls' keys go to their part's row.
Either way lists of any length are exact.

Defined results: a null url, or one without ``://``, has an empty host and path, matches nothing and is allowed; repeated pages
give repeated rows; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import join_hot, materialize, small, table

#: The rules asked for: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: A level lets through at most this part of the keys that it should not hold, and of many keys so few that the next level holds no more than it does.
RATE = 1 / 32
#: Above this a level is no literal.
LITERAL_BITS = 1 << 20
#: Listed keys in a part of a longer list, about.
PART_KEYS = 200_000
#: Bits of a word of a literal, nine bytes of seven bits: as text, such bytes can be read one by one.
WORD = 63


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    """One Bloom filter: a bit array, seven bits a byte."""

    seed: int
    bits: int
    hashes: int
    data: bytes = field(repr=False)

    def holds(self, key: Column) -> Column:
        data, found = F.lit(self.data), None
        for i in range(self.hashes):
            p = _position(key, self.seed, F.lit(i), F.lit(self.bits))
            byte = F.ascii(F.substring(data, (F.floor(p / 7) + 1).cast("int"), F.lit(1)).cast("string"))
            bit = F.getbit(byte, (p % 7).cast("int")) == 1
            found = bit if found is None else found & bit
        return found


def _position(key: Column, seed: int | Column, i: Column, bits: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), i, key), bits.cast("long"))


def _hashes(count, others, greatest=max, least=min, up=ceil, log_2=log2):
    """Half of the bits are set, so each hash halves what is let through, at 1 / ln 2 bits a key."""
    return up(-log_2(least(RATE, count / greatest(others, 1))))


def build_level(keys: DataFrame, seed: int, bits: int, hashes: int) -> Level:
    """Encode the column ``key``; only the set bits, grouped into words, come to the driver."""
    position = keys.select(F.explode(F.array(*[_position(F.col("key"), seed, F.lit(i), F.lit(bits)) for i in range(hashes)])).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % WORD).cast("int"))
    words = position.groupBy(F.floor(F.col("p") / WORD).alias("i")).agg(F.bit_or(one).alias("w")).collect()
    out = bytearray(bits // 7)
    for r in words:
        out[9 * r["i"] : 9 * r["i"] + 9] = bytes(r["w"] >> 7 * k & 127 for k in range(9))
    return Level(seed, bits, hashes, bytes(out))


@dataclass
class Cascade:
    """Levels that are literals."""

    levels: list[Level]

    def member(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out

    def mark(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (with ``key``) plus whether the key is listed."""
        return rows.withColumn(name, self.member(F.col("key")))


_LEVEL = "struct<level:int,bits:bigint,hashes:int,words:array<bigint>>"


@dataclass
class PartedCascade:
    """Levels that are rows of a table (part, levels), one for each part of the keys."""

    filters: DataFrame
    parts: int
    seed: int

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-self.seed), key), F.lit(self.parts))

    def holds(self, level: Column, key: Column) -> Column:
        bit = lambda p: F.getbit(F.get(level["words"], F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
        return F.forall(F.sequence(F.lit(0), level["hashes"] - 1), lambda i: bit(_position(key, F.lit(self.seed) + level["level"], i, level["bits"])))

    def member(self, levels: Column, key: Column) -> Column:
        first = F.aggregate(levels, F.lit(-1), lambda at, x: F.when(at >= 0, at).when(self.holds(x, key), F.lit(-1)).otherwise(x["level"]))
        return F.coalesce(F.when(first < 0, F.size(levels) % 2 == 1).otherwise(first % 2 == 1), F.lit(False))

    def mark(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (with ``key``) plus whether the key is listed. Every part has a row; a part of very many rows gets copies of it."""
        dealt = rows.withColumn("_part", self.part(F.col("key")))
        hot = materialize(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PART), "url-hot")
        met = join_hot(dealt, self.filters.withColumnRenamed("part", "_part"), "_part", hot, hot.count(), HOT_PART)
        return met.withColumn(name, self.member(F.col("levels"), F.col("key"))).drop("_part", "levels")


#: Rows that one copy of a part's filters serves.
HOT_PART = 1_000_000


def build_cascade(universe: DataFrame, literal_bits: int = LITERAL_BITS, part_keys: int = PART_KEYS, seed: int = 1) -> Cascade | PartedCascade:
    """``universe``: one row per key with ``listed``. Each level is built from the keys that all levels before let through."""
    levels: list[Level] = []
    passing, listed = universe, True
    while count := (n := {r["listed"]: r["count"] for r in passing.groupBy("listed").count().collect()}).get(listed, 0):
        hashes = _hashes(count, n.get(not listed, 0))
        bits = ceil(max(1, count * hashes / log(2) / WORD)) * WORD
        if bits > literal_bits:
            return _parted_cascade(universe, count if listed else n[True], part_keys, seed)
        levels.append(build_level(passing.where(F.col("listed") == listed), seed + len(levels), bits, hashes))
        listed = not listed
        passing = passing.where((F.col("listed") != listed) | levels[-1].holds(F.col("key")))
    return Cascade(levels)


def _parted_cascade(universe: DataFrame, count: int, part_keys: int, seed: int) -> PartedCascade:
    out = PartedCascade(None, max(1, ceil(count / part_keys)), seed)
    few = lambda df: small(df, out.parts)
    passing, listed, levels = universe.withColumn("part", out.part(F.col("key"))), True, []
    while True:
        of = lambda kind: F.count(F.when(F.col("listed") == kind, 1))
        sized = passing.groupBy("part").agg(of(listed).alias("count"), of(not listed).alias("others")).where("count > 0")
        hashes = _hashes(F.col("count"), F.col("others"), lambda x, y: F.greatest(x, F.lit(y)), lambda x, y: F.least(F.lit(x), y), F.ceil, F.log2).cast("int")
        sized = sized.withColumn("hashes", hashes).withColumn("bits", F.greatest(F.lit(1), F.ceil(F.col("count") * F.col("hashes") / log(2) / 64)).cast("long") * 64)
        sized = materialize(sized.select("part", "hashes", "bits"), "url-sizes")
        if not sized.limit(1).count():
            break
        at = passing.where(F.col("listed") == listed).join(few(sized), "part").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("hashes") - 1)))
        p = at.select("part", _position(F.col("key"), seed + len(levels), F.col("i"), F.col("bits")).alias("p"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
        words = p.select("part", F.floor(F.col("p") / 64).alias("i"), one.alias("w"))
        empty = sized.select("part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("bits") / 64).cast("long") - 1)).alias("i"), F.lit(0).cast("long").alias("w"))
        full = words.unionByName(empty).groupBy("part", "i").agg(F.bit_or("w").alias("w")).groupBy("part")  # a part's words: its keys set how many
        full = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))
        level = F.struct(F.lit(len(levels)).alias("level"), "bits", "hashes", "words").alias("x")
        levels.append(materialize(full.join(few(sized), "part").select("part", level), "url-level"))
        held = passing.join(levels[-1], "part").where((F.col("listed") == listed) | out.holds(F.col("x"), F.col("key")))
        listed = not listed
        passing = materialize(held.select(*passing.columns), "url-passing")
    every = reduce(DataFrame.unionByName, [universe.sparkSession.range(out.parts).select(F.col("id").alias("part"), F.lit(None).cast(_LEVEL).alias("x")), *levels])
    out.filters = materialize(every.groupBy("part").agg(F.sort_array(F.collect_list("x")).alias("levels")), "url-filters")
    return out


def candidate_keys(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The keys under which a rule for this url could be listed, longest first: for each shape of the rules (labels of the host,
    characters of the path) the host's last labels and the path's first characters."""
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules}, key=lambda s: (-s[0], -s[1]))
    labels = F.size(F.split(host, r"\.", -1))
    last = lambda n: F.call_function("substring_index", host, F.lit("."), -n)
    key = lambda s: F.when((labels >= s["n"]) & (F.length(path) >= s["m"]), F.concat(last(s["n"]), F.left(path, s["m"])))
    every = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes])
    return F.filter(F.transform(every, key), lambda k: k.isNotNull())


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """page_id, host, path, rule and verdict. A url that no rule fits is not listed, and the cascade allows it."""
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    parts = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    seen = parts.select(F.explode("keys").alias("key")).distinct()
    cascades = {}
    for i, verdict in enumerate(("block", "allow")):
        listed = sorted({h + p for v, h, p in rules if v == verdict})
        own = seen.sparkSession.createDataFrame([(k, True) for k in listed], "key string, listed boolean")
        both = seen.withColumn("listed", F.lit(False)).unionByName(own).groupBy("key").agg(F.max("listed").alias("listed"))
        cascades[verdict] = build_cascade(materialize(both, f"url-{verdict}"), seed=1 + 1000 * i, **how)
    said = lambda block, allow: F.when(block, "block").when(allow, "allow")
    if all(isinstance(c, Cascade) for c in cascades.values()):
        fits = F.transform("keys", lambda k: F.struct(k.alias("rule"), said(*[c.member(k) for c in cascades.values()]).alias("verdict")))
        parts = parts.withColumn("best", F.get(F.filter(fits, lambda x: x["verdict"].isNotNull()), F.lit(0)))
    else:
        rows = parts.withColumn("uid", F.monotonically_increasing_id()).select("uid", "page_id", "host", "path", F.posexplode_outer("keys").alias("at", "key"))
        for verdict, cascade in cascades.items():
            rows = cascade.mark(rows, verdict)
        rows = rows.withColumn("verdict", said(F.col("block"), F.col("allow")))
        best = F.min(F.when(F.col("verdict").isNotNull(), F.struct("at", F.col("key").alias("rule"), "verdict")))
        parts = rows.groupBy("uid").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], best.alias("best"))
    return parts.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the five rules."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _oracle(rules: Sequence[tuple[str, str, str]]) -> str:
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(rules, key=lambda r: (-r[1].count("."), -len(r[2]))))
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in rules)
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, host, path, CASE {fits} END AS rule FROM p)
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, 'allow') AS verdict FROM r"""


ORACLE_OP5 = _oracle(RULES)
