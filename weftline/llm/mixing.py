"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Every source gets a share of all words; the whole copies that fit into its share are
taken of each of its documents, and the remaining budget is filled by some of them once more. Which ones is a subset-sum problem
over *lengths*, not documents: documents are counted by exact length, each length gives its proportional share, and a bounded
knapsack over what is left of the counts closes the last words of the budget. Seeded hashes then pick that many documents of each
length. Python sees one row per source and distinct length, of which S words can have at most sqrt(2 S).

Defined results: a null text is empty (size 0, nothing taken); a null source is a source of its own, last in order; repeated rows
are separate documents; ties in the seeded order fall to doc_id, then to arrival; an empty table gives no rows. Columns of the
input that share a name with an output are replaced by it; all internal names start with ``_wl_``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, named, small, sums_before, table, text_of

#: Words: runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The knapsack closes at most this many words; proportional shares come before it.
DP_WORDS = 8192
#: Hash buckets by which one length's documents are spread, so that equal lengths never meet in one task.
BUCKETS = 256


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, n: int, weights: Sequence[int], cap: int) -> DataFrame:
    """Targets from one row per source (_wl_key, _wl_order, _wl_total), ``n`` in all: shares by weight, stopped at ``cap`` times the
    source's size with the excess reshared by weight. The fixed point of that resharing is min(cap * size, level * weight) for the
    one level at which the targets add up to all words, found by running sums over sources in the order of cap * size / weight."""
    t = sums_before(sizes, n, {"_wl_order": F.col("_wl_order")}, {"_wl_nth": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_wl_nth") % len(weights) + 1).cast("int"))
    t = t.withColumn("_wl_weight", weight).withColumn("_wl_cap", F.col("_wl_total") * cap)
    t = sums_before(t, n, {"_wl_ratio": F.col("_wl_cap") / F.col("_wl_weight"), "_wl_key": F.col("_wl_key")}, {"_wl_full": F.col("_wl_cap"), "_wl_done": F.col("_wl_weight")})
    t = materialize(t, "mix-sources")
    words, shares = t.agg(F.sum("_wl_total"), F.sum("_wl_weight")).first()
    level = (F.lit(words) - F.col("_wl_full")) / (F.lit(shares) - F.col("_wl_done"))
    at = t.select("_wl_ratio", "_wl_key", level.alias("_wl_level")).where("_wl_level <= _wl_ratio").agg(F.min(F.struct("_wl_ratio", "_wl_key", "_wl_level")).alias("x")).first()["x"]
    full = F.col("_wl_cap").cast("double")
    target = F.least(full, F.lit(at["_wl_level"]) * F.col("_wl_weight")) if at else full
    return t.select("_wl_key", "_wl_total", target.alias("_wl_target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as found, from below first.

    Proportional shares of all but the last words, then one more of each length from the longest down, then more until no more
    than ``dp_words`` are open, then a bounded knapsack (counts split into powers of two, reachable sums as the bits of one
    integer) over the rest. Where one document more, or one alone that is longer than the budget, comes nearer, it is taken."""
    order = np.argsort(-lengths, kind="stable")
    size, left = lengths[order].astype(object), counts[order].astype(object)
    total = int((size * left).sum()) if len(size) else 0
    take = np.array([0] * len(size), dtype=object)
    if total <= 0 or budget <= 0:
        return np.zeros(len(lengths), dtype=np.int64)
    for i in range(len(size)):
        take[i] = left[i] * (budget - min(budget, dp_words // 2)) // total if size[i] else 0
    left = left - take
    open_ = budget - int((size * take).sum())
    for most in (1, None):
        for i in range(len(size)):
            if open_ <= dp_words:
                break
            if size[i] and left[i]:
                n = min(left[i], (open_ - (dp_words // 2 if most else 0)) // size[i], most or left[i])
                if n > 0:
                    take[i], left[i], open_ = take[i] + n, left[i] - n, open_ - n * size[i]
    mask, reach, steps = (1 << (min(open_, dp_words) + 1)) - 1, 1, []
    for i in range(len(size)):
        if not size[i] or size[i] > open_:
            continue
        n, part = min(left[i], open_ // size[i]), 1
        while n > 0:
            part = min(part, n)
            steps.append((i, part, reach))
            reach |= (reach << (part * size[i])) & mask
            n, part = n - part, part * 2
        if reach >> min(open_, dp_words) & 1:
            break
    at = reach.bit_length() - 1
    open_ -= at
    for i, part, was in reversed(steps):
        if not was >> at & 1:
            take[i], left[i], at = take[i] + part, left[i] - part, at - part * size[i]
    over = [i for i in range(len(size)) if left[i] and size[i] and size[i] < 2 * open_]
    if over:
        i = min(over, key=lambda x: abs(size[x] - open_))
        take[i], open_ = take[i] + 1, open_ - size[i]
    longer = [i for i in range(len(size)) if counts[order[i]] and 0 <= size[i] - budget < abs(open_)]
    if longer:
        take[:] = 0
        take[longer[-1]] = 1
    out = np.zeros(len(lengths), dtype=np.int64)
    out[order] = take.astype(np.int64)
    return out


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    total, target = int(pdf["_wl_total"].iloc[0]), float(pdf["_wl_target"].iloc[0])
    whole = int(target // total) if total else 0
    if whole * total > target:  # pragma: no cover - float division
        whole -= 1
    pdf = pdf.sort_values("_wl_size")
    more = fit_budget(pdf["_wl_size"].to_numpy(), pdf["_wl_n"].to_numpy(), round(target) - whole * total)
    return pd.DataFrame({"_wl_key": pdf["_wl_key"], "_wl_size": pdf["_wl_size"], "_wl_total": total, "_wl_target": target, "_wl_whole": whole, "_wl_more": more})


def _mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` plus _wl_size, _wl_total, _wl_target and _wl_copies, among other internal columns."""
    size = F.col(size_col).cast("long") if size_col else n_words(text_of(text_col))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    base = docs.withColumns({"_wl_size": size, "_wl_key": key, "_wl_hash": F.xxhash64(F.lit(seed), F.col(id_col))})
    base = base.withColumn("_wl_bucket", F.pmod("_wl_hash", F.lit(BUCKETS)))
    counted = materialize(base.groupBy("_wl_key", F.col(source_col).alias("_wl_order"), "_wl_size", "_wl_bucket").agg(F.count(F.lit(1)).alias("_wl_n")), "mix-counts")
    lengths = counted.groupBy("_wl_key", "_wl_order", "_wl_size").agg(F.sum("_wl_n").alias("_wl_n"))
    sources = materialize(lengths.groupBy("_wl_key", "_wl_order").agg(F.sum(F.col("_wl_size") * F.col("_wl_n")).alias("_wl_total")), "mix-totals")
    n_sources = sources.count()
    with_target = lengths.select("_wl_key", "_wl_size", "_wl_n").join(small(source_targets(sources, n_sources, weights, cap), n_sources), "_wl_key")
    schema = "_wl_key string, _wl_size long, _wl_total long, _wl_target double, _wl_whole long, _wl_more long"
    fitted = materialize(with_target.groupBy("_wl_key").applyInPandas(_fit, schema), "mix-fit")
    running = Window.partitionBy("_wl_key", "_wl_size").orderBy("_wl_bucket")
    before = F.sum("_wl_n").over(running) - F.col("_wl_n")
    quota = (
        counted.select("_wl_key", "_wl_size", "_wl_bucket", "_wl_n").withColumn("_wl_before", before)
        .join(small(fitted, fitted.count()), ["_wl_key", "_wl_size"])
        .withColumn("_wl_quota", F.greatest(F.lit(0), F.least(F.col("_wl_n"), F.col("_wl_more") - F.col("_wl_before"))))
        .select("_wl_key", "_wl_size", "_wl_bucket", "_wl_total", "_wl_target", "_wl_whole", "_wl_quota")
    )
    rank = F.row_number().over(Window.partitionBy("_wl_key", "_wl_size", "_wl_bucket").orderBy("_wl_hash", id_col))
    copies = F.col("_wl_whole") + F.when(F.col("_wl_rank") <= F.col("_wl_quota"), 1).otherwise(0)
    ranked = base.withColumn("_wl_rank", rank).join(quota, ["_wl_key", "_wl_size", "_wl_bucket"])
    return ranked.withColumn("_wl_copies", F.when(F.col("_wl_size") > 0, copies).otherwise(F.lit(0)).cast("long"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """All rows of ``docs`` plus size, source_size, target, copies (how often the mix takes the document) and taken (copies * size).

    ``id_col``, ``text_col`` and ``source_col`` name the columns; ``size_col`` one that already has the sizes; ``weights`` repeat
    over the sources in order; no document is taken more than ``cap`` times; ``seed`` orders documents of one length."""
    new = {"size": F.col("_wl_size"), "source_size": F.col("_wl_total"), "target": F.col("_wl_target"), "copies": F.col("_wl_copies"), "taken": F.col("_wl_copies") * F.col("_wl_size")}
    return _mixed(docs, **how).select(*named([c for c in docs.columns if c.lower() not in new]), *[v.alias(k) for k, v in new.items()])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, weights 1, 2, 3, repeating."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", n_words(text_of("text")).alias("n_words")), "mix-sizes")
    return mix_sources(sized, size_col="n_words").select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, all its columns as they were."""
    taken = _mixed(docs).where("_wl_copies > 0").withColumn("_wl_copy", F.explode(F.sequence(F.lit(1), F.col("_wl_copies"))))
    return taken.select(*named(docs.columns))
