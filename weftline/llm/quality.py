"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier over text statistics gives each document's evidence. It is trained on a bounded, hash-ordered sample of the
labelled documents (``train_rows``); everything else covers all documents. The sites that documents come from, a host and below it a
path, get posteriors: the mean of their documents' probabilities, shrunk towards the level above by a prior whose strength is found
from the data (method of moments over all hosts, over all paths), so a sparse path leans on its host and a sparse host on the
global rate. A document's final log odds are its evidence plus those of its path. Hosts and paths are grouped aggregates with partial
sums; nothing per document is shuffled.

Defined results: a null text is empty; its statistics are zeros and it is judged like any other; a null host or path is a site of
its own; repeated rows count and are kept or rejected alike; without labels of both kinds the evidence is zero and all is
kept; an empty table gives no rows; other columns pass through the stage untouched, internal names start with ``_wl_``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialize, named, small, table, text_of

#: At most this many labelled documents train the classifier.
TRAIN_ROWS = 20_000
REJECT_BELOW = 0.5
RIDGE = 1e-3
#: Bounds of the prior strength, in documents.
WEAKEST, STRONGEST = 5.0, 5000.0


def text_statistics(text: Column) -> list[Column]:
    """Shares of capitals, marks, exclamation, bars and digits; vocabulary richness and logarithms of the lengths."""
    chars = F.length(text)
    part = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1))
    words = F.filter(F.split(text, r"[\s.,;:!?]+"), lambda w: w != "")
    n = F.size(words)
    distinct = F.size(F.array_distinct(words))
    richness = F.log((distinct + 1.0) / (n + 1.0))
    return [
        part(r"\p{Lu}"), part(r"[#$%&*@^~=<>{}\[\]\\/_+]"), part("!"), part(r"\|"), part(r"\d"),
        richness, F.log(n + 1.0), richness / F.log(n + 3.0), F.log((chars + 1.0) / (n + 1.0)),
    ]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Weights, intercept first, by Newton's method on standardised columns."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(x))
    penalty[0] = 0
    for _ in range(steps):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    raw = w[1:] / std
    return np.concatenate([[w[0] - (raw * mean).sum()], raw])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", *, rows: int = TRAIN_ROWS, seed: int = 9) -> tuple[np.ndarray, float] | None:
    """Weights, and the rate of good documents among those trained on; None without labels of both kinds."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("_wl_y"))
    sample = marked.withColumn("_wl_h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("_wl_h", "doc_id").limit(rows).select("doc_id", "_wl_y")
    marks = F.struct(*[c.cast("double").alias(f"f{i}") for i, c in enumerate(text_statistics(text_of("text")))])
    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "_wl_y", marks.alias("f"))
    got = got.groupBy("doc_id", "_wl_y").agg(F.min("f").alias("f")).orderBy("doc_id").select("_wl_y", "f.*")  # of a document's rows one, the same in each run
    data = got.toPandas().to_numpy(dtype=np.float64)  # no more rows than the sample
    if not len(data) or data[:, 0].min() == data[:, 0].max():
        return None
    return fit_logistic(data[:, 1:], data[:, 0]), float(data[:, 0].mean())


def evidence(text: Column, weights: np.ndarray, rate: float) -> Column:
    """The document's own log odds, without those of the labelled sample."""
    total = F.lit(float(weights[0] - np.log(rate / (1 - rate))))
    for w, c in zip(weights[1:], text_statistics(text), strict=True):
        total = total + F.lit(float(w)) * c
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, total: str, n: str, above: Column) -> float:
    """Prior documents: the spread of site means beyond what chance gives sites of their sizes, by the method of moments."""
    mean = F.col(total) / F.col(n)
    r = sites.where(F.col(n) > 1).agg(F.sum((mean - above) ** 2 * F.col(n)).alias("v"), F.sum(F.col(n)).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(above * (1 - above) * F.col(n)).alias("b")).first()
    if not r["n"] or r["k"] < 2:
        return WEAKEST
    p = r["b"] / r["n"]
    between = max(0.0, (r["v"] - p * r["k"]) / r["n"])
    return float(min(STRONGEST, max(WEAKEST, p / between - 1 if between > 0 else STRONGEST)))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, int]:
    """One row for each (_wl_host, _wl_path) of ``scored`` (with _wl_p): host and path posteriors."""
    paths = materialize(scored.groupBy("_wl_host", "_wl_path").agg(F.sum("_wl_p").alias("pt"), F.count(F.lit(1)).alias("pn")), "quality-paths")
    hosts = paths.groupBy("_wl_host").agg(F.sum("pt").alias("ht"), F.sum("pn").alias("hn"))
    r = hosts.agg(F.sum("ht").alias("t"), F.sum("hn").alias("n"), F.count(F.lit(1)).alias("k")).first()
    rate = min(0.999, max(0.001, (r["t"] or 0.0) / r["n"])) if r["n"] else 0.5
    m = _strength(hosts, "ht", "hn", F.lit(rate))
    hosts = hosts.withColumn("host_posterior", (F.col("ht") + m * rate) / (F.col("hn") + m))
    both = paths.join(small(hosts, r["k"]), "_wl_host")
    m = _strength(both, "pt", "pn", F.col("host_posterior"))
    post = (F.col("pt") + m * F.col("host_posterior")) / (F.col("pn") + m)
    clip = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    return both.select("_wl_host", "_wl_path", clip(F.col("host_posterior")).alias("_wl_hp"), clip(post).alias("_wl_pp")), paths.count()


def classify(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", host: Column | None = None, path: Column | None = None, reject_below: float = REJECT_BELOW, train_rows: int = TRAIN_ROWS, carry: Sequence[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs``, all if None, plus _wl_evidence, _wl_hp, _wl_pp (host and path posteriors), _wl_score (probability
    of good) and _wl_keep. What is carried is written with its evidence once, so no text is measured twice."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = train(docs, labels, rows=train_rows)
    own = evidence(text_of(text_col), *model) if model else F.lit(0.0)
    prior = float(np.log(model[1] / (1 - model[1]))) if model else 0.0
    site = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    carried = named(docs.columns if carry is None else list(carry))
    rows = materialize(docs.select(*carried, own.alias("_wl_evidence"), site(host).alias("_wl_host"), site(path).alias("_wl_path")), "quality-evidence")
    sites, n = site_posteriors(rows.select("_wl_host", "_wl_path", (1 / (1 + F.exp(-(F.col("_wl_evidence") + prior)))).alias("_wl_p")))
    score = 1 / (1 + F.exp(-(F.col("_wl_evidence") + _logit(F.col("_wl_pp")))))
    out = rows.join(small(sites, n), ["_wl_host", "_wl_path"]).withColumn("_wl_score", score)
    return out.withColumn("_wl_keep", (F.col("_wl_score") >= reject_below) if model else F.lit(True))


def op9_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, posteriors, score and decision for every document."""
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.select("doc_id", F.col("_wl_evidence").alias("evidence"), F.col("_wl_hp").alias("host_posterior"), F.col("_wl_pp").alias("path_posterior"), F.col("_wl_score").alias("score"), F.col("_wl_keep").alias("keep"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    return classify(docs, table(spark, sf_dir, "labels")).where("_wl_keep").select(*named(docs.columns))
