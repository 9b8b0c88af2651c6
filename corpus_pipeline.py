"""The corpus pipeline: quality classifier, n-gram Jaccard join, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet into the shared folder and read again as the next stage's
documents. All stages but the last return the columns of documents; the last returns where each piece was packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import materialize, table
from weftline.llm.jaccard_join import jaccard_stage
from weftline.llm.mixing import mixing_stage
from weftline.llm.packing import packing_stage
from weftline.llm.quality import quality_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: A trained classifier, MinHash signatures and a genetic algorithm are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
