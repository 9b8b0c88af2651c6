"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.fuzzy_hash import op4_context_triggered_hashes
from weftline.llm.html_text import op2_tag_path_text
from weftline.llm.jaccard_join import ORACLE_OP8, op8_ngram_jaccard_join
from weftline.llm.media_chunks import op10_content_defined_chunks
from weftline.llm.mixing import op1_mix_sources
from weftline.llm.packing import op6_grouping_genetic_packing
from weftline.llm.quality import op9_empirical_bayes_quality
from weftline.llm.sharding import op3_kd_tree_shards
from weftline.llm.tool_calls import ORACLE_OP7, op7_tool_call_linking
from weftline.llm.url_filter import ORACLE_OP5, op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_tag_path_text,
        op3_kd_tree_shards,
        op4_context_triggered_hashes,
        op5_url_filter,
        op6_grouping_genetic_packing,
        op7_tool_call_linking,
        op8_ngram_jaccard_join,
        op9_empirical_bayes_quality,
        op10_content_defined_chunks,
    )
}

ORACLES: dict[str, str] = {"op5_url_filter": ORACLE_OP5, "op7_tool_call_linking": ORACLE_OP7, "op8_ngram_jaccard_join": ORACLE_OP8}
