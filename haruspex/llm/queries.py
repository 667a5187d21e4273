"""The subpackage's queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haruspex.llm import chat, divergence, jaccard, negatives, substrings
from haruspex.llm.bpe import op11_bpe
from haruspex.llm.chat import op5_chat_format
from haruspex.llm.compression import op3_compression_score
from haruspex.llm.decontaminate import op2_decontaminate
from haruspex.llm.divergence import op12_source_divergence
from haruspex.llm.jaccard import op8_near_components
from haruspex.llm.licenses import op7_license_scan
from haruspex.llm.mixing import op1_pareto_mix
from haruspex.llm.negatives import op13_hard_negatives
from haruspex.llm.rules import op9_quality_rules
from haruspex.llm.secrets import op10_secret_scan
from haruspex.llm.sharding import op4_shard
from haruspex.llm.substrings import op6_remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pareto_mix,
        op2_decontaminate,
        op3_compression_score,
        op4_shard,
        op5_chat_format,
        op6_remove_repeats,
        op7_license_scan,
        op8_near_components,
        op9_quality_rules,
        op10_secret_scan,
        op11_bpe,
        op12_source_divergence,
        op13_hard_negatives,
    )
}
SQL: dict[str, str] = {"op5_chat_format": chat.SQL, "op6_remove_repeats": substrings.SQL, "op8_near_components": jaccard.SQL, "op12_source_divergence": divergence.SQL, "op13_hard_negatives": negatives.SQL}
