"""A training corpus from ``documents``: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept, which is written as Parquet and read again between stages.  All but the
last return the columns of ``documents``; the last adds shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from haruspex.llm.common import shared_folder
from haruspex.llm.decontaminate import decontaminate_stage
from haruspex.llm.jaccard import near_stage
from haruspex.llm.mixing import mix_stage
from haruspex.llm.rules import rules_stage
from haruspex.llm.sharding import shard_stage

STAGES = [
    ("quality rules", rules_stage),
    ("n-gram jaccard join", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mix_stage),
    ("sharding", shard_stage),
]

#: The stages train a model, tile greedily and hash: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
