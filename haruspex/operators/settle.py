"""Tables that are computed once, and ranks in a global order."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share; only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="checkpoint-")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor changes nothing in it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ordered(df: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """``df`` with its 1-based rank in a global order, without gathering it in one task.

    Rows are range-partitioned by the keys and sorted inside their partition; a
    row's place there (the low bits of its monotonic id) and the counts of the
    partitions before it make up its rank, so there is one exchange.  Keys should
    end in a unique column, or equal ones share a partition.  Nulls come last.
    """
    by = [F.col(k).asc_nulls_last() for k in keys]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    ranged = settled(ranged)
    part, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    rows, before = [], 0
    for r in sorted(ranged.groupBy(part.alias("p")).count().collect()):
        rows.append((r[0], before))
        before += r[1]
    # one row for each partition
    starts = df.sparkSession.createDataFrame(rows or [(0, 0)], "__q int, __before long")
    out = ranged.join(F.broadcast(starts), part == F.col("__q"))
    return out.withColumn(rank, F.col("__before") + place).drop("__at", "__q", "__before")
