"""Exact order statistics of many groups at once, without sorting rows.

A double's bits, read as a whole number with the sign turned over, are in the
double's order.  Each of four passes counts the rows of the groups by sixteen
further bits, as partial sums; the counts tell in which bucket a rank lies, and the
next pass reads the rows of such buckets alone.  So a group of any size sends
65,536 counts from a task at most, and equal values are one count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.operators.settle import settled

DIGIT = 16
#: Open buckets up to which they are sent to every executor; more are joined by a shuffle.
FEW = 100_000
_TOP = np.int64(np.iinfo(np.int64).min)


def to_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers that, read without a sign, are in the order of the doubles; zeros are one, and NaN is above all."""
    x = np.where(np.isnan(x), np.nan, x) + 0.0
    b = x.view(np.int64)
    return np.where(b < 0, ~b, b ^ _TOP)


def from_bits(u: np.ndarray) -> np.ndarray:
    return np.where(u < 0, u ^ _TOP, ~u).view(np.float64)


def _least(u: np.ndarray) -> np.ndarray:
    """The least number of a bucket that begins with these bits; below all numbers it is the negative infinity."""
    x = from_bits(u)
    return np.where(np.isnan(x) & (u >= 0), -np.inf, x)


def _coded(df: DataFrame, columns: list[str], source: str, target: str, made, kind) -> DataFrame:
    """``df``'s columns, and ``target`` made of ``source`` in Arrow batches."""
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField(target, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(len(columns)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(made(x))], names=schema.names)

    return df.select(*columns, F.col(source).alias("__source")).mapInArrow(run, schema)


def order_statistics(df: DataFrame, value: str, ranks: list[Column], by: list[str] = ()) -> DataFrame:
    """``by..., n, v0, v1, ...``: of each group, its rows with a value and the values at the given ranks.

    ``ranks`` are expressions of ``n``, from 1 to ``n``.  Nulls take no part; NaN is above
    all; a group without values isn't there.  Null keys are a group.
    """
    keys = list(by) or ["__all"]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k) if by else F.lit(0).alias(k) for k in keys], F.col(value).cast("double").alias("__v"))
    places = [f"__k{j}" for j in range(len(ranks))]
    digit = lambda r: F.shiftrightunsigned("__b", 64 - DIGIT * (r + 1)).bitwiseAND((1 << DIGIT) - 1)
    prefix = lambda r: F.shiftrightunsigned("__b", 64 - DIGIT * r) if r else F.lit(0).cast("long")
    open_, sizes = None, None
    for r in range(64 // DIGIT):
        if r:
            marks = open_.select(*keys, "__p").distinct()
            ends = _coded(marks.withColumn("__l", F.shiftleft("__p", 64 - DIGIT * r)), [*keys, "__p", "__l"], "__l", "__low", _least, T.DoubleType())
            ends = _coded(ends.withColumn("__h", F.col("__l") + F.lit((1 << (64 - DIGIT * r)) - 1)), [*keys, "__p", "__low"], "__h", "__high", from_bits, T.DoubleType())
            ends = settled(ends)
            # a bucket of the numbers that aren't any is open above; names apart from the rows' own
            renamed = ends.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], "__p", "__low", F.when(F.isnan("__low"), F.lit(float("nan"))).otherwise(F.col("__high")).alias("__high"))
            met = [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]
            side = F.broadcast(renamed) if renamed.count() <= FEW else renamed
            near = rows.join(side, [*met, F.col("__v") >= F.col("__low"), F.col("__v") <= F.col("__high")], "left_semi")
        else:
            near = rows
        coded = _coded(near, keys, "__v", "__b", to_bits, T.LongType())
        counts = coded.groupBy(*keys, prefix(r).alias("__p"), digit(r).alias("__d")).agg(F.count(F.lit(1)).alias("__c"))
        if not r:
            counts = settled(counts)
            sizes = settled(counts.groupBy(*keys).agg(F.sum("__c").alias("n")))
            open_ = sizes.select(*keys, F.explode(F.array(*[F.struct(F.lit(j).alias("j"), k.cast("long").alias("k")) for j, k in enumerate(ranks)])).alias("__t"))
            open_ = open_.select(*keys, F.col("__t.j").alias("__j"), F.col("__t.k").alias("__k"), F.lit(0).cast("long").alias("__p"))
        run = W.partitionBy(*keys, "__p").orderBy("__d")
        # 65,536 buckets of a key at most
        counts = counts.withColumn("__upto", F.sum("__c").over(run.rowsBetween(W.unboundedPreceding, W.currentRow)))
        named = counts.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), "__d", "__upto", (F.col("__upto") - F.col("__c")).alias("__before"))
        met = [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)] + [F.col("__p") == F.col("__q"), F.col("__k") > F.col("__before"), F.col("__k") <= F.col("__upto")]
        open_ = open_.join(named, met).select(*keys, "__j", (F.col("__k") - F.col("__before")).alias("__k"), F.shiftleft("__p", DIGIT).bitwiseOR(F.col("__d")).alias("__p"))
        open_ = settled(open_)
    found = _coded(open_, [*keys, "__j"], "__p", "__x", from_bits, T.DoubleType())
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("__j") == j, F.col("__x"))).alias(f"v{j}") for j in range(len(places))])
    renamed = sizes.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], "n")
    out = wide.join(renamed, [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)])
    return out.select(*by, "n", *[f"v{j}" for j in range(len(places))])


def medians(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """``by..., n, median``, the mean of the two middle values where their number is even."""
    n = F.col("n")
    both = order_statistics(df, value, [F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")], by)
    return both.select(*by, n, ((F.col("v0") + F.col("v1")) / 2).alias("median"))
