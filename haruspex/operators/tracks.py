"""Windows over long series: one series may hold most of the rows.

Rows get a rank in the order of series and time by one range partitioning.  Blocks of
consecutive ranks, with as many rows of the neighbouring blocks as a window reaches,
are then windows of a bounded size, whatever series they cut.  What reaches further
than that is carried from block to block by a small table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.operators.settle import ordered

#: Rows of a block.
BLOCK = 1 << 16
#: Rows over which what lies beyond a block's edge may work on a spline in it.  A row's equation
#: weighs its neighbours half of itself at most, so this leaves 2 ** -HALO of it: nothing in a double.
HALO = 64


def blocked(df: DataFrame, by: list[str], order: list[str], before: int, after: int) -> DataFrame:
    """``df`` with ``__rank``, ``__block`` and ``__own``; each block has ``before`` and ``after`` more rows, which aren't its own.

    Equal keys may have any order, and don't share a range.
    """
    size = max(BLOCK, before, after)
    tie = df.withColumn("__t", F.monotonically_increasing_id())
    ranked = ordered(tie, [*by, *order, "__t"], "__rank").drop("__t").withColumn("__rank", F.col("__rank") - 1)
    block, at = F.expr(f"__rank div {size}"), F.col("__rank") % size
    copies = [F.struct(block.alias("b"), F.lit(True).alias("own"))]
    copies += [F.when(at >= size - before, F.struct((block + 1).alias("b"), F.lit(False).alias("own")))] if before else []
    copies += [F.when((at < after) & (block > 0), F.struct((block - 1).alias("b"), F.lit(False).alias("own")))] if after else []
    spread = ranked.withColumn("__c", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    return spread.select("*", F.col("__c.b").alias("__block"), F.col("__c.own").alias("__own")).drop("__c")


def moving(df: DataFrame, value: str, by: list[str], order: list[str], width: int) -> DataFrame:
    """Moving mean and variance over the last ``width`` rows of a series; its first ``width - 1`` rows are dropped."""
    frame = W.partitionBy("__block", *by).orderBy("__rank").rowsBetween(-(width - 1), 0)
    v = F.col(value)
    out = blocked(df, by, order, width - 1, 0)
    out = out.withColumns({"__k": F.count(F.lit(1)).over(frame), "mov_avg": F.avg(v).over(frame), "__sq": F.avg(v * v).over(frame)})
    out = out.where(F.col("__own") & (F.col("__k") == width))
    return out.withColumn("mov_var", F.col("__sq") - F.col("mov_avg") * F.col("mov_avg")).select(*df.columns, "mov_avg", "mov_var")


def up_crossings(df: DataFrame, value: str, t: str, by: list[str], level: float = 0.0, order: list[str] | None = None) -> DataFrame:
    """Crossings with rising slope for each series, and their rate over the complete cycles between first and last."""
    nxt = F.lead(value).over(W.partitionBy("__block", *by).orderBy("__rank"))
    near = blocked(df, by, order or [t], 0, 1).withColumn("__n", nxt).where("__own")
    hits = near.where(((F.col(value) - level) * (F.col("__n") - level) < 0) & (F.col("__n") > F.col(value)))
    span = F.max(t) - F.min(t)
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_up"), F.when(F.count(F.lit(1)) > 1, (F.count(F.lit(1)) - 1) / F.nullif(span, F.lit(0))).alias("rate"))


def tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Solves a[i] x[i - 1] + b[i] x[i] + c[i] x[i + 1] = d[i] by parallel cyclic reduction; rows must be dominated by their diagonal."""
    a, b, c, d = (np.array(x, float) for x in (a, b, c, d))
    n, step = len(b), 1
    if n:
        a[0] = c[-1] = 0.0
    while step < n and max(np.abs(a / b).max(), np.abs(c / b).max()) > 1e-20:
        down = lambda x, fill: np.concatenate([np.full(step, fill), x[:-step]])  # noqa: E731, B023
        up = lambda x, fill: np.concatenate([x[step:], np.full(step, fill)])  # noqa: E731, B023
        p, q = -a / down(b, 1.0), -c / up(b, 1.0)
        a, b, c, d = p * down(a, 0.0), b + p * down(c, 0.0) + q * up(a, 0.0), q * up(c, 0.0), d + p * down(d, 0.0) + q * up(d, 0.0)
        step *= 2
    return d / b


def _bent(times: np.ndarray, values: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Second derivatives of natural cubic splines through consecutive series."""
    n = len(times)
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = series[1:] != series[:-1]
    last[:-1] = first[1:]
    h = np.ones(n)
    h[1:] = np.where(first[1:], 1.0, np.diff(times))
    ahead = np.append(h[1:], 1.0)
    slope = np.zeros(n)
    slope[1:] = np.where(first[1:], 0.0, np.diff(values) / h[1:])
    inner = ~first & ~last
    total = np.where(inner, h + ahead, 1.0)
    a, c = np.where(inner, h / total, 0.0), np.where(inner, ahead / total, 0.0)
    d = np.where(inner, 6 * (np.append(slope[1:], 0.0) - slope) / total, 0.0)
    return tridiagonal(a, np.full(n, 2.0), c, d)


def splines(samples: DataFrame, t: str, value: str, by: list[str]) -> DataFrame:
    """``by..., t, value, bend``: the knots of each series's natural cubic spline with its second derivative there.

    Values at equal times are averaged first; rows without a time or value take no part.
    """
    knots = samples.where(F.col(t).isNotNull() & F.col(value).isNotNull()).groupBy(*by, F.col(t).cast("double").alias(t)).agg(F.avg(F.col(value).cast("double")).alias(value))
    near = blocked(knots, by, [t], HALO, HALO)
    near = near.withColumn("__s", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    schema = T.StructType([*knots.schema.fields, T.StructField("bend", T.DoubleType())])

    def bend(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("__rank")
        series = np.zeros(len(block), np.int64)
        for k in by:  # a change of any key begins a series
            codes = pd.factorize(block[k], use_na_sentinel=False)[0]
            series[1:] += np.cumsum(codes[1:] != codes[:-1])
        block["bend"] = _bent(block[t].to_numpy(), block[value].to_numpy(), series)
        return block.loc[block["__own"], schema.names]

    return near.drop("__s").groupBy("__block").applyInPandas(bend, schema)


def interpolate(grid: DataFrame, samples: DataFrame, t: str, value: str, by: list[str], kind: str = "linear") -> DataFrame:
    """Each series at grid times, ``linear`` or by a natural ``cubic`` spline; outside its range the nearest end's value.

    A grid time of a series without samples has no value.
    """
    if kind not in ("linear", "cubic"):
        raise ValueError(f"unknown kind {kind}")
    if kind == "cubic":
        knots = splines(samples, t, value, by).select(*by, t, F.col(value).alias("__v"), F.col("bend").alias("__m"))
    else:
        knots = samples.where(F.col(value).isNotNull()).select(*by, F.col(t).cast("double").alias(t), F.col(value).cast("double").alias("__v"), F.lit(0.0).alias("__m"))
    marks = knots.withColumn("__f", F.lit(0)).unionByName(grid.select(*by, F.col(t).cast("double").alias(t), F.lit(None).cast("double").alias("__v"), F.lit(None).cast("double").alias("__m"), F.lit(1).alias("__f")))
    rows = blocked(marks, by, [t, "__f"], 0, 0).withColumn("__p", F.when(F.col("__f") == 0, F.struct(F.col(t).alias("t"), "__v", "__m")))
    # the last sample before each block and the first behind it, by series: one row for each block and series
    names = [f"__g{i}" for i in range(len(by))]
    ends = rows.groupBy("__block", *by).agg(F.max_by("__p", F.when(F.col("__p").isNotNull(), F.col("__rank"))).alias("__z"), F.min_by("__p", F.when(F.col("__p").isNotNull(), F.col("__rank"))).alias("__y"))
    run = W.partitionBy(*by).orderBy("__block") if by else W.orderBy("__block")
    ends = ends.withColumns({"__back": F.last("__z", True).over(run.rowsBetween(W.unboundedPreceding, -1)), "__ahead": F.first("__y", True).over(run.rowsBetween(1, W.unboundedFollowing))})
    ends = ends.select(F.col("__block").alias("__e"), *[F.col(k).alias(n) for k, n in zip(by, names)], "__back", "__ahead")
    within = W.partitionBy("__block", *by).orderBy("__rank")
    out = rows.withColumns({"__a": F.last("__p", True).over(within.rowsBetween(W.unboundedPreceding, W.currentRow)), "__b": F.first("__p", True).over(within.rowsBetween(W.currentRow, W.unboundedFollowing))}).where("__f = 1")
    out = out.join(ends, [F.col("__block") == F.col("__e"), *[F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names)]])
    out = out.withColumns({"__a": F.coalesce("__a", "__back"), "__b": F.coalesce("__b", "__ahead")})
    h, x = F.col("__b.t") - F.col("__a.t"), F.col(t) - F.col("__a.t")
    slope = (F.col("__b.__v") - F.col("__a.__v")) / F.nullif(h, F.lit(0.0))
    # the chord, less what the bends take off
    bent = x * (h - x) * (F.col("__a.__m") * (2 * h - x) + F.col("__b.__m") * (h + x)) / (6 * F.nullif(h, F.lit(0.0)))
    inside = F.col("__a.__v") + F.coalesce(slope, F.lit(0.0)) * x - F.coalesce(bent, F.lit(0.0))
    return out.select(*by, t, F.when(F.col("__a").isNull(), F.col("__b.__v")).when(F.col("__b").isNull(), F.col("__a.__v")).otherwise(inside).alias(value))
