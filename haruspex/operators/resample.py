"""Domains of interest by closeness to a level, and weighted samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haruspex.operators.geometry import MAX_CENTERS
from haruspex.operators.settle import settled


def hashed_uniform(key: Column, seed: int = 0) -> Column:
    """A number of (0, 1) from the first 32 bits of a key's MD5: the same in any engine that has one."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def weighted_sample(df: DataFrame, weight: Column, k: int, id_col: str, seed: int = 0) -> DataFrame:
    """``k`` rows without replacement, as if drawn one by one with chances proportional to ``weight``; with ``draw``, their exponential key.

    The rows with the smallest keys -ln(u) / weight.  A task keeps its ``k`` smallest, and those of
    tasks merge, so nothing is sorted as a whole; the same rows whatever the partitions.
    Rows without a positive weight are never drawn; fewer rows than ``k`` are all drawn.
    """
    key = -F.log(hashed_uniform(F.col(id_col), seed)) / weight
    return df.where(weight > 0).withColumn("draw", key).orderBy("draw", id_col).limit(k)


def nearest_to_level(df: DataFrame, value: str, level: float, n: int, id_col: str) -> DataFrame:
    """The n rows whose value is nearest to ``level``, by id on ties."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).orderBy(F.abs(F.col(value) - level), id_col).limit(n)


def level_domain(data: DataFrame, candidates: DataFrame, xs: list[str], value: str, level: float, id_col: str, *, n: int = 10, radius: float = 0.1, least: int = 100) -> DataFrame:
    """Candidates nearer than ``radius`` to one of the ``n`` data points whose value is nearest to ``level``; with ``min_dist``.

    A point that has no candidate that near brings its ``least`` nearest ones instead.
    """
    if n > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} points")
    centers = [tuple(r) for r in nearest_to_level(data, value, level, n, id_col).select(*[F.col(x).cast("double") for x in xs]).collect()]
    if not centers:
        return candidates.withColumn("min_dist", F.lit(None).cast("double")).where(F.lit(False))
    # each distance once, as a column of its own
    away = [F.sqrt(sum((F.pow(F.col(x) - float(v), F.lit(2.0)) for x, v in zip(xs, c)), F.lit(0.0))) for c in centers]
    made = settled(candidates.withColumn("__d", F.array(*away)).withColumn("min_dist", F.array_min("__d")))
    counts = made.agg(*[F.count(F.when(F.col("__d")[k] < radius, 1)) for k in range(len(centers))]).first()
    out = made.where(F.col("min_dist") < radius)
    lonely = [k for k, c in enumerate(counts) if not c]
    for k in lonely:
        out = out.unionByName(made.orderBy(F.col("__d")[k], id_col).limit(least))
    return (out.dropDuplicates([id_col]) if lonely else out).drop("__d")


def domain_sample(data: DataFrame, candidates: DataFrame, xs: list[str], value: str, level: float, id_col: str, k: int, *, n: int = 10, radius: float = 0.1, least: int = 100, seed: int = 0) -> DataFrame:
    """``k`` candidates of the level's domain, the nearer the likelier: weights fall off with the square of the distance in radii."""
    near = level_domain(data, candidates, xs, value, level, id_col, n=n, radius=radius, least=least)
    return weighted_sample(near, 1 / (1 + F.pow(F.col("min_dist") / radius, F.lit(2.0))), k, id_col, seed)
