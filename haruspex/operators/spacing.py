"""Closest pairs of points over grids, and space-filling designs chosen by them."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haruspex.operators import sampling
from haruspex.operators.settle import settled

#: Points of a cell up to which its pairs are compared; with more, the pigeonhole gives a smaller radius first.
CROWDED = 32


def _cells(xs: list[str], width: Column) -> list[Column]:
    return [F.floor(F.col(x) / width).cast("decimal(38,0)") for x in xs]


def _distance(a: str, b: str, d: int) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}.x{k}") - F.col(f"{b}.x{k}"), F.lit(2.0)) for k in range(d)), F.lit(0.0)))


def closest_pairs(df: DataFrame, xs: list[str], id_col: str, by: list[str] = ()) -> DataFrame:
    """``by..., a, b, dist``: of each group the two points that lie nearest to each other, a before b; ties by a, then b.

    The closest pair lies in neighbouring cells of a grid no finer than its distance.  A radius
    that it can't exceed comes from the box around the points; while a cell holds more than ``CROWDED`` points, two of
    them share a part of it, which gives a smaller one.  Each step is a count by cell; then
    neighbouring cells are joined.  Points that coincide are found by grouping.  Groups of one point have no row;
    rows with a null or non-finite coordinate take no part.  Groups should be few: a row each is broadcast.
    """
    d, keys = len(xs), list(by) or ["__all"]
    rows = df.select(*[F.col(k) if by else F.lit(0).alias(k) for k in keys], F.col(id_col).alias("__id"), *[F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)])
    for k in range(d):
        rows = rows.where(F.col(f"x{k}").isNotNull() & (F.abs(F.col(f"x{k}")) < float("inf")))
    names = [f"x{k}" for k in range(d)]
    rows = settled(rows)
    least = lambda pairs: pairs.groupBy(*keys).agg(F.min(F.struct("dist", "a", "b")).alias("m")).select(*keys, "m.a", "m.b", "m.dist")
    # points that coincide: the two smallest ids of each
    alike = rows.groupBy(*keys, *names).agg(F.min("__id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    second = rows.join(alike, [*keys, *names]).where(F.col("__id") > F.col("a")).groupBy(*keys, "a").agg(F.min("__id").alias("b"))
    same = least(second.withColumn("dist", F.lit(0.0)))
    rows = rows.join(F.broadcast(same.select(*keys)), keys, "left_anti")
    box = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{f.__name__}_{x}") for x in names for f in (F.min, F.max)])
    longest = F.greatest(*[F.col(f"max_{x}") - F.col(f"min_{x}") for x in names]) if d > 1 else F.col("max_x0") - F.col("min_x0")
    # n points in a cube: two share one of k ** d equal parts of it, k ** d being less than n
    parts = F.greatest(F.lit(1.0), F.ceil(F.pow(F.col("n").cast("double"), F.lit(1.0 / d))) - 1)
    radius = settled(box.where("n > 1").select(*keys, (longest * F.lit(d**0.5) / parts * (1 + 1e-9)).alias("__r")))
    for _ in range(200):
        counted = rows.join(F.broadcast(radius), keys).withColumns({f"c{k}": c for k, c in enumerate(_cells(names, F.col("__r")))})
        most = counted.groupBy(*keys, "__r", *[f"c{k}" for k in range(d)]).count().groupBy(*keys, "__r").agg(F.max("count").alias("m"))
        inner = F.ceil(F.pow(F.col("m").cast("double"), F.lit(1.0 / d))) - 1
        smaller = F.col("__r") * F.lit(d**0.5) / F.greatest(inner, F.lit(1.0)) * (1 + 1e-9)
        most = settled(most.select(*keys, F.least("__r", smaller).alias("__r"), ((F.col("m") > CROWDED) & (smaller < 0.99 * F.col("__r"))).alias("again")))
        radius = most.select(*keys, "__r")
        if not most.where("again").limit(1).count():
            break
    placed = rows.join(F.broadcast(radius), keys).withColumns({f"c{k}": c for k, c in enumerate(_cells(names, F.col("__r")))})
    point = F.struct("__id", *names).alias("p")
    left = placed.select(*keys, *[f"c{k}" for k in range(d)], point)
    # each pair of neighbouring cells once: a cell with itself and with those after it
    shifts = [s for s in product((-1, 0, 1), repeat=d) if s >= (0,) * d]
    moves = F.array(*[F.struct(*[F.lit(v).alias(f"s{k}") for k, v in enumerate(s)]) for s in shifts])
    right = placed.withColumn("__s", F.explode(moves)).select(*keys, *[(F.col(f"c{k}") - F.col(f"__s.s{k}")).cast("decimal(38,0)").alias(f"c{k}") for k in range(d)], point.alias("q"), reduce(lambda a, b: a & b, [F.col(f"__s.s{k}") == 0 for k in range(d)]).alias("own"))
    pairs = left.join(right, [*keys, *[f"c{k}" for k in range(d)]]).where(~F.col("own") | (F.col("p.__id") < F.col("q.__id")))
    pairs = pairs.select(*keys, F.least("p.__id", "q.__id").alias("a"), F.greatest("p.__id", "q.__id").alias("b"), _distance("p", "q", d).alias("dist"))
    return least(pairs).unionByName(same).select(*by, "a", "b", "dist")


def correlations(df: DataFrame, xs: list[str], by: list[str]) -> DataFrame:
    """``by..., corr``: the largest absolute correlation between two coordinates of each group."""
    pairs = [F.abs(F.corr(a, b)) for i, a in enumerate(xs) for b in xs[i + 1 :]]
    return df.groupBy(*by).agg((F.greatest(*pairs) if len(pairs) > 1 else pairs[0]).alias("corr"))


def best_hypercube(spark: SparkSession, d: int, n: int, designs: int, *, criterion: str = "maximin", center: bool = False, seed: int = 0) -> DataFrame:
    """The best of some Latin hypercubes ``global_id, xi_0, ...``: the furthest closest pair, or the least correlation; the first on ties.

    All designs are scored side by side, whatever their size.
    """
    if criterion not in ("maximin", "correlation"):
        raise ValueError(f"unknown criterion {criterion}")
    xs, every = [f"xi_{k}" for k in range(d)], None
    for k in range(designs):
        one = sampling.lhs(spark, d, n, seed + k, center=center).withColumn("design", F.lit(k))
        every = one if every is None else every.unionByName(one)
    every = settled(every)
    if criterion == "maximin":
        best = closest_pairs(every, xs, "global_id", ["design"]).orderBy(F.desc("dist"), "design").first()
    else:
        best = correlations(every, xs, ["design"]).orderBy("corr", "design").first()
    return every.where(F.col("design") == best["design"]).drop("design")
