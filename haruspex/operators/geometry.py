"""Filters by place, joins by distance, and ordered set operations on ids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haruspex.operators.settle import settled
from haruspex.operators.stats import rounded

#: Centres up to which distances are one expression; more of them are joined by grid cells.
MAX_CENTERS = 64


def distance2(xs: list[str], center) -> Column:
    return sum((F.pow(F.col(x) - F.lit(float(c)), F.lit(2.0)) for x, c in zip(xs, center)), F.lit(0.0))


def annulus(df: DataFrame, xs: list[str], inner: float, outer: float) -> tuple[DataFrame, DataFrame]:
    """Rows strictly between two radii, and the others; a box that the outer ball fits in reaches the scan."""
    r = F.sqrt(distance2(xs, [0.0] * len(xs)))
    inside = (r > inner) & (r < outer)
    boxed = df
    for x in xs:
        boxed = boxed.where((F.col(x) > -outer) & (F.col(x) < outer))
    return boxed.where(inside), df.where(~inside)


def ellipsoid(df: DataFrame, xs: list[str], center, radii, rotation=None) -> DataFrame:
    """Rows strictly inside an ellipsoid; ``rotation`` turns coordinates about the centre first."""
    d = [F.col(x) - float(c) for x, c in zip(xs, center)]
    if rotation is not None:
        d = [sum((float(m) * v for m, v in zip(row, d)), F.lit(0.0)) for row in rotation]
    return df.where(sum((F.pow(v / float(r), F.lit(2.0)) for v, r in zip(d, radii)), F.lit(0.0)) < 1)


def box(df: DataFrame, xs: list[str], low, high, inclusive: bool = False) -> DataFrame:
    """Rows of an axis-aligned box; comparisons that a Parquet scan can use."""
    out = df
    for x, a, b in zip(xs, low, high):
        out = out.where(F.col(x).between(float(a), float(b)) if inclusive else (F.col(x) > float(a)) & (F.col(x) < float(b)))
    return out


def within_day(minute: Column, start: int, end: int) -> Column:
    """Minutes of a day from start to end, which may wrap around midnight."""
    return minute.between(start, end) if start <= end else (minute >= start) | (minute <= end)


def min_distance(df: DataFrame, xs: list[str], centers: list) -> DataFrame:
    """``df`` with ``min_dist`` to the nearest of a few centres, as one expression.

    The coordinates are put in one struct, so a coordinate that is itself a long
    expression is neither generated nor computed for each centre anew.
    """
    if len(centers) > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centres: use near_join")
    point = F.struct(*[F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)])

    def nearest(p: Column) -> Column:
        d = [F.sqrt(sum((F.pow(p[f"x{k}"] - F.lit(float(v)), F.lit(2.0)) for k, v in enumerate(c)), F.lit(0.0))) for c in centers]
        return F.least(*d) if len(d) > 1 else d[0]

    return df.withColumn("min_dist", F.get(F.transform(F.array(point), nearest), F.lit(0)))


def ball(df: DataFrame, xs: list[str], centers: list, radius: float, strict: bool = False) -> DataFrame:
    """Rows within ``radius`` of any centre, with their distance; a bounding box goes first."""
    boxed = df
    for k, x in enumerate(xs):
        boxed = boxed.where(F.col(x).between(min(c[k] for c in centers) - radius, max(c[k] for c in centers) + radius))
    near = min_distance(boxed, xs, centers)
    return near.where(F.col("min_dist") < radius if strict else F.col("min_dist") <= radius)


#: Points, and centres, of a cell that are compared in one block, and the comparisons wished for a task.
CELL_ROWS, TASK_PAIRS = 2048, 1 << 25


def near_join(points: DataFrame, centers: DataFrame, xs: list[str], radius: float, id_col: str, center_id: str) -> DataFrame:
    """``id, center, dist`` of all pairs within ``radius``: an equi-join on grid cells of that width.

    A centre is copied to the 3^d cells around its own, so no cross product is made.  A cell of many
    rows is cut in blocks of CELL_ROWS points by CELL_ROWS centres, and tasks are dealt by comparisons:
    few bytes may hold many of them.
    """
    cells = [f"__c{k}" for k in range(len(xs))]
    cell = [F.floor(F.col(x) / radius).cast("long") for x in xs]
    a = points.select(F.col(id_col), *[F.col(x).alias(f"__p{k}") for k, x in enumerate(xs)], *[c.alias(n) for c, n in zip(cell, cells)])
    shifts = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s{k}") for k, s in enumerate(t)]) for t in product((-1, 0, 1), repeat=len(xs))])
    b = centers.select(F.col(center_id), *[F.col(x).alias(f"__q{k}") for k, x in enumerate(xs)], *[c.alias(f"__o{k}") for k, c in enumerate(cell)]).withColumn("__s", F.explode(shifts))
    b = b.select(center_id, *[f"__q{k}" for k in range(len(xs))], *[(F.col(f"__o{k}") + F.col(f"__s.s{k}")).alias(n) for k, n in enumerate(cells)])
    met = a.groupBy(*cells).agg(F.count(F.lit(1)).alias("__n")).join(b.groupBy(*cells).agg(F.count(F.lit(1)).alias("__m")), cells)
    met = settled(met.withColumn("__pb", F.ceil(F.col("__n") / CELL_ROWS)).withColumn("__qb", F.ceil(F.col("__m") / CELL_ROWS)))
    pairs = met.agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0.0
    # cells with more rows than a block: at most one for each CELL_ROWS rows of either side
    big = F.broadcast(met.where("__pb > 1 OR __qb > 1").select(*cells, "__pb", "__qb"))
    mine = lambda key, n: F.pmod(F.xxhash64(F.col(key)), F.coalesce(F.col(n), F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)) - 1))
    a = a.join(big, cells, "left").withColumn("__u", mine(id_col, "__pb")).withColumn("__v", every("__qb")).drop("__pb", "__qb")
    b = b.join(big, cells, "left").withColumn("__v", mine(center_id, "__qb")).withColumn("__u", every("__pb")).drop("__pb", "__qb")
    keys, tasks = [*cells, "__u", "__v"], int(min(1 << 16, max(1, -(-pairs // TASK_PAIRS))))
    if tasks > 1:
        a, b = a.repartition(tasks, *keys), b.repartition(tasks, *keys)
    d2 = sum((F.pow(F.col(f"__p{k}") - F.col(f"__q{k}"), F.lit(2.0)) for k in range(len(xs))), F.lit(0.0))
    return a.join(b, keys).withColumn("dist", F.sqrt(d2)).where(F.col("dist") <= radius).select(id_col, center_id, "dist")


def nearest_k(df: DataFrame, xs: list[str], centers: list, k: int, id_col: str) -> DataFrame:
    """The k rows nearest to any centre, by distance and id."""
    return min_distance(df, xs, centers).orderBy("min_dist", id_col).limit(k)


def neighbourhood(df: DataFrame, xs: list[str], centers: list, radius: float, id_col: str, *, least: int = 0, fallback: str = "skip", grow: float = 2.0, tries: int = 8) -> tuple[DataFrame, float, str | None]:
    """Rows near centres, with the fallbacks ``expand``, ``global``, ``legacy_nearest`` and ``skip``.

    Counts within every radius of the growing series come from one aggregate.
    """
    near = min_distance(df, xs, centers)
    radii = [radius * grow**k for k in range(tries + 1)]
    found = near.agg(*[F.sum((F.col("min_dist") <= r).cast("long")) for r in radii], F.count(F.lit(1))).first()
    counts = [int(c or 0) for c in found]
    if counts[0] >= least:
        return near.where(F.col("min_dist") <= radius), radius, None
    if fallback == "expand":
        k = next((k for k in range(1, tries + 1) if counts[k] >= least), tries)
        return near.where(F.col("min_dist") <= radii[k]), radii[k], fallback
    if fallback in ("global", "legacy_nearest"):
        n = min(counts[-1], least if fallback == "global" else max(100, least))
        if n < least:
            raise ValueError("DoI minimum size could not be met")
        return near.orderBy("min_dist", id_col).limit(n), radius, fallback
    if fallback == "skip":
        return near.where(F.col("min_dist") <= radius), radius, None
    raise ValueError("DoI minimum size could not be met")


def unevaluated(candidates: DataFrame, observations: DataFrame, key: str = "global_id") -> DataFrame:
    return candidates.join(observations.select(key), key, "left_anti")


def ordered_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, pos``: distinct ids of both, those of ``a`` first; each side has ``key, pos``."""
    both = a.select(key, F.lit(0).alias("__s"), "pos").unionByName(b.select(key, F.lit(1).alias("__s"), "pos"))
    return both.groupBy(key).agg(F.min(F.struct("__s", "pos")).alias("o")).select(key, F.col("o.__s").alias("side"), F.col("o.pos").alias("pos"))


def strict_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of ids that mustn't overlap."""
    if a.join(b.select(key), key, "left_semi").limit(1).count():
        raise ValueError("the sets overlap")
    return a.select(key).unionByName(b.select(key))


def ordered_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti").groupBy(key).agg(F.min("pos").alias("pos"))


def ordered_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi").groupBy(key).agg(F.min("pos").alias("pos"))


def complement_check(universe: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids missing from both, in both, and outside the universe; all 0 if a and b part it."""
    tags = universe.select(key, F.lit(1).alias("u"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    tags = tags.unionByName(a.select(key, F.lit(0).alias("u"), F.lit(1).alias("a"), F.lit(0).alias("b"))).unionByName(b.select(key, F.lit(0).alias("u"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    one = tags.groupBy(key).agg(F.max("u").alias("u"), F.max("a").alias("a"), F.max("b").alias("b"))
    return one.agg(
        F.sum(F.when((F.col("u") == 1) & (F.col("a") + F.col("b") == 0), 1).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("a") + F.col("b") == 2, 1).otherwise(0)).alias("overlap"),
        F.sum(F.when((F.col("u") == 0) & (F.col("a") + F.col("b") > 0), 1).otherwise(0)).alias("outside"),
    )


def common_points(a: DataFrame, b: DataFrame, xs: list[str], decimals: int = 8) -> DataFrame:
    """Rows of ``a`` whose rounded coordinates all occur as one row of ``b``."""
    keys = lambda df: [rounded(x, decimals).alias(f"__k{i}") for i, x in enumerate(xs)]
    return a.select("*", *keys(a)).join(b.select(*keys(b)).distinct(), [f"__k{i}" for i in range(len(xs))], "left_semi").drop(*[f"__k{i}" for i in range(len(xs))])


def duplicate_points(df: DataFrame, xs: list[str], decimals: int = 8) -> DataFrame:
    """Groups of rows with the same rounded coordinates: the coordinates and how many."""
    return df.groupBy(*[rounded(x, decimals).alias(x) for x in xs]).count().where("count > 1")


def coef_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest, absolute and Euclidean difference of two coefficient tables ``degree, coefficient`` over either's terms."""
    both = a.select("degree", F.col("coefficient").alias("ca")).join(b.select("degree", F.col("coefficient").alias("cb")), "degree", "full_outer")
    d = F.coalesce("ca", F.lit(0.0)) - F.coalesce("cb", F.lit(0.0))
    return both.agg(F.max(F.abs(d)).alias("linf"), F.sum(F.abs(d)).alias("l1"), F.sqrt(F.sum(d * d)).alias("l2"))


def seed_cross(samples: DataFrame, seeds: list[int]) -> DataFrame:
    """Each sample with each of a few short-term seeds, as an array: no join."""
    return samples.withColumn("seed_id", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
