"""Sampling as table functions: rows come from ids and counters, so partitions don't matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haruspex.functions import rng
from haruspex.functions.basis import Basis
from haruspex.functions.dist import Marginal, norm
from haruspex.operators.stats import ordered


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "global_id")


def monte_carlo(spark: SparkSession, marginals: list[Marginal], n: int, seed: int = 0) -> DataFrame:
    """Independent samples of the marginals."""
    i = F.col("global_id")
    return _ids(spark, n).select(i, *[m.ppf(rng.uniform(i, k, seed)).alias(f"xi_{k}") for k, m in enumerate(marginals)])


def christoffel(spark: SparkSession, kind: str, d: int, n: int, seed: int = 0) -> DataFrame:
    """Christoffel sampling: ``cls1`` arcsine product, ``cls2`` ball with cosine radius, ``cls4`` ball of radius sqrt 2.

    ``cls4`` takes a squared radius from Beta(d/2, d/2 + 1): for even d a ratio of
    sums of exponentials, for odd d also a squared normal.
    """
    i, u = F.col("global_id"), lambda k: rng.uniform(F.col("global_id"), k, seed)
    if kind == "cls1":
        return _ids(spark, n).select(i, *[F.cos(F.pi() * u(k)).alias(f"xi_{k}") for k in range(d)])
    if kind not in ("cls2", "cls4"):
        raise ValueError(f"unknown sampling {kind}")
    df = _ids(spark, n)
    for k in range(d):
        df = df.withColumn(f"z{k}", rng.normal(i, k, seed))
    length = F.sqrt(sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(d)), F.lit(0.0)))
    if kind == "cls2":
        radius = F.cos(F.pi() / 2 * u(d))
    else:
        a, b = _gamma_half(i, d, d + 1, seed), _gamma_half(i, d + 2, d + 1 + d // 2 + 2, seed)
        radius = F.sqrt(2 * a / (a + b))
    return df.withColumn("r", radius / length).select(i, *[(F.col(f"z{k}") * F.col("r")).alias(f"xi_{k}") for k in range(d)])


def _gamma_half(i: Column, twice_shape: int, dim: int, seed: int) -> Column:
    """Gamma variate of shape ``twice_shape`` / 2 as a sum of exponentials, and half a squared normal if it is odd."""
    out = sum((-F.log(rng.uniform(i, dim + k, seed)) for k in range(twice_shape // 2)), F.lit(0.0))
    if twice_shape % 2:
        z = rng.normal(i, dim + twice_shape // 2, seed)
        out = out + z * z / 2
    return out


def affine(df: DataFrame, xs: list[str], loc, scale) -> DataFrame:
    """Location and scale of each dimension; one number stands for all."""
    d = len(xs)
    loc, scale = (v if isinstance(v, (list, tuple)) else [v] * d for v in (loc, scale))
    loc, scale = (v * d if len(v) == 1 else v for v in (list(loc), list(scale)))
    if len(loc) != d or len(scale) != d:
        raise ValueError("location and scale need one value or one for each dimension")
    return df.withColumns({x: F.col(x) * float(s) + float(m) for x, m, s in zip(xs, loc, scale)})


def uniform_ball(spark: SparkSession, d: int, n: int, radius: float = 1.0, seed: int = 0) -> DataFrame:
    i, df = F.col("global_id"), _ids(spark, n)
    for k in range(d):
        df = df.withColumn(f"z{k}", rng.normal(i, k, seed))
    length = F.sqrt(sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(d)), F.lit(0.0)))
    r = F.pow(rng.uniform(i, d, seed), F.lit(1.0 / d)) * radius
    return df.withColumn("r", r / length).select(i, *[(F.col(f"z{k}") * F.col("r")).alias(f"xi_{k}") for k in range(d)])


def lhs(spark: SparkSession, d: int, n: int, seed: int = 0, center: bool = False) -> DataFrame:
    """Latin hypercube of any size: in each dimension, ranks of a hash are the strata."""
    i = F.col("global_id")
    out = _ids(spark, n)
    for k in range(d):
        keyed = out.withColumn("__h", F.xxhash64(i, F.lit(k), F.lit(seed)))
        ranked = ordered(keyed, ["__h", "global_id"], "__rank")
        inside = F.lit(0.5) if center else rng.uniform(i, 1000 + k, seed)
        out = ranked.withColumn(f"xi_{k}", (F.col("__rank") - 1 + inside) / float(n)).drop("__h", "__rank")
    return out


def lhs_small(d: int, n: int, criterion: str | None = None, iterations: int = 5, state: int | np.random.RandomState | None = None) -> np.ndarray:
    """Seeded Latin hypercube (n, d) on the driver; criteria center, maximin, centermaximin and correlation."""
    gen = state if isinstance(state, np.random.RandomState) else np.random.RandomState(state)
    name = {"c": "center", "m": "maximin", "cm": "centermaximin", "corr": "correlation"}.get((criterion or "").lower(), (criterion or "").lower())
    if name not in ("", "center", "maximin", "centermaximin", "correlation"):
        raise ValueError(f"unknown criterion {criterion}")

    def plain() -> np.ndarray:
        edges = np.linspace(0, 1, n + 1)
        u = gen.rand(n, d)
        inside = u * np.diff(edges)[:, None] + edges[:-1, None]
        return np.column_stack([inside[gen.permutation(n), k] for k in range(d)])

    def centred() -> np.ndarray:
        edges = np.linspace(0, 1, n + 1)
        mids = (edges[1:] + edges[:-1]) / 2
        return np.column_stack([gen.permutation(mids) for _ in range(d)])

    if name == "":
        return plain()
    if name == "center":
        return centred()
    best, top = None, -np.inf
    for _ in range(iterations):
        H = centred() if name == "centermaximin" else plain()
        if name == "correlation":
            R = np.corrcoef(H.T)
            value = -np.abs(R[~np.eye(len(R), dtype=bool)]).max()
        else:
            diff = H[:, None] - H[None]
            value = np.sqrt((diff**2).sum(-1))[np.triu_indices(n, 1)].min()
        if value > top:
            best, top = H, value
    return best


def lhs_marginals(spark: SparkSession, marginals: list[Marginal], n: int, seed: int = 0) -> DataFrame:
    df = lhs(spark, len(marginals), n, seed)
    return df.withColumns({f"xi_{k}": m.ppf(F.col(f"xi_{k}")) for k, m in enumerate(marginals)})


def quadrature(spark: SparkSession, basis: Basis, n: int, loc: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Tensor grid of the n-point rule: ``xi_k`` and ``w``, whose sum is 1; node indices are digits of the row's id."""
    x, w = basis.gauss_nodes(n)
    xs, ws = F.array(*[F.lit(float(v)) for v in x]), F.array(*[F.lit(float(v)) for v in w])
    i = F.col("global_id")
    digit = lambda k: F.pmod(F.floor(i / float(n**k)).cast("long"), F.lit(n)).cast("int")
    weight = F.lit(1.0)
    for k in range(basis.d):
        weight = weight * F.get(ws, digit(k))
    return _ids(spark, n**basis.d).select(i, *[(F.get(xs, digit(k)) * scale + loc).alias(f"xi_{k}") for k in range(basis.d)], weight.alias("w"))


def primitive_polynomials(count: int) -> list[tuple[int, int]]:
    """(degree, coefficients) of the first primitive polynomials over two elements, found by the order of x."""
    out: list[tuple[int, int]] = []
    degree = 1
    while len(out) < count:
        full = (1 << degree) - 1
        primes = [p for p in range(2, full + 1) if full % p == 0 and all(p % q for q in range(2, int(p**0.5) + 1))] if degree <= 8 else []
        for low in range(1, 1 << degree, 2):
            poly = 1 << degree | low

            def power(e: int, poly=poly, degree=degree) -> int:
                r, b = 1, 2 if degree > 1 else 2 ^ poly
                while e:
                    if e & 1:
                        r = _mul(r, b, poly, degree)
                    b = _mul(b, b, poly, degree)
                    e >>= 1
                return r

            if power(full) == 1 and all(power(full // p) != 1 for p in primes):
                out.append((degree, (poly >> 1) & ((1 << (degree - 1)) - 1)))
        degree += 1
    return out[:count]


def _mul(a: int, b: int, poly: int, degree: int) -> int:
    r = 0
    while b:
        if b & 1:
            r ^= a
        a <<= 1
        if a >> degree & 1:
            a ^= poly
        b >>= 1
    return r


def sobol_directions(d: int, bits: int = 30) -> list[list[int]]:
    """Direction numbers of each dimension; initial ones are 1, 3, 5, ... truncated to odd numbers that fit."""
    out = [[1 << (bits - 1 - k) for k in range(bits)]]
    for degree, coef in primitive_polynomials(d - 1):
        m = [(2 * k + 1) % (1 << (k + 1)) | 1 for k in range(degree)]
        for k in range(degree, bits):
            new = m[k - degree] ^ (m[k - degree] << degree)
            for j in range(1, degree):
                if coef >> (degree - 1 - j) & 1:
                    new ^= m[k - j] << j
            m.append(new)
        out.append([m[k] << (bits - 1 - k) for k in range(bits)])
    return out[:d]


def sobol(spark: SparkSession, d: int, n: int, skip: int = 0, bits: int = 30) -> DataFrame:
    """Digital sequence by Gray code, up to 40 dimensions; any row by itself, without the ones before."""
    if not 1 <= d <= 40:
        raise ValueError("1 to 40 dimensions")
    j = F.col("global_id") + skip
    df = _ids(spark, n).withColumn("__g", j.bitwiseXOR(F.shiftright(j, 1)))
    for k, v in enumerate(sobol_directions(d, bits)):
        acc = F.lit(0).cast("long")
        for b in range(bits):
            acc = acc.bitwiseXOR(F.when(F.col("__g").bitwiseAND(F.lit(1 << b)) != 0, F.lit(v[b]).cast("long")).otherwise(F.lit(0).cast("long")))
        df = df.withColumn(f"xi_{k}", acc / float(1 << bits))
    return df.drop("__g")


def bootstrap(df: DataFrame, value: str, repeats: int, seed: int = 0, id_col: str = "global_id") -> DataFrame:
    """``rep, n, mean``: Poisson(1) weights for each row and repeat, so nothing is joined or sorted.

    A row's weight is the quantile of its hash; sums are combined map-side.
    """
    cum = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])
    reps = df.select(F.col(id_col), F.col(value)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col("rep"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    w = sum(((u > float(c)).cast("int") for c in cum), F.lit(0))
    return reps.withColumn("w", w).groupBy("rep").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def with_noise(df: DataFrame, y: str, kind: str = "cov", scale: float = 0.1, seed: int = 0, id_col: str = "global_id") -> DataFrame:
    """Observation noise: ``null``, ``iid`` (fixed deviation) or ``cov`` (deviation relative to |y|)."""
    z = rng.normal(F.col(id_col), 9001, seed)
    add = {"null": F.lit(0.0), "iid": z * scale, "cov": F.abs(F.col(y)) * z * scale}[kind]
    return df.withColumn(y, F.col(y) + add)


def seed_table(spark: SparkSession, n: int, top: int = 1_000_000, seed: int = 100) -> DataFrame:
    """``idx, seed`` of short-term realisations."""
    return spark.createDataFrame([(k, int(s)) for k, s in enumerate(np.random.RandomState(seed).randint(0, top, n))], "idx int, seed long")


def contour(spark: SparkSession, chain, beta: float, n: int) -> DataFrame:
    """Environmental contour: the circle of radius ``beta`` in standard normal space, carried through a site's chain."""
    a = F.col("global_id") * (2 * np.pi / n)
    df = _ids(spark, n).select("global_id", (beta * F.cos(a)).alias("u_0"), (beta * F.sin(a)).alias("u_1"))
    for k, m in enumerate(chain[:2]):
        # a column for each step, or expressions would nest
        df = df.withColumn(f"p_{k}", norm().cdf(F.col(f"u_{k}")))
        df = df.withColumn(f"x_{k}", m([F.col(f"x_{j}") for j in range(k)]).ppf(F.col(f"p_{k}")))
    return df.drop("p_0", "p_1")


def sea_states(spark: SparkSession, chain, n: int, seed: int = 0) -> DataFrame:
    """Joint samples of a site's chain, each variable given those before."""
    df = _ids(spark, n)
    for k, m in enumerate(chain):
        df = df.withColumn("__u", rng.uniform(F.col("global_id"), k, seed))
        df = df.withColumn(f"x_{k}", m([F.col(f"x_{j}") for j in range(k)]).ppf(F.col("__u")))
    return df.drop("__u")


def random_subset(df: DataFrame, k: int, exclude: DataFrame | None = None, seed: int = 0, id_col: str = "global_id") -> DataFrame:
    """k rows without replacement, apart from excluded ids: the first in hash order."""
    left = df if exclude is None else df.join(exclude.select(id_col), id_col, "left_anti")
    return left.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(k)
