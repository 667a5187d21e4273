"""Queries over the numerical operators whose results have a closed form, with that form as SQL.

The catalogue imports this module, which registers its queries there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from haruspex.functions import dist
from haruspex.functions.basis import Basis
from haruspex.functions.special import normal_cdf
from haruspex.operators import design, geometry, linalg, sampling, series, stats, surrogate
from haruspex.plans.catalogue import _points, _points_sql, _query, _r, _rs, _t

_XY = f"(SELECT *, 1 + global_id % 8 AS wt, 2 + 3 * xi_0 - xi_1 * xi_1 AS y FROM {_points_sql(2)})"


def _xy(spark, sf_dir):
    """Uniform points with a whole-number weight and a response."""
    return _points(spark, sf_dir, 2).withColumn("wt", 1 + F.col("global_id") % 8).withColumn("y", 2 + 3 * F.col("xi_0") - F.col("xi_1") * F.col("xi_1"))


def _once(cols, f):
    """``f`` of the columns, each computed once: a lambda's argument isn't inlined where ``f`` uses it again."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(f"v{k}") for k, c in enumerate(cols)])), lambda p: f([p[f"v{k}"] for k in range(len(cols))])), F.lit(0))


# -- designs


@_query("SELECT CAST(d AS INT) AS d, round((k + 0.5e0) / 400, 8) AS x FROM range(3) a(d), range(400) b(k)")
def q_lhs_centred(spark, sf_dir):
    """A centred Latin hypercube holds the middle of every stratum once in each dimension."""
    s = sampling.lhs(spark, 3, 400, 5, center=True)
    return s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("d"), stats.rounded(f"xi_{k}", 8).alias("x")) for k in range(3)])).alias("s")).select("s.d", "s.x")


@_query("SELECT CAST(k AS BIGINT) AS stratum, CAST(1 AS BIGINT) AS n_uniform, CAST(1 AS BIGINT) AS n_gumbel FROM range(300) r(k)")
def q_lhs_marginals(spark, sf_dir):
    """Latin hypercube through marginals: their probabilities fall once in every stratum."""
    ms = [dist.uniform(-2, 5), dist.Marginal("gumbel", (1.0, 3.0))]
    s = sampling.lhs_marginals(spark, ms, 300, 9)
    cells = [s.select(F.floor(m.cdf(F.col(f"xi_{k}")) * 300).alias("stratum"), F.lit(k).alias("k")) for k, m in enumerate(ms)]
    c = cells[0].unionByName(cells[1]).groupBy("stratum").agg(*[F.sum((F.col("k") == k).cast("long")).alias(n) for k, n in enumerate(("n_uniform", "n_gumbel"))])
    return c.select("stratum", "n_uniform", "n_gumbel")


@_query("SELECT 1.0e0 AS w, " + ", ".join([_rs("5.0e0") + " AS mean", _rs("4 / 3.0e0") + " AS var", _rs("1 / 15.0e0") + " AS m24", _rs("1 / 7.0e0") + " AS m6"]))
def q_quadrature_legendre(spark, sf_dir):
    """A tensor rule of four Legendre nodes, moved and scaled, against the integrals that it must give exactly."""
    q = sampling.quadrature(spark, Basis("legendre", 2, 1), 4, 5.0, 2.0)
    u = q.withColumns({f"u{k}": (F.col(f"xi_{k}") - 5) / 2 for k in range(2)})
    p = lambda c, n: F.pow(c, F.lit(float(n)))
    return u.agg(
        _r(F.sum("w")).alias("w"), _r(F.sum(F.col("w") * F.col("xi_0"))).alias("mean"), _r(F.sum(F.col("w") * p(F.col("xi_1") - 5, 2))).alias("var"),
        _r(F.sum(F.col("w") * p("u0", 2) * p("u1", 4))).alias("m24"), _r(F.sum(F.col("w") * p("u0", 6))).alias("m6"),
    )


@_query("SELECT CAST(d AS INT) AS d, CAST(k AS INT) AS k, CAST(power(2, 29 - k) AS BIGINT) AS lowest_bit FROM range(40) a(d), range(30) b(k)")
def q_sobol_lowest_bits(spark, sf_dir):
    """Direction numbers are odd multiples of a falling power of two."""
    rows = [(d, k, int(v)) for d, vs in enumerate(sampling.sobol_directions(40)) for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "d int, k int, v long").select("d", "k", F.col("v").bitwiseAND(-F.col("v")).alias("lowest_bit"))


@_query("SELECT kind, count(*) AS n, count(*) FILTER (WHERE kind = 'iid' OR kind = 'cov' AND value <> 0) AS changed FROM events, (VALUES ('null'), ('iid'), ('cov')) k(kind) WHERE value IS NOT NULL GROUP BY kind")
def q_noise_kinds(spark, sf_dir):
    """Values that each kind of observation noise changes; noise relative to a value of zero is none."""
    e = _t(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "value", F.col("value").alias("y"))
    out = None
    for kind in ("null", "iid", "cov"):
        one = sampling.with_noise(e, "y", kind, 0.1, 3, "event_id").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum((F.col("y") != F.col("value")).cast("long")).alias("changed"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("SELECT CAST(1000 AS BIGINT) AS n, CAST(0 AS INT) AS first, CAST(999 AS INT) AS last, CAST(1000 AS BIGINT) AS in_range")
def q_seed_table(spark, sf_dir):
    s = sampling.seed_table(spark, 1000)
    return s.agg(F.countDistinct("idx").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.sum(F.col("seed").between(0, 999_999).cast("long")).alias("in_range"))


def _close(c, expected: float, sd: float, n: int):
    """Whether a mean of n draws lies within five standard errors."""
    return F.abs(c - expected) < 5 * sd / n**0.5


@_query("SELECT CAST(k AS INT) AS dim, true AS mean_near, true AS inside FROM range(4) r(k)")
def q_monte_carlo_tolerance(spark, sf_dir):
    """Draws of four marginals: probabilities inside (0, 1), with a mean within five standard errors of a half."""
    n, ms = 20_000, [dist.norm(), dist.uniform(-1, 2), dist.lognorm(0, 0.25), dist.weibull(1.5)]
    s = sampling.monte_carlo(spark, ms, n, 3)
    u = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), m.cdf(F.col(f"xi_{k}")).alias("u")) for k, m in enumerate(ms)])).alias("s")).select("s.*")
    return u.groupBy("dim").agg(_close(F.avg("u"), 0.5, 12**-0.5, n).alias("mean_near"), ((F.min("u") > 0) & (F.max("u") < 1)).alias("inside"))


@_query("SELECT kind, true AS inside, true AS share_near FROM (VALUES ('ball'), ('cls1'), ('cls2'), ('cls4')) v(kind)")
def q_sampling_tolerance(spark, sf_dir):
    """Supports of the ball and Christoffel samples, and shares that their laws fix, within five standard errors."""
    n = 10_000
    near = lambda c, p: _close(F.avg(c.cast("double")), p, (p * (1 - p)) ** 0.5, n)
    r = lambda d: F.sqrt(geometry.distance2([f"xi_{k}" for k in range(d)], [0] * d))
    ball = sampling.uniform_ball(spark, 3, n, 2.0, 1).agg(F.lit("ball").alias("kind"), (F.max(r(3)) <= 2).alias("inside"), near(r(3) <= 1, 1 / 8).alias("share_near"))
    arc = sampling.christoffel(spark, "cls1", 2, n, 5).agg(F.lit("cls1").alias("kind"), (F.max(F.greatest(F.abs("xi_0"), F.abs("xi_1"))) <= 1).alias("inside"), near(F.abs("xi_0") <= 0.5, 1 / 3).alias("share_near"))
    out = ball.unionByName(arc)
    for kind, top in (("cls2", 1.0), ("cls4", 2**0.5)):
        s = sampling.christoffel(spark, kind, 2, n, 5)
        out = out.unionByName(s.agg(F.lit(kind).alias("kind"), (F.max(r(2)) <= top + 1e-12).alias("inside"), near(F.col("xi_0") <= 0, 0.5).alias("share_near")))
    return out


@_query("SELECT count(DISTINCT p_partkey) AS pool, least(100, count(DISTINCT p_partkey)) AS n, least(100, count(DISTINCT p_partkey)) AS in_pool FROM part")
def q_candidate_pool(spark, sf_dir):
    """A random subset of fixed size, in hash order: distinct ids of the pool."""
    from haruspex.sources.files import candidate_pool

    pool = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("global_id"), "p_size")
    picks = candidate_pool(pool, ["p_size"], 100, 4).select("global_id").distinct()
    inside = picks.join(pool.select("global_id"), "global_id", "left_semi").agg(F.count(F.lit(1)).alias("in_pool"))
    return pool.agg(F.countDistinct("global_id").alias("pool")).crossJoin(picks.agg(F.count(F.lit(1)).alias("n"))).crossJoin(inside)


@_query("WITH s AS (SELECT count(*) AS n FROM supplier) SELECT CAST(k AS INT) AS fold, n // 7 + CASE WHEN k < n % 7 THEN 1 ELSE 0 END AS tested, n - (n // 7 + CASE WHEN k < n % 7 THEN 1 ELSE 0 END) AS trained FROM range(7) r(k), s")
def q_fold_sizes(spark, sf_dir):
    """Sizes of seven shuffled folds of as many rows as there are suppliers."""
    n = _t(spark, sf_dir, "supplier").count()
    return spark.createDataFrame([(k, len(set(te.tolist())), len(set(tr.tolist()) - set(te.tolist()))) for k, (tr, te) in enumerate(linalg.folds(n, 7))], "fold int, tested long, trained long")


@_query("SELECT CAST(p AS INT) AS p, CAST(ceil(2 * p * ln(p)) AS BIGINT) AS by_log, CAST(ceil(1.5e0 * p) AS BIGINT) AS by_alpha, CAST(least(5, greatest(3, p)) AS BIGINT) AS batch FROM range(2, 60) r(p)")
def q_sample_sizes(spark, sf_dir):
    rows = [(p, design.sample_size(p), design.sample_size(p, 1.5), design.batch_size(p)) for p in range(2, 60)]
    return spark.createDataFrame(rows, "p int, by_log long, by_alpha long, batch long")


@_query("WITH b AS (SELECT min(s_acctbal) AS a0, max(s_acctbal) AS a1, 0.0e0 AS c0, 24.0e0 AS c1 FROM supplier) SELECT round((a0 + a1) / 2, 1) AS x, round((c0 + c1) / 2, 1) AS y, round(sqrt(2.0) * (a1 - a0) / 2, 0) AS rx, round(sqrt(2.0) * (c1 - c0) / 2, 1) AS ry FROM b")
def q_enclosing_ellipse(spark, sf_dir):
    """The least ellipse around a rectangle's corners: half its sides times the root of two."""
    lo, hi = _t(spark, sf_dir, "supplier").agg(F.min("s_acctbal").cast("double"), F.max("s_acctbal").cast("double")).first()
    c, A = design.enclosing_ellipsoid(np.array([(x, y) for x in (lo, hi) for y in (0.0, 24.0)]), 1e-9)
    # the shape's unit is the inverse square of a half axis
    r = 1 / np.sqrt(np.diag(A))
    return spark.createDataFrame([(round(float(c[0]), 1), round(float(c[1]), 1), round(float(r[0]), 0), round(float(r[1]), 1))], "x double, y double, rx double, ry double")


# -- distributions and bases

_EXPON = "(1 - exp(-{0} / 2.0e0))"


@_query(
    f"WITH x AS (SELECT g, 2 * power(-ln(1 - xi_0), 1 / 1.5e0) AS x0, xi_0 AS u0, xi_1 AS u1 FROM {_points_sql(2)}), y AS (SELECT *, x0 - (1 + x0) * ln(-ln(u1)) AS x1 FROM x) "
    f"SELECT g, {_rs('avg(x0)', 5)} AS x0, {_rs('avg(x1)', 5)} AS x1, {_rs('avg(u0)')} AS u0, {_rs('avg(u1)')} AS u1 FROM y GROUP BY g"
)
def q_rosenblatt_chain(spark, sf_dir):
    """A wave height and what depends on it from two uniforms, and back."""
    chain = [lambda xs: dist.weibull(1.5, 0.0, 2.0), lambda xs: dist.Marginal("gumbel", (xs[0], 1 + xs[0]))]
    x0, x1 = dist.inverse_rosenblatt([F.col("xi_0"), F.col("xi_1")], chain)
    df = _points(spark, sf_dir, 2).select("g", x0.alias("x0"), x1.alias("x1"))
    u0, u1 = dist.rosenblatt([F.col("x0"), F.col("x1")], chain)
    return df.withColumns({"u0": u0, "u1": u1}).groupBy("g").agg(*[_r(F.avg(c), d).alias(c) for c, d in (("x0", 5), ("x1", 5), ("u0", 6), ("u1", 6))])


@_query(
    f"WITH t AS (SELECT g, -2 * ln(1 - ({_EXPON.format('1.0e0')} + xi_0 * ({_EXPON.format('5.0e0')} - {_EXPON.format('1.0e0')}))) AS x FROM {_points_sql(1)}) "
    f"SELECT g, {_rs('avg(x)')} AS mean, min(x) >= 1 - 1e-9 AND max(x) <= 5 + 1e-9 AS inside FROM t GROUP BY g"
)
def q_truncated_quantile(spark, sf_dir):
    x = dist.truncated_ppf(F.col("xi_0"), dist.Marginal("expon", (0.0, 2.0)), 1, 5)
    return _points(spark, sf_dir, 1).select("g", x.alias("x")).groupBy("g").agg(_r(F.avg("x")).alias("mean"), ((F.min("x") >= 1 - 1e-9) & (F.max("x") <= 5 + 1e-9)).alias("inside"))


@_query(
    f"SELECT g, {_rs('avg(exp(-xi_0 - exp(-xi_0)) * exp(-xi_1 / 2) / 2)')} AS pdf, {_rs('avg(exp(-exp(-xi_0)) * (1 - exp(-xi_1 / 2)))')} AS cdf FROM {_points_sql(2)} GROUP BY g"
)
def q_joint_density(spark, sf_dir):
    """Density and distribution of independent marginals, with a constant that passes through."""
    ms = [dist.Marginal("gumbel", (0.0, 1.0)), dist.Marginal("expon", (0.0, 2.0)), 7.0]
    xs = [F.col("xi_0"), F.col("xi_1"), F.lit(7.0)]
    return _points(spark, sf_dir, 2).select("g", dist.joint_pdf(xs, ms).alias("p"), dist.joint_cdf(xs, ms).alias("c")).groupBy("g").agg(_r(F.avg("p")).alias("pdf"), _r(F.avg("c")).alias("cdf"))


@_query("SELECT CAST(t AS INT) AS years, round(1e6 * 3 / (t * 365.25e0 * 24), 4) + 0.0 AS probability_e6 FROM (VALUES (1), (10), (50), (100)) v(t)")
def q_reliability_index(spark, sf_dir):
    """The normal probability beyond the reliability index of a return period is that period's."""
    rows = [(t, dist.contour(t, 3, 1)[0]) for t in (1, 10, 50, 100)]
    return spark.createDataFrame(rows, "years int, beta double").select("years", _r(1e6 * normal_cdf(-F.col("beta")), 4).alias("probability_e6"))


@_query("SELECT site, k AS global_id, 1.0e0 AS ratio FROM (VALUES ('buoy_46022'), ('kvitebjorn'), ('norway5_2d')) s(site), range(36) r(k)")
def q_contour_radius(spark, sf_dir):
    """Points of an environmental contour, carried back to normal space, lie on the circle of the reliability index."""
    beta, out = dist.contour(50, 3, 1)[0], None
    for name in ("buoy_46022", "kvitebjorn", "norway5_2d"):
        chain = dist.site(name)
        c = sampling.contour(spark, chain, beta, 36)
        u = _once([F.col("x_0"), F.col("x_1")], lambda xs: F.array(*dist.rosenblatt(xs, chain)))
        z = _once([u], lambda v: F.array(*[dist.norm().ppf(F.get(v[0], F.lit(k))) for k in range(2)]))
        radius = F.aggregate(z, F.lit(0.0), lambda a, v: a + v * v, F.sqrt)
        one = c.select(F.lit(name).alias("site"), "global_id", _r(radius / beta, 3).alias("ratio"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("SELECT site, true AS h_near, true AS t_near FROM (VALUES ('buoy_46022'), ('kvitebjorn'), ('norway5_2d')) s(site)")
def q_sea_state_tolerance(spark, sf_dir):
    """Conditional probabilities of drawn sea states have a mean within five standard errors of a half."""
    out = None
    for name in ("buoy_46022", "kvitebjorn", "norway5_2d"):
        chain = dist.site(name)
        u = _once([F.col("x_0"), F.col("x_1")], lambda xs: F.struct(*[p.alias(n) for n, p in zip("ht", dist.rosenblatt(xs, chain))]))
        one = sampling.sea_states(spark, chain, 5000, 2).select(u.alias("u")).select("u.h", "u.t").agg(F.lit(name).alias("site"), *[_close(F.avg(c), 0.5, 12**-0.5, 5000).alias(f"{c}_near") for c in "ht"])
        out = one if out is None else out.unionByName(one)
    return out


_X = "(2 * xi_0 - 1)"


@_query(f"SELECT g, {_rs(f'avg(2 * {_X} / sqrt(0.8e0))')} AS p1, {_rs(f'avg((15 * {_X} * {_X} - 3) / 4 / sqrt(9 / 14.0e0))')} AS p2 FROM {_points_sql(1)} GROUP BY g")
def q_basis_jacobi(spark, sf_dir):
    """Orthonormal Jacobi polynomials with both exponents one."""
    b = Basis("jacobi", 1, 2, (1.0, 1.0))
    df = b.with_powers(_points(spark, sf_dir, 1).withColumn("x", 2 * F.col("xi_0") - 1), ["x"])
    t = b.terms()
    return df.select("g", t[1].alias("p1"), t[2].alias("p2")).groupBy("g").agg(_r(F.avg("p1")).alias("p1"), _r(F.avg("p2")).alias("p2"))


@_query(f"WITH t AS (SELECT g, 1.0e0 AS a, sqrt(3.0e0) * {_X} AS b FROM {_points_sql(1)}) SELECT g, {_rs('avg(2 * a * a / (a * a + b * b))')} AS first, {_rs('avg(2 * b * b / (a * a + b * b))')} AS second FROM t GROUP BY g")
def q_christoffel_rows(spark, sf_dir):
    """Rows of a design scaled to length sqrt(P): mean squares of their entries."""
    b = Basis("legendre", 1, 1)
    df = b.with_powers(_points(spark, sf_dir, 1).withColumn("x", 2 * F.col("xi_0") - 1), ["x"])
    w = surrogate.christoffel_weight(b)
    return df.select("g", *[(w * t * t).alias(n) for n, t in zip(("first", "second"), b.terms())]).groupBy("g").agg(_r(F.avg("first")).alias("first"), _r(F.avg("second")).alias("second"))


# -- least squares


@_query(
    f"WITH m AS (SELECT sum(wt * xi_0) / sum(wt) AS a, sum(wt * xi_1) / sum(wt) AS b, sum(wt * y) / sum(wt) AS c FROM {_XY}), s AS (SELECT a, b, c, sqrt(sum(wt * (xi_0 - a) * (xi_0 - a))) AS la, sqrt(sum(wt * (xi_1 - b) * (xi_1 - b))) AS lb, sum(wt * (xi_0 - a) * (y - c)) AS ac FROM m, {_XY} GROUP BY a, b, c) "
    f"SELECT {_rs('a')} AS mean_0, {_rs('b')} AS mean_1, {_rs('c')} AS mean_y, {_rs('la', 4)} AS length_0, {_rs('lb', 4)} AS length_1, {_rs('ac / la', 4)} AS xy_0 FROM s"
)
def q_weighted_preprocess(spark, sf_dir):
    """Weighted means, lengths and products of a centred and scaled design, from one pass of moments."""
    (m,) = linalg.fold_moments(_xy(spark, sf_dir), ["xi_0", "xi_1"], "y", F.lit(0), 1, "wt")
    by = m.sums[0, 1:] / m.sums[0, 0]
    length = np.append(np.sqrt(np.diag(m.shifted(by, np.ones(3))[0])), 1.0)
    xy = m.shifted(by, length)[1]
    row = [*by, *length[:2], xy[0]]
    names = ("mean_0", "mean_1", "mean_y", "length_0", "length_1", "xy_0")
    return spark.createDataFrame([tuple(map(float, row))], ", ".join(f"{n} double" for n in names)).select(*[_r(F.col(n), 4 if n[0] in "lx" else 6).alias(n) for n in names])


@_query(
    f"WITH m AS (SELECT sum(wt) AS w, sum(wt * xi_0) AS x, sum(wt * y) AS y, sum(wt * xi_0 * xi_0) AS xx, sum(wt * xi_0 * y) AS xy FROM {_XY}), s AS (SELECT *, (xy - x * y / w) / (xx - x * x / w) AS slope FROM m) "
    f"SELECT {_rs('y / w - slope * x / w', 5)} AS c0, {_rs('slope / sqrt(3.0e0)', 5)} AS c1 FROM s"
)
def q_weighted_ols(spark, sf_dir):
    """Weighted least squares on the constant and the linear Legendre term."""
    s = surrogate.fit_ols(_xy(spark, sf_dir), Basis("legendre", 1, 1), ["xi_0"], "y", "wt")
    return spark.createDataFrame([tuple(s.coefficients)], "c0 double, c1 double").select(*[_r(F.col(c), 5).alias(c) for c in ("c0", "c1")])


_TERMS = ((0, 1.5), (1, 2.0), (4, -0.8), (5, 0.3))
_TERM_VALUES = "(VALUES " + ", ".join(f"({k}, {c}e0)" for k, c in _TERMS) + ")"


def _polynomial(spark, sf_dir):
    """Logistic points with the response that four Hermite terms make."""
    b = Basis("hermite_e", 2, 2)
    return b, surrogate.Surrogate(b, tuple(k for k, _ in _TERMS), tuple(c for _, c in _TERMS)).predict(_points(spark, sf_dir, 2, True), ["xi_0", "xi_1"], "y")


@_query(f"SELECT CAST(k AS INT) AS basis_id, {_rs('c', 5)} AS coefficient FROM {_TERM_VALUES} v(k, c)")
def q_lars_recovers(spark, sf_dir):
    """Least angle regression over a whole table gives back the terms that made its response."""
    b, df = _polynomial(spark, sf_dir)
    s = surrogate.fit_lars(df, b, ["xi_0", "xi_1"], "y")
    return _nonzero(spark, s)


@_query(f"SELECT CAST(k AS INT) AS basis_id, {_rs('c', 1)} AS coefficient FROM {_TERM_VALUES} v(k, c)")
def q_lasso_recovers(spark, sf_dir):
    """So does the cross-validated lasso, up to what its penalty shrinks."""
    b, df = _polynomial(spark, sf_dir)
    return _nonzero(spark, surrogate.fit_lasso(df, b, ["xi_0", "xi_1"], "y"), 1)


def _nonzero(spark, s, digits: int = 5):
    t = spark.createDataFrame([(int(k), float(c)) for k, c in zip(s.active, s.coefficients)], "basis_id int, c double")
    return t.select("basis_id", _r(F.col("c"), digits).alias("coefficient")).where("coefficient <> 0")


@_query(f"SELECT CAST(k AS INT) AS basis_id, row_number() OVER (ORDER BY abs(c) DESC) AS place FROM {_TERM_VALUES} v(k, c)")
def q_lars_order(spark, sf_dir):
    """On an orthonormal design, terms enter by falling absolute coefficient."""
    b = Basis("hermite_e", 2, 2)
    nodes = surrogate.Surrogate(b, tuple(k for k, _ in _TERMS), tuple(c for _, c in _TERMS)).predict(sampling.quadrature(spark, b, 4), ["xi_0", "xi_1"], "y")
    made = b.with_powers(nodes, ["xi_0", "xi_1"]).select(*[t.alias(f"t{k}") for k, t in enumerate(b.terms())], "y", "w")
    G, v, _ = linalg.gram_matrix(made, [f"t{k}" for k in range(b.size)], "y", "w")
    order = linalg.lars_order(np.round(G, 10), np.round(v, 10), 1)
    return spark.createDataFrame([(int(k), i) for i, k in enumerate(order, 1)], "basis_id int, place long")


@_query(
    f"WITH s AS (SELECT count(*) AS n, sum(y * y) - CASE WHEN abs(sum(y)) >= sqrt(3.0e0) * abs(sum(xi_0 * y)) THEN sum(y) * sum(y) / count(*) ELSE sum(xi_0 * y) * sum(xi_0 * y) / sum(xi_0 * xi_0) END AS one, regr_syy(y, xi_0) * (1 - regr_r2(y, xi_0)) AS two FROM {_XY}) "
    f"SELECT CAST(terms AS INT) AS terms, {_rs('CASE terms WHEN 1 THEN one / (two / (n - 2)) - n + 2 ELSE 2 END', 2)} AS cp FROM s, (VALUES (1), (2)) v(terms)"
)
def q_mallows_cp(spark, sf_dir):
    """Mallows' Cp of the term that enters first, by its product with the response, and of both terms."""
    cp = surrogate.mallows_cp(_xy(spark, sf_dir), Basis("legendre", 1, 1), ["xi_0"], "y")
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(cp, 1)], "terms int, cp double").select("terms", _r(F.col("cp"), 2).alias("cp"))


@_query(f"SELECT {_rs('sum(c) FILTER (WHERE k = 0)')} AS mean, {_rs('sum(c * c) FILTER (WHERE k > 0)')} AS var FROM {_TERM_VALUES} v(k, c)")
def q_surrogate_moments(spark, sf_dir):
    """Mean and variance of a projected surrogate: its constant, and its other coefficients' squares."""
    b = Basis("hermite_e", 2, 2)
    nodes = surrogate.Surrogate(b, tuple(k for k, _ in _TERMS), tuple(c for _, c in _TERMS)).predict(sampling.quadrature(spark, b, 4), ["xi_0", "xi_1"], "y")
    s = surrogate.fit_quadrature(nodes, b, ["xi_0", "xi_1"], "y")
    return spark.createDataFrame([(s.mean(), s.variance())], "mean double, var double").select(_r(F.col("mean")).alias("mean"), _r(F.col("var")).alias("var"))


@_query(f"SELECT g, count(*) AS n, count(*) AS of_either FROM {_points_sql(1)} GROUP BY g")
def q_mixture_predict(spark, sf_dir):
    """Every row is predicted by one of two surrogates, here told by their sign."""
    b = Basis("legendre", 1, 0)
    df = surrogate.mixture_predict(_points(spark, sf_dir, 1), [surrogate.Surrogate(b, (0,), (c,)) for c in (1.0, -1.0)], ["xi_0"], "global_id")
    return df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y_hat").isin(1.0, -1.0).cast("long")).alias("of_either"))


# -- filters and ordered sets


@_query(f"SELECT g, count(*) AS n FROM {_points_sql(2)} WHERE xi_0 BETWEEN 0.25 AND 0.75 AND xi_1 BETWEEN 0.1 AND 0.3 GROUP BY g")
def q_box_inclusive(spark, sf_dir):
    return geometry.box(_points(spark, sf_dir, 2), ["xi_0", "xi_1"], (0.25, 0.1), (0.75, 0.3), inclusive=True).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT l_returnflag AS g, count(*) AS n, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS total FROM lineitem GROUP BY 1")
def q_finite_guard(spark, sf_dir):
    """Values behind the guard that fails on null, NaN and infinity."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), dist.finite(F.col("l_quantity").cast("double")).alias("v")).groupBy("g").agg(F.count("v").alias("n"), stats.rounded(F.sum("v"), 2).alias("total"))


@_query("SELECT user_id AS sample_id, user_id % 3 AS seed_id, round(max(abs(value)), 6) AS y_max, round(arg_max(value, event_id), 6) AS last FROM events WHERE event_id >= 20 GROUP BY user_id")
def q_short_term_maxima(spark, sf_dir):
    """Largest absolute value of each series after its transient, and its last value."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), (F.col("user_id") % 3).alias("seed_id"), F.col("event_id").alias("t_idx"), F.col("event_id").cast("double").alias("t"), "value")
    return series.short_term_maxima(e, 20.0).select("sample_id", "seed_id", stats.rounded("y_max", 6).alias("y_max"), stats.rounded("last", 6).alias("last"))


@_query("SELECT s_suppkey AS global_id FROM supplier")
def q_strict_union(spark, sf_dir):
    """Two parts of a pool that don't overlap make it up."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("global_id"))
    return geometry.strict_union(s.where("global_id % 3 = 0"), s.where("global_id % 3 <> 0"), "global_id")


_CENTRES = [(0.2, 0.8), (0.6, 0.4)]
_NEAREST = "least(" + ", ".join(f"sqrt(power(xi_0 - {a}e0, 2) + power(xi_1 - {b}e0, 2))" for a, b in _CENTRES) + ")"


@_query(f"SELECT global_id, round({_NEAREST}, 9) AS min_dist FROM {_points_sql(2)} ORDER BY {_NEAREST}, global_id LIMIT 60")
def q_doi_global(spark, sf_dir):
    """A domain of interest too small for its radius falls back to the nearest 60 points."""
    near, _, _ = geometry.neighbourhood(_points(spark, sf_dir, 2), ["xi_0", "xi_1"], _CENTRES, 1e-9, "global_id", least=60, fallback="global")
    return near.select("global_id", stats.rounded("min_dist", 9).alias("min_dist"))


# -- spectra

_N, _DW = 64, 0.25
_LORENTZ = f"(SELECT j, CASE WHEN j <= {_N // 2} THEN j ELSE {_N} - j END * {_DW}e0 AS w FROM range({_N}) r(j))"


@_query(f"SELECT p_size AS id, {_rs('4 / (4 + p_size * p_size * 0.01e0)', 8)} AS lorentz, CASE WHEN p_size * 0.1e0 BETWEEN 0 AND 2.05 THEN 1.5e0 ELSE 0 END AS white FROM part GROUP BY p_size")
def q_test_spectra(spark, sf_dir):
    w = F.col("id") * 0.1
    return _t(spark, sf_dir, "part").select(F.col("p_size").alias("id")).distinct().select("id", _r(series.lorentz(w), 8).alias("lorentz"), series.white_noise(w, 1.5, 0.0, 2.05).alias("white"))


@_query(
    f"WITH s AS (SELECT j, 4 / (4 + w * w) AS p FROM {_LORENTZ}) SELECT CAST(k AS INT) AS lag, {_rs(f'sum(p * cos(2 * pi() * j * k / {_N})) * {_DW}e0 / (2 * pi())', 8)} AS acf, "
    f"{_rs('max(p) FILTER (WHERE j = k)', 8)} AS psd FROM s, range({_N}) r(k) GROUP BY k"
)
def q_spectrum_autocorrelation(spark, sf_dir):
    """A two-sided spectrum's autocorrelation, and the spectrum that this gives back."""
    j = np.arange(_N)
    w = np.where(j <= _N // 2, j, _N - j) * _DW
    acf = series.to_autocorrelation(4 / (4 + w * w), _DW)
    back = series.to_spectrum(acf, 2 * np.pi / (_N * _DW))
    return spark.createDataFrame([(int(k), float(a), float(p)) for k, a, p in zip(j, acf, back)], "lag int, a double, p double").select("lag", _r(F.col("a"), 8).alias("acf"), _r(F.col("p"), 8).alias("psd"))


@_query(f"SELECT CAST(j AS INT) AS j, round(CASE WHEN j IN (0, {_N // 2}) THEN 1 ELSE 2 END * 4 / (4 + w * w), 8) AS psd FROM {_LORENTZ} WHERE j <= {_N // 2}")
def q_one_sided_spectrum(spark, sf_dir):
    """A one-sided spectrum holds both sides' power, once at zero and at the last frequency."""
    j = np.arange(_N)
    w = np.where(j <= _N // 2, j, _N - j) * _DW
    out = series.one_sided(4 / (4 + w * w))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(out)], "j int, v double").select("j", stats.rounded("v", 8).alias("psd"))


# -- adaptive runs

# fixed values: published calls and trace rows of the named scenarios
_RUNS = (("converged", 12, 15), ("max_order", 20, 23), ("overfit_fallback", 20, 25), ("runtime_failure", 0, 2))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({c} AS BIGINT), CAST({r} AS BIGINT))" for n, c, r in _RUNS) + ") v(scenario, calls, trace_rows)")
def q_adaptive_counts(spark, sf_dir):
    """Calls and trace rows of the small adaptive runs."""
    from haruspex.plans import scenarios

    runs = [(n, scenarios.small(spark, n)) for n, _, _ in _RUNS]
    return spark.createDataFrame([(n, o.calls, len(o.trace)) for n, o in runs], "scenario string, calls long, trace_rows long")
