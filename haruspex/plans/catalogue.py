"""All queries of the library by name, with equivalent SQL where SQL can express them.

Inputs are the driver's tables.  Uniform inputs of a row come from modular
arithmetic on its keys, so both engines see the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haruspex.functions import dist
from haruspex.functions.basis import Basis
from haruspex.functions.models import MODELS, affine_input, evaluate
from haruspex.operators.adaptive import INVARIANTS as _INVARIANTS
from haruspex.operators import design, geometry, linalg, sampling, series, stats, surrogate, tracks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Multipliers of the modular uniforms, one pair for each dimension.
_MULT = ((7919, 104729), (6101, 15485), (3571, 32452), (9173, 49979), (5023, 67867), (8011, 86028), (2749, 99991), (4637, 11939))
_MOD = 99991


def _u(k: int) -> str:
    a, b = _MULT[k]
    return f"(((l_orderkey * {a} + l_linenumber * {b} + {k + 1}) % {_MOD}) + 0.5e0) / {_MOD}"


def _z(k: int) -> str:
    """Roughly standard normal: the logistic quantile of a uniform, scaled."""
    return f"(0.5513e0 * ln({_u(k)} / (1 - {_u(k)})))"


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 6):
    """Rounded, without negative zero."""
    return stats.rounded(c, digits) + 0.0


def _rs(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0"


def _points(spark: SparkSession, sf_dir: str, d: int, normal: bool = False) -> DataFrame:
    """``global_id, g, xi_0, ...`` of the line items."""
    of = _z if normal else _u
    return _t(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("global_id"), F.col("l_returnflag").alias("g"), *[F.expr(of(k)).alias(f"xi_{k}") for k in range(d)])


def _points_sql(d: int, normal: bool = False) -> str:
    of = _z if normal else _u
    cols = ", ".join(f"{of(k)} AS xi_{k}" for k in range(d))
    return f"(SELECT l_orderkey * 8 + l_linenumber AS global_id, l_returnflag AS g, {cols} FROM lineitem)"


# -- models: one scan, one aggregate each


def _model_query(name: str) -> None:
    m = MODELS[name]
    inputs = [f"xi_{k}" for k in range(m.ndim)]
    mapped = [affine_input(i, x).replace("e0", "") for i, x in zip(m.inputs, inputs)]

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _points(spark, sf_dir, m.ndim)
        df = df.select("g", *[F.expr(e).cast("double").alias(f"x_{k}") for k, e in enumerate(mapped)])
        v = df.select("g", evaluate(m, [f"x_{k}" for k in range(m.ndim)]).alias("y"))
        return v.groupBy("g").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("y"), 5).alias("mean"), _r(F.min("y"), 5).alias("least"), _r(F.max("y"), 5).alias("most"), _r(F.avg((F.col("y") <= 0).cast("double"))).alias("pf"))

    cols = ", ".join(f"CAST({e} AS DOUBLE) AS x_{k}" for k, e in enumerate(mapped))
    text = m.text([f"x_{k}" for k in range(m.ndim)])
    QUERIES[f"model_{name}"] = q
    SQL[f"model_{name}"] = (
        f"WITH p AS (SELECT g, {cols} FROM {_points_sql(m.ndim)}), v AS (SELECT g, {text} AS y FROM p) "
        f"SELECT g, count(*) AS n, {_rs('avg(y)', 5)} AS mean, {_rs('min(y)', 5)} AS least, {_rs('max(y)', 5)} AS most, {_rs('avg(CASE WHEN y <= 0 THEN 1.0e0 ELSE 0 END)')} AS pf FROM v GROUP BY g"
    )


for _name in MODELS:
    _model_query(_name)


_FB = MODELS["four_branch"].text(["xi_0", "xi_1"])


@_query(f"WITH v AS (SELECT g, {_FB} AS y FROM {_points_sql(2, True)}), s AS (SELECT g, count(*) AS n, avg(CASE WHEN y <= 0 THEN 1.0e0 ELSE 0 END) AS p FROM v GROUP BY g) SELECT g, n, {_rs('p')} AS pf, {_rs('sqrt(p * (1 - p) / n)')} AS se FROM s")
def q_pf_four_branch(spark, sf_dir):
    """Failure probability of the series system by group, with its standard error."""
    df = _points(spark, sf_dir, 2, True)
    out = stats.failure_probability(df, evaluate("four_branch", ["xi_0", "xi_1"]), ["g"])
    return out.select("g", "n", _r(F.col("pf")).alias("pf"), _r(F.col("se")).alias("se"))


# -- aggregates


@_query(
    "WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY event_type), c AS (SELECT e.event_type, value, value - mu AS d, event_id FROM events e JOIN m ON e.event_type = m.event_type) "
    f"SELECT event_type, count(value) AS n, {_rs('avg(value)')} AS mean, {_rs('stddev_pop(value)')} AS std, {_rs('var_pop(value)', 4)} AS var, {_rs('avg(d*d*d) / power(avg(d*d), 1.5)')} AS skew, {_rs('avg(d*d*d*d) / power(avg(d*d), 2) - 3')} AS kurt, "
    f"{_rs('max(abs(value))')} AS absmax, {_rs('min(abs(value))')} AS absmin, {_rs('max(value)')} AS most, {_rs('min(value)')} AS least, {_rs('arg_max(value, event_id)')} AS last FROM c GROUP BY event_type"
)
def q_stats_panel(spark, sf_dir):
    s = stats.moments_panel(_t(spark, sf_dir, "events"), "value", ["event_type"], "event_id")
    return s.select("event_type", "n", *[_r(F.col(a), 4 if a == "var" else 6).alias(b) for a, b in (("mean", "mean"), ("std", "std"), ("var", "var"), ("skew", "skew"), ("kurt", "kurt"), ("absmax", "absmax"), ("absmin", "absmin"), ("max", "most"), ("min", "least"), ("last", "last"))])


def _mq_sql(src: str, value: str, p: float, name: str) -> str:
    m = 0.4 + p * 0.2
    return (
        f"(WITH r AS (SELECT {value} AS x, row_number() OVER (ORDER BY {value}) AS k, count(*) OVER () AS n FROM {src} WHERE {value} IS NOT NULL), "
        f"a AS (SELECT max(n) AS n, CAST(floor(least(greatest(max(n) * {p}e0 + {m!r}e0, 1), max(n) - 1)) AS BIGINT) AS j, max(n) * {p}e0 + {m!r}e0 AS pos FROM r) "
        f"SELECT (1 - least(greatest(pos - j, 0), 1)) * max(CASE WHEN k = j THEN x END) + least(greatest(pos - j, 0), 1) * max(CASE WHEN k = j + 1 THEN x END) FROM r, a GROUP BY pos, j) AS {name}"
    )


@_query("SELECT " + ", ".join(_rs(f"{n}", 4) + f" AS {n}" for n in ("q0", "q1", "q2")) + " FROM (SELECT " + ", ".join(_mq_sql("lineitem", "l_extendedprice", p, f"q{i}") for i, p in enumerate((0.01, 0.5, 0.99))) + ")")
def q_mquantiles(spark, sf_dir):
    s = stats.mquantiles(_t(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", [0.01, 0.5, 0.99])
    return s.select(*[_r(F.col(f"q{i}"), 4).alias(f"q{i}") for i in range(3)])


@_query("WITH m AS (SELECT avg(o_totalprice / 1e5) AS mu FROM orders) SELECT 0.0e0 AS m1, " + ", ".join(f"{_rs(f'avg(power(o_totalprice / 1e5 - mu, {k}))')} AS m{k}" for k in (2, 3, 4)) + " FROM orders, m")
def q_central_moments(spark, sf_dir):
    s = stats.central_moments(_t(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1e5).alias("v")), "v", [1, 2, 3, 4])
    return s.select("m1", *[_r(F.col(f"m{k}")).alias(f"m{k}") for k in (2, 3, 4)])


@_query(
    "WITH r AS (SELECT avg(x) a, avg(x*x) b, avg(x*x*x) c, avg(x*x*x*x) d FROM (SELECT o_totalprice / 1e5 AS x FROM orders)) "
    f"SELECT {_rs('a')} AS mean, {_rs('b - a*a')} AS var, {_rs('(c - 3*a*b + 2*a*a*a) / power(b - a*a, 1.5)', 5)} AS skew, {_rs('(d - 4*a*c + 6*a*a*b - 3*a*a*a*a) / power(b - a*a, 2) - 3', 5)} AS kurt FROM r"
)
def q_raw_moments(spark, sf_dir):
    x = F.col("o_totalprice") / 1e5
    raw = _t(spark, sf_dir, "orders").agg(*[F.avg(F.pow(x, F.lit(float(k)))).alias(f"r{k}") for k in range(1, 5)])
    m = stats.raw_to_central(*[F.col(f"r{k}") for k in range(1, 5)])
    return raw.select(*[_r(c, d).alias(n) for c, n, d in zip(m, ("mean", "var", "skew", "kurt"), (6, 6, 5, 5))])


_FIT = "(1500e0 * l_quantity)"


@_query(
    f"WITH e AS (SELECT l_extendedprice AS y, {_FIT} AS f FROM lineitem) SELECT count(*) AS n, {_rs('avg(power((y - f) / 1e3, 2))', 4)} AS mse, {_rs('sqrt(avg(power((y - f) / 1e3, 2)))')} AS rmse, {_rs('avg(abs(y - f)) / 1e3')} AS mae, {_rs('quantile_cont(abs(y - f), 0.5) / 1e3')} AS medae, "
    f"{_rs('avg(power(ln(1 + y) - ln(1 + f), 2))')} AS msle, {_rs('1 - var_pop(y - f) / var_pop(y)')} AS explained, {_rs('1 - avg(power(y - f, 2)) / var_pop(y)')} AS r2, {_rs('1 - (avg(power(y - f, 2)) / var_pop(y)) * (count(*) - 1) / (count(*) - 2)')} AS r2_adj, {_rs('avg(power((y - f) / y, 2))')} AS msre FROM e"
)
def q_regression_metrics(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select((F.col("l_extendedprice")).alias("y"), (1500.0 * F.col("l_quantity")).alias("f"))
    s = stats.regression_metrics(df, "y", "f")
    return s.select("n", _r(F.col("mse") / 1e6, 4).alias("mse"), _r(F.col("rmse") / 1e3).alias("rmse"), _r(F.col("mae") / 1e3).alias("mae"), _r(F.col("medae") / 1e3).alias("medae"), *[_r(F.col(c)).alias(c) for c in ("msle", "explained", "r2", "r2_adj", "msre")])


@_query("WITH t AS (SELECT sum(p_retailprice) AS t FROM part), k AS (SELECT least(greatest(CAST(floor((p_size - 0.0) / 5.0) AS INT), 0), 9) AS bin, sum(p_retailprice) AS w FROM part GROUP BY 1) " f"SELECT bin, {_rs('(bin + 1) * 5.0', 3)} AS edge, {_rs('sum(w) OVER (ORDER BY bin)', 2)} AS cum, {_rs('1 - sum(w) OVER (ORDER BY bin) / t')} AS exceed FROM k, t")
def q_weighted_cumfreq(spark, sf_dir):
    s = stats.weighted_exceedance(_t(spark, sf_dir, "part"), "p_size", "p_retailprice", 10, 0.0, 50.0)
    return s.select("bin", _r(F.col("edge"), 3).alias("edge"), _r(F.col("cum"), 2).alias("cum"), _r(F.col("exceed")).alias("exceed"))


@_query(f"SELECT idx, x, {_rs('k / n')} AS y FROM (SELECT event_id AS idx, value AS x, CAST(row_number() OVER (ORDER BY value, event_id) AS DOUBLE) AS k, count(*) OVER () AS n FROM events)")
def q_ecdf_steps(spark, sf_dir):
    return stats.ecdf(_t(spark, sf_dir, "events"), "value", "event_id").select("idx", "x", _r(F.col("y")).alias("y"))


@_query("SELECT x, " + _rs("avg(CASE WHEN value <= x THEN 1.0e0 ELSE 0 END)") + " AS y FROM events, (VALUES (0.0e0), (10.0e0), (50.0e0), (100.0e0)) AS p(x) GROUP BY x")
def q_ecdf_at(spark, sf_dir):
    return stats.ecdf_at(_t(spark, sf_dir, "events"), "value", [0.0, 10.0, 50.0, 100.0]).select("x", _r(F.col("y")).alias("y"))


def _compressed_sql(key: str, alpha: float, y: str) -> str:
    return (
        "WITH m AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n FROM events), r AS (SELECT event_id AS idx, value AS x, row_number() OVER (ORDER BY value, event_id) AS k FROM events), "
        f"f AS (SELECT r.*, n, CAST(floor(n * (1 - {alpha}e0)) AS BIGINT) AS tail, {key} AS kk FROM r, m), g AS (SELECT *, row_number() OVER (PARTITION BY kk, k <= tail ORDER BY k) AS j FROM f) SELECT idx, x, {_rs(y)} AS y FROM g WHERE k > tail OR j = 1"
    )


@_query(_compressed_sql("round((x - lo) / (hi - lo), 2)", 0.01, "CAST(k AS DOUBLE) / n"))
def q_ecdf_compressed(spark, sf_dir):
    return stats.compressed_ecdf(_t(spark, sf_dir, "events"), "value", "event_id", 0.01).select("idx", "x", _r(F.col("y")).alias("y"))


@_query(_compressed_sql("round(x, 0)", 0.05, "1 - CAST(k AS DOUBLE) / n"))
def q_exceedance_tail(spark, sf_dir):
    return stats.exceedance(_t(spark, sf_dir, "events"), "value", "event_id", 0.05, 0).select("idx", "x", _r(F.col("y")).alias("y"))


@_query(
    "WITH w AS (SELECT event_id, user_id, value, row_number() OVER b AS k, avg(value) OVER f AS m, avg(value * value) OVER f AS s FROM events WINDOW b AS (PARTITION BY user_id ORDER BY event_id), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) "
    f"SELECT event_id, {_rs('m', 4)} AS mov_avg, {_rs('s - m * m', 3)} AS mov_var FROM w WHERE k >= 5"
)
def q_moving_stats(spark, sf_dir):
    s = tracks.moving(_t(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", ["user_id"], ["event_id"], 5)
    return s.select("event_id", _r(F.col("mov_avg"), 4).alias("mov_avg"), _r(F.col("mov_var"), 3).alias("mov_var"))


@_query(
    "WITH l AS (SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events) "
    f"SELECT user_id, count(*) AS n_up, {_rs('CASE WHEN count(*) > 1 THEN (count(*) - 1) / CAST(max(event_id) - min(event_id) AS DOUBLE) END', 9)} AS rate FROM l WHERE (value - 50) * (nx - 50) < 0 AND nx > value GROUP BY user_id"
)
def q_up_crossing(spark, sf_dir):
    s = tracks.up_crossings(_t(spark, sf_dir, "events"), "value", "event_id", ["user_id"], 50.0)
    return s.select("user_id", "n_up", _r(F.col("rate"), 9).alias("rate"))


@_query(f"SELECT user_id, {_rs('max(abs(value)) / avg(abs(value))')} AS indicator FROM events GROUP BY user_id")
def q_phase_indicator(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("user_id", F.abs("value").alias("v"))
    return stats.phase_indicator(df, "v", ["user_id"]).select("user_id", _r(F.col("indicator")).alias("indicator"))


@_query("WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS med FROM part GROUP BY p_brand) SELECT p_brand, " + _rs("med", 4) + " AS median FROM m ORDER BY med DESC, p_brand LIMIT 1")
def q_seed_median_argmax(spark, sf_dir):
    return stats.median_then_argmax(_t(spark, sf_dir, "part"), "p_retailprice", ["p_brand"]).select("p_brand", _r(F.col("median"), 4).alias("median"))


@_query("SELECT p_partkey, p_retailprice FROM part ORDER BY abs(p_retailprice - 1200), p_partkey LIMIT 1")
def q_nearest_state(spark, sf_dir):
    return stats.nearest_state(_t(spark, sf_dir, "part"), "p_retailprice", 1200.0, "p_partkey").select("p_partkey", "p_retailprice")


# -- filters and joins


_NEAR = "sqrt(power(xi_0 - {0}, 2) + power(xi_1 - {1}, 2))"
_CENTERS = [(1.5, 1.5), (-1.0, 2.0), (0.0, -2.0)]
_MIND = "least(" + ", ".join(_NEAR.format(f"({a}e0)", f"({b}e0)") for a, b in _CENTERS) + ")"


@_query(f"SELECT global_id, {_rs('d')} AS min_dist FROM (SELECT global_id, {_MIND} AS d FROM {_points_sql(2, True)}) WHERE d <= 0.4")
def q_doi_ball(spark, sf_dir):
    return geometry.ball(_points(spark, sf_dir, 2, True), ["xi_0", "xi_1"], _CENTERS, 0.4).select("global_id", _r(F.col("min_dist")).alias("min_dist"))


@_query(f"SELECT global_id, {_rs('d')} AS min_dist FROM (SELECT global_id, {_MIND} AS d FROM {_points_sql(2, True)}) ORDER BY d, global_id LIMIT 100")
def q_doi_nearest_k(spark, sf_dir):
    near = geometry.nearest_k(_points(spark, sf_dir, 2, True), ["xi_0", "xi_1"], _CENTERS, 100, "global_id")
    return near.select("global_id", _r(F.col("min_dist")).alias("min_dist"))


@_query(
    f"WITH d AS (SELECT global_id, {_MIND} AS d FROM {_points_sql(2, True)}), r AS (SELECT min(0.01 * power(2, k)) AS r FROM range(0, 9) t(k) WHERE (SELECT count(*) FROM d WHERE d <= 0.01 * power(2, k)) >= 40) "
    f"SELECT global_id, {_rs('d')} AS min_dist FROM d, r WHERE d <= r"
)
def q_doi_expand(spark, sf_dir):
    near, _, _ = geometry.neighbourhood(_points(spark, sf_dir, 2, True), ["xi_0", "xi_1"], _CENTERS, 0.01, "global_id", least=40, fallback="expand")
    return near.select("global_id", _r(F.col("min_dist")).alias("min_dist"))


@_query(
    "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) "
    f"SELECT p.vec_id, c.vec_id AS center_id, {_rs('sqrt(power(p.a - c.a, 2) + power(p.b - c.b, 2))', 5)} AS dist FROM e p JOIN e c ON c.vec_id % 20 = 0 AND power(p.a - c.a, 2) + power(p.b - c.b, 2) <= 0.01"
)
def q_near_join(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    centers = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "center_id")
    return geometry.near_join(e, centers, ["a", "b"], 0.1, "vec_id", "center_id").select("vec_id", "center_id", _r(F.col("dist"), 5).alias("dist"))


@_query(f"SELECT global_id FROM {_points_sql(2, True)} WHERE xi_0 > -0.5 AND xi_0 < 0.25 AND xi_1 > 0.1 AND xi_1 < 0.9")
def q_box_filter(spark, sf_dir):
    return geometry.box(_points(spark, sf_dir, 2, True), ["xi_0", "xi_1"], [-0.5, 0.1], [0.25, 0.9]).select("global_id")


@_query(f"SELECT global_id FROM {_points_sql(2, True)} WHERE sqrt(xi_0 * xi_0 + xi_1 * xi_1) > 1.5 AND sqrt(xi_0 * xi_0 + xi_1 * xi_1) < 2")
def q_annulus_filter(spark, sf_dir):
    return geometry.annulus(_points(spark, sf_dir, 2, True), ["xi_0", "xi_1"], 1.5, 2.0)[0].select("global_id")


@_query(f"SELECT global_id FROM {_points_sql(2, True)} WHERE power((0.6e0 * (xi_0 - 0.5) + 0.8e0 * (xi_1 - 0.2)) / 1.5, 2) + power((-0.8e0 * (xi_0 - 0.5) + 0.6e0 * (xi_1 - 0.2)) / 0.5, 2) < 1")
def q_ellipsoid_filter(spark, sf_dir):
    return geometry.ellipsoid(_points(spark, sf_dir, 2, True), ["xi_0", "xi_1"], [0.5, 0.2], [1.5, 0.5], [[0.6, 0.8], [-0.8, 0.6]]).select("global_id")


@_query("SELECT event_id FROM events WHERE event_id % 1440 >= 1380 OR event_id % 1440 <= 30")
def q_day_range(spark, sf_dir):
    return _t(spark, sf_dir, "events").where(geometry.within_day(F.col("event_id") % 1440, 1380, 30)).select("event_id")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def q_unevaluated_anti(spark, sf_dir):
    done = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return geometry.unevaluated(_t(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 7 % 1000003).alias("pos"))
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"))
    return c, o


_SETS = "c AS (SELECT c_custkey AS k, c_custkey * 7 % 1000003 AS pos FROM customer), o AS (SELECT o_custkey AS k, o_orderkey AS pos FROM orders)"


@_query(f"WITH {_SETS}, u AS (SELECT k, 0 AS side, pos FROM c UNION ALL SELECT k, 1, pos FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY side, pos) AS j FROM u) SELECT k, side, pos FROM r WHERE j = 1")
def q_ordered_union(spark, sf_dir):
    return geometry.ordered_union(*_sets(spark, sf_dir), "k")


@_query(f"WITH {_SETS} SELECT k, min(pos) AS pos FROM c WHERE k NOT IN (SELECT k FROM o) GROUP BY k")
def q_ordered_diff(spark, sf_dir):
    return geometry.ordered_difference(*_sets(spark, sf_dir), "k")


@_query(f"WITH {_SETS} SELECT k, min(pos) AS pos FROM o WHERE k IN (SELECT k FROM c WHERE k % 3 = 0) GROUP BY k")
def q_ordered_intersect(spark, sf_dir):
    c, o = _sets(spark, sf_dir)
    return geometry.ordered_intersection(o, c.where("k % 3 = 0"), "k")


@_query("SELECT CAST(count(*) FILTER (WHERE o_orderkey % 3 = 2) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 = 0) AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS outside FROM orders")
def q_complement_check(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey")
    a = o.where("o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 5 = 0)")
    return geometry.complement_check(o, a, o.where("o_orderkey % 3 = 1"), "o_orderkey")


@_query("WITH b AS (SELECT DISTINCT round(l_quantity, 2) AS a, round(l_discount, 2) AS d FROM lineitem WHERE l_orderkey % 50 = 0) SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM b WHERE b.a = round(l.l_quantity, 2) AND b.d = round(l.l_discount, 2))")
def q_coord_join_rounded(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return geometry.common_points(li, li.where("l_orderkey % 50 = 0"), ["l_quantity", "l_discount"], 2).select("l_orderkey", "l_linenumber")


@_query("SELECT round(l_quantity, 2) + 0.0 AS l_quantity, round(l_extendedprice, 0) + 0.0 AS l_extendedprice, count(*) AS count FROM lineitem GROUP BY round(l_quantity, 2), round(l_extendedprice, 0) HAVING count(*) > 1")
def q_duplicate_coords(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(stats.rounded("l_quantity", 2).alias("l_quantity"), stats.rounded("l_extendedprice", 0).alias("l_extendedprice"))
    d = geometry.duplicate_points(li, ["l_quantity", "l_extendedprice"], 2)
    return d.select((F.col("l_quantity") + 0.0).alias("l_quantity"), (F.col("l_extendedprice") + 0.0).alias("l_extendedprice"), "count")


@_query("WITH a AS (SELECT p_size AS degree, avg(p_retailprice) AS ca FROM part WHERE p_partkey % 2 = 0 AND p_size < 40 GROUP BY p_size), b AS (SELECT p_size AS degree, avg(p_retailprice) AS cb FROM part WHERE p_partkey % 2 = 1 AND p_size > 10 GROUP BY p_size), d AS (SELECT coalesce(ca, 0) - coalesce(cb, 0) AS d FROM a FULL OUTER JOIN b ON a.degree = b.degree) " f"SELECT {_rs('max(abs(d))', 4)} AS linf, {_rs('sum(abs(d))', 3)} AS l1, {_rs('sqrt(sum(d * d))', 4)} AS l2 FROM d")
def q_coef_error(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    side = lambda cond: p.where(cond).groupBy(F.col("p_size").alias("degree")).agg(F.avg("p_retailprice").alias("coefficient"))
    e = geometry.coef_error(side("p_partkey % 2 = 0 AND p_size < 40"), side("p_partkey % 2 = 1 AND p_size > 10"))
    return e.select(_r(F.col("linf"), 4).alias("linf"), _r(F.col("l1"), 3).alias("l1"), _r(F.col("l2"), 4).alias("l2"))


@_query("SELECT s_suppkey, CAST(seed_id AS INT) AS seed_id FROM supplier, (VALUES (11), (23), (47)) v(seed_id)")
def q_seed_cross(spark, sf_dir):
    return geometry.seed_cross(_t(spark, sf_dir, "supplier").select("s_suppkey"), [11, 23, 47])


# -- bases, surrogates, designs


_H = ["1.0e0", "{x}", "({x}*{x} - 1) / sqrt(2.0e0)", "({x}*{x}*{x} - 3*{x}) / sqrt(6.0e0)"]
_L = ["1.0e0", "{x} * sqrt(3.0e0)", "(3*{x}*{x} - 1) / 2 * sqrt(5.0e0)", "(5*{x}*{x}*{x} - 3*{x}) / 2 * sqrt(7.0e0)"]
_IDX = Basis("hermite_e", 2, 3).indices


def _term_sql(table: list[str], t: tuple[int, ...]) -> str:
    return " * ".join(f"({table[n].format(x=f'xi_{i}')})" for i, n in enumerate(t))


def _basis_sql(table: list[str], normal: bool) -> str:
    src = _points_sql(2, True) if normal else f"(SELECT global_id, g, 2 * xi_0 - 1 AS xi_0, 2 * xi_1 - 1 AS xi_1 FROM {_points_sql(2)})"
    return "SELECT g, " + ", ".join(f"{_rs(f'avg({_term_sql(table, t)})', 5)} AS t{k}, {_rs(f'avg(power({_term_sql(table, t)}, 2))', 4)} AS s{k}" for k, t in enumerate(_IDX)) + f" FROM {src} GROUP BY g"


def _basis_query(spark, sf_dir, family: str, normal: bool) -> DataFrame:
    df = _points(spark, sf_dir, 2, normal)
    if not normal:
        df = df.withColumns({x: 2 * F.col(x) - 1 for x in ("xi_0", "xi_1")})
    b = Basis(family, 2, 3)
    terms = b.with_powers(df, ["xi_0", "xi_1"]).select("g", *[t.alias(f"t{k}") for k, t in enumerate(b.terms())])
    return terms.groupBy("g").agg(*[x for k in range(b.size) for x in (_r(F.avg(f"t{k}"), 5).alias(f"t{k}"), _r(F.avg(F.col(f"t{k}") * F.col(f"t{k}")), 4).alias(f"s{k}"))])


@_query(_basis_sql(_H, True))
def q_basis_hermite(spark, sf_dir):
    return _basis_query(spark, sf_dir, "hermite_e", True)


@_query(_basis_sql(_L, False))
def q_basis_legendre(spark, sf_dir):
    return _basis_query(spark, sf_dir, "legendre", False)


_COEF = {0: 1.0, 1: 0.8, 4: 0.1, 5: 0.35, 8: -0.2}


@_query(f"SELECT g, count(*) AS n, {_rs('avg(y)', 5)} AS mean, {_rs('avg(CASE WHEN y <= 0 THEN 1.0e0 ELSE 0 END)')} AS pf FROM (SELECT g, " + " + ".join(f"({c}e0) * {_term_sql(_H, _IDX[k])}" for k, c in _COEF.items()) + f" AS y FROM {_points_sql(2, True)}) GROUP BY g")
def q_poly_predict(spark, sf_dir):
    s = surrogate.Surrogate(Basis("hermite_e", 2, 3), tuple(_COEF), tuple(_COEF.values()))
    y = s.predict(_points(spark, sf_dir, 2, True), ["xi_0", "xi_1"], "y")
    return y.groupBy("g").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("y"), 5).alias("mean"), _r(F.avg((F.col("y") <= 0).cast("double"))).alias("pf"))


@_query("SELECT g, " + _rs("avg(10 / (" + " + ".join(f"power({_term_sql(_H, t)}, 2)" for t in _IDX) + "))") + f" AS w FROM {_points_sql(2, True)} GROUP BY g")
def q_christoffel_weight(spark, sf_dir):
    b = Basis("hermite_e", 2, 3)
    df = b.with_powers(_points(spark, sf_dir, 2, True), ["xi_0", "xi_1"])
    return df.select("g", surrogate.christoffel_weight(b).alias("w")).groupBy("g").agg(_r(F.avg("w")).alias("w"))


_X = {"x0": "1.0e0", "x1": "l_quantity / 50", "x2": "l_discount * 10", "x3": "l_tax * 10"}


def _design_rows(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_linenumber", *[F.expr(e).cast("double").alias(n) for n, e in _X.items()], (F.col("l_extendedprice") / 1e5).alias("y"))


_ROWS = "r AS (SELECT l_linenumber, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _X.items()) + ", l_extendedprice / 1e5 AS y FROM lineitem)"


@_query(f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {_rs(f'sum({a} * {b})', 2)} AS value FROM r" for i, a in [*enumerate(_X), (-1, "y")] for j, b in [*enumerate(_X), (-1, "y")] if (i >= 0 and (j >= i or j == -1)) or (i == j == -1)))
def q_gram_matrix(spark, sf_dir):
    return linalg.gram(_design_rows(spark, sf_dir), list(_X), "y").select("i", "j", _r(F.col("value"), 2).alias("value"))


@_query(f"WITH {_ROWS} SELECT " + ", ".join(f"{_rs(f'sum({x} * {x})', 2)} AS n_{x}" for x in _X) + f", {_rs('max(abs(c))')} AS c_max FROM r, (SELECT greatest(abs(corr(x1, x2)), abs(corr(x1, x3)), abs(corr(x2, x3))) AS c FROM r)")
def q_col_norms(spark, sf_dir):
    df = _design_rows(spark, sf_dir)
    pairs = (("x1", "x2"), ("x1", "x3"), ("x2", "x3"))
    return df.agg(*[_r(F.sum(F.col(x) * F.col(x)), 2).alias(f"n_{x}") for x in _X], _r(F.greatest(*[F.abs(F.corr(a, b)) for a, b in pairs])).alias("c_max"))


@_query(f"WITH {_ROWS} SELECT {_rs('regr_intercept(y, x1)')} AS c0, {_rs('regr_slope(y, x1)')} AS c1 FROM r")
def q_ols_coef(spark, sf_dir):
    G, b, _ = linalg.gram_matrix(_design_rows(spark, sf_dir), ["x0", "x1"], "y")
    c = linalg.solve_ols(G, b)
    return spark.createDataFrame([tuple(float(v) for v in c)], "c0 double, c1 double").select(_r(F.col("c0")).alias("c0"), _r(F.col("c1")).alias("c1"))


@_query(
    f"WITH {_ROWS}, s AS (SELECT l_linenumber % 4 AS fold, count(*) AS n, sum(x1*x1) AS xx, sum(x1*y) AS xy, sum(y*y) AS yy FROM r GROUP BY 1), t AS (SELECT sum(xx) AS xx, sum(xy) AS xy FROM s) "
    f"SELECT CAST(fold AS INT) AS fold, n, {_rs('(s.yy - 2 * b * s.xy + b * b * s.xx) / n')} AS mse FROM (SELECT s.*, (t.xy - s.xy) / (t.xx - s.xx) AS b FROM s, t) s"
)
def q_kfold_mse(spark, sf_dir):
    df = _design_rows(spark, sf_dir).withColumn("fold", (F.col("l_linenumber") % 4).cast("int"))
    s = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x1") * F.col("x1")).alias("xx"), F.sum(F.col("x1") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    rows = s.collect()  # one row for each fold
    xx, xy = sum(r["xx"] for r in rows), sum(r["xy"] for r in rows)
    out = [(r["fold"], r["n"], float((r["yy"] - 2 * b * r["xy"] + b * b * r["xx"]) / r["n"])) for r in rows for b in [(xy - r["xy"]) / (xx - r["xx"])]]
    return spark.createDataFrame(out, "fold int, n long, mse double").select("fold", "n", _r(F.col("mse")).alias("mse"))


_PART = "p AS (SELECT p_partkey AS global_id, CAST(p_size AS DOUBLE) / 50 AS a, p_retailprice / 1000 AS b FROM part)"
_GAIN = "ln(1 + (a * a * g22 - 2 * a * b * g12 + b * b * g11) / (g11 * g22 - g12 * g12))"


@_query(f"WITH {_PART}, g AS (SELECT sum(a*a) AS g11, sum(a*b) AS g12, sum(b*b) AS g22 FROM p WHERE global_id IN (1, 2, 3, 4)), s AS (SELECT global_id, {_GAIN} AS gain FROM p, g WHERE global_id NOT IN (1, 2, 3, 4)) SELECT global_id FROM s ORDER BY gain DESC, global_id LIMIT 1")
def q_d_score_pick(spark, sf_dir):
    df = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("global_id"), (F.col("p_size").cast("double") / 50).alias("a"), (F.col("p_retailprice") / 1000).alias("b"))
    picks = design.greedy_distributed(df, ["a", "b"], 1, [1, 2, 3, 4], "D")
    return spark.createDataFrame([(p,) for p in picks], "global_id long")


@_query(f"WITH {_PART}, g AS (SELECT sum(a*a) AS g11, sum(a*b) AS g12, sum(b*b) AS g22 FROM p WHERE global_id IN (1, 2, 3, 4)), s AS (SELECT global_id, {_GAIN} - ln((g11 + a*a) / g11) - ln((g22 + b*b) / g22) AS gain FROM p, g WHERE global_id NOT IN (1, 2, 3, 4)) SELECT global_id FROM s ORDER BY gain DESC, global_id LIMIT 1")
def q_s_score_pick(spark, sf_dir):
    df = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("global_id"), (F.col("p_size").cast("double") / 50).alias("a"), (F.col("p_retailprice") / 1000).alias("b"))
    picks = design.greedy_distributed(df, ["a", "b"], 1, [1, 2, 3, 4], "S")
    return spark.createDataFrame([(p,) for p in picks], "global_id long")


@_query(
    f"WITH {_PART}, one AS (SELECT * FROM p ORDER BY a*a + b*b DESC, global_id LIMIT 1), "
    "two AS (SELECT p.* FROM p, one WHERE p.global_id <> one.global_id ORDER BY p.a*p.a + p.b*p.b - power(p.a*one.a + p.b*one.b, 2) / (one.a*one.a + one.b*one.b) DESC, p.global_id LIMIT 1), "
    "c AS (SELECT * FROM one UNION ALL SELECT * FROM two), g AS (SELECT sum(a*a) AS g11, sum(a*b) AS g12, sum(b*b) AS g22 FROM c), "
    f"three AS (SELECT global_id FROM p, g WHERE global_id NOT IN (SELECT global_id FROM c) ORDER BY {_GAIN} DESC, global_id LIMIT 1) "
    "SELECT CAST(1 AS BIGINT) AS place, global_id FROM one UNION ALL SELECT 2, global_id FROM two UNION ALL SELECT 3, global_id FROM three"
)
def q_design_select(spark, sf_dir):
    """A D-optimal design from nothing, by scans of the whole table: two pivots, then the best score."""
    df = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("global_id"), (F.col("p_size").cast("double") / 50).alias("a"), (F.col("p_retailprice") / 1000).alias("b"))
    picks = design.greedy_distributed(df, ["a", "b"], 3, [], "D")
    return spark.createDataFrame(list(enumerate(picks, 1)), "place long, global_id long")


_GH = Basis("hermite_e", 1, 1).gauss_nodes(4)
_NODES = "(VALUES " + ", ".join(f"({float(x)!r}e0, {float(w)!r}e0)" if "e" not in f"{float(x)!r}{float(w)!r}" else f"({float(x)!r}, {float(w)!r})" for x, w in zip(*_GH)) + ")"


@_query(f"SELECT {_rs('sum(a.w * b.w)')} AS w, {_rs('sum(a.w * b.w * power(a.x, 2) * power(b.x, 4))')} AS m24, {_rs('sum(a.w * b.w * power(a.x, 6))')} AS m6 FROM {_NODES} a(x, w), {_NODES} b(x, w)")
def q_quadrature_tensor(spark, sf_dir):
    q = sampling.quadrature(spark, Basis("hermite_e", 2, 1), 4)
    x, y, w = F.col("xi_0"), F.col("xi_1"), F.col("w")
    return q.agg(_r(F.sum(w)).alias("w"), _r(F.sum(w * x * x * y * y * y * y)).alias("m24"), _r(F.sum(w * F.pow(x, F.lit(6.0)))).alias("m6"))


@_query("SELECT * FROM (VALUES (0, 1.0e0), (1, 0.8e0), (2, 0.0e0), (3, 0.0e0), (4, 0.1e0), (5, " + repr(round(0.35 * 2**0.5, 6)) + "e0)) v(basis_id, coefficient)")
def q_quadrature_projection(spark, sf_dir):
    """Coefficients of a quadratic model, known exactly."""
    nodes = sampling.quadrature(spark, Basis("hermite_e", 2, 1), 4)
    nodes = nodes.withColumn("y", evaluate("quadratic_mix", ["xi_0", "xi_1"]))
    b = Basis("hermite_e", 2, 2)
    s = surrogate.fit_quadrature(nodes, b, ["xi_0", "xi_1"], "y")
    by = {t: c for t, c in zip(b.indices, s.coefficients)}
    order = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]
    return spark.createDataFrame([(k, round(by[t], 6) + 0.0) for k, t in enumerate(order)], "basis_id int, coefficient double")


# -- spectra, sites


_JS = "(5.0e0 / 16 * hs * hs * power(wp, 4) * power(w, -5) * exp(-1.25e0 * power(w / wp, -4)) * (1 - 0.287e0 * ln(3.3e0)) * power(3.3e0, exp(-0.5e0 * power((w - wp) / (CASE WHEN w > wp THEN 0.09e0 ELSE 0.07e0 END) / wp, 2))))"


@_query(
    f"WITH p AS (SELECT s_suppkey AS id, 1 + (s_suppkey % 9) AS hs, 6.283185307179586e0 / (6 + s_suppkey % 10) AS wp FROM supplier), f AS (SELECT id, k * 0.02e0 AS w, CASE WHEN k = 0 THEN 0 ELSE {_JS.replace('w /', 'w1 /').replace('power(w,', 'power(w1,').replace('(w - wp)', '(w1 - wp)').replace('w > wp', 'w1 > wp')} END AS s FROM (SELECT p.*, k, greatest(k, 1) * 0.02e0 AS w1 FROM p, range(0, 151) t(k))) "
    f"SELECT id, {_rs('sum(s) * 0.02', 5)} AS m0, {_rs('sum(w * w * s) * 0.02', 5)} AS m2, {_rs('6.283185307179586e0 * sqrt(sum(s) / sum(w * w * s))', 4)} AS tz FROM f GROUP BY id"
)
def q_jonswap_moments(spark, sf_dir):
    p = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (1 + F.col("s_suppkey") % 9).cast("double").alias("hs"), (6 + F.col("s_suppkey") % 10).cast("double").alias("tp"))
    f = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(150)))).withColumn("w", F.col("k") * 0.02).withColumn("s", series.jonswap(F.col("w"), F.col("hs"), F.col("tp")))
    m = series.spectral_moments(f, "w", "s", ["id"], 0.02)
    return m.select("id", _r(F.col("m0"), 5).alias("m0"), _r(F.col("m2"), 5).alias("m2"), _r(F.col("tz"), 4).alias("tz"))


@_query(f"SELECT p_partkey, {_rs('0.4010e0 + 2.007e0 * power(-ln(1 - u), 1 / 1.667e0)')} AS hs, {_rs('CASE WHEN x <= 0.4010e0 THEN 0 ELSE 1 - exp(-power((x - 0.4010e0) / 2.007e0, 1.667e0)) END')} AS cdf FROM (SELECT p_partkey, (p_partkey % 997 + 0.5e0) / 997 AS u, CAST(p_size AS DOUBLE) / 8 + 0.41 AS x FROM part)")
def q_site_wave_height(spark, sf_dir):
    df = _t(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 997 + 0.5) / 997).alias("u"), (F.col("p_size").cast("double") / 8 + 0.41).alias("x"))
    height = dist.site("buoy_46022")[0]([])
    return df.select("p_partkey", _r(height.ppf(F.col("u"))).alias("hs"), _r(height.cdf(F.col("x"))).alias("cdf"))


# -- index defects: counts by joins


@_query("WITH p AS (SELECT o_orderkey AS id, (o_orderkey * 7919 + 13) % 1000003 AS a, (o_orderkey * 104729 + 7) % 1000003 AS b FROM orders), x AS (SELECT id, row_number() OVER (ORDER BY a, id) AS ra, row_number() OVER (ORDER BY b, id) AS rb FROM p) SELECT count(*) AS n, count(*) FILTER (WHERE ra <> rb) AS mismatches FROM x")
def q_index_defect(spark, sf_dir):
    """Positions at which two random orders of one pool hold different ids."""
    p = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7919 + 13) % 1000003).alias("a"), ((F.col("o_orderkey") * 104729 + 7) % 1000003).alias("b"))
    a = stats.ordered(p, ["a", "id"], "ra").select("id", "ra")
    b = stats.ordered(p, ["b", "id"], "rb").select("id", "rb")
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ra") != F.col("rb")).cast("long")).alias("mismatches"))


# -- more of the operators, on line items, parts and events


@_query(
    f"WITH {_ROWS}, s AS (SELECT count(*) AS n, sum(x1*x1) AS g, sum(x1*y) AS b, var_pop(y) AS v FROM r) SELECT {_rs('avg(power((y - b / g * x1) / (1 - x1 * x1 / g), 2)) / max(v)', 8)} AS loo FROM r, s"
)
def q_loo_error(spark, sf_dir):
    """Leave-one-out error of a line through the origin, by its hat values."""
    e = linalg.loo_error(_design_rows(spark, sf_dir), ["x1"], "y")
    return spark.createDataFrame([(e,)], "loo double").select(_r(F.col("loo"), 8).alias("loo"))


@_query(f"WITH {_ROWS}, g AS (SELECT sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x2*x2) AS c FROM r) SELECT {_rs('sqrt((a + c + sqrt(power(a - c, 2) + 4 * b * b)) / (a + c - sqrt(power(a - c, 2) + 4 * b * b)))', 5)} AS kappa FROM g")
def q_condition_number(spark, sf_dir):
    G, _, _ = linalg.gram_matrix(_design_rows(spark, sf_dir), ["x1", "x2"])
    return spark.createDataFrame([(linalg.condition_number(G),)], "kappa double").select(_r(F.col("kappa"), 5).alias("kappa"))


_H4, _SK, _KU = "((sqrt(1 + 1.5e0 * 1.2e0) - 1) / 18)", "0.4e0", "4.2e0"
_H3 = f"({_SK} / (6 * (1 + 6 * {_H4})))"


@_query(f"SELECT g, {_rs('avg(2 + 3 * (z + ' + _H3 + ' * (z * z - 1) + ' + _H4 + ' * (z * z * z - 3 * z)) / sqrt(1 + 2 * ' + _H3 + ' * ' + _H3 + ' + 6 * ' + _H4 + ' * ' + _H4 + '))', 5)} AS mean, {_rs('max(2 + 3 * (z + ' + _H3 + ' * (z * z - 1) + ' + _H4 + ' * (z * z * z - 3 * z)) / sqrt(1 + 2 * ' + _H3 + ' * ' + _H3 + ' + 6 * ' + _H4 + ' * ' + _H4 + '))', 5)} AS most FROM (SELECT g, xi_0 AS z FROM {_points_sql(1, True)}) GROUP BY g")
def q_hermite_moment(spark, sf_dir):
    df = _points(spark, sf_dir, 1, True)
    v = stats.hermite_moment(F.col("xi_0"), F.lit(2.0), F.lit(3.0), F.lit(0.4), F.lit(4.2))
    return df.select("g", v.alias("v")).groupBy("g").agg(_r(F.avg("v"), 5).alias("mean"), _r(F.max("v"), 5).alias("most"))


@_query("SELECT global_id, " + _rs("-2 + 5 * xi_0") + " AS a, " + _rs("1 - 3 * ln(-ln(xi_1))", 5) + f" AS b FROM {_points_sql(2)}")
def q_map_domain(spark, sf_dir):
    """Uniform inputs carried to another interval and to a Gumbel marginal."""
    df = _points(spark, sf_dir, 2)
    u = dist.uniform(0, 1)
    a, b = dist.map_domain(F.col("xi_0"), u, dist.uniform(-2, 5)), dist.map_domain(F.col("xi_1"), u, dist.Marginal("gumbel", (1.0, 3.0)))
    return df.select("global_id", _r(a).alias("a"), _r(b, 5).alias("b"))


@_query(
    "WITH k AS (SELECT user_id, CAST(event_id AS DOUBLE) AS t, value AS v FROM events), e AS (SELECT user_id, t, v, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY t)), "
    "g AS (SELECT user_id, min(t) + 0.37e0 * (max(t) - min(t)) AS t FROM k GROUP BY user_id HAVING count(*) > 1) "
    f"SELECT g.user_id, {_rs('g.t', 4)} AS t, {_rs('e.v + (e.v2 - e.v) * (g.t - e.t) / (e.t2 - e.t)', 4)} AS value FROM g JOIN e ON g.user_id = e.user_id AND g.t >= e.t AND g.t < e.t2"
)
def q_interpolation(spark, sf_dir):
    k = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("t"), F.col("value"))
    g = k.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("user_id", (F.col("a") + 0.37 * (F.col("b") - F.col("a"))).alias("t"))
    return tracks.interpolate(g, k, "t", "value", ["user_id"]).select("user_id", _r(F.col("t"), 4).alias("t"), _r(F.col("value"), 4).alias("value"))


@_query("WITH c AS (SELECT p_size AS id, avg(p_retailprice) - 1400 AS c FROM part GROUP BY p_size), r AS (SELECT id, sum(c * c) OVER (ORDER BY c * c DESC, id ROWS UNBOUNDED PRECEDING) AS s, sum(c * c) OVER () AS t, c * c AS q FROM c) SELECT id, " + _rs("s / t") + " AS share FROM r WHERE (s - q) / t < 0.8")
def q_variance_share(spark, sf_dir):
    c = _t(spark, sf_dir, "part").groupBy(F.col("p_size").alias("id")).agg((F.avg("p_retailprice") - 1400).alias("c"))
    return stats.variance_share(c, "c", "id", 0.8).select("id", _r(F.col("share")).alias("share"))


@_query("WITH c AS (SELECT s_suppkey AS id, s_suppkey % 40 AS k FROM supplier), t AS (SELECT k * 0.05e0 AS w, k * k AS amp FROM range(0, 30) r(k)) SELECT c.id, CAST(coalesce(amp, -1) AS BIGINT) AS amp FROM c LEFT JOIN t ON CAST(round(t.w / 0.05) AS BIGINT) = c.k")
def q_transfer_lookup(spark, sf_dir):
    """A transfer function looked up on a frequency grid, within its cell."""
    t = spark.range(30).select((F.col("id") * 0.05).alias("w"), (F.col("id") * F.col("id")).alias("amp"))
    df = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40 * 0.05).alias("w"))
    return series.on_grid(df, t, "w", 0.05).select("id", F.coalesce("amp", F.lit(-1)).cast("long").alias("amp"))


@_query(f"SELECT global_id, {_rs('4 * xi_0 + 1')} AS xi_0, {_rs('0.5 * xi_1 + 2')} AS xi_1 FROM {_points_sql(2)}")
def q_affine_inputs(spark, sf_dir):
    df = sampling.affine(_points(spark, sf_dir, 2), ["xi_0", "xi_1"], [1.0, 2.0], [4.0, 0.5])
    return df.select("global_id", _r(F.col("xi_0")).alias("xi_0"), _r(F.col("xi_1")).alias("xi_1"))


@_query("SELECT event_type, user_id % 7 AS k, count(*) AS n, count(*) FILTER (WHERE value <= 20) AS failures FROM events GROUP BY ALL")
def q_failures_by_group(spark, sf_dir):
    """What a failure probability is made of, by group: counts merge, in batch and in streams."""
    df = _t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("k"), "value")
    return df.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") <= 20).cast("long")).alias("failures"))


@_query()
def q_lars_surrogate(spark, sf_dir):
    """Terms and coefficients of a sparse surrogate of a quadratic model, fitted on all line items."""
    df = _points(spark, sf_dir, 2, True).withColumn("y", evaluate("quadratic_mix", ["xi_0", "xi_1"]))
    s = surrogate.fit_lars(df, Basis("hermite_e", 2, 3), ["xi_0", "xi_1"], "y")
    return spark.createDataFrame([(int(k), round(float(c), 6)) for k, c in zip(s.active, s.coefficients)], "basis_id int, coefficient double")


@_query()
def q_surge_response(spark, sf_dir):
    s = series.short_term_maxima(series.surge_response(_sea(spark, sf_dir), "hs", "tp", [(0.2, 0.1), (0.6, 1.0), (2.0, 0.1)]), 20.0)
    return s.select("sample_id", "seed_id", _r(F.col("y_max")).alias("y_max"))


# -- sampling: properties that hold for any seed


@_query("SELECT CAST(2 AS BIGINT) AS dims, CAST(500 AS BIGINT) AS strata, true AS one_each")
def q_lhs_strata(spark, sf_dir):
    """Every stratum of every dimension holds one point."""
    s = sampling.lhs(spark, 2, 500, 11)
    cells = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col(f"xi_{k}") * 500).alias("c")) for k in range(2)])).alias("s"))
    c = cells.groupBy("s.k", "s.c").count()
    return c.agg(F.countDistinct("k").alias("dims"), F.countDistinct("c").alias("strata"), (F.max("count") == 1).alias("one_each"))


@_query("SELECT CAST(2 AS BIGINT) AS dims, CAST(1024 AS BIGINT) AS n, CAST(1 AS BIGINT) AS fullest")
def q_sobol_strata(spark, sf_dir):
    """1024 points of the digital sequence: one in each of 1024 equal intervals of each dimension."""
    s = sampling.sobol(spark, 2, 1024)
    c = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col(f"xi_{k}") * 1024).alias("c")) for k in range(2)])).alias("s")).groupBy("s.k", "s.c").count()
    return c.agg(F.countDistinct("k").alias("dims"), F.countDistinct("c").alias("n"), F.max("count").alias("fullest"))


@_query()
def q_monte_carlo_moments(spark, sf_dir):
    s = sampling.monte_carlo(spark, [dist.norm(), dist.uniform(-1, 2), dist.lognorm(0, 0.25), dist.weibull(1.5)], 20_000, 3)
    return s.agg(*[_r(F.avg(f"xi_{k}")).alias(f"m{k}") for k in range(4)], *[_r(F.stddev_pop(f"xi_{k}")).alias(f"s{k}") for k in range(4)])


@_query()
def q_christoffel_samples(spark, sf_dir):
    parts = [sampling.christoffel(spark, k, 2, 5000, 5).select(F.lit(k).alias("kind"), F.sqrt(F.pow("xi_0", F.lit(2.0)) + F.pow("xi_1", F.lit(2.0))).alias("r")) for k in ("cls1", "cls2", "cls4")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), _r(F.max("r")).alias("r_max"), _r(F.avg("r")).alias("r_mean"))


@_query()
def q_uniform_ball(spark, sf_dir):
    s = sampling.uniform_ball(spark, 3, 10_000, 2.0, 1)
    return s.agg(_r(F.max(F.sqrt(geometry.distance2(["xi_0", "xi_1", "xi_2"], [0, 0, 0])))).alias("r_max"), _r(F.avg(geometry.distance2(["xi_0", "xi_1", "xi_2"], [0, 0, 0]))).alias("r2"))


@_query()
def q_bootstrap_means(spark, sf_dir):
    b = sampling.bootstrap(_t(spark, sf_dir, "events").select(F.col("event_id").alias("global_id"), "value"), "value", 20, 1)
    return b.select("rep", "n", _r(F.col("mean"), 4).alias("mean"))


@_query()
def q_environment_contour(spark, sf_dir):
    beta, _ = dist.contour(50, 1, 4)
    return sampling.contour(spark, dist.site("kvitebjorn"), beta, 72).select("global_id", *[_r(F.col(f"x_{k}")).alias(f"x_{k}") for k in range(2)])


@_query()
def q_sea_states(spark, sf_dir):
    parts = [sampling.sea_states(spark, dist.site(s)[:2], 5000, 2).agg(F.lit(s).alias("site"), _r(F.avg("x_0")).alias("h"), _r(F.avg("x_1")).alias("t")) for s in ("kvitebjorn", "buoy_46022", "norway5_2d", "norway5_3d")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sea(spark, sf_dir) -> DataFrame:
    return geometry.seed_cross(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"), (2.0 + F.col("s_suppkey") % 5).alias("hs"), (8.0 + F.col("s_suppkey") % 4).alias("tp")), [1, 2])


@_query()
def q_linear_oscillator(spark, sf_dir):
    s = series.short_term_maxima(series.linear_response(_sea(spark, sf_dir), "hs", "tp"), 20.0)
    return s.select("sample_id", "seed_id", _r(F.col("y_max")).alias("y_max"))


@_query()
def q_duffing_oscillator(spark, sf_dir):
    s = series.short_term_maxima(series.duffing(_sea(spark, sf_dir), "hs", "tp"), 20.0)
    return s.select("sample_id", "seed_id", _r(F.col("y_max")).alias("y_max"))


# -- adaptive runs on frozen pools


def _run_query(kind: str, name: str) -> None:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        from haruspex.operators.adaptive import trace_table
        from haruspex.plans import scenarios

        return trace_table(spark, (scenarios.small if kind == "small" else scenarios.reduced)(spark, name))

    QUERIES[f"adaptive_{name}"] = q


for _k, _names in (("small", ("converged", "max_order", "overfit_fallback", "runtime_failure")), ("reduced", ("four_branch", "gayton", "ishigami"))):
    for _name in _names:
        _run_query(_k, _name)


@_query()
def q_adaptive_lineitem(spark, sf_dir):
    """The observations of a run whose pool and test points are all line items, by transaction."""
    from haruspex.plans import scenarios

    run = scenarios.over_points(_points(spark, sf_dir, 2, True).drop("g"), "four_branch")
    return run.observations().select("global_id", "txn", "place", _r(F.col("y")).alias("y"))


@_query(f"SELECT invariant, CAST(0 AS BIGINT) AS findings, (SELECT count(*) FROM lineitem) AS points FROM (VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in _INVARIANTS) + ") v(invariant)")
def q_adaptive_invariants(spark, sf_dir):
    """What a run over all line items breaks of each invariant: nothing."""
    from haruspex.operators.adaptive import invariants
    from haruspex.plans import scenarios

    points = _points(spark, sf_dir, 2, True).drop("g")
    found = invariants(scenarios.over_points(points, "four_branch")).groupBy("invariant").count()
    named = spark.createDataFrame([(x,) for x in _INVARIANTS], "invariant string")
    return named.join(found, "invariant", "left").crossJoin(points.agg(F.count(F.lit(1)).alias("points"))).select("invariant", F.coalesce("count", F.lit(0)).cast("long").alias("findings"), "points")


@_query("SELECT * FROM (VALUES ('four_branch', CAST(4096 AS BIGINT), 0.002685546875e0), ('gayton', CAST(4096 AS BIGINT), 0.108642578125e0)) v(pool, n, pf)")
def q_reference_pf(spark, sf_dir):
    """Failure probabilities of the frozen reference points."""
    from haruspex.sources.frozen import pool, table

    out = None
    for name, model in (("four_branch", "four_branch"), ("gayton", "gayton_shifted")):
        t = table(spark, {"reference": pool(name)["reference"]})
        s = t.agg(F.lit(name).alias("pool"), F.count(F.lit(1)).alias("n"), F.avg((evaluate(model, ["xi_0", "xi_1"]) <= 0).cast("double")).alias("pf"))
        out = s if out is None else out.unionByName(s)
    return out


from haruspex.plans import numerics as _numerics, scale as _scale  # noqa: E402,F401  (they register their queries)
