"""Queries of the operators for hot groups, long series and steep designs, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haruspex.operators import orthogonal, selection, spectra, stats, tracks
from haruspex.plans.catalogue import _points, _points_sql, _query, _r, _rs, _t

# -- a design whose second column is nearly its first: condition about 1e9

_STEEP = 1e-9


def _steep(spark, sf_dir):
    p = _points(spark, sf_dir, 3, True)
    rows = p.select(F.col("xi_0").alias("a"), (F.col("xi_0") + F.lit(_STEEP) * F.col("xi_1")).alias("b"), "xi_1", "xi_2")
    return rows.select("a", "b", (3.0 * F.col("a") + 2.0 * F.col("xi_1") + 0.1 * F.col("xi_2")).alias("y"))


# the difference of the columns is exact, so the well-conditioned pair (a, d) has the same least squares
_STEEP_SQL = (
    f"WITH r AS (SELECT xi_0 AS a, ((xi_0 + {_STEEP!r} * xi_1) - xi_0) / {_STEEP!r} AS d, xi_0 + {_STEEP!r} * xi_1 AS b, 3e0 * xi_0 + 2e0 * xi_1 + 0.1e0 * xi_2 AS y FROM {_points_sql(3, True)}), "
    "g AS (SELECT sum(a*a) AS aa, sum(a*d) AS ad, sum(d*d) AS dd, sum(a*y) AS ay, sum(d*y) AS dy, sum(b*b) AS bb, sum(a*b) AS ab FROM r) "
)


@_query(_STEEP_SQL + f"SELECT {_rs('(aa * dy - ad * ay) / (aa * dd - ad * ad)', 4)} AS steep, {_rs('(dd * ay - ad * dy) / (aa * dd - ad * ad)', 3)} AS both FROM g")
def q_steep_ols(spark, sf_dir):
    """Least squares of nearly equal columns: the second one's coefficient in units of 1e9, and the sum of both."""
    beta, _ = orthogonal.solve(orthogonal.triangular(_steep(spark, sf_dir), ["a", "b", "y"]))
    return spark.createDataFrame([(float(beta[1] * _STEEP), float(beta[0] + beta[1]))], "steep double, both double").select(_r(F.col("steep"), 4).alias("steep"), _r(F.col("both"), 3).alias("both"))


@_query(_STEEP_SQL + f"SELECT {_rs('(aa + bb + sqrt(power(aa - bb, 2) + 4 * ab * ab)) / 2 / sqrt(aa * dd - ad * ad)', 5)} AS kappa FROM g")
def q_steep_condition(spark, sf_dir):
    """The condition of that design in units of 1e9."""
    kappa = orthogonal.condition_number(orthogonal.triangular(_steep(spark, sf_dir), ["a", "b"]))
    return spark.createDataFrame([(kappa * _STEEP,)], "kappa double").select(_r(F.col("kappa"), 5).alias("kappa"))


_LOO = "WITH r AS (SELECT l_quantity / 50 AS x1, l_discount * 10 AS x2, l_extendedprice / 1e5 AS y FROM lineitem), g AS (SELECT sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x2*x2) AS c, sum(x1*y) AS u, sum(x2*y) AS v FROM r), s AS (SELECT a, b, c, a*c - b*b AS d, (c*u - b*v) / (a*c - b*b) AS k1, (a*v - b*u) / (a*c - b*b) AS k2 FROM g) "


@_query(_LOO + f"SELECT {_rs('avg(power((y - k1 * x1 - k2 * x2) / (1 - (c * x1 * x1 - 2 * b * x1 * x2 + a * x2 * x2) / d), 2)) / var_pop(y)', 8)} AS loo FROM r, s")
def q_loo_two_terms(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_extendedprice") / 1e5).alias("y"))
    return spark.createDataFrame([(orthogonal.leave_one_out(rows, ["x1", "x2"], "y"),)], "loo double").select(_r(F.col("loo"), 8).alias("loo"))


# -- order statistics by group; a group may hold most of the rows

_HOT = "CASE WHEN user_id % 10 = 0 THEN user_id ELSE -1 END"
_PROBS = (0.05, 0.5, 0.999)


def _mq(p: float, name: str) -> str:
    pos = f"(n * {p}e0 + {0.4 + p * 0.2!r}e0)"
    k = f"CAST(floor(least(greatest({pos}, 1), greatest(n - 1, 1))) AS BIGINT)"
    g = f"least(greatest({pos} - {k}, 0), 1)"
    return _rs(f"(1 - max({g})) * max(CASE WHEN k = {k} THEN value END) + max({g}) * max(CASE WHEN k = least({k} + 1, n) THEN value END)", 6) + f" AS {name}"


@_query(f"WITH s AS (SELECT CAST({_HOT} AS BIGINT) AS series, value FROM events WHERE value IS NOT NULL), r AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value) AS k, count(*) OVER (PARTITION BY series) AS n FROM s) SELECT series, " + ", ".join(_mq(p, f"q{i}") for i, p in enumerate(_PROBS)) + " FROM r GROUP BY series")
def q_mquantiles_by(spark, sf_dir):
    """Quantiles of every series of events, of which one holds most."""
    df = _t(spark, sf_dir, "events").select(F.expr(f"CAST({_HOT} AS BIGINT)").alias("series"), "value")
    return stats.mquantiles(df, "value", list(_PROBS), ["series"]).select("series", *[_r(F.col(f"q{i}")).alias(f"q{i}") for i in range(len(_PROBS))])


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, " + _rs("quantile_cont(l_extendedprice, 0.5)", 4) + " AS median FROM lineitem GROUP BY ALL")
def q_grouped_medians(spark, sf_dir):
    m = selection.medians(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return m.select("l_returnflag", "l_linestatus", "n", _r(F.col("median"), 4).alias("median"))


# -- long series


def _hot(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.expr(f"CAST({_HOT} AS BIGINT)").alias("series"), "event_id", F.col("event_id").cast("double").alias("t"), "value")


@_query(
    f"WITH e AS (SELECT CAST({_HOT} AS BIGINT) AS series, event_id, value FROM events), w AS (SELECT event_id, row_number() OVER b AS k, avg(value) OVER f AS m, avg(value * value) OVER f AS s FROM e WINDOW b AS (PARTITION BY series ORDER BY event_id), f AS (PARTITION BY series ORDER BY event_id ROWS BETWEEN 96 PRECEDING AND CURRENT ROW)) "
    f"SELECT event_id, {_rs('m', 4)} AS mov_avg, {_rs('s - m * m', 3)} AS mov_var FROM w WHERE k >= 97"
)
def q_moving_hot(spark, sf_dir):
    """A moving window of 97 events over series of which one holds most."""
    s = tracks.moving(_hot(spark, sf_dir), "value", ["series"], ["event_id"], 97)
    return s.select("event_id", _r(F.col("mov_avg"), 4).alias("mov_avg"), _r(F.col("mov_var"), 3).alias("mov_var"))


@_query(
    f"WITH e AS (SELECT CAST({_HOT} AS BIGINT) AS series, event_id, value FROM events), l AS (SELECT series, event_id, value, lead(value) OVER (PARTITION BY series ORDER BY event_id) AS nx FROM e) "
    f"SELECT series, count(*) AS n_up, {_rs('CASE WHEN count(*) > 1 THEN (count(*) - 1) / CAST(max(event_id) - min(event_id) AS DOUBLE) END', 9)} AS rate FROM l WHERE (value - 50) * (nx - 50) < 0 AND nx > value GROUP BY series"
)
def q_up_crossing_hot(spark, sf_dir):
    s = tracks.up_crossings(_hot(spark, sf_dir), "value", "event_id", ["series"], 50.0)
    return s.select("series", "n_up", _r(F.col("rate"), 9).alias("rate"))


@_query(f"SELECT CAST({_HOT} AS BIGINT) AS series, count(*) AS knots, 0.0e0 AS worst, 0.0e0 AS ends FROM events GROUP BY ALL")
def q_spline_equations(spark, sf_dir):
    """What the splines of the series leave of the equations that define them (a continuous slope, no bend at the ends): nothing."""
    s = tracks.splines(_hot(spark, sf_dir), "t", "value", ["series"])
    run = W.partitionBy("series").orderBy("t")
    s = s.withColumns({f"{c}_{k}": f(c).over(run) for k, f in (("a", F.lag), ("b", F.lead)) for c in ("t", "value", "bend")})
    h, g = F.col("t") - F.col("t_a"), F.col("t_b") - F.col("t")
    left = h * F.col("bend_a") + 2 * (h + g) * F.col("bend") + g * F.col("bend_b") - 6 * ((F.col("value_b") - F.col("value")) / g - (F.col("value") - F.col("value_a")) / h)
    edge = F.when(F.col("t_a").isNull() | F.col("t_b").isNull(), F.abs("bend"))
    return s.groupBy("series").agg(F.count(F.lit(1)).alias("knots"), _r(F.coalesce(F.max(F.abs(left)), F.lit(0.0)), 6).alias("worst"), _r(F.max(edge), 6).alias("ends"))


_GRID = 0.37


@_query(
    "WITH RECURSIVE n AS (SELECT user_id AS s, CAST(event_id AS DOUBLE) AS t, value AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, lag(CAST(event_id AS DOUBLE)) OVER w AS t0, lead(CAST(event_id AS DOUBLE)) OVER w AS t1, lag(value) OVER w AS v0, lead(value) OVER w AS v1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "q AS (SELECT s, k, n, t, v, t1, v1, CASE WHEN k > 1 AND k < n THEN (t - t0) / (t1 - t0) ELSE 0 END AS a, CASE WHEN k > 1 AND k < n THEN (t1 - t) / (t1 - t0) ELSE 0 END AS c, CASE WHEN k > 1 AND k < n THEN 6 * ((v1 - v) / (t1 - t) - (v - v0) / (t - t0)) / (t1 - t0) ELSE 0 END AS d FROM n), "
    "down(s, k, c, d) AS (SELECT s, k, c / 2, d / 2 FROM q WHERE k = 1 UNION ALL SELECT q.s, q.k, q.c / (2 - q.a * f.c), (q.d - q.a * f.d) / (2 - q.a * f.c) FROM down f JOIN q ON q.s = f.s AND q.k = f.k + 1), "
    "up(s, k, m) AS (SELECT f.s, f.k, f.d FROM down f JOIN q ON q.s = f.s AND q.k = f.k AND q.k = q.n UNION ALL SELECT f.s, f.k, f.d - f.c * u.m FROM up u JOIN down f ON f.s = u.s AND f.k = u.k - 1), "
    f"g AS (SELECT user_id AS s, min(event_id) + {_GRID}e0 * (max(event_id) - min(event_id)) AS x FROM events GROUP BY user_id HAVING count(*) > 1), "
    "e AS (SELECT g.s, g.x, q.t, q.v, q.t1, q.v1, m0.m AS ma, m1.m AS mb, (q.t1 - g.x) / (q.t1 - q.t) AS aa, (g.x - q.t) / (q.t1 - q.t) AS bb FROM g JOIN q ON q.s = g.s AND g.x >= q.t AND g.x < q.t1 JOIN up m0 ON m0.s = q.s AND m0.k = q.k JOIN up m1 ON m1.s = q.s AND m1.k = q.k + 1) "
    f"SELECT s AS user_id, {_rs('x', 4)} AS t, {_rs('aa * v + bb * v1 + ((aa * aa * aa - aa) * ma + (bb * bb * bb - bb) * mb) * power(t1 - t, 2) / 6', 4)} AS value FROM e"
)
def q_spline_interpolation(spark, sf_dir):
    """Each user's events by a natural cubic spline, at one time in the series."""
    k = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("t"), "value")
    g = k.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("user_id", (F.col("a") + _GRID * (F.col("b") - F.col("a"))).alias("t"))
    return tracks.interpolate(g, k, "t", "value", ["user_id"], "cubic").select("user_id", _r(F.col("t"), 4).alias("t"), _r(F.col("value"), 4).alias("value"))


# -- spectra of long series

_LEN = 16
_DFT = (
    f"WITH e AS (SELECT CAST({_HOT} AS BIGINT) AS series, value AS v, row_number() OVER (PARTITION BY {_HOT} ORDER BY event_id) - 1 AS place FROM events), "
    f"c AS (SELECT series, place // {_LEN // 2} AS seg, place % {_LEN // 2} AS i, v FROM e UNION ALL SELECT series, place // {_LEN // 2} - 1, place % {_LEN // 2} + {_LEN // 2}, v FROM e WHERE place >= {_LEN // 2}), "
    f"z AS (SELECT series, seg, i, (v - avg(v) OVER (PARTITION BY series, seg)) * (0.5e0 - 0.5e0 * cos(2 * pi() * i / {_LEN})) AS x FROM c QUALIFY count(*) OVER (PARTITION BY series, seg) = {_LEN}), "
    f"p AS (SELECT series, seg, j, power(sum(x * cos(2 * pi() * i * j / {_LEN})), 2) + power(sum(x * sin(2 * pi() * i * j / {_LEN})), 2) AS p FROM z, range(0, {_LEN // 2 + 1}) t(j) GROUP BY ALL), "
    f"s AS (SELECT series, j, count(*) AS segments, avg(p) * (CASE WHEN j IN (0, {_LEN // 2}) THEN 1 ELSE 2 END) / {0.375 * _LEN!r}e0 AS density FROM p GROUP BY series, j) "
)


@_query(_DFT + f"SELECT series, CAST(j AS INTEGER) AS j, {_rs(f'j / {_LEN}e0')} AS frequency, {_rs('density', 4)} AS density, segments FROM s")
def q_event_spectrum(spark, sf_dir):
    """Averaged spectra of series of events, of which one holds most."""
    s = spectra.spectrum(_hot(spark, sf_dir), "value", ["series"], ["event_id"], _LEN)
    return s.select("series", "j", _r(F.col("frequency")).alias("frequency"), _r(F.col("density"), 4).alias("density"), "segments")


_HALVED = f"density / (CASE WHEN j IN (0, {_LEN // 2}) THEN 1 ELSE 2 END)"


@_query(
    _DFT + f", h AS (SELECT series, j, {_HALVED} * (CASE WHEN j IN (0, {_LEN // 2}) THEN 1 ELSE 2 END) AS w FROM s), r AS (SELECT series, lag, sum(w * cos(2 * pi() * j * lag / {_LEN})) AS r, sum(w) AS r0 FROM h, range(0, {_LEN // 2 + 1}) t(lag) GROUP BY ALL) "
    f"SELECT series, CAST(lag AS INTEGER) AS lag, {_rs('CASE WHEN r0 > 0 THEN r / r0 ELSE 0 END', 5)} AS r FROM r"
)
def q_event_autocorrelation(spark, sf_dir):
    s = spectra.spectrum(_hot(spark, sf_dir), "value", ["series"], ["event_id"], _LEN)
    return spectra.autocorrelation(s, ["series"], _LEN).select("series", "lag", _r(F.col("r"), 5).alias("r"))


# -- the least ellipsoid, and domains of interest by a level

_CORE = ["a", "b", "c"]


def _coordinates(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(_CORE)])


@_query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside, true AS least, true AS touched FROM embeddings")
def q_least_ellipsoid(spark, sf_dir):
    """Of the least ellipsoid around all embeddings' first components: what lies outside, whether its gap proves it least, and whether points are on it."""
    from haruspex.operators.ellipsoid import least_ellipsoid

    points = _coordinates(spark, sf_dir)
    e = least_ellipsoid(points, _CORE, 1e-6)
    m = e.measure(_CORE)
    return points.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(m > 1 + 1e-9, 1)).alias("outside"), F.lit(e.gap <= 1e-6).alias("least"), (F.count(F.when(m > 1 - 1e-4, 1)) >= len(_CORE) + 1).alias("touched"))


_LEVEL, _WIDE = 50000.0, 0.05
_NEAR = (
    f"WITH p AS (SELECT global_id, xi_0, xi_1, 4e4 + 2e4 * xi_0 * xi_0 + 1e4 * xi_1 AS y FROM (SELECT global_id, min(xi_0) AS xi_0, min(xi_1) AS xi_1 FROM {_points_sql(2, True)} GROUP BY global_id)), c AS (SELECT * FROM p ORDER BY abs(y - {_LEVEL}), global_id LIMIT 10), "
    "d AS (SELECT p.global_id, c.global_id AS at, sqrt(power(p.xi_0 - c.xi_0, 2) + power(p.xi_1 - c.xi_1, 2)) AS d FROM p, c), "
    f"n AS (SELECT global_id, min(d) AS d FROM d GROUP BY global_id HAVING min(d) < {_WIDE}) "
)


def _level(spark, sf_dir):
    once = _points(spark, sf_dir, 2, True).groupBy("global_id").agg(F.min("xi_0").alias("xi_0"), F.min("xi_1").alias("xi_1"))
    return once.withColumn("y", 4e4 + 2e4 * F.col("xi_0") * F.col("xi_0") + 1e4 * F.col("xi_1"))


@_query(_NEAR + f"SELECT global_id, {_rs('d')} AS min_dist FROM n")
def q_level_domain(spark, sf_dir):
    """Line items near the points whose response is nearest to a level."""
    from haruspex.operators.resample import level_domain

    p = _level(spark, sf_dir)
    return level_domain(p, p, ["xi_0", "xi_1"], "y", _LEVEL, "global_id", radius=_WIDE).select("global_id", _r(F.col("min_dist")).alias("min_dist"))


@_query(_NEAR + f", w AS (SELECT global_id, d, -ln((CAST('0x' || substr(md5(global_id || ':7'), 1, 8) AS BIGINT) + 0.5e0) / 4294967296) * (1 + power(d / {_WIDE}, 2)) AS k FROM n) SELECT global_id, {_rs('k')} AS draw FROM w ORDER BY k, global_id LIMIT 50")
def q_level_sample(spark, sf_dir):
    """Fifty of them, the nearer the likelier."""
    from haruspex.operators.resample import domain_sample

    p = _level(spark, sf_dir)
    return domain_sample(p, p, ["xi_0", "xi_1"], "y", _LEVEL, "global_id", 50, radius=_WIDE, seed=7).select("global_id", _r(F.col("draw")).alias("draw"))


# -- spacing and evidence


@_query(
    "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, label FROM embeddings), "
    "p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2) + power(x.c - y.c, 2)) AS dist FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id) "
    f"SELECT label, a, b, {_rs('dist', 9)} AS dist FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY dist, a, b) = 1"
)
def q_closest_pairs(spark, sf_dir):
    """The closest two embeddings of each label, by three components."""
    from haruspex.operators.spacing import closest_pairs

    rows = _coordinates(spark, sf_dir).join(_t(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return closest_pairs(rows, _CORE, "vec_id", ["label"]).select("label", "a", "b", _r(F.col("dist"), 9).alias("dist"))


@_query("SELECT 'new row' AS finding, o_orderkey FROM orders WHERE o_orderkey % 97 = 5 UNION ALL SELECT 'missing row', CAST(-1 AS BIGINT) FROM orders WHERE o_orderkey % 97 IN (5, 6)")
def q_evidence_changes(spark, sf_dir):
    """Orders against the hash tree of orders of which some had another price and some are gone."""
    from haruspex.operators.settle import settled
    from haruspex.sources import evidence

    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    held_tree, held_leaves = settled(evidence.tree(orders)), settled(evidence.leaves(orders).groupBy("bucket", "leaf").count())
    key = F.col("o_orderkey") % 97
    other = orders.where(key != 6).withColumn("o_totalprice", F.when(key == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    found = evidence.changed(other, held_tree, held_leaves)
    return found.select("finding", F.coalesce(F.get_json_object("row", "$.o_orderkey").cast("long"), F.lit(-1).cast("long")).alias("o_orderkey"))


# -- the stopping controller on a trace made of events

_MIN_R2, _ABS_QOI = 0.2, 60.0


def _trace(events):
    n = F.col("event_id") % 50
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), n.alias("calls"), (F.col("event_id") % 7).alias("order"), (F.col("value") / 100).alias("r2"), F.col("value").alias("mse"), F.col("value").alias("qoi"), "ts")


def _rules():
    from haruspex.streaming.stopping import Rules

    return Rules(budget=45, max_order=5, min_r2=_MIN_R2, rel_mse=2.0, abs_qoi=_ABS_QOI)


_VERDICTS = (
    "WITH t AS (SELECT user_id AS run, event_id AS step, event_id % 50 AS calls, event_id % 7 AS ord, value AS v, lag(value) OVER w AS v1, lag(value, 2) OVER w AS v2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) "
    f"SELECT run, step, CASE WHEN calls >= 45 THEN 'budget' WHEN ord > 5 THEN 'order' WHEN v1 IS NULL OR v / 100 < {_MIN_R2} OR v1 / 100 < {_MIN_R2} OR v2 IS NULL "
    f"OR abs(v - v1) > 2 * abs(v1) OR v1 = 0 OR abs(v1 - v2) > 2 * abs(v2) OR v2 = 0 OR abs(v - v1) > {_ABS_QOI} OR abs(v1 - v2) > {_ABS_QOI} THEN 'continues' ELSE 'met' END AS verdict FROM t"
)


@_query(_VERDICTS)
def q_stopping_verdicts(spark, sf_dir):
    from haruspex.streaming.stopping import judged

    return judged(_trace(_t(spark, sf_dir, "events")), _rules()).select("run", "step", "verdict")


@_query(_VERDICTS)
def q_stopping_stream(spark, sf_dir):
    """The same by a stateful stream over the table, written and read again."""
    import uuid

    from haruspex.operators.settle import shared_folder
    from haruspex.streaming.stopping import watched

    events = _t(spark, sf_dir, "events")
    folder = f"{shared_folder(spark)}/stopping-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    out = watched(_trace(stream), _rules(), idle_ms=10**13)
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("run", "step", "verdict")
