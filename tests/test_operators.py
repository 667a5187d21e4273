import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from haruspex.functions import dist, models, special
from haruspex.functions.basis import Basis
from haruspex.operators import geometry, linalg, sampling, series, stats, surrogate, tracks
from haruspex.streaming import incremental


def test_normal_functions(spark):
    z = [-8.0, -3.0, -1.0, -0.1, 0.0, 0.5, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in z], "z double").select("z", special.normal_cdf(F.col("z")).alias("p")).select("z", "p", special.normal_ppf(F.col("p")).alias("back"))
    for r in df.collect():
        want = math.erfc(-r["z"] / math.sqrt(2)) / 2
        assert r["p"] == pytest.approx(want, rel=1e-12, abs=1e-15)
        if abs(r["z"]) < 4:
            assert r["back"] == pytest.approx(r["z"], abs=1e-9)
    p = spark.createDataFrame([(v,) for v in (0.0, 1e-12, 0.3, 0.999, 1.0)], "p double").select("p", special.normal_ppf(F.col("p")).alias("x")).collect()
    assert p[0]["x"] is None and p[4]["x"] is None
    for r in p[1:4]:
        assert r["x"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-9)


@pytest.mark.parametrize("m", [dist.norm(1, 2), dist.uniform(-1, 2), dist.lognorm(0.1, 0.5), dist.weibull(1.5, 0.2, 2.0), dist.Marginal("gumbel", (1.0, 2.0)), dist.Marginal("expon", (0.0, 2.0))])
def test_marginals_invert_and_integrate(spark, m):
    df = spark.range(1, 200).select((F.col("id") / 200.0).alias("u")).withColumn("x", m.ppf(F.col("u"))).withColumn("back", m.cdf(F.col("x"))).withColumn("d", m.pdf(F.col("x")))
    rows = df.orderBy("u").collect()
    assert all(abs(r["u"] - r["back"]) < 1e-9 for r in rows)
    area = sum((b["x"] - a["x"]) * (a["d"] + b["d"]) / 2 for a, b in zip(rows, rows[1:]))
    assert area == pytest.approx(rows[-1]["u"] - rows[0]["u"], abs=0.01)


def test_map_domain_and_rosenblatt(spark):
    chain = dist.site("norway5_3d")
    df = spark.createDataFrame([(0.3, 0.6, 0.8)], "a double, b double, c double")
    us = [F.col("a"), F.col("b"), F.col("c")]
    xs = dist.inverse_rosenblatt(us, chain)
    got = df.select(*[x.alias(n) for x, n in zip(xs, "xyz")]).select(*[u.alias(f"u{k}") for k, u in enumerate(dist.rosenblatt([F.col(n) for n in "xyz"], chain))]).first()
    assert tuple(got) == pytest.approx((0.3, 0.6, 0.8), abs=1e-9)
    r = df.select(dist.map_domain(F.col("a"), dist.uniform(0, 1), dist.uniform(-1, 2)).alias("m"), dist.truncated_ppf(F.col("a"), dist.norm(), -1, 1).alias("t")).first()
    assert r["m"] == pytest.approx(-0.4) and -1 < r["t"] < 1
    with pytest.raises(Exception, match="non-finite"):
        df.select(dist.finite(F.lit(float("nan")))).collect()


def test_genz_integrals(spark):
    a, b = (1.5, 2.0), (0.3, 0.6)
    nodes = sampling.quadrature(spark, Basis("legendre", 2, 1), 40, 0.5, 0.5)
    for k, tol in ((1, 1e-10), (2, 1e-8), (4, 1e-10), (5, 1e-3), (6, 0.12)):
        got = nodes.agg(F.sum(F.col("w") * models.evaluate(models.genz(k, a, b), ["xi_0", "xi_1"]))).first()[0]
        assert got == pytest.approx(models.genz_integral(k, a, b), rel=tol)


def test_lhs_goldens():
    H = sampling.lhs_small(3, 17, None, state=np.random.RandomState(81))
    assert all(sorted(np.floor(H[:, k] * 17).astype(int)) == list(range(17)) for k in range(3))
    C = sampling.lhs_small(2, 5, "center", state=42)
    assert sorted(C[:, 0]) == pytest.approx([0.1, 0.3, 0.5, 0.7, 0.9])
    for c in ("maximin", "cm", "corr"):
        assert sampling.lhs_small(2, 6, c, state=1).shape == (6, 2)
    with pytest.raises(ValueError):
        sampling.lhs_small(2, 5, "best")


def test_sobol_is_random_access(spark):
    a = {r[0]: r[1:] for r in sampling.sobol(spark, 5, 64).collect()}
    b = {r[0] + 32: r[1:] for r in sampling.sobol(spark, 5, 32, skip=32).collect()}
    assert all(a[k] == b[k] for k in b)
    assert all(len({int(v[d] * 64) for v in a.values()}) == 64 for d in range(5))


def test_sampling_does_not_depend_on_partitions(spark):
    a = sampling.monte_carlo(spark, [dist.norm()], 100, 3).repartition(7).orderBy("global_id").collect()
    assert a == sampling.monte_carlo(spark, [dist.norm()], 100, 3).orderBy("global_id").collect()


def test_surrogate_fits(spark):
    df = sampling.monte_carlo(spark, [dist.norm(), dist.norm()], 200, 1).withColumn("y", models.evaluate("quadratic_mix", ["xi_0", "xi_1"]))
    b = Basis("hermite_e", 2, 3)
    for s in (surrogate.fit_ols(df, b, ["xi_0", "xi_1"], "y"), surrogate.fit_lars(df, b, ["xi_0", "xi_1"], "y"), surrogate.fit_lasso(df, b, ["xi_0", "xi_1"], "y")):
        m = stats.regression_metrics(s.predict(df, ["xi_0", "xi_1"]), "y", "y_hat").first()
        assert m["r2"] > 0.999
        assert s.mean() == pytest.approx(1.0, abs=0.05)
    wide = surrogate.Surrogate(Basis("hermite_e", 2, 12), tuple(range(91)), tuple([1.0] * 91))
    assert wide.predict(df, ["xi_0", "xi_1"]).where("y_hat IS NULL").count() == 0
    mix = surrogate.mixture_predict(df, [s, s], ["xi_0", "xi_1"], "global_id")
    assert mix.count() == 200
    assert len(surrogate.mallows_cp(df, b, ["xi_0", "xi_1"], "y")) >= 4


def test_wide_and_narrow_gram_agree(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 14))
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], [f"c{k}" for k in range(14)])
    G, _, _ = linalg.gram_matrix(df, [f"c{k}" for k in range(14)])
    assert np.allclose(G, X.T @ X)
    g, b, yy = linalg.gram_matrix(df, ["c0", "c1"], "c2")
    assert np.allclose(g, X[:, :2].T @ X[:, :2]) and np.allclose(b, X[:, :2].T @ X[:, 2]) and yy == pytest.approx(X[:, 2] @ X[:, 2])
    loo = linalg.loo_error(df, ["c0", "c1"], "c2")
    e = [X[i, 2] - X[i, :2] @ np.linalg.lstsq(np.delete(X[:, :2], i, 0), np.delete(X[:, 2], i), rcond=None)[0] for i in range(200)]
    assert loo == pytest.approx(np.mean(np.square(e)) / X[:, 2].var())


def test_ordered_ranks_globally(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 997).alias("v"))
    rows = stats.ordered(df, ["v", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 1001))
    assert [(r["v"], r["id"]) for r in rows] == sorted((r["v"], r["id"]) for r in rows)


def test_empty_and_null_inputs(spark):
    empty = spark.createDataFrame([], "event_id long, value double")
    assert stats.ecdf(empty, "value", "event_id").count() == 0
    assert stats.compressed_ecdf(empty, "value", "event_id", 0.1).count() == 0
    nulls = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert stats.mquantiles(nulls, "v", [0.5]).first()[0] == pytest.approx(2.0)


def test_interpolation(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0)], "k int, t double, v double")
    g = spark.createDataFrame([(1, x) for x in (-1.0, 0.5, 1.0, 3.0)], "k int, t double")
    got = {r["t"]: r["v"] for r in tracks.interpolate(g, s, "t", "v", ["k"]).collect()}
    assert got == {-1.0: 0.0, 0.5: 1.0, 1.0: 2.0, 3.0: 4.0}


def test_near_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    P = rng.uniform(-2, 2, size=(200, 2))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(P)], "id int, x double, y double")
    got = {(r[0], r[1]) for r in geometry.near_join(df, df.withColumnRenamed("id", "c"), ["x", "y"], 0.3, "id", "c").collect()}
    assert got == {(i, j) for i in range(200) for j in range(200) if np.hypot(*(P[i] - P[j])) <= 0.3}


def test_spectra():
    w = np.arange(257) * 0.02
    x = series.synthesise(series._jonswap(w, 4.0, 10.0), 0.02, 1)
    assert x.std() * 4 == pytest.approx(4.0, rel=0.1)
    p = np.abs(np.fft.fft(x)) ** 2
    assert len(series.one_sided(p)) == len(p) // 2 + 1
    acf = series.to_autocorrelation(p, 1.0)
    assert np.allclose(series.to_spectrum(acf, 2 * np.pi / len(p)), p)


def test_series_models(spark):
    sea = geometry.seed_cross(spark.createDataFrame([(1, 3.0, 9.0)], "sample_id long, hs double, tp double"), [1, 2])
    for made in (series.wave_elevation(sea, "hs", "tp", 64), series.surge_response(sea, "hs", "tp", [(0.2, 1.0), (2.0, 0.1)], n=64), series.slow_drift(sea, "hs", "tp", lambda a, b: 1.0 + 0 * (a + b), n_w=8, n=64)):
        assert made.count() == 128
        assert series.short_term_maxima(made, 5.0).count() == 2


def test_near_join_cuts_a_hot_cell(spark, monkeypatch):
    """A cell of most rows is compared in blocks by several tasks, with every pair once."""
    monkeypatch.setattr(geometry, "CELL_ROWS", 16, raising=False)
    monkeypatch.setattr(geometry, "TASK_PAIRS", 500, raising=False)
    rng = np.random.default_rng(4)
    X = np.concatenate([rng.uniform(0.01, 0.09, (150, 2)), rng.normal(size=(60, 2)), np.full((20, 2), 0.05)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(X)], "id long, x double, y double")
    made = geometry.near_join(df, df.where("id % 3 = 0").withColumnRenamed("id", "c"), ["x", "y"], 0.1, "id", "c").withColumn("part", F.spark_partition_id()).collect()
    want = {(i, j) for i in range(230) for j in range(0, 230, 3) if np.sqrt(((X[i] - X[j]) ** 2).sum()) <= 0.1}
    assert len(made) == len(want) and {(r["id"], r["c"]) for r in made} == want
    hot = [r["part"] for r in made if r["id"] < 150 and r["c"] < 150]
    assert max(hot.count(p) for p in set(hot)) < len(hot) / 3


def test_oscillators_share_their_work(spark, monkeypatch):
    """One small file's rows are dealt over tasks, and a step is taken for many rows at once, each as if alone."""
    monkeypatch.setattr(series, "TASK", 8)
    monkeypatch.setattr(series, "BLOCK", 3)
    sea = geometry.seed_cross(spark.range(20).coalesce(1).select(F.col("id").alias("sample_id"), (2.0 + F.col("id") % 5).alias("hs"), (8.0 + F.col("id") % 4).alias("tp")), [1, 2])
    made = series.duffing(sea, "hs", "tp", n=32).withColumn("part", F.spark_partition_id())
    assert made.select("part").distinct().count() > 1
    got = {(r["sample_id"], r["seed_id"], r["t_idx"]): r["value"] for r in made.collect()}
    assert len(got) == 20 * 2 * 32
    alone = series.duffing(sea.where("sample_id = 7 AND seed_id = 2"), "hs", "tp", n=32).collect()
    assert [r["value"] for r in sorted(alone, key=lambda r: r["t_idx"])] == [got[7, 2, i] for i in range(32)]
    dw = 2 * np.pi / (64 * 0.125)
    f, x, v = series.synthesise(series._jonswap(np.arange(33) * dw, 4.0, 11.0), dw, 2), 0.0, 0.0
    acc = lambda x, v, q: q - 0.2 * v - x - 0.1 * x**3
    k1, l1 = v, acc(x, v, f[0])
    k2, l2 = v + 0.125 * l1, acc(x + 0.125 * k1, v + 0.125 * l1, f[1])
    k3, l3 = v + 0.125 * l2, acc(x + 0.125 * k2, v + 0.125 * l2, f[1])
    k4 = v + 0.25 * l3
    assert got[7, 2, 0] == 0.0 and got[7, 2, 1] == pytest.approx(x + 0.25 / 6 * (k1 + 2 * k2 + 2 * k3 + k4), rel=1e-12)


def test_streaming_failures(spark, sf_dir, tmp_path):
    src = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = incremental.windowed_failures(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("value") - 20, ["event_type"], "1 day", "1 hour")
    q = out.writeStream.outputMode("complete").format("memory").queryName("failures").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("failures").agg(F.sum("n"), F.sum("failures")).first()
    want = spark.read.parquet(src).agg(F.count("*"), F.sum((F.col("value") <= 20).cast("long"))).first()
    assert tuple(got) == tuple(want)


def test_files(spark, tmp_path):
    from haruspex.sources import files

    a = np.random.default_rng(0).normal(size=(3, 50))
    np.save(tmp_path / "pool.npy", a)
    df = files.read_npy(spark, str(tmp_path / "pool.npy"), 2)
    assert np.allclose(np.array([r["xi"] for r in df.orderBy("global_id").collect()]).T, a[:2])
    import hashlib

    assert files.identity(spark, str(tmp_path / "pool.npy")).first()["sha256"] == hashlib.sha256((tmp_path / "pool.npy").read_bytes()).hexdigest()
    assert files.write_artifacts(str(tmp_path / "out"), {"x.txt": b"1"})[0]["bytes"] == 1
