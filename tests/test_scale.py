"""Operators that must hold for one hot group: selection, windows, splines, spectra; and tall factors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haruspex.operators import orthogonal, selection, spectra, stats, tracks


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(tracks, "BLOCK", 40)


# -- selection


def test_bits_are_in_the_order_of_doubles():
    rng = np.random.default_rng(1)
    x = np.sort(np.concatenate([rng.normal(size=500), rng.normal(size=50) * 1e300, rng.normal(size=50) * 1e-310, [0.0, np.inf, -np.inf, 5e-324, -5e-324]]))
    u = selection.to_bits(x).view(np.uint64)
    assert (np.diff(u.astype(object)) >= 0).all() and (selection.from_bits(u.view(np.int64)) == x).all()
    assert selection.to_bits(np.array([-0.0])) == selection.to_bits(np.array([0.0])) and selection.to_bits(np.array([np.nan])).view(np.uint64) > u.max()


def _groups():
    rng = np.random.default_rng(2)
    hot = rng.normal(size=9000)
    rows = [("hot", float(v)) for v in hot] + [("same", 3.25)] * 400 + [("one", -7.0)] + [(None, float(k)) for k in range(6)]
    rows += [("odd", v) for v in (float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 1e-320, -1e308)] + [("none", None)] * 3
    return rows


@pytest.mark.parametrize("few", [selection.FEW, 0])
def test_order_statistics_with_a_hot_group(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    df = spark.createDataFrame(_groups(), "g string, v double").repartition(5)
    n = F.col("n")
    got = selection.order_statistics(df, "v", [F.lit(1), F.expr("(n + 1) div 2"), n, F.least(n, F.lit(3))], ["g"])
    want = {}
    for g, v in _groups():
        if v is not None:
            want.setdefault(g, []).append(v)
    rows = {r["g"]: r for r in got.collect()}
    assert set(rows) == set(want)
    for g, values in want.items():
        s = np.sort(np.array(values) + 0.0)  # NaN comes last
        at = [0, (len(s) + 1) // 2 - 1, len(s) - 1, min(len(s), 3) - 1]
        assert rows[g]["n"] == len(s)
        np.testing.assert_array_equal([rows[g][f"v{j}"] for j in range(4)], s[at])


def test_medians_and_quantiles(spark):
    df = spark.createDataFrame(_groups(), "g string, v double").where("g <> 'odd'")
    got = {r["g"]: r["median"] for r in selection.medians(df, "v", ["g"]).collect()}
    hot = [v for g, v in _groups() if g == "hot"]
    assert got == {"hot": np.median(hot), "same": 3.25, "one": -7.0}
    q = stats.mquantiles(df.where("g = 'hot'"), "v", [0.01, 0.5, 0.999]).first()
    s, n = np.sort(hot), len(hot)
    for i, p in enumerate((0.01, 0.5, 0.999)):
        pos = n * p + 0.4 + p * 0.2
        k = int(np.floor(np.clip(pos, 1, n - 1)))
        assert q[i] == pytest.approx((1 - (pos - k)) * s[k - 1] + (pos - k) * s[k], rel=1e-12)
    by = {r["g"]: r["q0"] for r in stats.mquantiles(df, "v", [0.5], ["g"]).collect()}
    assert by["same"] == 3.25 and by["one"] == -7.0
    assert stats.mquantiles(df.limit(0), "v", [0.5]).collect()[0][0] is None
    assert selection.medians(df.limit(0), "v", ["g"]).count() == 0
    none = stats.regression_metrics(spark.createDataFrame([], "y double, f double"), "y", "f").first()
    assert none["n"] == 0 and none["medae"] is None


# -- series


def _series():
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.uniform(0.2, 3.0, 500))
    hot = pd.DataFrame({"s": "hot", "t": t, "v": np.sin(t / 3) + rng.normal(size=500) * 0.1})
    few = pd.DataFrame({"s": "few", "t": [1.0, 2.0, 4.0], "v": [0.0, 1.0, -1.0]})
    one = pd.DataFrame({"s": "one", "t": [5.0], "v": [2.0]})
    two = pd.DataFrame({"s": "two", "t": [0.0, 2.0], "v": [1.0, 3.0]})
    return pd.concat([hot, few, one, two], ignore_index=True)


def _natural(t, v):
    n = len(t)
    A, d = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a, b = t[i] - t[i - 1], t[i + 1] - t[i]
        A[i, i - 1 : i + 2] = a / (a + b), 2, b / (a + b)
        d[i] = 6 * ((v[i + 1] - v[i]) / b - (v[i] - v[i - 1]) / a) / (a + b)
    return np.linalg.solve(A, d)


def test_moving_windows_over_blocks(spark):
    data = _series()
    df = spark.createDataFrame(data).repartition(7)
    for width in (1, 3, 60):
        got = tracks.moving(df, "v", ["s"], ["t"], width).toPandas().sort_values(["s", "t"]).reset_index(drop=True)
        parts = [g.assign(mov_avg=g["v"].rolling(width).mean()).dropna() for _, g in data.sort_values(["s", "t"]).groupby("s")]
        want = pd.concat(parts).reset_index(drop=True)
        assert got[["s", "t"]].equals(want[["s", "t"]])
        np.testing.assert_allclose(got["mov_avg"], want["mov_avg"], atol=1e-12)


def test_up_crossings_over_blocks(spark):
    data = _series()
    got = {r["s"]: (r["n_up"], r["rate"]) for r in tracks.up_crossings(spark.createDataFrame(data), "v", "t", ["s"]).collect()}
    h = data[data["s"] == "hot"]
    v, t = h["v"].to_numpy(), h["t"].to_numpy()
    up = np.flatnonzero((v[:-1] * v[1:] < 0) & (v[1:] > v[:-1]))
    assert got["hot"] == (len(up), pytest.approx((len(up) - 1) / (t[up[-1]] - t[up[0]]))) and "one" not in got


def test_splines_over_blocks_equal_one_solve(spark):
    data = _series()
    got = tracks.splines(spark.createDataFrame(data).repartition(3), "t", "v", ["s"]).toPandas().sort_values(["s", "t"])
    for s, g in got.groupby("s"):
        own = data[data["s"] == s]
        np.testing.assert_allclose(g["bend"].to_numpy(), _natural(own["t"].to_numpy(), own["v"].to_numpy()), atol=1e-11)
    twice = spark.createDataFrame(pd.concat([data, data]))
    assert tracks.splines(twice, "t", "v", ["s"]).count() == len(data)
    assert tracks.splines(twice.limit(0), "t", "v", ["s"]).count() == 0


@pytest.mark.parametrize("kind", ["linear", "cubic"])
def test_interpolation_over_blocks(spark, kind):
    data = _series()
    h = data[data["s"] == "hot"]
    t, v = h["t"].to_numpy(), h["v"].to_numpy()
    at = np.concatenate([np.linspace(t[0] - 2, t[-1] + 2, 300), t[100:103]])
    grid = spark.createDataFrame(pd.DataFrame({"s": ["hot"] * len(at) + ["one", "none", "two"], "t": [*at, 9.0, 1.0, 0.5]}))
    got = tracks.interpolate(grid, spark.createDataFrame(data), "t", "v", ["s"], kind).toPandas()
    assert len(got) == len(at) + 3
    rest = got[got["s"] != "hot"].set_index("s")["v"]
    assert rest["one"] == 2.0 and pd.isna(rest["none"]) and rest["two"] == pytest.approx(1.5)
    own = got[got["s"] == "hot"].sort_values("t")
    x = own["t"].to_numpy()
    want = np.interp(x, t, v)
    if kind == "cubic":
        m, k = _natural(t, v), np.clip(np.searchsorted(t, x, "right") - 1, 0, len(t) - 2)
        b, A, B = t[k + 1] - t[k], (t[k + 1] - x) / (t[k + 1] - t[k]), (x - t[k]) / (t[k + 1] - t[k])
        inside = A * v[k] + B * v[k + 1] + ((A**3 - A) * m[k] + (B**3 - B) * m[k + 1]) * b * b / 6
        want = np.where((x >= t[0]) & (x <= t[-1]), inside, want)
    np.testing.assert_allclose(own["v"].to_numpy(), want, atol=1e-10)
    with pytest.raises(ValueError):
        tracks.interpolate(grid, grid, "t", "v", ["s"], "quintic")


def test_blocks_are_bounded_whatever_the_series(spark):
    df = spark.createDataFrame(pd.DataFrame({"s": ["hot"] * 2000 + ["x"] * 10, "t": np.arange(2010.0), "v": 1.0}))
    sizes = tracks.blocked(df, ["s"], ["t"], 4, 1).groupBy("__block").count().toPandas()["count"]
    assert sizes.max() <= 45 and len(sizes) == 51


def test_tridiagonal():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 50, 257):
        a, c, d = rng.uniform(-1, 1, (3, n))
        b = 2.5 + rng.uniform(0, 1, n)
        A = np.diag(b) + (np.diag(a[1:], -1) + np.diag(c[:-1], 1) if n > 1 else 0)
        np.testing.assert_allclose(tracks.tridiagonal(a, b, c, d), np.linalg.solve(A, d) if n else d, atol=1e-12)


# -- spectra


def test_spectrum_by_series(spark):
    rng, length = np.random.default_rng(5), 32
    t = np.arange(1000)
    hot, few = np.cos(2 * np.pi * t / 8) + 0.1 * rng.normal(size=1000), rng.normal(size=70)
    rows = pd.DataFrame({"s": ["hot"] * 1000 + ["few"] * 70 + ["short"] * 31, "t": [*t, *range(70), *range(31)], "v": [*hot, *few, *rng.normal(size=31)]})
    got = spectra.spectrum(spark.createDataFrame(rows).repartition(5), "v", ["s"], ["t"], length, 0.5).toPandas()
    assert set(got["s"]) == {"hot", "few"}
    w = spectra.taper(length)
    for s, x in (("hot", hot), ("few", few)):
        segs = np.array([x[a : a + length] for a in range(0, len(x) - length + 1, length // 2)])
        p = np.abs(np.fft.rfft((segs - segs.mean(1, keepdims=True)) * w, axis=1)) ** 2 * 0.5 / (w**2).sum()
        p[:, 1:-1] *= 2
        own = got[got["s"] == s].sort_values("j")
        assert (own["segments"] == len(segs)).all()
        np.testing.assert_allclose(own["density"], p.mean(0), atol=1e-12)
        np.testing.assert_allclose(own["frequency"], np.fft.rfftfreq(length, 0.5))
    r = spectra.autocorrelation(spark.createDataFrame(got), ["s"], length).toPandas()
    own = r[r["s"] == "hot"].sort_values("lag")["r"].to_numpy()
    assert own[0] == 1.0 and own[8] > 0.6 and own[4] < -0.7 and len(own) == 17
    assert spectra.spectrum(spark.createDataFrame(rows).limit(0), "v", ["s"], ["t"], length).count() == 0
    whole = spectra.spectrum(spark.createDataFrame(rows[rows["s"] == "hot"]), "v", [], ["t"], length, 0.5).toPandas().sort_values("j")
    np.testing.assert_allclose(whole["density"], got[got["s"] == "hot"].sort_values("j")["density"])


# -- tall factors


@pytest.fixture(scope="module")
def steep(spark):
    rng = np.random.default_rng(6)
    u, v = rng.normal(size=(2, 3000))
    rows = pd.DataFrame({"a": u, "b": u + 1e-9 * v, "c": rng.normal(size=3000), "w": rng.uniform(1, 2, 3000)})
    rows["y"] = 3 * rows["a"] + 2e9 * (rows["b"] - rows["a"]) + 0.5 * rows["c"]
    return rows, spark.createDataFrame(rows).repartition(9)


@pytest.mark.parametrize("fan", [64, 2])
def test_factors_of_a_steep_design(steep, monkeypatch, fan):
    monkeypatch.setattr(orthogonal, "FAN", fan)
    rows, df = steep
    r = orthogonal.triangular(df, ["a", "b", "c"])
    want = np.linalg.cond(rows[["a", "b", "c"]].to_numpy())
    assert want > 1e9 and orthogonal.condition_number(r) == pytest.approx(want, rel=1e-6)
    beta, left = orthogonal.solve(orthogonal.triangular(df, ["a", "b", "c", "y"]))
    assert beta[1] == pytest.approx(2e9, rel=1e-6) and beta[0] + beta[1] == pytest.approx(3.0, rel=1e-5) and beta[2] == pytest.approx(0.5, rel=1e-6) and left < 1e-7
    weighted = orthogonal.triangular(df, ["a", "c"], "w")
    x = rows[["a", "c"]].to_numpy()
    np.testing.assert_allclose(weighted.T @ weighted, x.T @ (x * rows["w"].to_numpy()[:, None]), rtol=1e-10)


def test_factors_of_few_and_no_rows(spark, steep):
    _, df = steep
    assert (orthogonal.triangular(df.limit(0), ["a", "b"]) == 0).all()
    one = orthogonal.triangular(df.limit(1), ["a", "c", "y"])
    assert one.shape == (3, 3) and orthogonal.condition_number(one) == float("inf")
    beta, _ = orthogonal.solve(np.array([[1.0, 1.0, 2.0], [0, 0, 0], [0, 0, 0]]))
    np.testing.assert_allclose(beta, [1.0, 1.0])


@pytest.mark.parametrize("adjusted", [False, True])
def test_leave_one_out(steep, adjusted):
    rows, df = steep
    noisy = rows.assign(y=rows["a"] + 0.3 * rows["c"] + np.random.default_rng(7).normal(size=len(rows)))
    x, y = noisy[["a", "c"]].to_numpy(), noisy["y"].to_numpy()
    hat = x @ np.linalg.inv(x.T @ x) @ x.T
    want = np.mean(((y - hat @ y) / (1 - np.diag(hat))) ** 2) / y.var()
    if adjusted:
        n = len(y)
        want *= n / (n - 2) * (1 + np.trace(np.linalg.inv(x.T @ x)))
    got = orthogonal.leave_one_out(df.sparkSession.createDataFrame(noisy), ["a", "c"], "y", adjusted)
    assert got == pytest.approx(want, rel=1e-9)


# -- ellipsoids


@pytest.mark.parametrize("d", [2, 3, 6])
def test_least_ellipsoid(spark, d):
    from haruspex.operators import design
    from haruspex.operators.ellipsoid import least_ellipsoid

    rng = np.random.default_rng(d)
    x = rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) * 100 + 7
    xs = [f"x{k}" for k in range(d)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=xs)).unionByName(spark.createDataFrame(pd.DataFrame([[float("nan")] * d], columns=xs)).where("x0 > 0")).repartition(5)
    e = least_ellipsoid(df, xs, 1e-7)
    off = x - e.center
    measure = np.einsum("ij,jk,ik->i", off, e.shape, off)
    assert measure.max() == pytest.approx(1, abs=1e-6) and (measure <= 1 + 1e-9).all() and e.gap <= 1e-7
    _, A = design.enclosing_ellipsoid(x, 1e-6, 20_000)
    assert 1 / np.sqrt(np.linalg.det(A)) == pytest.approx(1 / np.sqrt(np.linalg.det(e.shape)), rel=0.02)
    got = np.array([r[0] for r in df.select(e.measure(xs)).where(F.col("x0").isNotNull()).collect()])
    np.testing.assert_allclose(np.sort(got[~np.isnan(got)]), np.sort(measure), atol=1e-8)
    if d < 4:
        s = e.surface(20) - e.center
        np.testing.assert_allclose(np.einsum("ij,jk,ik->i", s, e.shape, s), 1, atol=1e-9)
    if d == 2:
        half = e.axes()[0]
        assert e.volume() == pytest.approx(np.pi * half.prod())


def test_ellipsoid_of_a_square_and_of_a_plane(spark):
    from haruspex.operators.ellipsoid import least_ellipsoid

    square = spark.createDataFrame([(float(a), float(b)) for a in (0, 2) for b in (0, 6)] + [(1.0, 3.0)] * 50, "a double, b double")
    e = least_ellipsoid(square, ["a", "b"], 1e-9)
    np.testing.assert_allclose(e.center, [1, 3], atol=1e-6)
    np.testing.assert_allclose(e.axes()[0], [3 * np.sqrt(2), np.sqrt(2)], rtol=1e-6)
    for bad in (square.withColumn("b", F.col("a") * 2), square.withColumn("b", F.lit(1.0)), square.limit(0)):
        with pytest.raises(ValueError):
            least_ellipsoid(bad, ["a", "b"])


# -- samples near a level


def test_weighted_samples_have_their_frequencies(spark):
    from haruspex.operators.resample import weighted_sample

    w = np.array([1.0, 2.0, 4.0, 8.0] * 5 + [0.0] * 3)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(w)], "id long, w double").coalesce(2)
    taken = np.zeros((600, len(w)))
    seeds = spark.range(600).withColumnRenamed("id", "s")
    from haruspex.operators.resample import hashed_uniform

    key = -F.log(hashed_uniform(F.concat_ws("/", "id", "s"), 3)) / F.col("w")
    rows = df.where("w > 0").crossJoin(F.broadcast(seeds)).withColumn("k", key)
    for r in rows.groupBy("s").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "id"))), 1, 4).alias("a")).collect():
        taken[r["s"], [x["id"] for x in r["a"]]] = 1
    rng, draws = np.random.default_rng(1), np.zeros((6000, len(w)))
    for t in range(len(draws)):
        draws[t, rng.choice(len(w), 4, replace=False, p=w / w.sum())] = 1
    for v in (1, 2, 4, 8):
        assert taken[:, w == v].mean() == pytest.approx(draws[:, w == v].mean(), abs=0.025)
    a = {r["id"] for r in weighted_sample(df, F.col("w"), 6, "id", 5).collect()}
    b = {r["id"] for r in weighted_sample(df.repartition(7), F.col("w"), 6, "id", 5).collect()}
    assert a == b and len(a) == 6 and max(a) < 20
    assert weighted_sample(df, F.col("w"), 99, "id").count() == 20 and weighted_sample(df.limit(0), F.col("w"), 9, "id").count() == 0


def test_level_domain_with_lonely_points(spark):
    from haruspex.operators.resample import level_domain

    rng = np.random.default_rng(8)
    data = pd.DataFrame({"id": range(300), "a": rng.normal(size=300), "b": rng.normal(size=300)})
    data["y"] = data["a"] + data["b"]
    data.loc[299, ["a", "b", "y"]] = 50.0, -50.0, 0.0  # nothing is near this one
    cand = data[data["id"] != 299]
    got = {r["id"] for r in level_domain(spark.createDataFrame(data), spark.createDataFrame(cand), ["a", "b"], "y", 0.0, "id", n=5, radius=0.3, least=7).collect()}
    centers = data.assign(d=data["y"].abs()).sort_values(["d", "id"]).head(5)
    want = set()
    for c in centers.itertuples():
        d = np.hypot(cand["a"] - c.a, cand["b"] - c.b)
        near = set(cand["id"][d < 0.3]) or set(cand["id"].iloc[np.argsort(d, kind="stable")[:7]])
        want |= near
    assert got == want
    assert level_domain(spark.createDataFrame(data).limit(0), spark.createDataFrame(cand), ["a", "b"], "y", 0.0, "id").count() == 0


# -- closest pairs


def _closest(x, ids):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = [(d[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(x)) for j in range(i)]
    return min(pairs) if pairs else None


@pytest.mark.parametrize("d", [1, 2, 3])
def test_closest_pairs(spark, d):
    from haruspex.operators.spacing import closest_pairs

    rng = np.random.default_rng(d)
    sets = {"even": rng.uniform(size=(300, d)), "dense": np.vstack([rng.normal(size=(200, d)) * 1e-6, rng.normal(size=(50, d)) * 1e3]), "alike": np.vstack([rng.normal(size=(60, d)), np.ones((4, d))]), "two": np.array([[0.0] * d, [5.0] * d]), "one": np.zeros((1, d))}
    xs = [f"c{k}" for k in range(d)]
    rows = pd.concat([pd.DataFrame(x, columns=xs).assign(s=s, id=rng.permutation(len(x))) for s, x in sets.items()])
    got = {r["s"]: (r["dist"], r["a"], r["b"]) for r in closest_pairs(spark.createDataFrame(rows).repartition(4), xs, "id", ["s"]).collect()}
    assert set(got) == {"even", "dense", "alike", "two"}
    for s, (dist, a, b) in got.items():
        want = _closest(rows[rows["s"] == s][xs].to_numpy(), rows[rows["s"] == s]["id"].to_numpy())
        assert (a, b) == want[1:] and dist == pytest.approx(want[0], abs=1e-12)
    whole = closest_pairs(spark.createDataFrame(rows[rows["s"] == "even"]), xs, "id").first()
    assert (whole["a"], whole["b"]) == got["even"][1:]
    assert closest_pairs(spark.createDataFrame(rows).limit(0), xs, "id").count() == 0


@pytest.mark.parametrize("criterion", ["maximin", "correlation"])
def test_best_hypercube(spark, criterion):
    from haruspex.operators import sampling
    from haruspex.operators.spacing import best_hypercube

    best = best_hypercube(spark, 2, 40, 4, criterion=criterion, seed=3).orderBy("global_id").toPandas()
    designs = [sampling.lhs(spark, 2, 40, 3 + k).orderBy("global_id").toPandas() for k in range(4)]
    of = {"maximin": lambda x: -_closest(x, range(len(x)))[0], "correlation": lambda x: abs(np.corrcoef(x.T)[0, 1])}[criterion]
    scores = [of(x[["xi_0", "xi_1"]].to_numpy()) for x in designs]
    pd.testing.assert_frame_equal(best, designs[int(np.argmin(scores))])


# -- evidence


def test_evidence_tells_what_changed(spark, tmp_path):
    from haruspex.sources import evidence

    a = spark.createDataFrame([(k, float(k) / 3, None if k % 5 else "x") for k in range(200)] + [(7, 7.0, "twice")] * 2, "id long, v double, t string")
    folder = str(tmp_path / "package")
    roots = evidence.write_package({"a": a, "b": a.limit(0)}, folder)
    assert evidence.root(evidence.tree(a.repartition(7).select("t", "v", "id"))) == roots["a"]
    assert evidence.findings(spark, folder, roots).count() == 0
    assert sorted(map(tuple, evidence.read_package(spark, folder)["a"].where("id = 7").collect()))[-1] == (7, 7.0, "twice")
    rows = a.where("id <> 11").withColumn("v", F.when(F.col("id") == 12, F.col("v") + 1e-12).otherwise(F.col("v"))).collect()
    spark.createDataFrame(rows[:-1], a.schema).write.mode("overwrite").parquet(f"{folder}/tables/a")
    got = sorted((r["finding"], r["n"], r["row"]) for r in evidence.findings(spark, folder, roots).collect())
    assert [g[:2] for g in got] == [("missing row", 1)] * 3 + [("new row", 1)] and '"id":12' in got[-1][2]
    evidence.write_package({"a": spark.createDataFrame(rows, a.schema), "c": a}, folder)  # a package made anew
    got = {(r["name"], r["finding"]) for r in evidence.findings(spark, folder, roots).collect()}
    assert got == {("a", "another tree"), ("b", "table not in the package"), ("c", "table that was not told")}


# -- the stopping controller


def _run_trace(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for run in range(n):
        for step in range(40):
            v = [None if rng.random() < 0.03 else float(x) for x in (1 - np.exp(-step / 5) * rng.random(), np.exp(-step / 4) + 0.01 * rng.random(), 2 + np.exp(-step / 6) * rng.normal())]
            rows.append((run, step, step * 2, 1 + step // 8, *v, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=step)))
    return pd.DataFrame(rows, columns=["run", "step", "calls", "order", "r2", "mse", "qoi", "ts"])


TRACE = "run long, step long, calls long, order long, r2 double, mse double, qoi double, ts timestamp"


def _plain(df):
    out = df.astype(object).where(df.notna(), None)
    out["ts"] = pd.Series([t.to_pydatetime() for t in df["ts"]], dtype=object, index=df.index)
    return out


def test_stopping_stream_equals_batch_through_a_restart(spark, tmp_path):
    from haruspex.streaming.stopping import LATE, Rules, judged, watched

    rules = Rules(budget=70, max_order=4, min_r2=0.8, abs_mse=0.3, rel_mse=0.5, qoi_below=2.5, abs_qoi=0.4, rel_qoi=0.3)
    data = _run_trace(6, 1)
    rows = [tuple(r) for r in _plain(data).itertuples(index=False)]
    want = {(r["run"], r["step"]): r["verdict"] for r in judged(spark.createDataFrame(rows, TRACE), rules).collect()}
    assert len(want) == len(data) and set(want.values()) == {"continues", "met", "budget", "order"}
    by_rows = {}
    for run, own in data.groupby("run"):
        back = []
        for r in _plain(own).to_dict("records"):
            by_rows[run, r["step"]] = rules.verdict(r, back)
            back = [r, *back][:2]
    assert by_rows == want
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (range(0, 11), range(11, 13), range(13, 40)):  # each time a new query over the same checkpoint
        now = [r for r in rows if r[1] in part][::-1]
        spark.createDataFrame(now, TRACE).coalesce(1).write.mode("append").parquet(source)
        stream = watched(spark.readStream.schema(TRACE).parquet(source), rules, idle_ms=10**13)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(sink).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(sink).select("run", "step", "verdict").collect()]
    assert len(got) == len(want) and {(a, b): v for a, b, v in got} == want
    late = spark.createDataFrame([rows[0][:1] + (3,) + rows[0][2:7] + (rows[39][7],)], TRACE)
    late.coalesce(1).write.mode("append").parquet(source)
    stream = watched(spark.readStream.schema(TRACE).parquet(source), rules, idle_ms=10**13)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(sink).awaitTermination()
    more = [tuple(r) for r in spark.read.parquet(sink).select("run", "step", "verdict").collect()]
    assert sorted(set(more) - set(got)) == [(0, 3, LATE)]


def test_idle_runs_end(spark, tmp_path):
    from haruspex.streaming.stopping import IDLE, Rules, watched

    rules, source, sink = Rules(budget=99, max_order=9, abs_qoi=1.0), str(tmp_path / "in"), str(tmp_path / "out")
    t0 = pd.Timestamp("2024-01-01")
    for k, (run, hour) in enumerate(((1, 0), (2, 5), (2, 6))):
        spark.createDataFrame([(run, k, k, 1, None, None, 1.0, (t0 + pd.Timedelta(hours=hour)).to_pydatetime())], TRACE).coalesce(1).write.mode("append").parquet(source)
        stream = watched(spark.readStream.schema(TRACE).parquet(source), rules, idle_ms=3_600_000)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(sink).awaitTermination()
    got = sorted((r["run"], r["step"], r["verdict"]) for r in spark.read.parquet(sink).collect())
    assert (1, 0, IDLE) in got and not any(r == 2 and v == IDLE for r, _, v in got)


# -- agreement with SQL where roundings tie


@pytest.mark.parametrize("name", ["ecdf_compressed", "exceedance_tail"])
def test_distributions_agree_with_sql_on_ties_and_nulls(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from haruspex.plans import catalogue

    # scaled by 560, some values lie where the decimals and the doubles round apart
    values = [None, None, *(k / 100 for k in range(0, 56001, 35)), *(k / 100 for k in range(0, 56000, 2800))]
    events = pd.DataFrame({"event_id": np.arange(len(values)), "value": values})
    spark.createDataFrame(events).withColumn("value", F.nanvl("value", F.lit(None))).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalogue.SQL[name]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 20


def test_rounding_is_by_scaling(spark):
    x = [0.145, 1.005, -0.145, 0.285, 2.5, -2.5, 1e300, 0.1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(stats.rounded("x", 2)).collect()]
    assert got == [0.14, 1.0, -0.14, 0.28, 2.5, -2.5, 1e300, 0.1]


# -- runs over tables with repeated points


@pytest.mark.parametrize("tie", [False, True])
def test_least_rows_are_those_of_all_points(spark, tie):
    from haruspex.plans import scenarios

    class Fit:
        def predict(self, df, xs):
            return df.withColumn("y_hat", F.col("xi_0") - 1.0)

    xs = ["xi_0", "xi_1"]
    made = [(10, 1.25, 0.0), (3, 1.25, 0.0), (7, 1.5, 0.0), (1, 0.75 if tie else 3.0, 0.0), (12, 0.75 if tie else 4.0, 0.0), (5, 2.5, 0.0), (4, 2.5, 0.0)]
    points = spark.createDataFrame(made, "global_id long, xi_0 double, xi_1 double")
    distinct = scenarios.distinct_points(points, xs)
    assert distinct.count() == len({r[1:] for r in made})
    for k in (1, 2, 3, 4, 9):
        assert scenarios._least_rows(Fit(), points, distinct, xs, k) == scenarios._least(Fit().predict(points, xs), xs, "abs(y_hat)", k)
