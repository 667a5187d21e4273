import numpy as np
import pytest
from pyspark.sql import functions as F

from haruspex.functions.models import evaluate
from haruspex.operators import adaptive, design
from haruspex.operators.adaptive import Campaign, Problem, dissertation, findings, invariants, publication, trace_table
from haruspex.operators.linalg import fit_path
from haruspex.functions.basis import Basis
from haruspex.plans import catalogue, scenarios
from haruspex.sources.files import run_config, validate_config


# The published outcomes
@pytest.mark.parametrize("name,want", [
    ("converged", ("converged", "outer_qoi_converged", 12, 15, 2)),
    ("max_order", ("nonconverged", "max_order_reached", 20, 23, 3)),
    ("overfit_fallback", ("overfit_fallback", "overfit_rebuild_not_converged", 20, 25, 2)),
    ("runtime_failure", ("runtime_failure", "runtime_failure", 0, 2, 1)),
])
def test_small_scenarios(spark, name, want):
    o = scenarios.small(spark, name)
    assert (o.status, o.reason, o.calls, len(o.trace), o.order) == want
    if name != "runtime_failure":
        assert invariants(o).count() == 0


# Hashes of discrete behaviour
@pytest.mark.parametrize("name,want", [
    ("gayton", "fdf6a793d8e5a1f89b2a10e5e87c682a6d8012b62315dbcf5f9adcbe5a3e0de9"),
    ("ishigami", "697fb5aa0a321fa871d59befd11571719cfa614cfc5517c4cfd76ce4d134a91c"),
])
def test_contract_hashes(spark, name, want):
    assert scenarios.reduced(spark, name).contract_hash() == want


def test_runs_go_on_from_any_step(spark, tmp_path):
    whole = scenarios.small(spark, "converged")
    for cut in (2, 5, 9):
        folder = str(tmp_path / str(cut))
        assert scenarios.small(spark, "converged", folder, steps=cut) is None
        # a transaction that no written state names doesn't count
        spark.createDataFrame([(0, 0.0, 0.0, 9.0, 0, 99)], "global_id long, xi_0 double, xi_1 double, y double, place int, txn int").write.parquet(f"{folder}/log/txn-00099")
        spark.createDataFrame([(1,)], "x int").write.parquet(f"{folder}/log/txn-{cut + 20:05d}")
        o = scenarios.small(spark, "converged", folder)
        assert o.trace == whole.trace and o.contract_hash() == whole.contract_hash()
    ended = scenarios.small(spark, "converged", str(tmp_path / "9"))
    assert ended.trace == whole.trace and ended.status == "converged"
    with pytest.raises(ValueError, match="another pool"):
        scenarios.reduced(spark, "gayton", str(tmp_path / "5"))


@pytest.mark.parametrize("over,calls", [({"budget_factor": 1.5}, 9), ({"doi_fallback": "global"}, 12), ({"doi_fallback": "skip"}, 12), ({"radius": 0.35}, 12)])
def test_sensitivity_calls(spark, over, calls):
    # Published model calls
    o = scenarios.small(spark, "converged", **over)
    assert (o.calls, o.status) == (calls, "converged")


def _replay(points, model, centers, radius, profile, orders):
    """Ids by batch of a run over points in memory, for a run without a domain of interest's fallback."""
    ids, batches, sparsity, values = [], [], 0, []
    xi = points[["xi_0", "xi_1"]].to_numpy().T
    y = model(xi)
    for order in orders:
        X = Basis("hermite_e", 2, order).vandermonde(xi)
        budget = int(np.ceil(profile.budget_factor * X.shape[1]))
        need = min(int(np.ceil(max(0.8 * X.shape[1], sparsity))), budget) - len(ids)
        free = lambda: [i for i in range(len(X)) if i not in set(ids)]
        if need > 0:
            batches.append(design.greedy(X, need, chosen=ids, pool=free(), criterion="D"))
            ids += batches[-1]
        fit = fit_path(X[ids], y[ids], n_folds=profile.cv_folds, seed=profile.cv_seed)
        for _ in range(profile.max_inner):
            n = min(design.batch_size(len(fit.selected)), budget - len(ids))
            if n <= 0:
                break
            batches.append(design.greedy(X[:, fit.selected], n, chosen=ids, pool=free(), criterion="D", pivot_start=False))
            ids += batches[-1]
            fit = fit_path(X[ids], y[ids], n_folds=profile.cv_folds, seed=profile.cv_seed)
            near = [i for i in free() if min(np.hypot(*(xi[:, i] - np.array(c))) for c in centers) <= radius]
            n = min(design.batch_size(len(fit.selected)), budget - len(ids), len(near))
            if n > 0:
                picks = design.greedy(X[near][:, fit.selected], n, criterion="D")
                batches.append([near[k] for k in picks])
                ids += batches[-1]
                fit = fit_path(X[ids], y[ids], n_folds=profile.cv_folds, seed=profile.cv_seed)
        sparsity = len(fit.selected)
        values.append(float((fit.predict(X) <= 0).mean()))
    return batches, values


def test_a_run_over_line_items_equals_a_replay_in_memory(spark, sf_dir, monkeypatch):
    points = scenarios.distinct_points(catalogue._points(spark, sf_dir, 2, True), ["xi_0", "xi_1"])
    rows = points.orderBy("global_id").toPandas()
    profile = publication(cv_folds=4, cv_seed=1, qoi_tolerance=0.0, inner_tolerance=None, max_inner=2, doi_least=0, overfit_rebuild=False)
    centers = [(1.5, 1.5), (-1.5, -1.0)]
    model = evaluate("quadratic_mix", ["xi_0", "xi_1"])
    problem = Problem(points, ["xi_0", "xi_1"], model, "hermite_e", points, scenarios.failures, centers=centers, radius=0.5, criterion="D")
    batches, values = _replay(rows, lambda x: 1.0 + 0.8 * x[0] + 0.35 * (x[1] ** 2 - 1.0) + 0.1 * x[0] * x[1], centers, 0.5, profile, (1, 2))
    for cells in (design.SMALL_POOL, 0):  # the same picks by scans of the table
        monkeypatch.setattr(design, "SMALL_POOL", cells)
        o = Campaign(problem, profile, range(1, 3)).run()
        got = {}
        for r in o.observations().orderBy("txn", "place").collect():
            got.setdefault(r["txn"], []).append(r["global_id"])
        assert list(got.values()) == [[int(rows["global_id"][i]) for i in b] for b in batches]
        assert [r["qoi"] for r in o.trace if r["stage"] == "order_completed"] == pytest.approx(values)
        assert invariants(o).count() == 0


def test_findings(spark):
    row = "global_id long, xi_0 double, xi_1 double, y double"
    found = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 1.0, 2.0, float("nan")), (3, 1.0, 2.0, 2.0), (4, 5.0, 5.0, None), (5, 7.0, 7.0, 1.0)], row)
    log = spark.createDataFrame([(9, 0.0, 0.0, 1.0), (5, 7.5, 7.0, 1.0)], row)
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5, 77)], "global_id long")
    got = {tuple(r) for r in findings(asked, found, log, ["xi_0", "xi_1"]).collect()}
    assert got == {("asked for twice", 5), ("not in the pool", 77), ("evaluated before", 5), ("a point that was evaluated before", 1), ("one point under two ids", 3), ("no finite response", 2), ("no finite response", 4)}


def test_invariants_tell_what_was_changed(spark, tmp_path):
    o = scenarios.small(spark, "converged", str(tmp_path / "run"))
    step = next(r["step"] for r in o.trace if r["stage"] == "doi_constructed")
    path = f"{o.log.folder}/log/txn-00001"
    rows = spark.createDataFrame(spark.read.parquet(path).collect(), o.log.schema)
    changed = rows.withColumn("y", F.when(F.col("place") == 0, F.col("y") + 1).otherwise(F.col("y"))).where("place <> 1")
    changed.coalesce(1).write.mode("overwrite").parquet(path)
    spark.createDataFrame([(o.trace[step]["evaluated_global_ids"][0], 0.0, step)] * 2, "global_id long, min_dist double, step int").write.mode("append").parquet(f"{o.log.folder}/doi/step-{step:05d}")
    o.trace[3]["active_path"] = [0, 0]
    o.trace[4]["added_global_ids"] = [95]
    found = {(r["invariant"], r["step"]) for r in invariants(o).collect()}
    for want in (("responses are the model's", None), ("the last record's ids are those of the log", None), ("a domain names a point once", step), ("a domain holds no evaluated point", step), ("a path names a term once", 3), ("selected terms begin the path", 3), ("additions are evaluated", 4)):
        assert want in found, want


def test_errors_are_not_outcomes(spark):
    points = spark.createDataFrame([(k, float(k), float(k % 3)) for k in range(20)], "global_id long, xi_0 double, xi_1 double")
    problem = Problem(points, ["xi_0", "xi_1"], F.col("xi_0"), "hermite_e", points, lambda y: F.avg(F.col("no_such_column")))
    with pytest.raises(Exception, match="no_such_column"):
        Campaign(problem, publication(), range(1, 2)).run()
    twice = Problem(points.withColumn("xi_0", F.lit(1.0)).withColumn("xi_1", F.lit(2.0)), ["xi_0", "xi_1"], F.col("xi_0"), "hermite_e")
    o = Campaign(twice, publication(), range(1, 2)).run()
    assert o.status == "runtime_failure" and "one point under two ids" in o.trace[-1]["error_message"] and o.calls == 0


def test_profiles():
    publication().check()
    with pytest.raises(ValueError, match="budget"):
        dissertation().check()
    with pytest.raises(ValueError, match="not stated"):
        dissertation(budget_factor=2.0).check()


def test_config_is_closed(spark):
    good = {"schema": "v1", "purpose": "software_benchmark", "scale": "reduced", "runner": {"kind": "deterministic_benchmark", "benchmark": "small", "scenarios": ["converged"]}, "output": {"manifest": "m.json"}}
    a, b = run_config(spark, good), run_config(spark, good)
    assert a["manifest_hash"] == b["manifest_hash"] and a["scenarios"]["converged"]["calls"] == 12
    for bad in ({**good, "more": 1}, {**good, "scale": "full"}, {**good, "runner": {**good["runner"], "scenarios": ["converged", "converged"]}}):
        with pytest.raises(ValueError):
            validate_config(bad)


def test_trace_table(spark):
    t = trace_table(spark, scenarios.small(spark, "converged"))
    assert t.count() == 15 and t.columns == [f.name for f in adaptive.TRACE]
