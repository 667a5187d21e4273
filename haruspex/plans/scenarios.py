"""Named adaptive runs on frozen pools and on the driver's tables, by a registry that takes no import paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haruspex.functions.models import MODELS, evaluate
from haruspex.operators.adaptive import Campaign, Outcome, Problem, array_hash, publication
from haruspex.operators.settle import settled
from haruspex.sources.frozen import POOLS, benchmark_pool, pool, table

#: name: model and its inputs over the coordinates, basis family, whether the quantity of interest is the share of failures, and what is least at the centres
REDUCED = {
    "four_branch": ("four_branch", ("xi_0", "xi_1"), "hermite_e", True, "abs(y)"),
    "gayton": ("gayton_shifted", ("xi_0", "xi_1"), "hermite_e", True, "abs(y)"),
    "ishigami": ("ishigami", tuple(f"({MODELS['ishigami'].inputs[0][2] / 2!r}D * xi_{k})" for k in range(3)), "legendre", False, "-abs(power(pi() * xi_2, 4) * sin(pi() * xi_0))"),
}
#: name: tolerance of the quantity of interest, stable orders asked for, whether overfitting leads to a rebuild
SMALL = {"converged": (1e9, 1, False), "max_order": (1e-12, 1, False), "overfit_fallback": (1e-12, 99, True), "runtime_failure": (1e-12, 1, False)}


def failures(y):
    return F.avg((y <= 0).cast("double"))


def _least(points: DataFrame, xs: list[str], score: str, k: int) -> list[tuple]:
    """The k points of the least score, by id on ties."""
    rows = points.withColumn("__s", F.expr(score)).orderBy("__s", "global_id").limit(k).select(*xs).collect()
    return [tuple(r) for r in rows]


def _roles(spark: SparkSession, arrays: dict) -> dict[str, DataFrame]:
    return {role: table(spark, {role: a}).drop("role") for role, a in arrays.items()}


def reduced(spark: SparkSession, name: str, folder: str | None = None, steps: int | None = None) -> Outcome | None:
    model, inputs, family, failing, score = REDUCED[name]
    arrays, p = pool(name), POOLS[name]
    rows, xs = _roles(spark, {k: arrays[k] for k in ("candidate", "test")}), [f"xi_{k}" for k in range(p.d)]
    value = evaluate(model, inputs)
    profile = publication(cv_folds=4, cv_seed=p.cv_seed, qoi_tolerance=1e-3, outer_checks=1, inner_tolerance=None, max_inner=3, doi_least=8, overfit_rebuild=False)
    near = _least(rows["test"].withColumn("y", value), xs, score, 8)
    problem = Problem(rows["candidate"], xs, value, family, rows["test"], failures if failing else F.var_pop, centers=near, radius=0.75, mark=array_hash(arrays["candidate"]))
    return Campaign(problem, profile, range(2, 5), folder).run(steps)


def small(spark: SparkSession, name: str, folder: str | None = None, steps: int | None = None, **over) -> Outcome | None:
    if name not in SMALL:
        raise ValueError(f"unknown scenario: {name}")
    arrays = benchmark_pool()
    rows, (tolerance, checks, rebuild) = _roles(spark, arrays), SMALL[name]
    profile = publication(**({"cv_folds": 4, "cv_seed": 8080, "inner_tolerance": None, "max_inner": 3, "doi_least": 4, "qoi_tolerance": tolerance, "outer_checks": checks, "overfit_rebuild": rebuild} | {k: v for k, v in over.items() if k != "radius"}))
    problem = Problem(
        rows["candidate"], ["xi_0", "xi_1"], F.lit(float("nan")) if name == "runtime_failure" else evaluate("quadratic_mix", ["xi_0", "xi_1"]), "hermite_e", rows["test"], F.avg,
        accuracy=(lambda fit, q: False) if name in ("max_order", "overfit_fallback") else None, centers=[tuple(x) for x in arrays["test"][:, :4].T.tolist()], radius=over.get("radius", 0.55),
        cv_labels={1: 1.0, 2: 2.0, 3: 3.0} if name == "overfit_fallback" else None, mark=array_hash(arrays["candidate"]),
    )
    return Campaign(problem, profile, range(1, {"converged": 2, "runtime_failure": 1}.get(name, 3) + 1), folder).run(steps)


def distinct_points(points: DataFrame, xs: list[str]) -> DataFrame:
    """Each point once, under its smallest id, which is what a pool must be; and how many rows it stands for."""
    return settled(points.groupBy(*xs).agg(F.min("global_id").alias("global_id"), F.count(F.lit(1)).alias("__rows")).select("global_id", *xs, "__rows"))


def _least_rows(fit, points: DataFrame, distinct: DataFrame, xs: list[str], k: int) -> list[tuple]:
    """As ``_least`` of all points by the size of the prediction, from the distinct ones; only equal predictions of several points need the rows themselves."""
    top = fit.predict(distinct, xs).withColumn("__s", F.expr("abs(y_hat)")).orderBy("__s", "global_id").limit(k + 1).collect()
    out: list[tuple] = []
    for r, after in zip(top, [*top[1:], None]):
        if len(out) >= k:
            break
        if after is not None and after["__s"] == r["__s"]:
            tied = distinct.sparkSession.createDataFrame([tuple(t[x] for x in xs) for t in top[:k]], distinct.select(*xs).schema)
            return _least(fit.predict(points.join(F.broadcast(tied), xs, "left_semi"), xs), xs, "abs(y_hat)", k)
        out += [tuple(r[x] for x in xs)] * r["__rows"]
    return out[:k]


def over_points(points: DataFrame, model: str, folder: str | None = None, steps: int | None = None) -> Outcome | None:
    """A run over any table ``global_id, xi_0, xi_1`` of standardised points: its distinct points are the pool, and all are the test set.

    Points are read once: equal ones have equal predictions, so the run's scans are of the distinct points and their numbers of rows.
    """
    value, xs = evaluate(model, ["xi_0", "xi_1"]), ["xi_0", "xi_1"]
    distinct = distinct_points(points, xs)

    def boundary(fit) -> list[tuple]:
        """The points whose prediction is nearest to failure."""
        return _least_rows(fit, points, distinct, xs, 4)

    def failing(y):
        """``failures`` over all points."""
        return F.sum((y <= 0).cast("double") * F.col("__rows")) / F.sum("__rows")

    profile = publication(cv_folds=4, cv_seed=1, qoi_tolerance=0.02, outer_checks=1, inner_tolerance=0.02, max_inner=2, doi_least=8, overfit_rebuild=False)
    problem = Problem(distinct.drop("__rows"), xs, value, "hermite_e", distinct, failing, centers=boundary, radius=0.1)
    return Campaign(problem, profile, range(2, 5), folder).run(steps)
