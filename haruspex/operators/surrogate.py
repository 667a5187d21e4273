"""Polynomial chaos surrogates: fit on small designs, predict anywhere."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haruspex.functions.basis import Basis
from haruspex.operators import linalg

#: Terms up to which a prediction is one generated expression; beyond, Arrow batches are multiplied in numpy.
MAX_TERMS = 60


@dataclass(frozen=True)
class Surrogate:
    """Coefficients of a basis's active terms."""

    basis: Basis
    active: tuple[int, ...]
    coefficients: tuple[float, ...]
    cv_error: float | None = None

    def mean(self) -> float:
        return dict(zip(self.active, self.coefficients)).get(0, 0.0)

    def variance(self) -> float:
        return float(sum(c * c for k, c in zip(self.active, self.coefficients) if k))

    def predict(self, df: DataFrame, xs: list[str], name: str = "y_hat") -> DataFrame:
        """``df`` with predictions; only active terms are computed."""
        if len(self.active) <= MAX_TERMS:
            made = self.basis.with_powers(df, xs)
            value = sum((t * float(c) for t, c in zip(self.basis.terms(list(self.active)), self.coefficients)), F.lit(0.0))
            return made.select(*df.columns, value.alias(name))
        return self._in_batches(df, xs, name)

    def _in_batches(self, df: DataFrame, xs: list[str], name: str) -> DataFrame:
        import pyarrow as pa
        from pyspark.sql import types as T

        schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
        at, basis, active, coef = [df.columns.index(x) for x in xs], self.basis, list(self.active), np.array(self.coefficients)

        def run(batches):
            for b in batches:
                out = np.empty(b.num_rows)
                for i in range(0, b.num_rows, 4096):
                    xi = np.stack([b.column(k).to_numpy(zero_copy_only=False)[i : i + 4096] for k in at])
                    out[i : i + 4096] = basis.vandermonde(xi)[:, active] @ coef
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[f.name for f in schema])

        return df.mapInArrow(run, schema)


def christoffel_weight(basis: Basis, active: list[int] | None = None) -> Column:
    """P over the sum of squared terms; over the columns that ``with_powers`` made."""
    terms = basis.terms(active)
    return F.lit(float(len(terms))) / sum((t * t for t in terms), F.lit(0.0))


def _folded(df: DataFrame, basis: Basis, xs: list[str], y: str, weight: str | None, n_folds: int, seed: int) -> list[linalg.Moments]:
    """Sums of products of the basis terms and y, by folds that a hash of the coordinates tells: one pass, nothing collected but them."""
    names = [f"__t{k}" for k in range(basis.size)]
    fold = F.pmod(F.xxhash64(*xs, F.lit(seed)), F.lit(n_folds))
    made = basis.with_powers(df.withColumn("__f", fold), xs)
    made = made.select("__f", *[t.alias(n) for n, t in zip(names, basis.terms())], F.col(y).cast("double").alias("__y"), *([F.col(weight).alias("__w")] if weight else []))
    return linalg.fold_moments(made, names, "__y", F.col("__f"), n_folds, "__w" if weight else None)


def fit_ols(df: DataFrame, basis: Basis, xs: list[str], y: str, weight: str | None = None, active: list[int] | None = None) -> Surrogate:
    """Least squares on all rows, by one distributed reduction."""
    idx = list(range(basis.size)) if active is None else list(active)
    made = basis.with_powers(df, xs).select(*[t.alias(f"__t{k}") for k, t in zip(idx, basis.terms(idx))], F.col(y).cast("double").alias("__y"), *([F.col(weight).alias("__w")] if weight else []))
    G, b, _ = linalg.gram_matrix(made, [f"__t{k}" for k in idx], "__y", "__w" if weight else None)
    return Surrogate(basis, tuple(idx), tuple(linalg.solve_ols(G, b).tolist()))


def fit_lars(df: DataFrame, basis: Basis, xs: list[str], y: str, weight: str | None = None, n_folds: int = 5, seed: int = 0) -> Surrogate:
    """Least angle path with a cross-validated prefix, then least squares on it; equal points are in one fold."""
    fit = linalg.sparse_fit(_folded(df, basis, xs, y, weight, n_folds, seed))
    return Surrogate(basis, tuple(fit.selected), tuple(fit.coefficients.tolist()), fit.cv_error)


def fit_lasso(df: DataFrame, basis: Basis, xs: list[str], y: str, weight: str | None = None, n_folds: int = 5, seed: int = 0) -> Surrogate:
    fit = linalg.lasso_fit(_folded(df, basis, xs, y, weight, n_folds, seed))
    return Surrogate(basis, tuple(fit.selected), tuple(fit.coefficients.tolist()), fit.cv_error)


def fit_quadrature(nodes: DataFrame, basis: Basis, xs: list[str], y: str, w: str = "w") -> Surrogate:
    """Projection by quadrature: the sum of w * y * term, one aggregate for each term."""
    made = basis.with_powers(nodes, xs)
    row = made.agg(*[F.sum(F.col(w) * F.col(y) * t).alias(f"c{k}") for k, t in enumerate(basis.terms())]).first()
    return Surrogate(basis, tuple(range(basis.size)), tuple(float(v) for v in row))


def mallows_cp(df: DataFrame, basis: Basis, xs: list[str], y: str) -> list[float]:
    """Mallows' Cp of every prefix of the least angle path, from one reduction."""
    (all_,) = _folded(df, basis, xs, y, None, 1, 0)
    G, b, yy = all_.shifted(np.zeros(basis.size + 1), np.ones(basis.size + 1))
    path, n = linalg.lars_order(G, b, all_.n), all_.n
    sse = lambda cols: max(0.0, float(yy - b[cols] @ linalg.solve_ols(G[np.ix_(cols, cols)], b[cols])))
    s2 = sse(path) / max(1, n - len(path))
    return [sse(path[:k]) / s2 - n + 2 * k if s2 else float(k) for k in range(1, len(path) + 1)]


def mixture_predict(df: DataFrame, models: list[Surrogate], xs: list[str], id_col: str, seed: int = 0, name: str = "y_hat") -> DataFrame:
    """Each row by one of several surrogates, drawn by a hash of its id."""
    out = df
    for k, m in enumerate(models):
        out = m.predict(out, xs, f"__m{k}")
    pick = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(len(models))).cast("int")
    return out.select(*df.columns, F.get(F.array(*[F.col(f"__m{k}") for k in range(len(models))]), pick).alias(name))


def score_panel(df: DataFrame, y: str, fit: str) -> DataFrame:
    from haruspex.operators.stats import regression_metrics

    return regression_metrics(df, y, fit)
