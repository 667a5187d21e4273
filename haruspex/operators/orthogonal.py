"""Least squares by orthogonal factors of tall tables: a tree of small QR factorisations.

X'X squares a design's condition number, so beyond 1e8 nothing is left of its small
directions.  Each task factors its rows block by block and sends one triangular
factor of p * p numbers; factors are merged by FAN at a time until few are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haruspex.operators.settle import settled

#: Factors that are merged at a time, and that the driver merges at last.
FAN = 64


def _packed(r: np.ndarray, k: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["k", "r"])


def _merged(blobs, p: int) -> np.ndarray:
    acc = np.zeros((0, p))
    for b in blobs:
        acc = np.linalg.qr(np.vstack([acc, np.frombuffer(b, "<f8").reshape(-1, p)]), mode="r")
    return acc


def triangular(df: DataFrame, columns: list[str], weight: str | None = None) -> np.ndarray:
    """R of the rows' QR factorisation, each row times the root of its weight; rows with a null take no part.

    One pass over the rows, in any order; R is unique up to the signs of its rows, which
    are made such that the diagonal isn't negative.  Fewer rows than columns, or none,
    are filled up with zero rows.
    """
    p = len(columns)
    picked = df.select(*[F.col(c).cast("double") for c in columns], *([F.sqrt(F.col(weight)).cast("double").alias("__w")] if weight else [])).dropna()
    block = max(4 * p, 4096)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        acc = np.zeros((0, p))
        for b in batches:
            rows = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(p)])
            if weight:
                rows = rows * b.column(p).to_numpy(zero_copy_only=False)[:, None]
            for a in range(0, len(rows), block):
                acc = np.linalg.qr(np.vstack([acc, rows[a : a + block]]), mode="r")
        if len(acc):
            yield _packed(acc, TaskContext.get().partitionId())

    def merge(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_packed(_merged(t["r"].to_pylist(), p), t["k"][0].as_py())])

    made = settled(picked.mapInArrow(factors, "k long, r binary"))
    while made.count() > FAN:
        made = settled(made.withColumn("k", F.expr(f"k div {FAN}")).groupBy("k").applyInArrow(merge, "k long, r binary"))
    # some FAN factors of p * p numbers
    r = _merged([x["r"] for x in made.orderBy("k").collect()], p)
    r = np.vstack([r, np.zeros((p - len(r), p))])[:p]
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def condition_number(r: np.ndarray) -> float:
    """Of the design whose factor is ``r``; infinite if a direction is missing."""
    s = np.linalg.svd(r, compute_uv=False)
    return float("inf") if s[-1] == 0 else float(s[0] / s[-1])


def solve(r: np.ndarray, rcond: float = 1e-14) -> tuple[np.ndarray, float]:
    """(coefficients, sum of squared residuals) from the factor of (X, y): the minimum-norm solution if X lacks rank."""
    top, z = r[:-1, :-1], r[:-1, -1]
    u, s, vt = np.linalg.svd(top)
    on = s > rcond * max(s[0], 1e-300) if len(s) else s > 0
    beta = vt[on].T @ ((u[:, on].T @ z) / s[on])
    left = z - top @ beta
    return beta, float(left @ left + r[-1, -1] ** 2)


def leave_one_out(df: DataFrame, columns: list[str], y: str, adjusted: bool = False) -> float:
    """Leave-one-out error relative to the variance of y: a factor, then one pass for leverages and residuals in Arrow batches.

    A row's leverage is the squared length of its solution against R, so nothing is inverted.
    ``adjusted`` applies Chapelle's small-sample factor.
    """
    r = triangular(df, [*columns, y])
    beta, _ = solve(r)
    u, s, vt = np.linalg.svd(r[:-1, :-1])
    on = s > 1e-14 * max(s[0], 1e-300)
    half, p = vt[on].T / s[on], len(columns)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(p)])
            v = b.column(p).to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore", invalid="ignore"):
                e = (v - x @ beta) / (1 - ((x @ half) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(e * e), pa.array(v)], names=["e", "y"])

    picked = df.select(*[F.col(c).cast("double") for c in [*columns, y]]).dropna()
    row = picked.mapInArrow(errors, "e double, y double").agg(F.avg("e"), F.var_pop("y"), F.count(F.lit(1))).first()
    err = row[0] / row[1]
    if adjusted:
        n = row[2]
        err *= n / (n - p) * (1 + float((1 / s[on] ** 2).sum()))
    return float(err)
