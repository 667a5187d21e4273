"""The least-volume ellipsoid around a table's points, by a core set.

Only points on the boundary matter.  Weights of a bounded core set are optimised on
the driver; then one scan of the table finds the points that lie furthest out in
the ellipsoid's own measure, which join the core set.  The largest measure also
bounds how far the volume is from the least, so the result states its gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import gamma, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that a scan adds to the core set.
ADDED = 8


@dataclass(frozen=True)
class Ellipsoid:
    """(x - center)' shape (x - center) <= 1."""

    center: np.ndarray
    shape: np.ndarray
    #: The volume is at most (1 + gap) ** (d / 2) times the least.
    gap: float

    def volume(self) -> float:
        d = len(self.center)
        return pi ** (d / 2) / gamma(d / 2 + 1) / float(np.sqrt(np.linalg.det(self.shape)))

    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        """Half axes, longest first, and their directions as columns."""
        ev, v = np.linalg.eigh(self.shape)
        return 1 / np.sqrt(ev), v

    def surface(self, n: int) -> np.ndarray:
        """A grid of points on the surface: n angles in the plane, n x n of longitude and latitude in space."""
        angle = np.linspace(0, 2 * pi, n)
        if len(self.center) == 2:
            unit = np.stack([np.cos(angle), np.sin(angle)])
        elif len(self.center) == 3:
            lat = np.linspace(0, pi, n)
            unit = np.stack([np.outer(np.cos(angle), np.sin(lat)), np.outer(np.sin(angle), np.sin(lat)), np.outer(np.ones(n), np.cos(lat))]).reshape(3, -1)
        else:
            raise ValueError("a surface is drawn in two or three dimensions")
        half, v = self.axes()
        return (self.center[:, None] + v @ (half[:, None] * unit)).T

    def measure(self, xs: list[str]) -> Column:
        """Of each row: 1 on the surface, less inside."""
        off = [F.col(x).cast("double") - float(c) for x, c in zip(xs, self.center)]
        return sum((a * b * float(self.shape[i, j]) for i, a in enumerate(off) for j, b in enumerate(off)), F.lit(0.0))


def _weights(q: np.ndarray, u: np.ndarray, tolerance: float, rounds: int = 20_000) -> np.ndarray:
    """Weights of lifted points whose moment matrix has the largest determinant: steps to the furthest point and away from the nearest with weight."""
    n = q.shape[1]
    m = np.linalg.inv((q * u[:, None]).T @ q)
    k = np.einsum("ij,jk,ik->i", q, m, q)
    for turn in range(rounds):
        far = int(np.argmax(k))
        on = np.where(u > 1e-14, k, np.inf)
        near = int(np.argmin(on))
        if max(k[far] / n - 1, 1 - k[near] / n) <= tolerance:
            break
        if k[far] / n - 1 >= 1 - k[near] / n:
            i, step = far, (k[far] - n) / (n * (k[far] - 1))
        else:
            i = near
            step = max((k[near] - n) / (n * (k[near] - 1)) if k[near] > 1 else -np.inf, -u[near] / (1 - u[near]) if u[near] < 1 else -np.inf)
        u = (1 - step) * u
        u[i] += step
        u = np.clip(u, 0, None)
        if turn % 50 == 49:
            m = np.linalg.inv((q * u[:, None]).T @ q)
        else:  # a change of rank one
            v = m @ q[i]
            m = (m - np.outer(v, v) * (step / (1 - step + step * k[i]))) / (1 - step)
        k = np.einsum("ij,jk,ik->i", q, m, q)
    return u / u.sum()


def least_ellipsoid(df: DataFrame, xs: list[str], tolerance: float = 1e-6, scans: int = 200) -> Ellipsoid:
    """Around all rows with finite coordinates; its gap is at most ``tolerance``.

    Raises for points that lie in a plane, which no ellipsoid of a volume is least around, and
    where the gap isn't reached in so many scans.
    """
    d = len(xs)
    points = df.select(*[F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)])
    for k in range(d):
        points = points.where(F.col(f"x{k}").isNotNull() & (F.abs(F.col(f"x{k}")) < float("inf")))
    names = [f"x{k}" for k in range(d)]
    # the furthest both ways on each axis: 2 d points
    seeds = points.agg(*[f(F.struct(x, *[n for n in names if n != x])) for x in names for f in (F.min, F.max)]).first()
    if seeds[0] is None:
        raise ValueError("there are no points")
    core = np.unique(np.array([[s[n] for n in names] for s in seeds], float), axis=0)
    low, wide = core.min(0), np.ptp(core, axis=0)
    if not (wide > 0).all():
        raise ValueError("the points lie in a plane")
    core = (core - low) / wide  # a unit cube, so that nothing depends on units
    lifted = lambda x: np.hstack([x, np.ones((len(x), 1))])

    def furthest(m: np.ndarray) -> np.ndarray:
        """The points of the largest measure q' m q."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, value = np.zeros((0, d)), np.zeros(0)
            for b in batches:
                x = (np.column_stack([b.column(k).to_numpy() for k in range(d)]) - low) / wide
                q = lifted(x)
                best, value = np.vstack([best, x]), np.append(value, np.einsum("ij,jk,ik->i", q, m, q))
                top = np.argsort(-value, kind="stable")[:ADDED]
                best, value = best[top], value[top]
            yield pa.RecordBatch.from_arrays([*[pa.array(best[:, k]) for k in range(d)], pa.array(value)], names=[*names, "v"])

        rows = points.mapInArrow(run, ", ".join(f"{n} double" for n in names) + ", v double").orderBy(F.desc("v"), *names).limit(ADDED).collect()
        return np.array([[*(r[n] for n in names), r["v"]] for r in rows])

    # directions that the core set lacks, by what lies furthest beyond its span
    while np.linalg.matrix_rank(lifted(core), tol=1e-9) < d + 1:
        span = np.linalg.svd(lifted(core))[2][: np.linalg.matrix_rank(lifted(core), tol=1e-9)]
        got = furthest(np.eye(d + 1) - span.T @ span)
        if got[0, -1] <= 1e-18:
            raise ValueError("the points lie in a plane")
        core = np.vstack([core, got[:1, :d]])
    u = np.full(len(core), 1.0 / len(core))
    for _ in range(scans):
        u = _weights(lifted(core), u, tolerance / 4)
        keep = u > 1e-12
        core, u = core[keep], u[keep] / u[keep].sum()
        m = np.linalg.inv((lifted(core) * u[:, None]).T @ lifted(core))
        got = furthest(m)
        gap = float(got[0, -1] / (d + 1) - 1)
        if gap <= tolerance:
            c = core.T @ u
            spread = (core * u[:, None]).T @ core - np.outer(c, c)
            # as wide as the furthest point asks for
            shape = np.linalg.inv(spread) / (d * max(1.0, (got[0, -1] - 1) / d) * (1 + 1e-12))
            return Ellipsoid(low + wide * c, shape / np.outer(wide, wide), max(0.0, gap))
        new = got[(got[:, -1] / (d + 1) - 1) > tolerance / 2, :d]
        new = np.array([x for x in np.unique(new, axis=0) if not (np.abs(core - x).max(1) == 0).any()]).reshape(-1, d)
        core = np.vstack([core, new])
        u = np.append(u * 0.9, np.full(len(new), 0.1 / max(1, len(new))))
        u /= u.sum()
    raise RuntimeError(f"a gap of {gap} is left")
