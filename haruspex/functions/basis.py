"""Orthonormal polynomial bases of total degree, as Column expressions and as numpy matrices."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import comb, factorial, gamma, prod, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = ("hermite_e", "hermite", "legendre", "jacobi")


def multi_indices(d: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents whose sum is at most ``degree``, by sum and then as the product enumerates them."""
    if d * (degree + 1) ** d > 5_000_000:
        return _indices_by_total(d, degree)
    return sorted((t for t in product(range(degree + 1), repeat=d) if sum(t) <= degree), key=sum)


def _indices_by_total(d: int, degree: int) -> list[tuple[int, ...]]:
    def of(total: int, left: int):
        if left == 1:
            yield (total,)
            return
        for first in range(total + 1):
            for rest in of(total - first, left - 1):
                yield (first, *rest)

    return [t for total in range(degree + 1) for t in of(total, d)]


@dataclass(frozen=True)
class Basis:
    """``family`` in ``d`` variables up to total ``degree``; Jacobi takes its exponents in ``params``."""

    family: str
    d: int
    degree: int
    params: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"unknown family {self.family}")

    @property
    def indices(self) -> list[tuple[int, ...]]:
        return multi_indices(self.d, self.degree)

    @property
    def size(self) -> int:
        return comb(self.d + self.degree, self.d)

    def norm_squared(self, n: int) -> float:
        """Second moment of the n-th polynomial under the family's probability density."""
        match self.family:
            case "hermite_e":
                return float(factorial(n))
            case "hermite":
                return float(factorial(n) * 2**n)
            case "legendre":
                return 1.0 / (2 * n + 1)
        a, b = self.params
        if n == 0:
            return 1.0
        full = 2 ** (a + b + 1) * gamma(a + 1) * gamma(b + 1) / gamma(a + b + 2)
        return 2 ** (a + b + 1) / (2 * n + a + b + 1) * gamma(n + a + 1) * gamma(n + b + 1) / (gamma(n + a + b + 1) * factorial(n)) / full

    def _next(self, n: int, x, now, before):
        """Three-term recurrence; works on Columns and on arrays."""
        match self.family:
            case "hermite_e":
                return x * now - float(n) * before if n else x * now
            case "hermite":
                return 2.0 * x * now - 2.0 * n * before if n else 2.0 * x * now
            case "legendre":
                return ((2 * n + 1.0) * x * now - float(n) * before) / float(n + 1) if n else x * now
        a, b = self.params
        if n == 0:
            return (a - b) / 2 + (a + b + 2) / 2 * x
        s = 2 * n + a + b
        c1 = 2.0 * (n + 1) * (n + a + b + 1) * s
        return ((s + 1) * (a * a - b * b) + s * (s + 1) * (s + 2) * x) / c1 * now - 2 * (n + a) * (n + b) * (s + 2) / c1 * before

    def one_dim(self, x, one) -> list:
        """Polynomials 0 to ``degree`` of one variable; ``one`` is the constant 1 of x's kind."""
        out = [one]
        for n in range(self.degree):
            out.append(self._next(n, x, out[n], out[n - 1] if n else None))
        return out

    def norms(self) -> list[float]:
        return [sqrt(prod(self.norm_squared(n) for n in t)) for t in self.indices]

    def vandermonde(self, xi: np.ndarray) -> np.ndarray:
        """(n, size) matrix of normalised values at points of shape (d, n)."""
        xi = np.asarray(xi, float).reshape(self.d, -1)
        rows = [self.one_dim(x, np.ones_like(x)) for x in xi]
        out = np.empty((xi.shape[1], self.size))
        for k, (t, norm) in enumerate(zip(self.indices, self.norms())):
            v = rows[0][t[0]].copy()
            for i, n in enumerate(t[1:], 1):
                v *= rows[i][n]
            out[:, k] = v / norm
        return out

    def with_powers(self, df, names: list[str], prefix: str = "__b"):
        """``df`` with one column for each variable and degree; the terms then share them."""
        for i, x in enumerate(names):
            values = [F.lit(1.0), F.col(x)]
            df = df.withColumn(f"{prefix}_{i}_0", values[0])
            for n in range(self.degree):
                now, before = F.col(f"{prefix}_{i}_{n}"), F.col(f"{prefix}_{i}_{n - 1}") if n else None
                df = df.withColumn(f"{prefix}_{i}_{n + 1}", self._next(n, F.col(x), now, before))
        return df

    def terms(self, active: list[int] | None = None, prefix: str = "__b") -> list[Column]:
        """Normalised terms over the columns that ``with_powers`` made; only the active ones, if given."""
        idx, norms = self.indices, self.norms()
        out = []
        for k in range(len(idx)) if active is None else active:
            factors = [F.col(f"{prefix}_{i}_{n}") for i, n in enumerate(idx[k]) if n]
            v = F.lit(1.0)
            for f in factors:
                v = v * f
            out.append(v / norms[k])
        return out

    def gauss_nodes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and weights of the n-point rule; weights sum to 1."""
        match self.family:
            case "hermite_e":
                x, w = np.polynomial.hermite_e.hermegauss(n)
            case "hermite":
                x, w = np.polynomial.hermite.hermgauss(n)
            case "legendre":
                x, w = np.polynomial.legendre.leggauss(n)
            case _:
                x, w = self._golub_welsch(n)
        return x, w / w.sum()

    def _golub_welsch(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.params
        k = np.arange(n, dtype=float)
        s = 2 * k + a + b
        with np.errstate(divide="ignore", invalid="ignore"):
            diag = np.where(s * (s + 2) == 0, (b - a) / (a + b + 2), (b * b - a * a) / (s * (s + 2)))
        j = np.arange(1, n, dtype=float)
        t = 2 * j + a + b
        off = 4 * j * (j + a) * (j + b) * (j + a + b) / (t * t * (t * t - 1))
        if n > 1:
            off[0] = 4 * (1 + a) * (1 + b) / ((a + b + 2) ** 2 * (a + b + 3))
        x, v = np.linalg.eigh(np.diag(diag) + np.diag(np.sqrt(off), 1) + np.diag(np.sqrt(off), -1))
        return x, v[0] ** 2
