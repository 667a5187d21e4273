"""Marginal distributions and site models as descriptors that compile to Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, pi, sin
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from haruspex.functions.special import normal_cdf, normal_pdf, normal_ppf


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


@dataclass(frozen=True)
class Marginal:
    """``family`` with ``params``; a parameter may be a Column, which makes the marginal conditional on it."""

    family: str
    params: tuple

    def cdf(self, x: Column) -> Column:
        p = [_col(v) for v in self.params]
        match self.family:
            case "norm":
                return normal_cdf((x - p[0]) / p[1])
            case "uniform":  # lower end, width
                return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - p[0]) / p[1]))
            case "lognorm":  # mean and standard deviation of the logarithm
                return F.when(x <= 0, F.lit(0.0)).otherwise(normal_cdf((F.log(F.when(x > 0, x)) - p[0]) / p[1]))
            case "weibull":  # shape, location, scale
                z = (x - p[1]) / p[2]
                return F.when(z <= 0, F.lit(0.0)).otherwise(1 - F.exp(-F.pow(F.when(z > 0, z), p[0])))
            case "gumbel":
                return F.exp(-F.exp(-(x - p[0]) / p[1]))
            case "expon":
                return F.when(x <= p[0], F.lit(0.0)).otherwise(1 - F.exp(-(x - p[0]) / p[1]))
        raise ValueError(f"unknown family {self.family}")

    def ppf(self, u: Column) -> Column:
        p = [_col(v) for v in self.params]
        inside = F.when((u > 0) & (u < 1), u)
        match self.family:
            case "norm":
                return p[0] + p[1] * normal_ppf(u)
            case "uniform":
                return p[0] + p[1] * u
            case "lognorm":
                return F.exp(p[0] + p[1] * normal_ppf(u))
            case "weibull":
                return p[1] + p[2] * F.pow(-F.log(1 - inside), 1 / p[0])
            case "gumbel":
                return p[0] - p[1] * F.log(-F.log(inside))
            case "expon":
                return p[0] - p[1] * F.log(1 - inside)
        raise ValueError(f"unknown family {self.family}")

    def pdf(self, x: Column) -> Column:
        p = [_col(v) for v in self.params]
        match self.family:
            case "norm":
                return normal_pdf((x - p[0]) / p[1]) / p[1]
            case "uniform":
                return F.when((x >= p[0]) & (x <= p[0] + p[1]), 1 / p[1]).otherwise(F.lit(0.0))
            case "lognorm":
                pos = F.when(x > 0, x)
                return F.when(x <= 0, F.lit(0.0)).otherwise(normal_pdf((F.log(pos) - p[0]) / p[1]) / (pos * p[1]))
            case "weibull":
                z = F.when(x > p[1], (x - p[1]) / p[2])
                return F.when(x <= p[1], F.lit(0.0)).otherwise(p[0] / p[2] * F.pow(z, p[0] - 1) * F.exp(-F.pow(z, p[0])))
            case "gumbel":
                z = (x - p[0]) / p[1]
                return F.exp(-z - F.exp(-z)) / p[1]
            case "expon":
                return F.when(x < p[0], F.lit(0.0)).otherwise(F.exp(-(x - p[0]) / p[1]) / p[1])
        raise ValueError(f"unknown family {self.family}")


def norm(mean=0.0, std=1.0) -> Marginal:
    return Marginal("norm", (mean, std))


def uniform(low=0.0, width=1.0) -> Marginal:
    return Marginal("uniform", (low, width))


def lognorm(mean_log=0.0, std_log=1.0) -> Marginal:
    return Marginal("lognorm", (mean_log, std_log))


def weibull(shape, loc=0.0, scale=1.0) -> Marginal:
    return Marginal("weibull", (shape, loc, scale))


def map_domain(x: Column, source: Marginal, target: Marginal, clip: float | None = None) -> Column:
    """``x`` carried from one marginal to another; affine between two of the same location-scale family.

    ``clip`` keeps probabilities that far from 0 and 1.
    """
    if source.family == target.family == "uniform":
        return _col(target.params[0]) + (x - _col(source.params[0])) / _col(source.params[1]) * _col(target.params[1])
    if source.family == target.family == "norm":
        return _col(target.params[0]) + (x - _col(source.params[0])) / _col(source.params[1]) * _col(target.params[1])
    u = source.cdf(x)
    if clip is not None:
        u = F.least(F.greatest(u, F.lit(clip)), F.lit(1 - clip))
    return target.ppf(u)


def finite(x: Column, what: str = "value") -> Column:
    """``x``, failing on null, NaN or infinity."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"non-finite {what}")).cast("double")).otherwise(x)


def truncated_ppf(u: Column, marginal: Marginal, low, high) -> Column:
    """Quantile of a marginal truncated to [low, high]."""
    a, b = marginal.cdf(_col(low)), marginal.cdf(_col(high))
    return marginal.ppf(a + u * (b - a))


def joint_pdf(xs: list[Column], marginals: list[Marginal | float]) -> Column:
    """Product of independent marginals' densities; constants don't count."""
    out = F.lit(1.0)
    for x, m in zip(xs, marginals):
        if isinstance(m, Marginal):
            out = out * m.pdf(x)
    return out


def joint_cdf(xs: list[Column], marginals: list[Marginal | float]) -> Column:
    out = F.lit(1.0)
    for x, m in zip(xs, marginals):
        if isinstance(m, Marginal):
            out = out * m.cdf(x)
    return out


def rosenblatt(xs: list[Column], chain, target: Marginal | None = None) -> list[Column]:
    """Conditional probabilities of a chain (and their ``target`` quantiles); ``chain[k](xs[:k])`` is the k-th marginal."""
    us = [m(xs[:k]).cdf(x) for k, (x, m) in enumerate(zip(xs, chain))]
    return us if target is None else [target.ppf(u) for u in us]


def inverse_rosenblatt(us: list[Column], chain, source: Marginal | None = None) -> list[Column]:
    """Values of a chain whose conditional probabilities (or ``source`` quantiles) are given."""
    xs: list[Column] = []
    for u, m in zip(us, chain):
        xs.append(m(xs).ppf(u if source is None else source.cdf(u)))
    return xs


@dataclass(frozen=True)
class Spliced:
    """One marginal below ``at``, another from there on."""

    low: Marginal
    high: Marginal
    at: float

    def cdf(self, x: Column) -> Column:
        return F.when(x < self.at, self.low.cdf(x)).otherwise(self.high.cdf(x))

    def pdf(self, x: Column) -> Column:
        return F.when(x < self.at, self.low.pdf(x)).otherwise(self.high.pdf(x))

    def ppf(self, u: Column) -> Column:
        low = self.low.ppf(u)
        return F.when(low < self.at, low).otherwise(self.high.ppf(u))


def _log_period(h: Column, mean: tuple, spread: Column) -> Marginal:
    """Peak period given wave height: lognormal with ``mean`` (m0, m1, m2) of the logarithm m0 + m1 * h ** m2."""
    return Marginal("lognorm", (F.lit(mean[0]) + F.lit(mean[1]) * F.pow(h, F.lit(mean[2])), spread))


def _north_sea():
    # Shape, scale and splice of wave height; log period's mean and variance
    height = Spliced(lognorm(0.77, 0.6565), weibull(1.503, 0.0, 2.691), 2.9)
    return [lambda xs: height, lambda xs: _log_period(xs[0], (1.134, 0.892, 0.225), F.sqrt(0.005 + 0.120 * F.exp(-0.455 * xs[0])))]


def _pacific_buoy():
    # Shape, location and scale of wave height; log period's mean and deviation
    return [lambda xs: weibull(1.667, 0.4010, 2.007), lambda xs: _log_period(xs[0], (-0.0034, 2.137, 0.1193), 0.4456 * F.exp(-0.1826 * xs[0]))]


def _norwegian_sea():
    # Shape, scale and splice of wave height; log period's mean and variance
    height = Spliced(lognorm(0.871, 0.506), weibull(1.433, 0.0, 2.547), 5.0)
    return [lambda xs: height, lambda xs: _log_period(xs[0], (1.886, 0.365, 0.312), F.sqrt(0.001 + 0.105 * F.exp(-0.264 * xs[0])))]


def _norwegian_sea_wind():
    # Wind; wave height given wind; period given both
    def height(xs):
        return Marginal("weibull", (2.136 + 0.013 * F.pow(xs[0], F.lit(1.709)), 0.0, 1.816 + 0.024 * F.pow(xs[0], F.lit(1.787))))

    def period(xs):
        wind, h = xs[0], xs[1]
        mean = 8.0 + 1.938 * F.pow(h, F.lit(0.486))
        usual = 2.5 + 3.001 * F.pow(h, F.lit(0.745))
        cov2 = F.pow(-0.001 + 0.316 * F.exp(-0.145 * h), F.lit(2.0))
        shifted = mean * (1 - 0.255 * ((wind - usual) / usual))
        return Marginal("lognorm", (F.log(shifted / F.sqrt(1 + cov2)), F.sqrt(F.log(1 + cov2))))

    return [lambda xs: weibull(2.029, 0.0, 9.409), height, period]


def site(name: str):
    """Conditional chain of a site's sea states: ``chain[k](xs[:k])`` is the k-th marginal."""
    return SITES[name]()


SITES = {"kvitebjorn": _north_sea, "buoy_46022": _pacific_buoy, "norway5_2d": _norwegian_sea, "norway5_3d": _norwegian_sea_wind}


def contour(return_period_years: float, state_hours: float, n: int) -> tuple[float, list[tuple[float, float]]]:
    """Reliability index of a return period, and ``n`` points of the circle of that radius."""
    beta = -NormalDist().inv_cdf(state_hours / (return_period_years * 365.25 * 24))
    return beta, [(beta * cos(2 * pi * k / n), beta * sin(2 * pi * k / n)) for k in range(n)]
