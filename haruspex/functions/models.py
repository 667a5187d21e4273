"""Limit states and test functions as row expressions.

A model is a text over ``{0}``, ``{1}``, ...: the same closed form goes to
Catalyst through ``expr`` and to any other SQL engine, and whole-stage code
generation covers it.  ``evaluate`` makes the Column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    name: str
    ndim: int
    sql: str
    #: Marginal of each input: ("uniform", low, width), ("norm", mean, deviation) or ("lognorm", mean, deviation of the log).
    inputs: tuple = ()

    def text(self, names: Sequence[str]) -> str:
        # literals with a point would be decimals; with an exponent they are doubles in any SQL
        exact = re.sub(r"(?<![\w.{])(\d+\.\d+)(?![\d.eE])", r"\1e0", self.sql)
        return "(" + exact.format(*names) + ")"


def evaluate(model: Model | str, names: Sequence[str]) -> Column:
    """The model's value as a Column over columns of those names."""
    m = MODELS[model] if isinstance(model, str) else model
    if len(names) != m.ndim:
        raise ValueError(f"{m.name} has {m.ndim} inputs")
    return F.expr(m.text(names))


def _sum(terms) -> str:
    return " + ".join(terms)


def _x(k: int) -> str:
    return "{" + str(k) + "}"


def _unit(k: int) -> str:
    """An input of [-1, 1] carried to [0, 1]."""
    return f"(({_x(k)} + 1) / 2)"


PI = "3.141592653589793"
R2 = "1.4142135623730951"
_U, _N, _STD = ("uniform", -1.0, 2.0), ("norm", 0.0, 1.0), ("uniform", 0.0, 1.0)


def four_branch(constant: float = 7.0, name: str = "four_branch") -> Model:
    """Series system of two parabolas and two lines at ``constant`` / sqrt 2."""
    bow, both = "3.0 + 0.1 * power({0} - {1}, 2)", "({0} + {1}) / " + R2
    return Model(name, 2, f"least({bow} - {both}, {bow} + {both}, {{0}} - {{1}} + {constant} / {R2}, {{1}} - {{0}} + {constant} / {R2})", (_N, _N))


def poly_product(d: int) -> Model:
    return Model(f"poly_product_{d}", d, "0.5 * (" + _sum(f"power({_x(k)}, 4) + power({_x(k)}, 2) + 5 * {_x(k)}" for k in range(d)) + ")", (_N,) * d)


def corner_peak(c=(1.0, 1.0)) -> Model:
    d = len(c)
    return Model("corner_peak", d, f"power(1 + {_sum(f'{v} * {_unit(k)}' for k, v in enumerate(c))}, -{d + 1})", (_U,) * d)


def exp_square_sum(c=(1.0, 1.0), w=(1.0, 0.5)) -> Model:
    return Model("exp_square_sum", len(c), "exp(-(" + _sum(f"{v * v} * power({_unit(k)} - ({w[k]}), 2)" for k, v in enumerate(c)) + "))", (_U,) * len(c))


def exp_abs_sum(c=(-2.0, 1.0), w=(0.25, -0.75)) -> Model:
    return Model("exp_abs_sum", len(c), "exp(-(" + _sum(f"({v}) * abs({_unit(k)} - ({w[k]}))" for k, v in enumerate(c)) + "))", (_U,) * len(c))


def exp_sum(d: int = 2) -> Model:
    return Model("exp_sum", d, "exp(-(" + _sum(_x(k) for k in range(d)) + "))", (_U,) * d)


def product_peak(c=(-3.0, 2.0), w=(0.5, 0.5)) -> Model:
    return Model("product_peak", len(c), " * ".join(f"(1.0 / ({1 / v**2!r} + power({_unit(k)} - ({w[k]}), 2)))" for k, v in enumerate(c)), (_U,) * len(c))


def lognorm_sum(d: int = 5, a: float = 0.2) -> Model:
    return Model(f"lognorm_sum_{d}", d, f"({d + 3 * a * d**0.5!r}) - ({_sum(_x(k) for k in range(d))})", (("lognorm", -0.019610356576611, 0.198042200435365),) * d)


def linear_high(d: int = 4, beta: float = 3.5) -> Model:
    """Linear limit state in many dimensions."""
    return Model(f"linear_{d}", d, f"{beta} - ({_sum(_x(k) for k in range(d))}) / {d**0.5!r}", (_N,) * d)


def sum_high(d: int = 4, a: float = 3.0, sigma: float = 0.2) -> Model:
    return Model(f"sum_{d}", d, f"{d + a * sigma * d**0.5!r} - ({_sum(_x(k) for k in range(d))})", (("norm", 1.0, sigma),) * d)


def double_point(c: float = 5.0) -> Model:
    """Two design points: the least of a bump and a hyperbola."""
    return Model("double_point", 2, f"least({c} - 1 - {{1}} + exp(-power({{0}}, 2) / 10.0) + power({{0}} / 5.0, 4), {c * c / 2} - {{0}} * {{1}})", (_N, _N))


def genz(kind: int, alpha: Sequence[float], beta: Sequence[float]) -> Model:
    """The six integrand families of A. Genz's test package, on [0, 1]^d."""
    d, z = len(alpha), [_x(k) for k in range(len(alpha))]
    if kind == 1:
        sql = f"cos({2 * 3.141592653589793 * beta[0]!r} + {_sum(z)})"
    elif kind == 2:
        sql = "1.0 / (" + " * ".join(f"({a ** -2!r} + power({x} - {b}, 2))" for x, a, b in zip(z, alpha, beta)) + ")"
    elif kind == 3:
        sql = f"power(1.0 + {_sum(x if b < 0.5 else f'{a} - {x}' for x, a, b in zip(z, alpha, beta))}, -{d + 1})"
    elif kind == 4:
        sql = "exp(-(" + _sum(f"power({a} * ({x} - {b}), 2)" for x, a, b in zip(z, alpha, beta)) + "))"
    elif kind == 5:
        sql = "exp(-(" + _sum(f"{a} * abs({x} - {b})" for x, a, b in zip(z, alpha, beta)) + "))"
    elif kind == 6:
        sql = f"CASE WHEN {' OR '.join(f'{x} > {b}' for x, b in zip(z, beta))} THEN 0.0 ELSE exp({_sum(f'{a} * {x}' for x, a in zip(z, alpha))}) END"
    else:
        raise ValueError("kinds are 1 to 6")
    return Model(f"genz_{kind}", d, sql, (_STD,) * d)


def genz_integral(kind: int, alpha: Sequence[float], beta: Sequence[float]) -> float:
    """Exact integral over [0, 1]^d of the families with product form (2, 4, 5, 6) and of the cosine (1)."""
    from math import atan, cos, erf, exp, pi, prod, sin, sqrt

    if kind == 1:
        # the real part of exp(2 pi i beta) times the product of (exp(i) - 1) / i
        return cos(2 * pi * beta[0] + len(alpha) / 2) * (2 * sin(0.5)) ** len(alpha)
    if kind == 2:
        return prod(a * (atan((1 - b) * a) + atan(b * a)) for a, b in zip(alpha, beta))
    if kind == 4:
        return prod(sqrt(pi) / (2 * a) * (erf(a * (1 - b)) + erf(a * b)) for a, b in zip(alpha, beta))
    if kind == 5:
        return prod((2 - exp(-a * b) - exp(-a * (1 - b))) / a for a, b in zip(alpha, beta))
    if kind == 6:
        return prod((exp(a * min(1.0, b)) - 1) / a for a, b in zip(alpha, beta))
    raise ValueError("no closed form here")


def _borehole(head: str, name: str) -> Model:
    log = "ln({1} / {0})"
    return Model(
        name, 8,
        f"2 * {PI} * {{2}} * ({head} - {{5}}) / ({log} * (1 + 2 * {{6}} * {{2}} / ({log} * power({{0}}, 2) * {{7}}) + {{2}} / {{4}}))",
        (("uniform", 0.05, 0.1), ("uniform", 100.0, 49900.0), ("uniform", 63070.0, 52530.0), ("uniform", 990.0, 110.0), ("uniform", 63.1, 52.9), ("uniform", 700.0, 120.0), ("uniform", 1120.0, 560.0), ("uniform", 9885.0, 2160.0)),
    )


_TANK = (
    "least(8.4e4 * {0} / sqrt(power({2}, 2) + power({3}, 2) - {2} * {3} + 3 * power({4}, 2)) - 1, 8.4e4 * {0} / abs({3}) - 1, "
    "0.847 + 0.96 * (4 * ({0} - 0.075)) + 0.986 * (20 * ({1} - 0.1)) - 0.216 * (-6e3 * (1.0 / {4} + 0.003)) + 0.077 * power(4 * ({0} - 0.075), 2) + 0.11 * power(20 * ({1} - 0.1), 2) "
    "+ 0.007 * power(-6e3 * (1.0 / {4} + 0.003), 2) + 0.378 * (4 * ({0} - 0.075)) * (20 * ({1} - 0.1)) - 0.106 * (4 * ({0} - 0.075)) * (-6e3 * (1.0 / {4} + 0.003)) - 0.11 * (20 * ({1} - 0.1)) * (-6e3 * (1.0 / {4} + 0.003)))"
)
_GAMMA, _GSAT = "(9.81 * ({4} + 0.2 * {5}) / (1 + {5}))", "(9.81 * ({4} + {5}) / (1 + {5}))"
_DEG = f"/ 180 * {PI}"

MODELS: dict[str, Model] = {
    m.name: m
    for m in (
        Model("ishigami", 3, "sin({0}) + 7.0 * power(sin({1}), 2) + 0.1 * power({2}, 4) * sin({0})", (("uniform", -3.141592653589793, 6.283185307179586),) * 3),
        Model("x_sin_x", 1, "{0} * sin({0})", (_U,)),
        Model("quartic", 1, "5 - 5 * {0} + 2.5 * power({0}, 2) - 0.36 * power({0}, 3) + 0.015 * power({0}, 4)", (_N,)),
        Model("square_root", 2, "14 - sqrt(power(10 - {0}, 2) + power({1} + 7, 2) + 10 * power({0} + {1}, 2))", (_N, _N)),
        four_branch(),
        four_branch(6.0, "four_branch_6"),
        poly_product(2),
        poly_product(5),
        Model("convex", 2, f"0.1 * power({{0}} - {{1}}, 2) - ({{0}} + {{1}}) / {R2} + 2.5", (_N, _N)),
        Model("parabolic", 2, "5 - {1} - 0.5 * power({0} - 0.1, 2)", (_N, _N)),
        Model("noisy", 6, "{0} + 2 * {1} + 2 * {2} + {3} - 5 * {4} - 5 * {5} + 0.001 * (" + _sum(f"sin(100 * {_x(k)})" for k in range(6)) + ")", (_N,) * 6),
        linear_high(), sum_high(), double_point(),
        Model("franke", 2, "0.75 * exp(-power(9 * {0} - 2, 2) / 4 - power(9 * {1} - 2, 2) / 4) + 0.75 * exp(-power(9 * {0} + 1, 2) / 49 - (9 * {1} + 1) / 10) + 0.5 * exp(-power(9 * {0} - 7, 2) / 4 - power(9 * {1} - 3, 2) / 4) - 0.2 * exp(-power(9 * {0} - 4, 2) - power(9 * {1} - 7, 2))", (_STD, _STD)),
        corner_peak(), exp_square_sum(), exp_abs_sum(), exp_sum(), product_peak(),
        Model("hydrogen_tank", 5, _TANK, (("norm", 0.07433, 0.005), ("norm", 0.1, 0.01), ("norm", 13.0, 60.0), ("norm", 4751.0, 48.0), ("norm", -648.0, 11.0))),
        Model(
            "infinite_slope", 6,
            f"({_GAMMA} * ({{0}} - {{0}} * {{1}}) + {{0}} * {{1}} * ({_GSAT} - 9.81)) * cos({{3}} {_DEG}) * tan({{2}} {_DEG}) / (({_GAMMA} * ({{0}} - {{0}} * {{1}}) + {{0}} * {{1}} * {_GSAT}) * sin({{3}} {_DEG})) - 1",
            (("uniform", 2.0, 6.0), _STD, ("lognorm", 3.552158, 0.079872), ("lognorm", 2.994484, 0.049969), ("uniform", 2.5, 0.2), ("uniform", 0.3, 0.3)),
        ),
        Model("gayton_hat", 2, "0.5 * power({0} - 2, 2) - 1.5 * power({1} - 5, 3) - 3", (_N, _N)),
        Model("gayton_shifted", 2, "0.5 * power({0} - 2, 2) - 1.5 * power({1} + 3 - 5, 3) - 3", (_N, _N)),
        Model("composite_gaussian", 2, "greatest(power({0}, 2) + {1} - 8, {0} / 5 + {1} - 6)", (("norm", 5.5, 1.0), ("norm", 5.0, 1.0))),
        Model("exp_tanh", 2, "exp(-{0}) * tanh(5 * {1})", (_U, _U)),
        Model("rastrigin", 2, f"10 - (power({{0}}, 2) - 5 * cos(2 * {PI} * {{0}})) - (power({{1}}, 2) - 5 * cos(2 * {PI} * {{1}}))", (_N, _N)),
        # the published model has the upper aquifer's head; the variant takes its transmissivity in that place
        _borehole("{3}", "borehole"), _borehole("{2}", "borehole_variant"),
        lognorm_sum(),
        Model("quadratic_mix", 2, "1.0 + 0.8 * {0} + 0.35 * (power({1}, 2) - 1.0) + 0.1 * {0} * {1}", (_N, _N)),
        *(genz(k, (1.5, 2.0), (0.3, 0.6)) for k in range(1, 7)),
    )
}


def affine_input(marginal: tuple, u: str) -> str:
    """SQL of an input drawn by ``u`` of [0, 1]: its quantile if uniform, else mean + 4 * (u - 1/2) deviations."""
    family, a, b = marginal
    if family == "uniform":
        return f"({a} + {b} * {u})"
    core = f"({a} + {b} * 4 * ({u} - 0.5))"
    return core if family == "norm" else f"exp{core}"
