"""Spectra, synthesised processes and oscillators; each series is one group of bounded length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jonswap(w: Column, hs: Column, tp: Column, gamma: float = 3.3) -> Column:
    """JONSWAP spectrum (IEC 61400-3) at angular frequency w; 0 at w = 0."""
    wp = 2 * np.pi / tp
    s = F.when(w > wp, F.lit(0.09)).otherwise(F.lit(0.07))
    pos = F.when(w > 0, w)
    base = 5 / 16 * hs * hs * F.pow(wp, F.lit(4.0)) * F.pow(pos, F.lit(-5.0))
    decay = F.exp(-1.25 * F.pow(pos / wp, F.lit(-4.0))) * (1 - 0.287 * np.log(gamma))
    peak = F.pow(F.lit(gamma), F.exp(-0.5 * F.pow((w - wp) / s / wp, F.lit(2.0))))
    return F.when(w <= 0, F.lit(0.0)).otherwise(base * decay * peak)


def lorentz(w: Column, c: float = 2.0) -> Column:
    """2c / (c^2 + w^2), whose correlation is exp(-c |t|)."""
    return 2 * c / (c * c + w * w)


def white_noise(w: Column, level: float = 1.0, low: float = 0.0, high: float = 5.0) -> Column:
    return F.when(w.between(low, high), F.lit(level)).otherwise(F.lit(0.0))


def gain(w: Column, m: float, c: float, k: float) -> Column:
    """Squared gain of a linear oscillator, which carries a force's spectrum to the response's."""
    return 1 / (F.pow(k - m * w * w, F.lit(2.0)) + F.pow(c * w, F.lit(2.0)))


def spectral_moments(df: DataFrame, w: str, s: str, by: list[str], dw: float) -> DataFrame:
    """Moments 0, 1, 2 and 4 of a one-sided spectrum, and the zero-crossing period."""
    m = {k: F.sum(F.pow(F.col(w), F.lit(float(k))) * F.col(s)) * dw for k in (0, 1, 2, 4)}
    out = df.groupBy(*by).agg(*[v.alias(f"m{k}") for k, v in m.items()])
    return out.withColumn("tz", 2 * np.pi * F.sqrt(F.col("m0") / F.col("m2")))


def to_autocorrelation(pxx: np.ndarray, dw: float) -> np.ndarray:
    """Autocorrelation of a two-sided spectrum on an FFT grid."""
    return np.fft.ifft(np.asarray(pxx)).real * len(pxx) * dw / (2 * np.pi)


def to_spectrum(acf: np.ndarray, dt: float) -> np.ndarray:
    return np.fft.fft(np.asarray(acf)).real * dt


def one_sided(pxx: np.ndarray) -> np.ndarray:
    """Non-negative frequencies, what lies on both sides counted twice."""
    n = len(pxx)
    out = np.array(pxx[: n // 2 + 1], float)
    out[1 : (n + 1) // 2] *= 2
    return out


def synthesise(pxx: np.ndarray, dw: float, seed: int) -> np.ndarray:
    """Gaussian process of a one-sided spectrum on frequencies 0, dw, ...: random phases and an inverse FFT."""
    rng = np.random.default_rng(seed)
    amp = np.sqrt(2 * np.asarray(pxx, float) * dw)
    amp[0] = 0.0
    z = np.zeros(2 * (len(amp) - 1), complex)
    z[: len(amp)] = amp * np.exp(1j * rng.uniform(0, 2 * np.pi, len(amp))) / 2
    z[len(amp) :] = np.conj(z[1 : len(amp) - 1][::-1])
    return np.fft.ifft(z).real * len(z)


SERIES = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("seed_id", T.LongType()), T.StructField("t_idx", T.IntegerType()), T.StructField("t", T.DoubleType()), T.StructField("value", T.DoubleType())])


#: Series of one task, and those computed at once.
TASK, BLOCK = 2048, 256


def _by_block(df: DataFrame, cols: list[str], make: Callable[..., np.ndarray], dt: float) -> DataFrame:
    """A series for each row (sample_id, seed_id, parameters): ``make`` gets columns of up to BLOCK rows, and returns a series in each row.

    A file of few bytes may hold many rows, each of which is a long computation: tasks are dealt by rows.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                v = np.asarray(make(*(b.column(k).to_numpy(zero_copy_only=False) for k in range(1, len(cols) + 2))), float)
                rows, n = v.shape
                ids = [pa.array(np.repeat(b.column(k).to_numpy(zero_copy_only=False), n)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.tile(np.arange(n, dtype=np.int32), rows)), pa.array(np.tile(np.arange(n) * dt, rows)), pa.array(v.ravel())], names=[f.name for f in SERIES])

    rows = df.select(F.col("sample_id").cast("long"), F.col("seed_id").cast("long"), *cols)
    return rows.repartition(max(1, -(-df.count() // TASK)), "sample_id", "seed_id").mapInArrow(run, SERIES)


def _by_row(df: DataFrame, cols: list[str], make: Callable[..., np.ndarray], dt: float) -> DataFrame:
    """As ``_by_block``, with a function of one row."""
    return _by_block(df, cols, lambda *block: np.stack([make(*r) for r in zip(*(c.tolist() for c in block))]), dt)


def wave_elevation(df: DataFrame, hs: str, tp: str, n: int = 1024, dt: float = 0.5) -> DataFrame:
    """Sea surface elevation of each (sample, seed)."""
    dw = 2 * np.pi / (n * dt)
    w = np.arange(n // 2 + 1) * dw

    def make(seed, h, t):
        return synthesise(_jonswap(w, h, t), dw, seed)

    return _by_row(df, [hs, tp], make, dt)


def _jonswap(w: np.ndarray, hs: float, tp: float, gamma: float = 3.3) -> np.ndarray:
    wp = 2 * np.pi / tp
    out, x = np.zeros_like(w), w[1:]
    s = np.where(x > wp, 0.09, 0.07)
    out[1:] = 5 / 16 * hs**2 * wp**4 * x**-5 * np.exp(-1.25 * (x / wp) ** -4.0) * (1 - 0.287 * np.log(gamma)) * gamma ** np.exp(-0.5 * ((x - wp) / s / wp) ** 2)
    return out


def linear_response(df: DataFrame, hs: str, tp: str, m: float = 1.0, c: float = 0.2, k: float = 1.0, n: int = 1024, dt: float = 0.5) -> DataFrame:
    """Response of a linear oscillator to the sea state, in the frequency domain."""
    dw = 2 * np.pi / (n * dt)
    w = np.arange(n // 2 + 1) * dw
    h2 = 1 / ((k - m * w * w) ** 2 + (c * w) ** 2)

    def make(seed, h, t):
        return synthesise(_jonswap(w, h, t) * h2, dw, seed)

    return _by_row(df, [hs, tp], make, dt)


def surge_response(df: DataFrame, hs: str, tp: str, transfer: list[tuple[float, float]], m: float = 1.0, c: float = 0.2, k: float = 1.0, n: int = 1024, dt: float = 0.5) -> DataFrame:
    """As ``linear_response``, with a transfer function given as (frequency, amplitude) that forces pass first."""
    dw = 2 * np.pi / (n * dt)
    w = np.arange(n // 2 + 1) * dw
    f, a = np.array(sorted(transfer)).T
    h2 = np.interp(w, f, a, left=0.0, right=0.0) ** 2 / ((k - m * w * w) ** 2 + (c * w) ** 2)

    def make(seed, h, t):
        return synthesise(_jonswap(w, h, t) * h2, dw, seed)

    return _by_row(df, [hs, tp], make, dt)


def slow_drift(df: DataFrame, hs: str, tp: str, qtf: Callable[[np.ndarray, np.ndarray], np.ndarray], m: float = 1.0, c: float = 0.1, k: float = 0.05, n_w: int = 64, w_max: float = 2.0, n: int = 512, dt: float = 1.0) -> DataFrame:
    """Low-frequency surge: difference-frequency forces, a double sum over wave components, on a linear oscillator."""
    w = np.linspace(w_max / n_w, w_max, n_w)
    dw = w[1] - w[0]
    diff = w[:, None] - w[None]
    H = 1 / (k - m * diff**2 + 1j * c * diff)
    Q = qtf(w[:, None], w[None])
    t = np.arange(n) * dt

    def make(seed, h, p):
        phase = np.random.default_rng(seed).uniform(0, 2 * np.pi, n_w)
        a = np.sqrt(2 * _jonswap(np.append(0.0, w), h, p)[1:] * dw) * np.exp(1j * phase)
        F2 = Q * H * a[:, None] * np.conj(a)[None]
        e = np.exp(1j * np.outer(t, w))
        return np.real(np.einsum("ti,ij,tj->t", e, F2, np.conj(e), optimize=True))

    return _by_row(df, [hs, tp], make, dt)


def duffing(df: DataFrame, hs: str, tp: str, m: float = 1.0, c: float = 0.2, k: float = 1.0, s: float = 0.1, n: int = 512, dt: float = 0.25) -> DataFrame:
    """Oscillator with a cubic spring, by fourth-order Runge-Kutta over a synthesised force at half steps."""
    fine = 2 * n
    dw = 2 * np.pi / (fine * dt / 2)
    w = np.arange(fine // 2 + 1) * dw

    def make(seeds, hs, tps):
        # a step of all rows at once
        f = np.stack([synthesise(_jonswap(w, h, p), dw, seed) for seed, h, p in zip(seeds.tolist(), hs.tolist(), tps.tolist())], axis=1)
        acc = lambda x, v, q: (q - c * v - k * x - s * x**3) / m
        x, v, out = np.zeros(len(seeds)), np.zeros(len(seeds)), np.zeros((n, len(seeds)))
        for i in range(n - 1):
            a0, a1, a2 = f[2 * i], f[2 * i + 1], f[2 * i + 2]
            k1, l1 = v, acc(x, v, a0)
            k2, l2 = v + dt / 2 * l1, acc(x + dt / 2 * k1, v + dt / 2 * l1, a1)
            k3, l3 = v + dt / 2 * l2, acc(x + dt / 2 * k2, v + dt / 2 * l2, a1)
            k4, l4 = v + dt * l3, acc(x + dt * k3, v + dt * l3, a2)
            x, v = x + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4), v + dt / 6 * (l1 + 2 * l2 + 2 * l3 + l4)
            out[i + 1] = x
        return out.T

    return _by_block(df, [hs, tp], make, dt)


def short_term_maxima(series: DataFrame, transient: float = 0.0) -> DataFrame:
    """Largest absolute value of each (sample, seed) after the transient."""
    return series.where(F.col("t") >= transient).groupBy("sample_id", "seed_id").agg(F.max(F.abs("value")).alias("y_max"), F.max_by("value", "t_idx").alias("last"))


def on_grid(df: DataFrame, table: DataFrame, w: str, dw: float) -> DataFrame:
    """A transfer function's rows joined on a frequency grid, by cell of width dw."""
    cell = lambda c: F.round(F.col(c) / dw).cast("long")
    return df.withColumn("__k", cell(w)).join(table.withColumn("__k", cell(w)).drop(w), "__k", "left").drop("__k")
