"""Spectra and autocorrelations of long series by averaged segments.

Segments of a fixed length overlap by half and are tapered.  A segment is the unit of
work: a series of any length is spread over the cluster, and tasks send sums of
their segments' spectra.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.operators.settle import ordered


def taper(length: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)


def placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``__place``, a row's place in its series from 0, without a window over a series."""
    ranked = ordered(df.withColumn("__t", F.monotonically_increasing_id()), [*by, *order, "__t"], "__rank").drop("__t")
    if not by:
        return ranked.withColumn("__place", F.col("__rank") - 1).drop("__rank")
    names = [f"__g{i}" for i in range(len(by))]
    starts = ranked.groupBy(*by).agg(F.min("__rank").alias("__start")).select(*[F.col(k).alias(n) for k, n in zip(by, names)], "__start")
    met = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names)]
    return ranked.join(starts, met).withColumn("__place", F.col("__rank") - F.col("__start")).drop("__rank", "__start", *names)


def spectrum(df: DataFrame, value: str, by: list[str], order: list[str], length: int = 256, spacing: float = 1.0) -> DataFrame:
    """``by..., j, frequency, density, segments``: the one-sided power density of each series, averaged over its segments.

    Segments of ``length`` values begin at every half of it; what is left at the end of a series is
    in no segment, and a series of less than one has no rows.  The mean of a segment is taken off before its taper.
    Rows without a value take no part.
    """
    if length < 4 or length % 2:
        raise ValueError("the length must be even, and 4 at least")
    half, window = length // 2, taper(length)
    scale = spacing / float((window**2).sum())
    rows = placed(df.where(F.col(value).isNotNull()).select(*by, *[c for c in order if c not in by], F.col(value).cast("double").alias("__v")), by, order)
    seg = F.expr(f"__place div {half}")
    at = F.array(F.struct(seg.alias("s"), (F.col("__place") % half).cast("int").alias("i")), F.struct((seg - 1).alias("s"), (F.col("__place") % half + half).cast("int").alias("i")))
    cut = rows.select(*by, "__v", F.explode(at).alias("__x")).where("__x.s >= 0")
    # length values in each list
    lists = cut.groupBy(*by, F.col("__x.s").alias("__seg")).agg(F.sort_array(F.collect_list(F.struct("__x.i", "__v"))).alias("__a")).where(F.size("__a") == length).select(*by, F.col("__a.__v").alias("__a"))
    one_sided = np.full(half + 1, 2.0)
    one_sided[[0, -1]] = 1.0
    fields = [df.schema[k] for k in by]
    schema = T.StructType([*fields, T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("segments", T.LongType())])

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, length)
            power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * window, axis=1)) ** 2 * scale * one_sided
            names = list(zip(*[b.column(k).to_pylist() for k in range(len(by))])) if by else [()] * b.num_rows
            of: dict[tuple, int] = {}
            which = np.array([of.setdefault(n, len(of)) for n in names])
            sums = np.zeros((len(of), half + 1))
            np.add.at(sums, which, power)
            arrays = [pa.array([n[k] for n in of], b.column(k).type) for k in range(len(by))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums), pa.list_(pa.float64())), pa.array(np.bincount(which, minlength=len(of)))], names=schema.names)

    made = lists.mapInArrow(transformed, schema).select(*by, "segments", F.posexplode("sums").alias("j", "power"))
    out = made.groupBy(*by, "j").agg((F.sum("power") / F.sum("segments")).alias("density"), F.sum("segments").alias("segments"))
    return out.select(*by, "j", (F.col("j") / F.lit(length * spacing)).alias("frequency"), "density", "segments")


def autocorrelation(spectra: DataFrame, by: list[str], length: int) -> DataFrame:
    """``by..., lag, r``: the cosine transform of the averaged densities, 1 at lag 0, for lags up to half a segment.

    A density's ``length`` / 2 + 1 values of a series are one small list.
    """
    half = length // 2
    lists = spectra.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("j", "density"))).alias("__a"))
    lists = lists.where(F.size("__a") == half + 1).select(*by, F.col("__a.density").alias("__a"))
    schema = T.StructType([*[spectra.schema[k] for k in by], T.StructField("r", T.ArrayType(T.DoubleType()))])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, half + 1).copy()
            x[:, 1:-1] /= 2
            r = np.fft.irfft(x, n=length, axis=1)[:, : half + 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.where(r[:, :1] > 0, r / r[:, :1], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], pa.array(list(r), pa.list_(pa.float64()))], names=schema.names)

    return lists.mapInArrow(turned, schema).select(*by, F.posexplode("r").alias("lag", "r"))
