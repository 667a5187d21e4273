"""Counter-based random columns: a row's numbers depend on its id, the dimension and the seed alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haruspex.functions.special import normal_ppf


def uniform(row_id: Column, dim: int, seed: int = 0) -> Column:
    """A number of (0, 1) with 53 bits; the same however the rows are partitioned."""
    return (F.shiftrightunsigned(F.xxhash64(row_id, F.lit(dim), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def normal(row_id: Column, dim: int, seed: int = 0) -> Column:
    return normal_ppf(uniform(row_id, dim, seed))


def index(row_id: Column, dim: int, n: int, seed: int = 0) -> Column:
    """An integer of 0 to n - 1."""
    return F.floor(uniform(row_id, dim, seed) * n).cast("long")
