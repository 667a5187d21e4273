"""Frozen candidate, test and reference pools: seeded, and checked by hash before use."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from haruspex.operators.adaptive import array_hash


@dataclass(frozen=True)
class Pool:
    draw: str  # normal or uniform
    d: int
    sizes: dict
    seeds: dict
    cv_seed: int
    hashes: dict


# Sizes, seeds and hashes of the published fixtures
POOLS = {
    "four_branch": Pool("normal", 2, {"candidate": 192, "test": 256, "reference": 4096}, {"candidate": 26080501, "test": 26080502, "reference": 26080503}, 26080504, {
        "candidate": "01ca05dc7f0312570cd13e6514b869683e1f7247b42c4dae72b5a1c05281538a",
        "test": "2ea6903f46a4e79f8d3844221a6dae21c16a28328b42150046eec3eed8058b42",
        "reference": "96d87567367d58e82dff38f84e05a01a608a1a6b7ba5a3491b012e67d2f5f5db",
    }),
    "ishigami": Pool("uniform", 3, {"candidate": 256, "test": 384, "reference": 4096}, {"candidate": 26080601, "test": 26080602, "reference": 26080603}, 26080604, {}),
    "gayton": Pool("normal", 2, {"candidate": 192, "test": 256, "reference": 4096}, {"candidate": 26080701, "test": 26080702, "reference": 26080703}, 26080704, {
        "candidate": "3a80fce33a0254e332cf4fd85ab758ecb8a370d112e06c89155572128c9da80f",
        "test": "4d202ea093be90c874f460b70762fbec84144174d18634e465b9b83c37e8f629",
        "reference": "d12f4e3cdf448c51d49e6194293c164250873cce72ae4609f6d928e397c169f3",
    }),
}


def pool(name: str) -> dict[str, np.ndarray]:
    """Arrays of shape (d, n) by role; fails if they aren't the published ones."""
    p = POOLS[name]
    out = {}
    for role, n in p.sizes.items():
        rng = np.random.default_rng(p.seeds[role])
        out[role] = rng.normal(size=(p.d, n)) if p.draw == "normal" else rng.uniform(-1.0, 1.0, size=(p.d, n))
        if role in p.hashes and array_hash(out[role]) != p.hashes[role]:
            raise RuntimeError(f"{name}: the {role} points aren't the frozen ones")
        out[role].setflags(write=False)
    return out


def benchmark_pool() -> dict[str, np.ndarray]:
    """Candidates and test points of the four small scenarios, drawn from one generator."""
    rng = np.random.default_rng(424242)
    return {"candidate": rng.normal(size=(2, 96)), "test": rng.normal(size=(2, 128))}


def table(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """``role, global_id, xi_0, ...``: one row for each point."""
    d = next(iter(arrays.values())).shape[0]
    parts = [pa.table({"role": [role] * a.shape[1], "global_id": np.arange(a.shape[1])} | {f"xi_{k}": a[k] for k in range(d)}) for role, a in arrays.items()]
    return spark.createDataFrame(pa.concat_tables(parts))
