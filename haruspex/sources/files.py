"""Reading and writing: arrays as tables, manifests with digests, file identities."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_npy(spark: SparkSession, path: str, ndim: int | None = None) -> DataFrame:
    """``global_id, xi``: the columns of a (d, n) NPY array as rows, read by the executors.

    ``path`` may be a pattern.  ``ndim`` keeps the first dimensions.  Pickled arrays aren't read.
    """
    import pyarrow as pa

    df = spark.read.format("binaryFile").load(path)

    def run(batches):
        import io

        for b in batches:
            for content in b.column(0).to_pylist():
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(1, -1) if a.ndim == 1 else a
                a = np.asarray(a[: ndim or len(a)], float)
                for i in range(0, a.shape[1], 65536):
                    part = a[:, i : i + 65536].T
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["global_id", "xi"])

    return df.select("content").mapInArrow(run, "global_id long, xi array<double>")


def identity(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files, computed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def candidate_pool(df: DataFrame, dims: list[str], k: int, seed: int = 0, id_col: str = "global_id") -> DataFrame:
    """k rows of a pool in hash order, with the dimensions asked for."""
    return df.select(id_col, *dims).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(k)


def write_series(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("seed_id").parquet(path)


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    return validate_config(value)


FIELDS = {"schema", "purpose", "scale", "runner", "output"}


def validate_config(config: dict) -> dict:
    """A runner's configuration: closed objects, known scenarios, each once."""
    from haruspex.plans import scenarios

    if set(config) != FIELDS:
        raise ValueError(f"config fields must be {sorted(FIELDS)}")
    if config["purpose"] != "software_benchmark" or config["scale"] != "reduced":
        raise ValueError("unsupported purpose or scale")
    runner = config["runner"]
    if set(runner) != {"kind", "benchmark", "scenarios"} or runner["kind"] != "deterministic_benchmark":
        raise ValueError("invalid runner")
    known = set(scenarios.SMALL) if runner["benchmark"] == "small" else {"reduced"} if runner["benchmark"] in scenarios.REDUCED else set()
    names = runner["scenarios"]
    if not names or len(set(names)) != len(names) or not set(names) <= known:
        raise ValueError("unknown or repeated scenario")
    return json.loads(json.dumps(config))


def run_config(spark: SparkSession, config: dict) -> dict:
    """Outcomes of a configuration's scenarios, with hashes of the config and of each run."""
    from haruspex.operators.adaptive import canonical_hash
    from haruspex.plans import scenarios

    config = validate_config(config)
    out = {}
    for name in config["runner"]["scenarios"]:
        o = scenarios.small(spark, name) if config["runner"]["benchmark"] == "small" else scenarios.reduced(spark, config["runner"]["benchmark"])
        out[name] = {"status": o.status, "stop_reason": o.reason, "calls": o.calls, "trace_rows": len(o.trace), "contract_hash": o.contract_hash(), "trace": o.trace}
    stable = {k: {x: v for x, v in s.items() if x != "trace"} for k, s in out.items()}
    return {"config": config, "config_hash": canonical_hash(config), "scenarios": out, "manifest_hash": canonical_hash(stable)}


def write_artifacts(folder: str, files: dict[str, bytes]) -> list[dict]:
    """Files with their sizes and digests, and a manifest of them."""
    os.makedirs(folder, exist_ok=True)
    rows = []
    for name, data in sorted(files.items()):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
        rows.append({"name": name, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump({"artifacts": rows}, f, sort_keys=True, indent=1)
    return rows


def main(argv: list[str] | None = None) -> int:
    """``--config FILE``: runs it and writes its manifest to the file that it names."""
    import argparse

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--config", required=True)
    config = load_config(p.parse_args(argv).config)
    spark = SparkSession.builder.getOrCreate()
    result = run_config(spark, config)
    with open(config["output"]["manifest"], "w", encoding="utf-8") as f:
        json.dump(result, f, sort_keys=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
