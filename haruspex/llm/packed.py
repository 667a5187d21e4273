"""Packed rows for shuffles of many small values: one row holds a bucket's values of a few thousand documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import common as C

SCHEMA = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("vals", T.BinaryType())])
ARROW = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("vals", pa.binary())])

#: Values that a task holds before it packs them.
FLUSH = 1 << 20
#: Bytes of input for each shuffle partition at most.
PARTITION_BYTES = 64 << 20
#: Stands for a null id: larger than any other.
NULL_ID = np.iinfo(np.int64).max


def n_partitions(spark: SparkSession, size: int) -> int:
    """The session's shuffle partitions; more where ``size`` bytes, as measured, ask for them."""
    return max(C.partitions(spark), min(size // PARTITION_BYTES, 100_000))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0


def labels(df: DataFrame, n: int) -> np.ndarray:
    """``n`` bucket numbers of which each is dealt to a partition of its own by ``repartition(n, "bucket")``.

    With them, packed rows are no more than tasks times partitions.
    """
    of, tried = {}, 0
    while len(of) < n:
        more = df.sparkSession.range(tried, tried + 16 * n).select(F.col("id").cast("int").alias("b"))
        for r in more.select("b", F.pmod(F.hash("b"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("b").alias("b")).collect():
            of.setdefault(r["p"], r["b"])
        tried += 16 * n
    return np.array([of[p] for p in range(n)], np.int32)


def pack(bucket: np.ndarray, ids: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    """Rows of one bucket each; values of an id lie together and its id is stored once."""
    order = np.lexsort((ids, bucket))
    bucket, ids, vals = bucket[order], ids[order], vals[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(ids))).astype(np.uint32)
    heads, owner = ids[at], bucket[at]
    cut = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1)) if len(owner) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(owner))
    rows: list[list] = [[], [], [], []]
    for a, b in zip(cut.tolist(), end.tolist()):
        rows[0].append(int(owner[a]))
        rows[1].append(heads[a:b].tobytes())
        rows[2].append(count[a:b].tobytes())
        rows[3].append(vals[at[a] : at[b] if b < len(at) else len(vals)].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, ARROW)], schema=ARROW)


class Packer:
    """Collects (bucket, id, value) and packs them ``FLUSH`` at a time."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, bucket: np.ndarray, ids: np.ndarray, vals: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(vals):
            self.held.append((bucket, ids, vals))
            self.n += len(vals)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield pack(*(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.n = [], 0


def unpack(batches: Iterator[pa.RecordBatch] | list[pa.RecordBatch], dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, id, value) of all the rows."""
    out: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for bucket, ids, counts, vals in zip(*(batch.column(i).to_pylist() for i in range(4))):
            n = np.frombuffer(counts, np.uint32)
            v = np.frombuffer(vals, dtype)
            out[0].append(np.full(len(v), bucket, np.int32))
            out[1].append(np.repeat(np.frombuffer(ids, np.int64), n))
            out[2].append(v)
    empty = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, dtype))
    return tuple(np.concatenate(x) if x else e for x, e in zip(out, empty))


def dealt(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, F.col("bucket"))
