"""What the training-data operators share: reading, lineage cuts, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import wordgrid as wg

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch; wide texts would make batches of the default 10,000 rows too large.
BATCH_ROWS = 500


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Where it is unset, a local master gets a temporary folder, as in tests; any
    other raises, as its executors wouldn't see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def release(spark: SparkSession) -> None:
    """Lets the driver drop what is no longer referred to.

    Spark removes shuffles, broadcasts and checkpoints once the objects that stand
    for them are collected; between the steps of an iteration that is worth asking for.
    Freed memory of this process goes back to the system.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)
    spark._jvm.java.lang.System.gc()


def bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """``2 ** bits`` bits, eight to a byte from the lowest, with those of the column ``p`` set; the executors make it up by pieces."""
    size = 1 << bits
    rows = positions.select(F.col("p").cast("long").alias("p")).groupBy(F.expr("p div 32768").alias("k")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("m"))
    out = np.zeros(max(size // 8, 4096), np.uint8)
    for r in rows.collect():
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out[: size // 8]


#: Bits of the filter that ``marked`` sends to the executors.
MARK_BITS = 24


def marked(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``marked``: true for each row whose ``key`` is in ``keys``, and for few others; null keys aren't.

    The filter has ``2 ** MARK_BITS`` bits whatever the number of keys (2 MB, in
    512 rows at most), so it may be broadcast.  With very many keys most rows are
    marked, which costs their joins but changes no result.
    """
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << MARK_BITS))
    made = keys.select(at.alias("p")).groupBy(F.expr("p div 32768").alias("__k")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("__m"))
    rows = df.withColumn("__p", at).withColumn("__k", F.expr("__p div 32768")).join(F.broadcast(made), "__k", "left")
    bit = F.expr("shiftright(CAST(conv(hex(substring(__m, CAST((__p % 32768) div 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(__p % 8 AS INT)) & 1 = 1")
    return rows.withColumn("marked", F.coalesce(bit & F.col(key).isNotNull(), F.lit(False))).drop("__k", "__m", "__p")


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label`` of the ids whose rows have one label; ids that are marked both ways are left out, whatever the order of rows."""
    return labels.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("__most")).where(F.col(label) == F.col("__most")).drop("__most")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> F.Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def counted(df: DataFrame, name: str, text: str, keep: list[str]) -> DataFrame:
    """``df``'s columns ``keep`` and the number of words of its text."""

    def make(data: np.ndarray, off: np.ndarray) -> dict[str, object]:
        return {name: wg.WordGrid(data, off).counts.astype(np.int64)}

    return arrow_append(df, make, [T.StructField(name, T.LongType())], text, keep=keep)


def arrow_append(
    df: DataFrame,
    fn: Callable[[np.ndarray, np.ndarray], dict[str, object]],
    fields: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with columns that ``fn(bytes, offsets)`` makes from pieces of its text.

    A column of ``df`` named like a new one gives way to it.  ``keep`` names the
    columns to carry along (default all); others are not read.
    """
    small_batches(df.sparkSession)
    new = [f.name for f in fields]
    cols = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in cols] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for batch in batches:
            for a, b, data, off in wg.chunks(batch, "__text"):
                made = fn(data, off)
                part = batch.slice(a, b - a)
                arrays = [part.column(i) for i in range(len(cols))]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x) for x in (made[c] for c in new)]
                if arrow is None:
                    from pyspark.sql.pandas.types import to_arrow_schema

                    arrow = to_arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([x.cast(t) if x.type != (t := arrow.field(i).type) and i >= len(cols) else x for i, x in enumerate(arrays)], names=cols + new)

    picked = df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").cast("binary").alias("__text"))
    return picked.mapInArrow(run, schema)
