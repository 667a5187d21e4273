"""Evidence packages: tables written with hash trees, and what has changed in them since.

A row's leaf is a digest of its values in the order of the columns' names; leaves are dealt
to buckets by their first bits, a bucket's digest is made of its leaves whatever their order, and
the root of all of them.  Roots tell whether anything changed, buckets where to look,
leaves which rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a tree.
BUCKETS = 4096


def leaves(df: DataFrame) -> DataFrame:
    """``df`` with ``leaf``, the SHA-256 of each row as JSON with nulls, and its ``bucket``."""
    cols = sorted(df.columns)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"})
    made = df.withColumn("leaf", F.sha2(text, 256))
    return made.withColumn("bucket", (F.conv(F.substring("leaf", 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"))


def tree(df: DataFrame) -> DataFrame:
    """``bucket, rows, digest``: four sums of 60 bits of the leaves' digits, so that partial sums merge."""
    parts = [F.sum(F.conv(F.substring("leaf", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    sums = leaves(df).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), *parts)
    return sums.select("bucket", "rows", F.sha2(F.concat_ws(":", "rows", "s0", "s1", "s2", "s3"), 256).alias("digest"))


def root(buckets: DataFrame) -> str:
    """Of a tree's buckets, which are BUCKETS at most."""
    rows = sorted(tuple(r) for r in buckets.select("bucket", "rows", "digest").collect())
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


def write_package(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Writes tables with their trees and leaves, and returns the root of each; ``read_package`` and ``findings`` read them back."""
    roots = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/tables/{name}")
        written = df.sparkSession.read.parquet(f"{folder}/tables/{name}")
        leaves(written).groupBy("bucket", "leaf").count().write.mode("overwrite").parquet(f"{folder}/leaves/{name}")
        tree(written).write.mode("overwrite").parquet(f"{folder}/trees/{name}")
        roots[name] = root(df.sparkSession.read.parquet(f"{folder}/trees/{name}"))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(sorted(roots.items()), "name string, root string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/roots")
    return roots


def read_package(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {r["name"]: spark.read.parquet(f"{folder}/tables/{r['name']}") for r in spark.read.parquet(f"{folder}/roots").collect()}


def changed(df: DataFrame, held: DataFrame, held_leaves: DataFrame) -> DataFrame:
    """``finding, bucket, leaf, n, row``: rows that came or went since; only leaves of buckets that differ are compared.

    ``row`` is the JSON of a row that is new; of a row that went the leaf is left.
    """
    now = tree(df)
    differ = now.alias("a").join(held.alias("b"), "bucket", "full").where("NOT (a.digest <=> b.digest)").select("bucket")
    rows = leaves(df).join(F.broadcast(differ), "bucket", "left_semi")  # BUCKETS numbers at most
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    mine = rows.groupBy("bucket", "leaf").agg(F.count(F.lit(1)).alias("m"), F.first(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("row"))
    theirs = held_leaves.join(F.broadcast(differ), "bucket", "left_semi").select("bucket", "leaf", F.col("count").alias("k"))
    both = mine.join(theirs, ["bucket", "leaf"], "full").withColumn("n", F.coalesce("m", F.lit(0)) - F.coalesce("k", F.lit(0))).where("n <> 0")
    return both.select(F.when(F.col("n") > 0, "new row").otherwise("missing row").alias("finding"), "bucket", "leaf", F.abs("n").alias("n"), F.when(F.col("n") > 0, F.col("row")).alias("row"))


def findings(spark: SparkSession, folder: str, roots: dict[str, str]) -> DataFrame:
    """``name, finding, bucket, leaf, n, row``: where a package differs from the roots that were told; no row if it doesn't.

    A package whose trees were made anew for other tables is told by its roots.
    """
    out = spark.createDataFrame([], "name string, finding string, bucket int, leaf string, n long, row string")
    named = {r["name"]: r["root"] for r in spark.read.parquet(f"{folder}/roots").collect()}
    told = lambda name, what: spark.createDataFrame([(name, what, None, None, None, None)], out.schema)
    for name in sorted({*roots, *named}):
        if name not in named or name not in roots:
            out = out.unionByName(told(name, "table not in the package" if name in roots else "table that was not told"))
            continue
        held, leaf = spark.read.parquet(f"{folder}/trees/{name}"), spark.read.parquet(f"{folder}/leaves/{name}")
        if root(held) != roots[name] or named[name] != roots[name]:
            out = out.unionByName(told(name, "another tree"))
        sums = [F.sum(F.col("count") * F.conv(F.substring("leaf", 1 + 15 * k, 15), 16, 10).cast("decimal(28,0)")).alias(f"s{k}") for k in range(4)]
        again = leaf.groupBy("bucket").agg(F.sum("count").alias("rows"), *sums).select("bucket", F.sha2(F.concat_ws(":", "rows", "s0", "s1", "s2", "s3"), 256).alias("d"))
        bad = again.join(held, "bucket", "full").where("NOT (d <=> digest)")
        null = lambda kind: F.lit(None).cast(kind)
        out = out.unionByName(bad.select(F.lit(name).alias("name"), F.lit("leaves that don't make their bucket").alias("finding"), "bucket", null("string").alias("leaf"), null("long").alias("n"), null("string").alias("row")))
        table = spark.read.parquet(f"{folder}/tables/{name}")
        out = out.unionByName(changed(table, held, leaf).select(F.lit(name).alias("name"), "finding", "bucket", "leaf", "n", "row"))
    return out
