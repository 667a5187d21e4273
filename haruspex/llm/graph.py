"""Connected components of an edge table, without collecting edges or gathering a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haruspex.llm import common as C

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``; root is the smallest node that it is connected with.

    Alternates two star contractions until all components are stars.  In the large step a
    node's larger neighbours are joined to its smallest one, in the small step the
    node and its smaller neighbours are; both keep connectivity, and the rounds
    grow with the logarithm of the nodes.  A hub's neighbours are reduced by a
    map-side minimum and joined back on the hub, which skew handling can split.
    """
    now = C.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def stars(e: DataFrame) -> DataFrame:
        """Each edge from the larger to the smaller end, and the smallest neighbour of the node that acts."""
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m")
        small = large.join(down, F.col("b") == F.col("k")).select(F.col("m").alias("x"), F.col("a").alias("y"), F.col("b").alias("z"))
        out = small.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(small.select(F.col("x").alias("a"), F.col("z").alias("b")))
        return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def settled(e: DataFrame) -> bool:
        """Whether each node is either a centre or the larger end of one edge."""
        ends = e.select(F.col("a").alias("node"), F.lit(0).alias("under")).unionByName(e.select(F.col("b").alias("node"), F.lit(1).alias("under")))
        return ends.groupBy("node").agg(F.sum("under").alias("n"), F.min("under").alias("least")).where("n > 1 OR n = 1 AND least = 0").isEmpty()

    for _ in range(MAX_ROUNDS):
        done = settled(now)
        # the shuffles and the checkpoint of the round before are dropped by the driver
        C.release(edges.sparkSession)
        if done:
            break
        now = C.cut(stars(now))
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
