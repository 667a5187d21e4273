"""Sharding by sampled splitters, with DataFrame operations only."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haruspex.llm import common as C

#: Rows that a range should hold, and the bounds of the number of ranges; splitters are as many.
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 200_000, 640, 16_384
#: Sampled keys for each range.
OVERSAMPLE = 8
#: A range is overfull from this many times the mean number of rows.
OVERFULL = 2.0
#: Share of a shard from which a group of equal texts is placed by itself.
LARGE_GROUP = 0.02


def _bucket(key: F.Column, splitters: list, kind: str = "bigint") -> F.Column:
    """Number of splitters that are <= key, by binary search in a constant array, which the optimizer folds."""
    if not splitters:
        return F.lit(0)
    arr = F.split(F.lit(",".join(map(repr, splitters))), ",").cast(f"array<{kind}>")
    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))
    init = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.get(arr, mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, init, halve, lambda acc: acc["lo"])


def _unit(*cols) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, carry: bool = False) -> DataFrame:
    """Shards of nearly equal bytes, by range-partitioning hashed keys at sampled splitters.

    A row's key is a hash of its text, so equal texts are one key.  Keys are
    drawn with probability proportional to size (about ``OVERSAMPLE`` for each
    range), and their quantiles are the splitters of ``MIN_RANGES`` to
    ``MAX_RANGES`` ranges.  A key that would make a range overfull gets a range of
    its own, which is subdivided by a hash of the other columns and, where that is
    constant too, by the row's place in the input; its neighbours aren't touched.

    Equal texts stay in one shard unless they are more than a shard's whole share.
    Groups of at least ``LARGE_GROUP`` of a share are put on the emptiest shard
    first, largest first; the other keys fill what is left of each shard in their
    order, a group going where its middle lies.  Larger groups than a share are
    divided by row.  A shard's bytes thus differ from the mean by about
    ``LARGE_GROUP`` of a share, or by half the last large group where such groups leave nothing to fill up with.

    With ``carry`` the input is checkpointed first, so that a row's place means
    the same wherever it is computed, and then goes through the one shuffle.

    Returns ``id, size, text_crc32, law, shard, slot, grown_shard`` (with
    ``carry`` also the input's other columns, which give way on a name clash).
    ``law`` is ``bytes``, ``grown_shard`` null: growing moves the boundaries.

    * Null text: no bytes, crc32 of nothing (0); size is ``overhead``; a group of equal texts with empty ones.
    * Null or repeated ids and equal rows: ordered by the other columns, then by
      place in the input; each gets its own slot.
    * Empty input: empty result.  One text longer than a shard's share: a shard to itself, and others may be empty.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c != text_col and docs.schema[c].dataType.simpleString() in ("string", "int", "bigint", "double", "boolean", "date", "timestamp")]
    rows = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []),
        F.col(id_col).alias("__id"),
        (F.length(text) + F.lit(overhead)).cast("long").alias("__size"),
        F.crc32(text).cast("long").alias("__crc"),
        F.xxhash64(text).alias("__key"),
        F.xxhash64(*others).alias("__tie"),
        F.monotonically_increasing_id().alias("__at"),
    )
    rows = C.cut(rows)
    placed = _placed(rows, shards)
    cols = [F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    if not carry:
        return placed.select(F.col("__id").alias(id_col), *cols)
    return placed.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in made], *cols)


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with shard and slot."""
    spark = rows.sparkSession
    narrow = rows.drop("__row", "__id", "__crc")
    n, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("__size"), F.lit(0))).first()
    if not n:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    ranges = int(min(MAX_RANGES, max(MIN_RANGES, 16 * shards, n // RANGE_ROWS)))
    p = F.col("__size") * float(ranges * OVERSAMPLE) / float(total)
    # at most about ranges * OVERSAMPLE keys, whatever the input
    drawn = narrow.where(_unit("__key", "__tie", "__at", F.lit(7)) < p).select("__key", F.greatest(p, F.lit(1.0)).alias("w")).collect()
    drawn = sorted((r["__key"], r["w"]) for r in drawn)
    mass, splitters, seen = sum(w for _, w in drawn), [], 0.0
    for key, w in drawn:
        seen += w
        if seen * ranges / mass >= len(splitters) + 1 and (not splitters or key > splitters[-1]):
            splitters.append(key)
    share, mean = total / shards, max(1.0, n / ranges)
    # keys with many rows or bytes; by their bounds no more than shards / LARGE_GROUP and ranges
    heavy = narrow.groupBy("__key").agg(F.count(F.lit(1)).alias("c"), F.sum("__size").alias("g"))
    heavy = {r["__key"]: (r["c"], r["g"]) for r in heavy.where((F.col("c") > OVERFULL * max(mean, 32)) | (F.col("g") >= LARGE_GROUP * share)).collect()}
    splitters = sorted({*splitters, *heavy, *(k + 1 for k in heavy if k + 1 < 1 << 63)})
    # large groups go to the emptiest shard; what they leave is filled in order
    loads, chosen = [(0, s) for s in range(shards)], {}
    for key, (_, g) in sorted(heavy.items(), key=lambda x: (-x[1][1], x[0])):
        if LARGE_GROUP * share <= g <= share:
            load, s = heapq.heappop(loads)
            chosen[key] = s
            heapq.heappush(loads, (load + g, s))
    left = [max(0.0, share - load) for load, _ in sorted(loads, key=lambda x: x[1])]
    flow = total - sum(heavy[k][1] for k in chosen)
    bounds, acc, room = [], 0.0, sum(left)
    for x in left[:-1]:
        acc += x * (flow / room if room else 0.0)
        bounds.append(acc)

    def celled(df: DataFrame) -> DataFrame:
        """With ``__range`` and ``__cell``, a part of it that one task takes."""
        df = df.withColumn("__range", _bucket(F.col("__key"), splitters))
        if not heavy:
            return df.withColumn("__cell", F.lit(0))
        parts = spark.createDataFrame([(k, int(-(-c // max(mean, 32)))) for k, (c, _) in heavy.items()], "h_key long, parts int")
        df = df.join(F.broadcast(parts), F.col("__key") == F.col("h_key"), "left")
        # equal ties are parted by the row's place
        mixed = F.xxhash64("__tie", F.floor(F.col("__at") / 64))
        return df.withColumn("__cell", F.when(F.col("parts").isNull(), 0).otherwise(F.floor(_rank_of(mixed) * F.col("parts")).cast("int"))).drop("h_key", "parts")

    cells = celled(narrow)
    sums = cells.groupBy("__range", "__cell").agg(F.count(F.lit(1)).alias("c"), F.sum("__size").alias("s"), F.min("__key").alias("k")).collect()
    before, rank, cell_rows, aside = 0, 0, [], []
    for r in sorted(sums, key=lambda r: (r["__range"], r["__cell"])):
        g = heavy[r["k"]][1] if r["k"] in heavy else None
        if r["k"] in chosen:
            aside.append((chosen[r["k"]], r))
            continue
        first = before if not cell_rows or cell_rows[-1][0] != r["__range"] else cell_rows[-1][5]
        cell_rows.append((r["__range"], r["__cell"], before, rank, g, first, None))
        before, rank = before + r["s"], rank + r["c"]
    for s, r in aside:
        cell_rows.append((r["__range"], r["__cell"], 0, 0, None, 0, s))
    # one row for each cell
    starts = spark.createDataFrame(cell_rows, "b_range int, b_cell int, before long, rank0 long, whole long, first long, given int")

    def ordered(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(starts), (F.col("__range") == F.col("b_range")) & (F.col("__cell") == F.col("b_cell")))
        order = W.partitionBy("__range", "__cell").orderBy("__key", "__tie", "__at")
        group = W.partitionBy("__range", "__cell", "__key")
        df = (
            df.withColumn("__end", F.sum("__size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before"))
            .withColumn("__rank", F.row_number().over(order).cast("long") - 1 + F.col("rank0"))
            .withColumn("__g", F.sum("__size").over(group))
            .withColumn("__gend", F.max("__end").over(group))
        )
        by_row = F.col("__end") - F.col("__size") / 2.0
        middle = F.when(F.col("whole") > F.lit(share), by_row).when(F.col("whole").isNotNull(), F.col("first") + F.col("whole") / 2.0).otherwise(F.col("__gend") - F.col("__g") / 2.0)
        return df.withColumn("shard", F.coalesce("given", _bucket(middle, bounds, "double")))

    # one row for each shard and cell of a group put aside
    counted = ordered(cells).groupBy("shard", "given", "__range", "__cell").agg(F.count(F.lit(1)).alias("c"), F.min("__rank").alias("f"))
    flows = {r["shard"]: (r["c"], r["f"]) for r in counted.where("given IS NULL").groupBy("shard").agg(F.sum("c").alias("c"), F.min("f").alias("f")).collect()}
    used = {s: c for s, (c, _) in flows.items()}
    offsets = [(s, -1, -1, -f) for s, (_, f) in flows.items()]
    for s, r in aside:
        offsets.append((s, r["__range"], r["__cell"], used.get(s, 0)))
        used[s] = used.get(s, 0) + r["c"]
    moved = spark.createDataFrame(offsets, "m_shard int, m_range int, m_cell int, moved long")
    out = ordered(celled(rows)).withColumn("__own", F.col("given").isNotNull())
    on = (F.col("shard") == F.col("m_shard")) & (F.col("m_range") == F.when(F.col("__own"), F.col("__range")).otherwise(-1)) & (F.col("m_cell") == F.when(F.col("__own"), F.col("__cell")).otherwise(-1))
    return out.join(F.broadcast(moved), on).withColumn("slot", F.col("__rank") + F.col("moved"))


def _rank_of(key: F.Column) -> F.Column:
    """A long's place among all longs, 0 to 1."""
    return F.least((key.cast("double") + float(1 << 63)) / float(1 << 64), F.lit(1 - 1e-12))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(C.load(spark, sf_dir, "documents"), 40)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: every row with its shard and slot, and its other columns.

    Nulls, repeated ids and rows, very long texts and empty input: as in ``shard``.
    Columns of the input named like a new one give way.
    """
    return shard(docs, 40, carry=True)
