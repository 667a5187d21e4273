"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haruspex.llm import common as C

#: Sources are a dimension of the corpus; their list, one row each, is read by the driver up to this many.
MAX_SOURCES = 200_000
#: Cells of the histogram in which the cut of a source's sampling order is found.
CELLS = 8192
#: Last places of a sample, each of which goes to the document that ends nearest to the target.
LAST = 4
#: Documents on either side of the cut, in order, of which one each may change places at last.
SWAPS = 256
#: Size classes for each doubling, over which a source's inclusion probabilities are scaled.
FINE = 32


def water_fill(sizes: list[float], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; what is above goes to the others by weight."""
    target, open_, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= cap * sizes[i]}
        for i in full or open_:
            target[i] = cap * sizes[i] if full else unit * weights[i]
        left -= sum(target[i] for i in full)
        open_ = open_ - full if full else set()
    return target


def source_targets(sizes: list[tuple[str | None, int]], cycle=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target): sources by code point, null last, weigh ``cycle`` in turn."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    weights = [float(cycle[i % len(cycle)]) for i in range(len(rows))]
    targets = water_fill([float(s) for _, s in rows], weights, share * sum(s for _, s in rows), cap)
    return [(k, s, t) for (k, s), t in zip(rows, targets)]


def pareto_mix(docs: DataFrame, *, cycle=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 20260801, size=None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Copies of each document in a mixture whose sources meet target sizes.

    A source whose target is m times its size first gets floor(m) certain whole
    copies of every document.  The words left of its target are a Pareto order
    sample of its documents:

    * Inclusion probabilities are proportional to size, ``min(1, c * size)``, with
      c such that the words expected are those left (solved over size classes).
      Their sum is the expected number of documents.
    * Random odds ``u / (1 - u)`` come from a hash of id, source and text.  Documents
      are taken by ascending ratio of random odds to inclusion odds; those of probability 1 come first.
    * The sample's size is the number of documents whose words come up to what is
      left; its last places (up to ``LAST``, one in all but small sources) go to the documents that end nearest to it.
      Then one of the ``SWAPS`` documents taken last and one of the ``SWAPS`` next in order
      change places where that comes nearer still.

    No source is sorted in one task: ratios are put in ``CELLS`` cells, sums by
    source and cell are aggregated map-side, and only the cell in which the cut
    lies is ranked.  Equal rows are one entry there, with their number.

    Returns ``id, size, source_size, target, taken, copies, inclusion`` (of the
    sampled copy; and with ``carry`` also the input's other columns, which give way to these on a name clash).

    * Null text: size 0; it is copied floor(m) times and takes no words.
    * Null source: a source of its own, last in order.
    * Null or repeated ids: drawn by text; equal rows are one draw, of which so many are taken as fit.
    * Empty input: empty result.
    """
    made = ["size", "source_size", "target", "taken", "copies", "inclusion"]
    both = _mix(docs, cycle, share, cap, seed, size, id_col, source_col, text_col, carry)
    out = [F.col("__size").alias("size"), "source_size", "target", (F.col("copies") * F.col("__size")).cast("long").alias("taken"), "copies", F.col("__p").alias("inclusion")]
    if carry:
        return both.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in made], *out)
    return both.select(F.col("__id").alias(id_col), *out)


def _mix(docs, cycle, share, cap, seed, size, id_col, source_col, text_col, carry) -> DataFrame:
    spark = docs.sparkSession
    # 53 bits of a hash, never 0 or 1
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    full = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []),
        F.col(id_col).alias("__id"),
        F.col(source_col).cast("string").alias("__source"),
        u.alias("__u"),
        *([F.col(text_col).alias("__words")] if size is None else [size.alias("__size")]),
    )
    if size is None:
        full = C.counted(full, "__size", "__words", [c for c in full.columns if c != "__words"])
    narrow = C.cut(full.drop("__row"))
    bin_ = F.when(F.col("__size") > 0, F.floor(F.log2(F.col("__size").cast("double")) * FINE)).otherwise(-1).cast("int")
    bins = C.cut(narrow.groupBy("__source", bin_.alias("__bin")).agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("n")))
    found = bins.groupBy("__source").agg(F.sum("words").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = []
    for source, s, target in source_targets([(r["__source"], int(r["s"])) for r in found], cycle, share, cap):
        whole = int(min(target // s, cap)) if s else 0
        rest = target - whole * s
        if s and s - rest < 0.5:  # rounding: one more whole copy
            whole, rest = whole + 1, 0.0
        plan.append((source, s, float(target), whole, float(rest)))
    scale = {r["__source"]: r["c"] for r in _scales(_by_source(bins, _table(spark, [(p[0], p[4]) for p in plan], "rest double"))).collect()}
    plan = [(*p, float(scale.get(p[0]) or 0.0)) for p in plan]
    kinds = "source_size long, target double, whole int, rest double, c double"
    ranked = _ratios(_by_source(narrow, _table(spark, plan, kinds))).where("__r IS NOT NULL")
    cuts = {r["__source"]: r for r in _cuts(ranked)}
    # the last places
    gap = {k: rest - cuts[k]["words"] for k, _, _, _, rest, _ in plan if k in cuts}
    last: dict[str | None, list[float]] = {k: [] for k in gap}
    for _ in range(LAST):
        open_ = [(k, float(g), cuts[k]["r_part"], int(cuts[k]["left"]), last[k]) for k, g in gap.items() if abs(g) >= 1]
        later = _by_source(ranked, _table(spark, open_, "gap double, r_part double, left long, last array<double>"))
        later = later.where("(__r > r_part OR (__r = r_part AND left > 0)) AND NOT array_contains(last, __r)")
        best = later.groupBy("__source").agg(F.min(F.struct(F.abs(F.col("__size") - F.col("gap")).alias("off"), "__r", "__size")).alias("m"), F.first("gap").alias("gap"))
        best = best.where("m.off < abs(gap)").select("__source", "m.__r", "m.__size").collect() if open_ else []
        for r in best:
            last[r["__source"]].append(r["__r"])
            gap[r["__source"]] -= r["__size"]
        if not best:
            break
    swaps = _swaps(ranked, [(k, float(g), cuts[k]["r_part"], last[k]) for k, g in gap.items() if abs(g) >= 1])
    final = [(*p, cuts[p[0]]["r_part"], int(cuts[p[0]]["k_part"]), last[p[0]], *swaps.get(p[0], (None, None))) if p[0] in cuts else (*p, None, 0, [], None, None) for p in plan]
    rows = _ratios(_by_source(full if carry else narrow, _table(spark, final, kinds + ", r_part double, k_part long, last array<double>, r_out double, r_in double")))
    one_more = F.array_contains(F.col("last"), F.col("__r")).cast("long")
    # rows of equal ratios are numbered by partition first, so that not one task numbers them; they are
    # cut with their partitions' numbers, which thus hold whatever is computed again
    rows = rows.withColumn("__quota", F.when(F.col("__r") == F.col("r_part"), F.col("k_part") + one_more).when(one_more == 1, one_more))
    sure = rows.where("__quota IS NULL").withColumn("__extra", F.coalesce((F.col("__r") < F.col("r_part")) & ~F.col("__r").eqNullSafe(F.col("r_out")) | F.col("__r").eqNullSafe(F.col("r_in")) & F.col("__r").isNotNull(), F.lit(False)).cast("int"))
    alike = C.cut(rows.where("__quota IS NOT NULL").withColumn("__in", F.spark_partition_id()))
    local = alike.withColumn("__nth", F.row_number().over(W.partitionBy("__source", "__r", "__in").orderBy("__id")))
    counts = alike.groupBy("__source", "__r", "__in").agg(F.count(F.lit(1)).alias("m"))
    before = counts.withColumn("__before", F.sum("m").over(W.partitionBy("__source", "__r").orderBy("__in")) - F.col("m")).select(F.col("__source").alias("b_source"), F.col("__r").alias("b_r"), F.col("__in").alias("b_in"), "__before")
    local = local.join(before, F.col("__source").eqNullSafe(F.col("b_source")) & (F.col("__r") == F.col("b_r")) & (F.col("__in") == F.col("b_in")))
    local = local.withColumn("__extra", (F.col("__nth") + F.col("__before") <= F.col("__quota")).cast("int")).select(*sure.columns)
    return sure.unionByName(local).withColumn("copies", (F.col("whole") + F.col("__extra")).cast("int"))


def _table(spark: SparkSession, rows: list[tuple], rest: str) -> DataFrame:
    """One row for each source, at most MAX_SOURCES."""
    return spark.createDataFrame(rows, f"p_source string, {rest}")


def _by_source(df: DataFrame, table: DataFrame) -> DataFrame:
    return df.join(F.broadcast(table), df["__source"].eqNullSafe(table["p_source"])).drop("p_source")


def _ratios(rows: DataFrame) -> DataFrame:
    """With the inclusion probability ``__p``, and ``__r``, the ratio of random odds to inclusion odds; null where nothing is sampled."""
    p = F.when((F.col("rest") > 0) & (F.col("__size") > 0), F.least(F.lit(1.0), F.col("c") * F.col("__size")))
    rows = rows.withColumn("__p", F.coalesce(p, F.lit(0.0)))
    ratio = F.when(F.col("__p") >= 1, F.lit(0.0)).when(F.col("__p") > 0, F.col("__u") / (1 - F.col("__u")) * (1 - F.col("__p")) / F.col("__p"))
    return rows.withColumn("__r", ratio)


def _scales(bins: DataFrame) -> DataFrame:
    """``__source, c``: with certain documents in the classes of larger sizes, the scale that leaves ``rest`` expected words.

    A source's classes are few (``FINE`` for each doubling), so a window may take them.
    """
    mean = F.col("words") / F.col("n")
    down = W.partitionBy("__source").orderBy(F.col("__bin").desc())
    rows = bins.where("rest > 0 AND words > 0").withColumn("mean", mean).withColumn("square", F.col("words") * mean)
    before = F.sum("words").over(down) - F.col("words")
    below = F.sum("square").over(W.partitionBy("__source").orderBy("__bin"))
    rows = rows.withColumn("c", (F.col("rest") - before) / below)
    # of the classes from which on nothing is certain, the one of the largest sizes
    return rows.where((F.col("c") * F.col("mean") < 1) | (F.col("c") <= 0)).groupBy("__source").agg(F.max_by("c", "__bin").alias("c"))


def _cuts(ranked: DataFrame) -> list:
    """For each source: the ratio below which all rows are taken, how many of that ratio (and how many are left), and the words of both."""
    spark = ranked.sparkSession
    ranked = ranked.withColumn("__cell", F.least(F.floor(F.col("__r") / (1 + F.col("__r")) * CELLS), F.lit(CELLS - 1)).cast("int"))
    upto = W.partitionBy("__source").orderBy("__cell")
    cells = ranked.groupBy("__source", "__cell").agg(F.sum("__size").alias("cs"), F.first("rest").alias("rest")).withColumn("run", F.sum("cs").over(upto))
    ends = cells.groupBy("__source").agg(
        F.min(F.when(F.col("run") > F.col("rest"), F.struct("__cell", (F.col("run") - F.col("cs")).alias("before")))).alias("e"),
        F.max(F.struct("__cell", (F.col("run") - F.col("cs")).alias("before"))).alias("all"),
    ).select("__source", F.coalesce("e", "all").alias("e")).select("__source", "e.__cell", "e.before").collect()
    edge = _table(spark, [(r["__source"], r["__cell"], int(r["before"])) for r in ends], "e_cell int, before long")
    near = _by_source(ranked, edge).where("__cell = e_cell").groupBy("__source", "__r", "before", "rest").agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("m"))
    near = near.withColumn("run", F.sum("words").over(W.partitionBy("__source").orderBy("__r")) - F.col("words") + F.col("before"))
    fits = F.least(F.col("m"), F.floor((F.col("rest") - F.col("run")) * F.col("m") / F.col("words"))).cast("long")
    near = near.withColumn("k", F.when(F.col("run") <= F.col("rest"), fits))
    part = F.max(F.when(F.col("k").isNotNull(), F.struct("__r", F.col("k").alias("k_part"), (F.col("m") - F.col("k")).alias("left"), (F.col("run") + F.col("k") * F.col("words") / F.col("m")).alias("words"))))
    return near.groupBy("__source").agg(part.alias("p")).select("__source", F.col("p.__r").alias("r_part"), "p.k_part", "p.left", "p.words").collect()


def _exchange(rows: pa.Table) -> pa.Table:
    """The document taken and the one not taken whose exchange ends nearest to a source's gap, if it is nearer than none."""
    taken, ratio, size, nth = (rows[c].to_numpy() for c in ("__taken", "__r", "__size", "__nth"))
    _, which, many = np.unique(ratio, return_inverse=True, return_counts=True)
    # documents of equal ratios stand or fall together, and the last of each side may have an equal beyond it
    alone = (many[which] == 1) & (nth < SWAPS)
    out, into = (np.flatnonzero(alone & side) for side in (taken, ~taken))
    none = pa.table({"__source": pa.array([], pa.string()), "r_out": pa.array([], pa.float64()), "r_in": pa.array([], pa.float64())})
    if not len(out) or not len(into):
        return none
    out, into = (x[np.lexsort((ratio[x], size[x]))] for x in (out, into))
    gap = float(rows["gap"][0].as_py())
    wanted, have = size[out] + gap, size[into]
    at = np.searchsorted(have, wanted)
    near = np.stack([np.clip(at - 1, 0, len(have) - 1), np.clip(at, 0, len(have) - 1)])
    off = np.abs(have[near] - wanted)
    k, i = np.unravel_index(int(off.argmin()), off.shape)
    if off[k, i] >= abs(gap):
        return none
    return pa.table({"__source": pa.array([rows["__source"][0].as_py()], pa.string()), "r_out": [float(ratio[out[i]])], "r_in": [float(ratio[into[near[k, i]]])]})


def _swaps(ranked: DataFrame, gaps: list[tuple]) -> dict:
    """By source: the ratios of the document that gives its place up and of the one that gets it."""
    if not gaps:
        return {}
    rows = _by_source(ranked, _table(ranked.sparkSession, gaps, "gap double, r_part double, last array<double>"))
    rows = rows.where("__r > 0 AND __r <> r_part AND NOT array_contains(last, __r)").withColumn("__taken", F.col("__r") < F.col("r_part"))
    near = W.partitionBy("__source", "__taken").orderBy(F.abs(F.col("__r") - F.col("r_part")), "__id")
    rows = rows.select("__source", "__taken", "__r", "__size", "gap", F.row_number().over(near).alias("__nth")).where(F.col("__nth") <= SWAPS)
    # 2 * SWAPS rows of a source at most
    found = rows.groupBy("__source").applyInArrow(_exchange, "__source string, r_out double, r_in double").collect()
    return {r["__source"]: (r["r_out"], r["r_in"]) for r in found}


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "inclusion")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mixture takes it, none up to twice.

    Nulls, ties, repeated rows, empty input: as in ``pareto_mix``.  All columns are carried along, whatever their names.
    """
    mixed = _mix(docs, (3.0, 1.0, 2.0), 1.5, 2.0, 20260801, None, "doc_id", "source", "text", True).where("copies > 0")
    rows = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
