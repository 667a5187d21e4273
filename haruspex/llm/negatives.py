"""Hard negatives by an exact nearest-neighbour join over a Voronoi partition.

The score is an inner product, so vectors are augmented: with r the largest norm of
any row, a row x becomes (x, sqrt(r^2 - |x|^2)) and an anchor a becomes (a, 0), and the
larger the score, the smaller the distance.  Anchors belong to the nearest of a
bounded number of pivots.  Scores with a bounded sample give each anchor a score
that its answers reach, thus a radius; by the triangle inequality a row is
replicated only to those groups of anchors that have one whose radius it may be in.
Groups are cut into blocks of bounded size, each of which is joined exactly.

Rows with equal vectors and labels are one class with its smallest ids, as larger
ones can't be among the first; so copies cost nothing, however many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haruspex.llm import common as C

#: Classes whose scores bound the radii, and from which pivots are made.
SAMPLE = 1024
#: Anchors for each pivot, about; there are MIN_PIVOTS to SAMPLE pivots.
PER_PIVOT, MIN_PIVOTS = 1024, 8
#: Buckets of labels in the search for positives.
LABEL_BUCKETS = 8
#: Anchors and classes of a tile, about.
TILE_ANCHORS, TILE_CLASSES = 4096, 4096
#: Scores that are held at a time.
HELD = 1 << 21
LARGEST = (1 << 31) - 1
#: Columns of a row of vectors.
_VECTOR = "label int, vec binary, n2 double"


@dataclass(frozen=True)
class Space:
    """What all tasks know: the dimension, the largest squared norm, pivots, and whether doubles hold every score."""

    dim: int
    r2: float
    pivots: np.ndarray

    def matrix(self, vecs: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Whole-number vectors, shorter ones filled up with zeros, as doubles where these hold every score."""
        out = np.zeros((len(vecs), self.dim), np.float64 if self.r2 < 2**53 else np.int64)
        k = 0
        for piece in vecs.chunks if isinstance(vecs, pa.ChunkedArray) else [vecs]:
            off = np.frombuffer(piece.buffers()[1], np.int32, len(piece) + 1, piece.offset * 4).astype(np.int64) // 4
            if len(piece) and off[-1] > off[0]:
                flat = np.frombuffer(piece.buffers()[2], "<i4", off[-1])[off[0] :]
                size = np.diff(off)
                if (size == self.dim).all():
                    out[k : k + len(piece)] = flat.reshape(-1, self.dim)
                else:
                    row = np.repeat(np.arange(len(piece)), size)
                    out[k + row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
            k += len(piece)
        return out

    def far(self, x: np.ndarray, anchor: bool) -> np.ndarray:
        """Distances to the pivots in the augmented space."""
        x = x.astype(np.float64)
        n2 = (x * x).sum(1)
        more = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(0, self.r2 - n2))
        cross = x @ self.pivots[:, :-1].T + more[:, None] * self.pivots[None, :, -1]
        return np.sqrt(np.maximum(0, (n2 + more**2)[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * cross))

    def distance(self, n2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from an anchor of squared norm n2 rows of that score are."""
        return np.sqrt(np.maximum(0, n2 + self.r2 - 2 * np.asarray(score, np.float64)))

    def kth(self, scores: np.ndarray, allowed: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
        """For each row the k-th largest of the allowed scores; ``least`` where there are fewer, or doubles don't hold scores."""
        if scores.shape[1] < k or self.r2 >= 2**53:
            return least
        return np.maximum(least, np.partition(np.where(allowed, scores, least[:, None]), -k, axis=1)[:, -k]).astype(np.int64)

    @property
    def slack(self) -> float:
        """More than what rounding may do to a distance."""
        return 1e-6 * (self.r2**0.5 + 1)


def whole(rows: DataFrame, vec_id: str, embedding: str, label: str, anchor: Column, scale: int) -> DataFrame:
    """Rows that take part: ``vec_id, anchor, label, vec, n2``; components are floor(scale * x), as 32-bit numbers."""
    picked = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{label}`").cast("int").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    picked = picked.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("x")
            off = col.offsets.to_numpy().astype(np.int64)
            flat = np.array(col.values.to_numpy(zero_copy_only=False), np.float64)[off[0] : off[-1]]
            off = off - off[0]
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
            good = sums(~np.isfinite(flat)) == 0
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.clip(np.nan_to_num(np.floor(scale * flat)), -LARGEST, LARGEST)
            raw = pa.Array.from_buffers(pa.binary(), len(good), [None, pa.py_buffer((off * 4).astype(np.int32).tobytes()), pa.py_buffer(q.astype("<i4").tobytes())])
            n2 = np.array([float(q[a:b] @ q[a:b]) for a, b in zip(off[:-1], off[1:])])
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("anchor"), batch.column("label"), raw, pa.array(n2, pa.float64())], names=["vec_id", "anchor", "label", "vec", "n2"])
            yield out.filter(pa.array(good))

    return picked.mapInArrow(run, f"vec_id long, anchor boolean, {_VECTOR}")


def made_pivots(sample: np.ndarray, r2: float, n: int) -> np.ndarray:
    """Centres of a few rounds of Lloyd's algorithm over the augmented sample."""
    x = np.hstack([sample.astype(np.float64), np.sqrt(np.maximum(0, r2 - (sample.astype(np.float64) ** 2).sum(1)))[:, None]])
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(5):
        near = ((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        centres = np.array([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(n)])
    return centres


def first(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each row: higher scores first, ties by smaller ident."""
    order = np.lexsort((ident, -score, row))
    row = row[order]
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    return order[rank < k]


def joined(space: Space, anchors: pa.Table, rows: pa.Table, lows: np.ndarray, highs: np.ndarray, same: bool, keep: int) -> tuple[np.ndarray, ...]:
    """(anchor's place, slot, score, id): for each anchor and slot the first ``keep`` rows with a score from low to high.

    ``lows`` and ``highs`` have a column for each slot.  Rows of the anchor's label count if ``same``, all others if not.
    """
    a, a_label = space.matrix(anchors["vec"]), anchors["label"].to_numpy()
    lists = rows["ids"].combine_chunks()
    ids, start = lists.values.to_numpy(), lists.offsets.to_numpy()
    start, head = start[:-1], ids[start[:-1]]
    count = np.diff(lists.offsets.to_numpy())
    r_label = rows["label"].to_numpy()
    n, slots = max(1, HELD // max(1, len(a))), lows.shape[1]
    best: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(3))] * slots
    lows = lows.copy()
    x = space.matrix(rows["vec"])
    for c in range(0, len(x), n):
        s = a @ x[c : c + n].T
        fits = (a_label[:, None] == r_label[None, c : c + n]) == same
        for j in range(slots):
            r, k = np.nonzero(fits & (s >= lows[:, j, None]) & (s <= highs[:, j, None]))
            if not len(r):
                continue
            score = s[r, k].astype(np.int64)
            top = first(r, score, head[c + k], keep)  # by each class's smallest id: no row before its class
            r, score, k = r[top], score[top], c + k[top]
            m = np.minimum(count[k], keep)
            at = np.repeat(start[k] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            held = [np.concatenate(z) for z in zip(best[j], (np.repeat(r, m), np.repeat(score, m), ids[at]))]
            top = first(*held, keep)
            best[j] = tuple(z[top] for z in held)
            full = np.bincount(best[j][0], minlength=len(a)) == keep
            last = np.full(len(a), np.iinfo(np.int64).max)
            np.minimum.at(last, best[j][0], best[j][1])
            lows[full, j] = np.maximum(lows[full, j], last[full])
    return tuple(np.concatenate(z) for z in zip(*[(b[0], np.full(len(b[0]), j), b[1], b[2]) for j, b in enumerate(best)]))


def hard_negatives(
    rows: DataFrame, anchor: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every row that ``anchor`` marks.

    An anchor's positives are the first ``positives`` other rows of its label; for each of them
    the first ``negatives`` rows of other labels score ``low`` to ``high`` percent of it.

    * Rows with a null id, label or vector, or a null or non-finite component, take no part.
    * Rows alike in id, label and vector count once; an anchor's own id is never its positive.
    * Shorter vectors are filled up with zeros; whole components are kept to 32 bits.
    * Ties go by smaller id.  Without anchors, or empty input: empty result.  Other columns aren't read.
    """
    spark, near = rows.sparkSession, positives + 1  # an anchor may be among its own first
    C.small_batches(spark)
    made = whole(rows, vec_id, embedding, label, anchor, scale)
    by_id = Window.partitionBy("label", "vec").orderBy("vec_id")
    few = made.select("vec_id", "label", "vec", "n2").dropDuplicates(["vec_id", "label", "vec"]).withColumn("k", F.row_number().over(by_id)).where(F.col("k") <= max(near, negatives))
    classes = C.cut(few.groupBy("label", "vec").agg(F.first("n2").alias("n2"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = C.cut(made.where("anchor").groupBy("label", "vec").agg(F.first("n2").alias("n2"), F.min("vec_id").alias("akey")))
    bucket = F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int")
    sizes = {r["b"]: r["n"] for r in classes.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    r2, width = classes.agg(F.max("n2"), F.max(F.octet_length("vec"))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n_anchors = asked.count()
    if not n_anchors:
        return spark.createDataFrame([], result)
    bare = Space(max(1, width // 4), r2, np.zeros((0, 1)))
    drawn = classes.select("label", "vec").orderBy(F.xxhash64("label", "vec"), "label", "vec").limit(SAMPLE).toArrow()
    sample, sample_label = bare.matrix(drawn["vec"]), drawn["label"].to_numpy()
    pivots = made_pivots(sample, r2, min(len(sample), max(MIN_PIVOTS, n_anchors // PER_PIVOT)))
    space = Space(bare.dim, r2, pivots)
    beyond = int(min(2.0 * r2 + 1, 2.0**62))  # above any score

    def placed(batch: pa.RecordBatch, lows: np.ndarray, highs: np.ndarray) -> list[pa.Array]:
        """Each anchor's pivot, and how far from it an answer may and must lie."""
        far = space.far(space.matrix(batch.column("vec")), True)
        cell = far.argmin(1)
        u, n2 = far[np.arange(len(far)), cell], batch.column("n2").to_numpy()
        return [pa.array(x) for x in (cell.astype(np.int32), u + space.distance(n2, lows), space.distance(n2, highs) - u)]

    spec = f"akey long, {_VECTOR}, lows array<long>, highs array<long>, cell int, outer double, inner double"
    names = [f.split()[0] for f in spec.split(", ")]

    def slotted(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), pa.int64()))

    def with_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = space.matrix(b.column("vec"))
            # the sample's own rows may be the anchor's class, which counts as one row at least
            allowed = b.column("label").to_numpy()[:, None] == sample_label[None, :]
            lows = space.kth(a @ sample.T, allowed, near, np.full(len(a), -beyond))[:, None]
            highs = np.full((len(a), 1), beyond)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("akey", "label", "vec", "n2")] + [slotted(lows), slotted(highs)] + placed(b, lows[:, 0], highs[:, 0]), names=names)

    def with_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = space.matrix(b.column("vec"))
            scores, allowed = a @ sample.T, b.column("label").to_numpy()[:, None] != sample_label[None, :]
            given = b.column("scores").to_pylist()
            lows, highs = np.ones((len(a), near), np.int64), np.zeros((len(a), near), np.int64)  # empty windows
            for k, values in enumerate(given):
                lows[k, : len(values)] = [-(-low * v // 100) for v in values]
                highs[k, : len(values)] = [high * v // 100 for v in values]
            for j in range(near):
                on = highs[:, j] >= lows[:, j]
                lows[on, j] = space.kth(scores[on], allowed[on] & (scores[on] <= highs[on, j, None]), negatives, lows[on, j])
            some = highs >= lows
            down, up = np.where(some, lows, np.inf).min(1), np.where(some, highs, -np.inf).max(1)
            out = pa.RecordBatch.from_arrays([b.column(c) for c in ("akey", "label", "vec", "n2")] + [slotted(lows), slotted(highs)] + placed(b, np.where(some.any(1), down, 0), np.where(some.any(1), up, 0)), names=names)
            yield out.filter(pa.array(some.any(1)))

    def search(anchors: DataFrame, same: bool, keep: int) -> DataFrame:
        """``akey, slot, score, vec_id``: the exact answers of every tile."""
        buckets = LABEL_BUCKETS if same else 1
        chunks = [-(-(sizes.get(k, 0) if same else sum(sizes.values())) // TILE_CLASSES) for k in range(buckets)]
        # one row for each pivot and bucket
        reach = anchors.groupBy("cell", (bucket if same else F.lit(0)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("outer").alias("outer"), F.min("inner").alias("inner")).collect()
        blocks, outer, inner = (np.zeros((len(pivots), buckets)) for _ in range(3))
        for r in reach:
            blocks[r["cell"], r["b"]], outer[r["cell"], r["b"]], inner[r["cell"], r["b"]] = -(-r["n"] // TILE_ANCHORS), r["outer"] + space.slack, r["inner"] - space.slack

        def served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = space.far(space.matrix(batch.column("vec")), False)
                b = batch.column("b").to_numpy()
                times = np.where((far <= outer[:, b].T) & (far >= inner[:, b].T), blocks[:, b].T, 0).astype(np.int64)
                row, cell = np.nonzero(times)
                n = times[row, cell]
                row, cell, block = np.repeat(row, n), np.repeat(cell, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                for a in range(0, len(row), 20_000):
                    z = slice(a, a + 20_000)
                    took = batch.take(pa.array(row[z]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[z].astype(np.int32)), took.column("b"), pa.array(block[z].astype(np.int32)), took.column("chunk"), took.column("label"), took.column("vec"), took.column("ids")], names=["cell", "b", "block", "chunk", "label", "vec", "ids"])

        pick = lambda values, at: F.element_at(F.array(*[F.lit(int(max(1, v))) for v in values]), at + 1)
        own = bucket if same else F.lit(0)
        left = classes.select(own.alias("b"), "label", "vec", "ids").withColumn("chunk", F.pmod(F.xxhash64(F.col("ids")[0]), pick(chunks, F.col("b"))).cast("int"))
        left = left.mapInArrow(served, "cell int, b int, block int, chunk int, label int, vec binary, ids array<long>")
        right = anchors.withColumn("b", own)
        in_cell = F.element_at(F.array(*[F.lit(int(max(1, v))) for v in blocks.ravel()]), F.col("cell") * buckets + F.col("b") + 1)
        right = right.withColumn("block", F.pmod(F.xxhash64("akey"), in_cell).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), pick(chunks, F.col("b")) - 1)))
        right = right.select("cell", "b", "block", "chunk", "akey", "label", "vec", "lows", "highs")

        def tile(a: pa.Table, r: pa.Table) -> pa.Table:
            if not a.num_rows or not r.num_rows:
                got = [np.zeros(0, np.int64)] * 4
            else:
                lows, highs = (np.array(a[c].to_pylist(), np.int64) for c in ("lows", "highs"))
                got = joined(space, a, r, lows, highs, same, keep)
            key = a["akey"].to_numpy()[got[0]] if a.num_rows else got[0]
            return pa.table([pa.array(key, pa.int64()), pa.array(got[1].astype(np.int32)), pa.array(got[2], pa.int64()), pa.array(got[3], pa.int64())], names=["akey", "slot", "score", "vec_id"])

        keys = ["cell", "b", "block", "chunk"]
        found = right.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInArrow(tile, "akey long, slot int, score long, vec_id long")
        order = Window.partitionBy("akey", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
        return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep)

    # positives: slot 0
    bounded = C.cut(asked.mapInArrow(with_bounds, spec))
    best = search(bounded, True, near).groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("k", "score", "vec_id"))).alias("best"))
    best = C.cut(best)
    # negatives: a slot for each score that a positive may have
    wanted = asked.join(best, "akey").select("akey", "label", "vec", "n2", F.array_sort(F.array_distinct(F.col("best.score"))).alias("scores"))
    windows = C.cut(wanted.mapInArrow(with_windows, spec))
    hits = search(windows, False, negatives).groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("slot", "k", "score", "vec_id"))).alias("hits"))
    answers = asked.select("akey", "label", "vec").join(best, "akey").join(hits, "akey").drop("akey")

    mine = made.where("anchor").select(F.col("vec_id").alias("anchor_id"), "label", "vec").distinct().join(answers, ["label", "vec"])
    others = F.slice(F.filter("best", lambda p: p["vec_id"] != F.col("anchor_id")), 1, positives)
    mine = mine.select("anchor_id", F.array_sort(F.array_distinct(F.col("best.score"))).alias("scores"), "hits", F.explode(others).alias("p"))
    slot = F.array_position("scores", F.col("p.score")) - 1
    mine = mine.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode(F.filter("hits", lambda h: h["slot"] == slot)).alias("h"))
    return mine.select("anchor_id", "positive_id", F.col("h.k").cast("int").alias("rank"), F.col("h.vec_id").alias("negative_id"), "positive_score", F.col("h.score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; where it is divisible by 7, the label is the next one."""
    rows = C.load(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


SQL = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label AND vec_id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT * FROM (
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
           s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
) WHERE rank <= 3
"""
