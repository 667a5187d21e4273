"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import common as C
from haruspex.llm import wordgrid as wg

#: Words of a seed, which is also the shortest tile; an item with fewer words is its own seed.
MIN_MATCH = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Items are broadcast in blocks of at most so many words (a longer item by itself); a larger benchmark takes several passes.
BLOCK_WORDS = 1_000_000


def _windows(words: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin fingerprints of the free windows of ``n`` words, and where they start."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = wg.power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    taken = np.zeros(len(words) + 1, np.int64)
    np.cumsum(~free, out=taken[1:])
    at = np.flatnonzero(taken[n:] == taken[:-n])
    return (sums[at + n] - sums[at]) * down[at], at


def _match(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_j: np.ndarray, n: int) -> tuple[int, int] | None:
    """The leftmost free window of ``n`` words of the item that the document has free too, compared word by word."""
    hi, at_i = _windows(item, free_i, n)
    hj, at_j = _windows(doc, free_j, n)
    if not len(hi) or not len(hj):
        return None
    order = np.argsort(hj, kind="stable")
    lo = np.minimum(np.searchsorted(hj[order], hi), len(hj) - 1)
    for x in np.flatnonzero(hj[order[lo]] == hi).tolist():
        i, j = int(at_i[x]), int(at_j[order[lo[x]]])
        if np.array_equal(item[i : i + n], doc[j : j + n]):
            return i, j
    return None


def tiles(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word fingerprints: (item position, document position, length).

    Running Karp-Rabin: the length of the longest match of unmarked words is
    bisected with rolling fingerprints, matches of that length are marked from the
    left, and so on with shorter ones, until none of ``k`` words is left or the
    item is covered.  Memory grows with the two texts, not with their pairs of positions.
    """
    free_i, free_j, out = np.ones(len(item), bool), np.ones(len(doc), bool), []
    top = min(len(item), len(doc))
    while free_i.any() and top >= k:
        low, best = k - 1, None
        high = top
        while low < high:
            n = (low + high + 1) // 2
            found = _match(item, doc, free_i, free_j, n)
            if found:
                low, best = n, found
            else:
                high = n - 1
        if best is None:
            break
        top = low
        while best:  # all of this length
            i, j = best
            free_i[i : i + top] = False
            free_j[j : j + top] = False
            out.append((i, j, top))
            best = _match(item, doc, free_i, free_j, top)
        top -= 1
    return out


class Index:
    """Seeds of a block of items: fingerprint -> items, with the number of times each has it."""

    def __init__(self, ids: list[int], texts: list[bytes], min_match: int):
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        grid = wg.WordGrid(np.frombuffer(b"".join(texts), np.uint8), off, lower=True, separators=wg.PUNCT)
        self.ids = ids
        self.words = [grid.hash[a:b] for a, b in zip(grid.first[:-1], grid.first[1:])]
        self.size = grid.counts
        self.seeds: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ids)
        self.by_k: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        short = np.minimum(self.size, min_match)
        for k in sorted({int(x) for x in short if x}):
            g, at = grid.grams(k)
            item = grid.doc[at]
            on = short[item] == k
            g, item = g[on], item[on]
            for i in np.flatnonzero(short == k).tolist():
                self.seeds[i] = g[item == i] if len(ids) < 64 else g[np.searchsorted(item, i) : np.searchsorted(item, i, "right")]
            order = np.lexsort((item, g))
            g, item = g[order], item[order]
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (item[1:] != item[:-1])])) if len(g) else np.zeros(0, np.int64)
            self.by_k[k] = g[first], item[first], np.diff(np.append(first, len(g)))


def scan(index: Index, data: np.ndarray, off: np.ndarray, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(document, item, matched words, tiles, item's words) of a chunk's pairs that reach the coverage.

    Seeds are joined document by document, each once.  Items whose words in seeds
    can't reach the coverage are left out before tiling.
    """
    grid = wg.WordGrid(data, off, lower=True, separators=wg.PUNCT)
    out = []
    for k, (keys, items, times) in index.by_k.items():
        g, at = grid.grams(k)
        lo = np.searchsorted(keys, g)
        hit = lo < len(keys)
        hit[hit] = keys[lo[hit]] == g[hit]
        if not hit.any():
            continue
        g, doc = g[hit], grid.doc[at[hit]]
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(doc)).tolist()):
            d, own = int(doc[a]), np.unique(g[a:b])
            lo = np.searchsorted(keys, own)
            n = np.searchsorted(keys, own, "right") - lo
            e = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            seeded = np.bincount(items[e], times[e], len(index.ids))
            for it in np.flatnonzero((seeded > 0) & (seeded * k >= coverage * index.size)).tolist():
                size = int(index.size[it])
                cover = np.zeros(size + 1, np.int64)
                begin = np.flatnonzero(np.isin(index.seeds[it], own))
                cover[begin] += 1
                cover[begin + k] -= 1
                if (np.cumsum(cover) > 0).sum() < coverage * size:
                    continue
                found = tiles(index.words[it], grid.hash[grid.first[d] : grid.first[d + 1]], k)
                matched = sum(t[2] for t in found)
                if matched >= coverage * size:
                    out.append((d, it, matched, len(found), size))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, words: int) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, size = [], [], 0
    for r in items.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).orderBy(id_col).toLocalIterator():
        b = r["t"].encode()
        n = int(wg.WordGrid(np.frombuffer(b, np.uint8), np.array([0, len(b)]), separators=wg.PUNCT).counts[0])
        if ids and size + n > words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[id_col])
        texts.append(b)
        size += n
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, items: DataFrame, *, coverage: float = COVERAGE, min_match: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds at least ``coverage``, in any order.

    Texts are compared as words of letters and digits, A-Z lower-cased.  Returns
    ``doc_id, item_id, matched_words, n_tiles, item_words, coverage``, one row for
    each such pair and input row.

    * Null or empty text, and items without words: in no pair.
    * An item of fewer than ``min_match`` words counts if the document holds all of it in one piece.
    * Repeated documents give repeated rows; other columns aren't read, so none can clash.
    * Empty documents or benchmark: empty result.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("matched_words", T.LongType()), T.StructField("n_tiles", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("coverage", T.DoubleType())])
    picked = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    parts = []
    for ids, texts in _blocks(items, "item_id", "text", block_words):
        index = spark.sparkContext.broadcast(Index(ids, texts, min_match))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            for batch in batches:
                for a, _, data, off in wg.chunks(batch, "text"):
                    found = scan(index.value, data, off, coverage)
                    if found:
                        docs_ = batch.column("doc_id").take(pa.array([a + f[0] for f in found]))
                        cols = [docs_, pa.array([index.value.ids[f[1]] for f in found], arrow.field(1).type)]
                        cols += [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3, 4)]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([f[2] / f[4] for f in found], pa.float64())], schema=arrow)

        parts.append(picked.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in no contaminated pair, in one pass for each block of items and no shuffle."""
    spark = docs.sparkSession
    C.small_batches(spark)
    coverage = options.get("coverage", COVERAGE)
    out, cols = docs, docs.columns
    for ids, texts in _blocks(items, "item_id", "text", options.get("block_words", BLOCK_WORDS)):
        index = spark.sparkContext.broadcast(Index(ids, texts, options.get("min_match", MIN_MATCH)))

        def make(data: np.ndarray, off: np.ndarray, index=index) -> dict[str, object]:
            clean = np.ones(len(off) - 1, bool)
            clean[[f[0] for f in scan(index.value, data, off, coverage)]] = False
            return {"__clean": clean}

        out = C.arrow_append(out, make, [T.StructField("__clean", T.BooleanType())]).where("__clean").select(*cols)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without benchmark passages.

    Null or empty texts stay, repeated rows stay or go together, all columns are
    carried along (one named ``__clean`` would give way).  Empty input or benchmark: the input.
    """
    return drop_contaminated(docs, C.load(spark, sf_dir, "benchmark"))
