"""Hashed word and character n-gram features, logistic regression and Platt calibration, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import common as C
from haruspex.llm import wordgrid as wg

#: Buckets of each of the four feature families: words, word pairs, character 3-grams, character 5-grams.
BITS = 14
FAMILIES = 4
#: A feature's number.
PLACE = np.min_scalar_type((FAMILIES << BITS) - 1)
#: Labelled rows that training reads at most.
MAX_ROWS = 800


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # FAMILIES << BITS
    bias: float
    slope: float  # of the Platt calibration
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def _families(grid: wg.WordGrid):
    """(bucket, document) of every feature occurrence, family by family."""
    mask = np.uint64((1 << BITS) - 1)
    yield (grid.hash & mask).astype(np.int32), grid.doc
    pair, at = grid.grams(2)
    yield (pair & mask).astype(np.int32), grid.doc[at]
    n = len(grid.data)
    doc_of = None
    for k in (3, 5):
        if n < k:
            yield np.zeros(0, np.int32), np.zeros(0, np.int64)
            continue
        if doc_of is None:
            doc_of = np.repeat(np.arange(len(grid.counts), dtype=np.int32), np.diff(grid.offsets))
        same = doc_of[: n - k + 1] == doc_of[k - 1 :]
        yield _char_buckets(grid.data, k)[same].astype(np.int32), doc_of[: n - k + 1][same]


def _span_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of the spans, each by itself: a document's doesn't depend on the others of its chunk."""
    out = np.zeros(len(first))
    on = np.flatnonzero(last > first)
    if len(on):
        edges = np.stack([first[on], last[on]], 1).ravel()
        out[on] = np.add.reduceat(np.append(values, 0).astype(np.float64), edges)[::2]
    return out


def margins(grid: wg.WordGrid, weights: np.ndarray, bias: float) -> np.ndarray:
    """bias plus, over the families, the mean weight of a document's features."""
    n = len(grid.counts)
    out = np.full(n, bias)
    w = weights.astype(np.float32).reshape(FAMILIES, 1 << BITS)
    mask = np.uint64((1 << BITS) - 1)
    first, last = grid.first[:-1], grid.first[1:]
    out += _span_sums(w[0][(grid.hash & mask).astype(np.int64)], first, last) / np.maximum(1, last - first)
    pair, at = grid.grams(2)
    f2 = np.searchsorted(at, grid.first)
    out += _span_sums(w[1][(pair & mask).astype(np.int64)], f2[:-1], f2[1:]) / np.maximum(1, np.diff(f2))
    size = len(grid.data)
    first, stop = grid.offsets[:-1], grid.offsets[1:]
    for k, fam in ((3, 2), (5, 3)):
        if size < k:
            continue
        last = np.maximum(first, stop - k + 1)
        first_ = np.minimum(first, size - k + 1)
        out += _span_sums(w[fam][_char_buckets(grid.data, k)], first_, np.minimum(last, size - k + 1)) / np.maximum(1, last - first)
    return out


def _char_buckets(data: np.ndarray, k: int) -> np.ndarray:
    n = len(data)
    acc = data[: n - k + 1].astype(np.uint32)
    for j in range(1, k):
        acc *= np.uint32(0x01000193)
        acc += data[j : n - k + 1 + j]
    acc *= np.uint32(0x2C1B3C6D)
    acc >>= np.uint32(32 - BITS)
    return acc


def sparse(grid: wg.WordGrid) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature ids, values) of each document; a family's values sum to 1."""
    n = len(grid.counts)
    rows: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    for k, (bucket, doc) in enumerate(_families(grid)):
        key, count = np.unique(doc.astype(np.int64) << BITS | bucket, return_counts=True)
        first = np.searchsorted(key >> BITS, np.arange(n + 1))
        for d in range(n):
            c = count[first[d] : first[d + 1]]
            if len(c):
                rows[d].append((((key[first[d] : first[d + 1]] & ((1 << BITS) - 1)) | k << BITS).astype(np.int32), (c / c.sum()).astype(np.float32)))
    empty = (np.zeros(0, np.int32), np.zeros(0, np.float32))
    return [(np.concatenate([i for i, _ in r]), np.concatenate([v for _, v in r])) if r else empty for r in rows]


def sample(labelled: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """At most MAX_ROWS labelled rows, half of each class, chosen by a hash of the id."""
    h = F.xxhash64(F.col(id_col), F.lit(99))
    counts = {r[0]: r[1] for r in labelled.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    half = MAX_ROWS // 2
    parts = [labelled.where(F.col(label) == y).orderBy(h, id_col).limit(min(n, half)) for y, n in sorted(counts.items())]
    if not parts:
        return labelled.limit(0)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def features(rows: DataFrame, label: str, text: str = "text", id_col: str = "doc_id") -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(id, label, feature ids, values) of the sampled rows, which are bounded by MAX_ROWS."""

    def make(data: np.ndarray, off: np.ndarray) -> dict[str, object]:
        made = sparse(wg.WordGrid(data, off))
        return {"ids": pa.array([i.tobytes() for i, _ in made], pa.binary()), "vals": pa.array([v.tobytes() for _, v in made], pa.binary())}

    df = C.arrow_append(rows, make, [T.StructField("ids", T.BinaryType()), T.StructField("vals", T.BinaryType())], text, keep=[id_col, label])
    got = df.collect()
    return [(r[id_col], int(r[label]), np.frombuffer(r["ids"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in sorted(got, key=lambda r: (r[id_col] is None, r[id_col] or 0, r[label], r["ids"]))]


#: Parts of the labelled rows; each is scored by a model of the others for the calibration.
FOLDS = 2


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]], steps: int = 150, l2: float = 1e-5) -> Model:
    """L2-regularised logistic regression of all rows; Platt scaling on margins that models of the other folds give.

    A row's fold is its place among its class in the order of mixed ids, so every
    fold has its share of a rare class.  Ids may be any whole numbers or null.
    """
    y = np.array([r[1] for r in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        p = 0.5 if len(rows) == 0 else (len(rows) * y.mean() + 1) / (len(rows) + 2)
        return Model(np.zeros(FAMILIES << BITS), 0.0, 1.0, float(np.log(p / (1 - p))))
    mixed = wg.mix(np.array([int(r[0] or 0) & 0xFFFFFFFFFFFFFFFF for r in rows], np.uint64))
    fold = np.zeros(len(rows), np.int64)
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        fold[own[np.argsort(mixed[own], kind="stable")]] = np.arange(len(own)) % FOLDS
    idx = np.concatenate([r[2].astype(PLACE) for r in rows])
    val = np.concatenate([r[3] for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
    n = len(rows)
    del rows  # the driver's memory holds the entries once
    # models in columns: one for each fold, of the others' rows, and one of all rows
    fit = np.concatenate([fold[:, None] != np.arange(FOLDS), np.ones((n, 1), bool)], axis=1)
    seen = np.array([len(set(y[fit[:, k]])) == 2 for k in range(FOLDS + 1)])
    z = np.stack([_fit(idx, val, row, y, fit[:, k], steps, l2) if seen[k] else np.zeros((FAMILIES << BITS) + 1) for k in range(FOLDS + 1)], 1)
    w, bias = z[:-1], z[-1]
    margin = np.zeros((FOLDS, n))
    begin = np.searchsorted(row, np.arange(n + 1))
    for a, b in _blocks(begin):
        on = slice(begin[a], begin[b])
        for k in range(FOLDS):
            margin[k, a:b] = np.bincount(row[on] - a, val[on] * w[idx[on], k], b - a) + bias[k]
    held = margin[fold, np.arange(n)]
    on = seen[fold]
    calibration = platt(held[on], y[on]) if len(set(y[on])) == 2 else (1.0, 0.0)
    return Model(w[:, FOLDS].copy(), float(bias[FOLDS]), *calibration)


#: Entries that one step of a sum holds; a row or feature with more is a step of its own.
STEP = 1 << 16


def _blocks(begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole segments of about STEP entries; ``begin`` tells where each segment begins, and the end."""
    a, n = 0, len(begin) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + STEP, "right")) - 1)
        yield a, b
        a = b


def _sums(value: np.ndarray, at: np.ndarray, factor: np.ndarray, begin: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """Each segment's sum of ``value * factor[at]``; no segment is empty or cut, so the sums don't depend on the blocks."""
    out = np.zeros(len(begin) - 1)
    for a, b in blocks:
        on = slice(begin[a], begin[b])
        out[a:b] = np.add.reduceat(value[on] * factor[at[on]], begin[a:b] - begin[a])
    return out


def _fit(idx: np.ndarray, val: np.ndarray, row: np.ndarray, y: np.ndarray, fit: np.ndarray, steps: int, l2: float) -> np.ndarray:
    """Weights and, last, the bias; full-batch Adam, classes of equal weight."""
    on = fit[row]
    fi, fv, fr = idx[on], val[on], row[on]
    count = np.bincount(fi, minlength=FAMILIES << BITS)
    known = np.flatnonzero(count)
    place = np.zeros(FAMILIES << BITS, PLACE)
    place[known] = np.arange(len(known))
    fi = place[fi]
    # sums over rows as the entries lie, over features in an order of their own
    rows, first_r = np.unique(fr, return_index=True)
    first_r = np.append(first_r, len(fr))
    order = np.argsort(fi, kind="stable")
    cv, cr = fv[order], fr[order]
    first_f = np.append(0, np.cumsum(count[known]))
    del on, fr, order
    by_row, by_feature = list(_blocks(first_r)), list(_blocks(first_f))
    share = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * fit
    size = len(known)
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.full(len(y), b)
        z[rows] += _sums(fv, fi, w, first_r, by_row)
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        g, gb = _sums(cv, cr, err, first_f, by_feature) + l2 * w, err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        lr = 0.5 * min(1.0, 2.0 * (1 - t / (steps + 1)) + 0.02)
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= lr * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    out = np.zeros((FAMILIES << BITS) + 1)
    out[known], out[-1] = w, b
    return out


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (z, y), with Platt's smoothed targets; the slope isn't negative."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / max(1, n1), 0.5 / max(1, n0))
    scale = max(1e-12, float(np.std(z)))
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        r, s = (p - t) * weight, np.maximum(p * (1 - p), 1e-9) * weight
        g = np.array([(r * x).sum() + 1e-4 * a, r.sum()])
        h = np.array([[(s * x * x).sum() + 1e-4, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        a, b = max(1e-3, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a / scale), float(b)
