"""Quality rules: exact counts, and a calibrated n-gram classifier against fixed thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import common as C
from haruspex.llm import linear
from haruspex.llm import wordgrid as wg

#: A document whose probability of being good is lower is rejected.
KEEP_FROM = 0.15
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def counts(data: np.ndarray, off: np.ndarray) -> tuple[wg.WordGrid, dict[str, np.ndarray]]:
    """The base counts of each document of a chunk."""
    grid = wg.WordGrid(data, off)
    n = len(off) - 1
    made = {
        "n_words": grid.counts.astype(np.int64),
        "word_chars": wg.per_doc(grid.inside & ((data & 0xC0) != 0x80), off),
        "n_symbols": wg.per_doc(_SYMBOL[data], off),
    }
    # lines with a word, by document and fingerprint
    brk = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], brk + 1]))
    stops = np.sort(np.concatenate([off[1:], brk]))
    doc = np.searchsorted(off[1:], starts, "right") if n else np.zeros(0, np.int64)
    # an empty document and a break at a document's end share a start: pair spans by order
    ok = (stops > starts) & (doc < n)
    starts, stops, doc = starts[ok], stops[ok], doc[ok]
    has = np.zeros(len(data) + 1, np.int64)
    np.cumsum(grid.inside, out=has[1:])
    worded = has[stops] > has[starts]
    starts, stops, doc = starts[worded], stops[worded], doc[worded]
    h = wg.span_hashes(data, starts, stops)
    h = wg.within(h, doc)
    order = np.argsort(h)
    hd, dd = h[order], doc[order]
    dup = np.zeros(len(hd), bool)
    dup[1:] = hd[1:] == hd[:-1]
    made["n_dup_lines"] = np.bincount(dd[dup], minlength=n).astype(np.int64)
    # words in windows found twice or more in the document
    g, at = grid.grams(REPEAT_WINDOW)
    g = wg.within(g, grid.doc[at])
    order = np.argsort(g)
    gs = g[order]
    same = np.zeros(len(gs), bool)
    same[1:] = gs[1:] == gs[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(grid.start) + 1, np.int64)
    begin = at[order[twice]]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    made["n_repeat_words"] = np.bincount(grid.doc[covered], minlength=n).astype(np.int64)
    return grid, made


BASE = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
VERDICT = [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("quality_score", T.DoubleType())]


def train(docs: DataFrame, labels: DataFrame) -> linear.Model:
    """A model of ``labels.quality`` from a bounded, documented sample of labelled rows (``linear.MAX_ROWS``)."""
    marked = C.agreed(labels.where("quality IN (0, 1) AND doc_id IS NOT NULL"), "quality")
    chosen = linear.sample(marked, "quality")
    # at most MAX_ROWS ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # a repeated document is learned from once
    rows = rows.groupBy(*[c for c in rows.columns if c != "text"]).agg(F.min("text").alias("text"))
    model = linear.train(linear.features(rows, "quality"))
    C.release(docs.sparkSession)  # the rows that were learned from
    return model


def quality_rules(docs: DataFrame, model: linear.Model, *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``quality_score`` and ``kept``.

    ``base_failed``: fewer than 10 words, or more than 20 % of the words in
    5-word windows that the text has twice.  ``kept``: not ``base_failed``, and
    the calibrated probability is at least ``KEEP_FROM``.  The model scores Arrow
    batches, whole texts in pieces of bounded size.

    * Null or empty text: all counts 0, ``base_failed``.
    * Repeated rows are scored alike; a column of the input that is named like a new one gives way.
    * Empty input: empty result.  No labels: the model keeps what the base rules keep.
    """

    def make(data: np.ndarray, off: np.ndarray) -> dict[str, object]:
        grid, made = counts(data, off)
        failed = (made["n_words"] < MIN_WORDS) | (100 * made["n_repeat_words"] > MAX_REPEAT_PERCENT * made["n_words"])
        p = model.probability(linear.margins(grid, model.weights, model.bias))
        return made | {"base_failed": failed, "kept": ~failed & (p >= KEEP_FROM), "quality_score": p}

    return C.arrow_append(docs, make, BASE + VERDICT, text, keep=keep)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents")
    model = train(docs, C.load(spark, sf_dir, "labels"))
    return quality_rules(docs, model, keep=["doc_id"])


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep.

    Null, empty and short texts go, as they fail the base rules; repeated rows go
    or stay alike; null or repeated ids train nothing or once; all columns are
    carried along under their names.  Empty input: empty result.
    """
    model = train(docs, C.load(spark, sf_dir, "labels"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__body"))
    return quality_rules(row, model, text="__body", keep=["__row"]).where("kept").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
