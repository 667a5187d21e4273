"""Compression classifier: zstandard dictionaries of good and bad text, a calibrated size difference."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import common as C
from haruspex.llm.linear import platt
from haruspex.llm.wordgrid import mix

#: Bytes of a dictionary, the compressor's level, and the score from which a document is predicted good.
DICT_BYTES, LEVEL, THRESHOLD = 112 << 10, 3, 0.7
#: Bound of the labelled sample: rows of each class, and the longest text among them.
CLASS_ROWS, MAX_TEXT = 2000, 32 << 10


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    slope: float
    offset: float

    def scorer(self):
        """A function of UTF-8 text: the normalised difference of its two compressed sizes."""
        sizes = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) if d else zstandard.ZstdCompressor(level=LEVEL) for d in (self.bad, self.good)]
        return lambda b: (len(sizes[0].compress(b)) - len(sizes[1].compress(b))) / len(b) if b else 0.0

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.offset, -40, 40)))


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:DICT_BYTES]


def train(rows: list[tuple[int, int, bytes]], odds: float) -> Model:
    """Dictionaries from 2/3 of the (id, label, text) rows, calibration on the others; ``odds`` are those of label 1."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    third = np.array([int(mix(np.array([r[0] & (1 << 63) - 1], np.uint64))[0] % np.uint64(3)) == 2 for r in rows], bool)
    label = np.array([r[1] for r in rows])
    if len(set(label[third])) < 2 or len(set(label[~third])) < 2:
        third = np.arange(len(rows)) % 3 == 2
    parts = [[r[2] for r, t in zip(rows, third) if r[1] == y and not t] for y in (0, 1)]
    model = Model(dictionary(parts[0]), dictionary(parts[1]), 1.0, 0.0)
    z, y = [(model.scorer()(r[2]), r[1]) for r, t in zip(rows, third) if t], label[third]
    if len(set(y)) < 2:
        return Model(model.bad, model.good, 1.0, float(np.log(odds)))
    slope, offset = platt(np.array([a for a, _ in z]), y)
    # the calibration weighs both classes alike; the labelled rows' odds shift it
    return Model(model.bad, model.good, slope, offset + float(np.log(odds)))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, int, bytes]], float]:
    """Bounded sample of the rows that may be learned from, and the odds of label 1 among all of them."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    marked = C.agreed(marked, "quality")
    counts = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    odds = (counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)
    h = F.xxhash64("doc_id", F.lit(31))
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("quality") == y).orderBy(h, "doc_id").limit(CLASS_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * CLASS_ROWS ids
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").where(F.length("text").between(1, MAX_TEXT))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return [(r["doc_id"], r["quality"], bytes(r["text"])) for r in rows.collect()], odds


def held_out(doc_id) -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def compression_score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``difference`` (normalised), ``score`` and ``predicted``.

    The whole text is compressed twice, with the dictionary of bad text and that
    of good text; the difference of the sizes over the text's own is mapped to a
    probability by the calibration curve.

    * Null or empty text: difference 0.
    * Repeated rows are scored alike; input columns named like a new one give way.
    * Empty input: empty result.
    """

    def make(data: np.ndarray, off: np.ndarray) -> dict[str, object]:
        f = _scorer(model)
        raw = data.tobytes()
        d = np.array([f(raw[a:b]) for a, b in zip(off[:-1], off[1:])], float)
        p = model.probability(d)
        return {"difference": d, "score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}

    fields = [T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return C.arrow_append(docs, make, fields, text, keep=keep)


_cache: dict[tuple[bytes, bytes], object] = {}


def _scorer(model: Model):
    """The model's compressors, made once in each worker: tasks get equal copies of a model, so its dictionaries are the key."""
    key = (model.bad, model.good)
    if key not in _cache:
        _cache.clear()
        _cache[key] = model.scorer()
    return _cache[key]


def op3_compression_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents")
    model = train(*labelled_sample(docs, C.load(spark, sf_dir, "labels")))
    scored = compression_score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "difference")
