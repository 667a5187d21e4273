"""Substring deduplication by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import common as C
from haruspex.llm import packed as P
from haruspex.llm import wordgrid as wg

#: Words of a window, and of a block.  Any window holds a whole block of its document: 2 * BLOCK - 1 <= WINDOW.
WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Bytes of text that a task packs at once.
TEXT_FLUSH = 8 << 20

_TEXT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("lens", T.BinaryType()), T.StructField("text", T.BinaryType())])
_TEXT_ARROW = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("lens", pa.binary()), ("text", pa.binary())])


def _id_bucket(ids: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return buckets[(wg.mix(ids.astype(np.uint64) + np.uint64(0x51ED270B)) % np.uint64(len(buckets))).astype(np.int64)]


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(int(P.NULL_ID)).to_numpy(zero_copy_only=False)


def _anchors(grams: np.ndarray, position: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit value of block fingerprints; the lowest bit tells reference blocks."""
    bucket = buckets[((grams >> np.uint64(32)) % np.uint64(len(buckets))).astype(np.int64)]
    value = (grams.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | (position % BLOCK == 0).astype(np.uint32)
    return bucket, value


def pack_texts(docs: DataFrame, buckets: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Compressed texts in buckets of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: dict[int, tuple[list, list, list]] = {}
            for ids, data, off in held:
                for b, i, x, y in zip(_id_bucket(ids, buckets).tolist(), ids.tolist(), off[:-1].tolist(), off[1:].tolist()):
                    r = rows.setdefault(b, ([], [], []))
                    r[0].append(i)
                    r[1].append(y - x)
                    r[2].append(data[x:y])
            for b, (ids_, lens, texts) in rows.items():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.array(ids_, np.int64).tobytes()]), pa.array([np.array(lens, np.int64).tobytes()]), pa.array([z.compress(np.concatenate(texts).tobytes())])], schema=_TEXT_ARROW)

        for batch in batches:
            ids = _ids(batch, "id")
            for a, b, data, off in wg.chunks(batch, "text"):
                held.append((ids[a:b], np.array(data), off))
                size += len(data)
                if size >= TEXT_FLUSH:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, _TEXT)


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of pieces of packed rows."""
    z = zstandard.ZstdDecompressor()
    for ids, lens, text in zip(*(table.column(c).to_pylist() for c in ("ids", "lens", "text"))):
        raw = z.decompress(text) if text else b""
        off = np.zeros(len(ids) // 8 + 1, np.int64)
        np.cumsum(np.frombuffer(lens, np.int64), out=off[1:])
        yield np.frombuffer(ids, np.int64), np.frombuffer(raw, np.uint8), off


class _Extremes:
    """Collects (key, id, whether it counts for the least) and sends, of each key, the rows of the least and of the largest id.

    A flush sends two rows for a key at most, so a key's bucket gets a number of
    rows that depends on the tasks, not on the documents that have it.
    """

    def __init__(self, pack) -> None:
        self.pack = pack
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, key: np.ndarray, ids: np.ndarray, ref: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((key, ids, ref))
        self.n += len(key)
        if self.n >= P.FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            key, ids, ref = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.n = [], 0
            key, least, most = _extremes(key, ids, ref)
            some, other = least != P.NULL_ID, most != least
            yield self.pack(np.concatenate([key[some], key[other]]), np.concatenate([least[some], most[other]]), np.concatenate([np.ones(some.sum(), bool), np.zeros(other.sum(), bool)]))
            # a null id that counts is the largest, too
            null = ~some & (most == P.NULL_ID)
            if null.any():
                yield self.pack(key[null], most[null], np.zeros(null.sum(), bool))


def _extremes(key: np.ndarray, ids: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least id of their rows that count (or NULL_ID), and the largest of all."""
    order = np.argsort(key, kind="stable")
    key, ids, ref = key[order], ids[order], ref[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key, ids, ids
    return key[first], np.minimum.reduceat(np.where(ref, ids, P.NULL_ID), first), np.maximum.reduceat(ids, first)


def _answers(key: np.ndarray, ids: np.ndarray, ref: np.ndarray, buckets: np.ndarray, both: bool) -> Iterator[pa.RecordBatch]:
    """To each bucket of texts that asked for a key that a smaller and a larger id have: the least id, and if ``both`` also the largest (by the key's last bit)."""
    one, least, most = _extremes(key, ids, ref)
    if not len(one):
        return
    at = np.searchsorted(one, key)
    on = least[at] < most[at]
    key, at, to = key[on], at[on], _id_bucket(ids[on], buckets)
    order = np.lexsort((key, to))
    key, at, to = key[order], at[order], to[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (to[1:] != to[:-1])
    key, at, to = key[new], at[new], to[new]
    if len(key):
        yield P.pack(to, least[at], key)
        if both:
            yield P.pack(to, most[at], key | np.uint64(1))


class _Lookup:
    """Ids by key."""

    def __init__(self, rows: pa.Table):
        _, ids, key = P.unpack(rows.to_batches(), np.uint64)
        order = np.argsort(key)
        self.key, self.ids = key[order], ids[order]

    def of(self, key: np.ndarray, missing: int) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), missing, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.ids[at], missing)


def _blocks(grid: wg.WordGrid, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and whether it is a reference block, of every rolling block of the documents that have a window."""
    g, at = grid.grams(BLOCK)
    doc = grid.doc[at]
    on = grid.counts[doc] >= WINDOW
    g, at, doc = g[on], at[on], doc[on]
    position = at - grid.first[doc]
    bucket, value = _anchors(g, position, buckets)
    return bucket.astype(np.uint64) << np.uint64(32) | (value & np.uint32(0xFFFFFFFE)).astype(np.uint64), at, position % BLOCK == 0


def _probe(texts: DataFrame, buckets: np.ndarray) -> DataFrame:
    """Fingerprints of every rolling block; those at multiples of BLOCK are the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Extremes(lambda key, ids, ref: P.pack((key >> np.uint64(32)).astype(np.int32), ids, key.astype(np.uint32) | ref.astype(np.uint32)))
        for batch in batches:
            for ids, data, off in _texts(batch):
                for a, b in _runs(off):
                    grid = wg.WordGrid(data[off[a] : off[b]], off[a : b + 1] - off[a])
                    key, at, ref = _blocks(grid, buckets)
                    yield from out.add(key, ids[a:b][grid.doc[at]], ref)
        yield from out.flush()

    return texts.mapInArrow(run, P.SCHEMA)


def _hits(probes: DataFrame, buckets: np.ndarray) -> DataFrame:
    """To each bucket of texts: its blocks that a reference block of a smaller id and a block of a larger one agree with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, value = P.unpack(batches, np.uint32)
        key = bucket.astype(np.uint64) << np.uint64(32) | (value & np.uint32(0xFFFFFFFE)).astype(np.uint64)
        yield from _answers(key, ids, (value & np.uint32(1)).astype(bool), buckets, True)

    return probes.mapInArrow(run, P.SCHEMA)


def _windows(texts: DataFrame, hits: DataFrame, buckets: np.ndarray) -> DataFrame:
    """Fingerprints of the windows around the hits."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        bucket_of = lambda w: buckets[(w % np.uint64(len(buckets))).astype(np.int64)]
        out = _Extremes(lambda w, ids, ref: P.pack(bucket_of(w), ids, w))
        made = []
        if right.num_rows:
            lookup = _Lookup(right)
            for ids, data, off in _texts(left):
                for a, b in _runs(off):
                    grid = wg.WordGrid(data[off[a] : off[b]], off[a : b + 1] - off[a])
                    key, at, ref = _blocks(grid, buckets)
                    own = ids[a:b][grid.doc[at]]
                    found = (lookup.of(key, int(P.NULL_ID)) < own) | (ref & (lookup.of(key | np.uint64(1), -int(P.NULL_ID) - 1) > own))
                    if not found.any():
                        continue
                    hit = np.zeros(len(grid.start) + 1, np.int64)
                    hit[at] = found
                    seen = np.concatenate([[0], np.cumsum(hit)])
                    w, start = grid.grams(WINDOW)
                    # a block of the window is a hit
                    on = seen[start + WINDOW - BLOCK + 1] > seen[start]
                    w, start = w[on], start[on]
                    made += out.add(w, ids[a:b][grid.doc[start]], np.ones(len(w), bool))
        made += out.flush()
        return pa.Table.from_batches(made, schema=P.ARROW)

    return texts.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(run, P.SCHEMA)


def _later(windows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """To each bucket of texts: its windows that several documents have, with the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids, w = P.unpack(batches, np.uint64)
        yield from _answers(w, ids, np.ones(len(w), bool), buckets, False)

    return windows.mapInArrow(run, P.SCHEMA)


def _runs(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents a to b of a chunk's bytes at a time; a longer one by itself."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + wg.CHUNK_BYTES, "right")) - 1)
        yield a, b
        a = b


def _strip(texts: DataFrame, later: DataFrame, id_field: T.StructField, kept_text: bool) -> DataFrame:
    fields = [id_field, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept_text", T.StringType())] * kept_text)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        lookup = _Lookup(right)
        rows: list[tuple] = []
        for ids, data, off in _texts(left):
            raw = data.tobytes()
            for a, b in _runs(off):
                stay, first = None, None
                if len(lookup.key):
                    grid = wg.WordGrid(data[off[a] : off[b]], off[a : b + 1] - off[a])
                    w, start = grid.grams(WINDOW)
                    begin = start[lookup.of(w, int(P.NULL_ID)) < ids[a:b][grid.doc[start]]]
                    cover = np.zeros(len(grid.start) + 1, np.int64)
                    cover[begin] += 1
                    cover[begin + WINDOW] -= 1
                    stay, first = np.cumsum(cover[:-1]) == 0, grid.first
                for k in range(a, b):
                    words, gone = raw[off[k] : off[k + 1]].split(), 0
                    n = len(words)
                    if stay is not None:
                        own = stay[first[k - a] : first[k - a + 1]]
                        gone = n - int(own.sum())
                        if gone:
                            words = list(compress(words, own.tolist()))
                    kept = b" ".join(words)
                    row = (None if ids[k] == P.NULL_ID else int(ids[k]), n, gone, hashlib.sha256(kept).hexdigest())
                    rows.append((*row, kept.decode("utf-8", "replace")) if kept_text else row)
        arrow = to_arrow_schema(schema)
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return texts.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """Each document without the windows of 13 words that a document of a smaller id has too.

    1. Non-overlapping blocks of 7 words, from a document's start on, are its
       reference blocks.  Every rolling block of every document probes them: both
       go, as 32-bit values in buckets of further bits, to the bucket's task.  Texts
       lie in buckets too, and a task sends only the least and the largest id that
       has a block; the answer, least reference and largest probe, goes back to the
       bucket of texts, which finds the hits.  Any common window of 13 words holds a
       whole reference block of the document with the smaller id.
    2. Around a hit, both documents' windows of 13 words are candidates; their
       64-bit fingerprints are compared, and adjoining windows that agree make up
       the maximal exact repeat.
    3. A window is removed if the smallest id that has it is smaller than the
       document's own; the words that removed windows cover go.

    What is shuffled grows with the words, not with pairs of copies, and what a
    block's or window's task gets grows with the tasks that send, not with the
    documents that share it.  Two different windows would be taken for equal with
    probability 2**-64.

    Returns ``id, n_words, n_removed, kept_sha256`` (and ``kept_text``).

    * Ids are whole numbers.  Null text: no words.  Null id: larger than all others; null ids aren't smaller than each other.
    * Rows with the same id are each judged, but not against each other.
    * Fewer than 13 words: nothing is removed.  Other columns aren't read.
    * Empty input: empty result.
    """
    C.small_batches(docs.sparkSession)
    n = P.n_partitions(docs.sparkSession, P.text_bytes(docs, text_col))
    buckets = P.labels(docs, n)
    texts = P.dealt(pack_texts(docs, buckets, id_col, text_col), n)  # read three times; the exchange is reused
    hits = P.dealt(_hits(P.dealt(_probe(texts, buckets), n), buckets), n)
    later = P.dealt(_later(P.dealt(_windows(texts, hits, buckets), n), buckets), n)
    return _strip(texts, later, T.StructField(id_col, T.LongType()), kept_text)


#: DuckDB SQL of ``op6_remove_repeats``, by all windows.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM starts),
least AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN least USING (k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op6_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.load(spark, sf_dir, "documents"))
