"""Byte-level BPE, encoded and decoded as a tokenizer file says, in Arrow batches.

A text is cut at the file's added tokens and then into words by character class,
all words of a chunk at once.  Each distinct word is encoded once and kept by the
worker.  A short word is a contiguous array of part boundaries and of the ranks
of adjacent parts: the least rank is looked for again and again, its boundary
deleted and the two ranks beside it made anew; all new short words of a chunk
are rows of one such array.  In a long word the least rank comes from a heap.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import common as C
from haruspex.llm import wordgrid as wg

#: Words of up to so many bytes are rows of a rank array, longer ones use a heap; both give the same parts.
SHORT = 32
#: Distinct words that a worker keeps about, before it begins anew.
KEPT_WORDS = 1 << 18
#: A text is encoded in pieces of about this size, cut where a blank begins.
PIECE = 1 << 18

OTHER, LETTER, NUMBER, BLANK = range(4)
NONE = np.int32(np.iinfo(np.int32).max)

# What Unicode 16 added to the letters and to the numbers, for Pythons whose tables are older.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Unicode's property White_Space.
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[list(BLANKS)] = BLANK
    return out


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: a printable one for itself, those from U+0100 on for the others."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids of single bytes, merges by pair, the bytes of every id, and added tokens; some megabytes, whatever the corpus."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout"))
        added = spec.get("added_tokens") or []
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("only byte-level BPE without a normalizer, prefix spaces or stripping added tokens is known")
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        of = lambda t: vocab[bytes(alphabet[c] for c in t)]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
        key = np.array([of(a) * self.size + of(b) for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([of(a + b) for a, b in pairs], np.int32)[order]
        self.byte_id = np.array([vocab.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_id < 0).any():
            raise ValueError("a byte has no token of its own")
        every = np.arange(256)
        self.byte_rank = np.full((257, 257), NONE, np.int32)  # of adjacent bytes; the last stands for none
        self.byte_rank[:256, :256] = self.look_up(np.repeat(self.byte_id[every], 256), np.tile(self.byte_id[every], 256))[0].reshape(256, 256)
        self.added = {t["content"].encode(): t["id"] for t in added if t["content"]}
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        tokens = [by_id.get(i, b"") for i in range(self.size)]
        self.token_end = np.cumsum([len(t) for t in tokens])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # the longest of the added tokens that begin at a place counts
        self.added_re = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id made) of pairs of ids; the rank is NONE where they don't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = (self.key[at] == key) & (a >= 0) & (b >= 0) if len(self.key) else np.zeros(len(key), bool)
        return np.where(found, self.rank[at], NONE), np.where(found, self.made[at], -1)


def merge_short(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and part boundaries of each word, a row each with -1 behind the last; all words are rows of one rank array."""
    size = np.array([len(w) for w in words], np.int64)
    width = int(size.max(initial=1))
    places = np.arange(width + 1, dtype=np.int16)
    raw = np.full((len(words), width + 1), 256, np.int16)
    raw[places < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    ids, rank = np.append(vocab.byte_id, np.int32(-1))[raw], vocab.byte_rank[raw[:, :-1], raw[:, 1:]]
    bound = np.where(places <= size[:, None], places, np.int16(-1))
    out_ids, out_bound = ids.copy(), bound.copy()
    row = np.arange(len(words))
    while len(row):
        p = rank.argmin(1)
        going = rank[np.arange(len(row)), p] != NONE
        if not going.all():
            ended = row[~going]
            out_ids[ended], out_bound[ended] = -1, -1
            out_ids[ended, : ids.shape[1]], out_bound[ended, : ids.shape[1]] = ids[~going], bound[~going]
            row, ids, bound, rank, p = row[going], ids[going], bound[going], rank[going], p[going]
        if not len(row):
            break
        here, behind = np.arange(len(row)), places[: ids.shape[1] - 1] > p[:, None]
        made = vocab.look_up(ids[here, p], ids[here, p + 1])[1]
        # the boundary between p and p + 1 goes: what lies behind moves one place
        ids, bound = np.where(behind, ids[:, 1:], ids[:, :-1]), np.where(behind, bound[:, 1:], bound[:, :-1])
        ids[here, p] = made
        if ids.shape[1] == 1:
            out_ids[row], out_bound[row] = -1, -1
            out_ids[row, 0], out_bound[row, 0] = ids[:, 0], 0
            out_bound[row, 1] = size[row]
            break
        # the ranks left and right of the part made
        rank = np.where(places[: rank.shape[1] - 1] >= p[:, None], rank[:, 1:], rank[:, :-1])
        right = p < rank.shape[1]
        rank[here[right], p[right]] = vocab.look_up(made[right], ids[here[right], p[right] + 1])[0]
        left = p > 0
        rank[here[left], p[left] - 1] = vocab.look_up(ids[here[left], p[left] - 1], made[left])[0]
    return out_ids, out_bound


def merge_long(vocab: Vocabulary, word: bytes) -> np.ndarray:
    """The ids of a word of any length: the least rank from a heap, parts in a linked list."""
    n = len(word)
    ids = vocab.byte_id[np.frombuffer(word, np.uint8)]
    if n < 2:
        return ids
    ranks, made = (x.tolist() for x in vocab.look_up(ids[:-1], ids[1:]))
    part, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, part[k], part[k + 1], m) for k, (r, m) in enumerate(zip(ranks, made)) if r != NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def push(a: int, b: int) -> None:
        if a >= 0 and b < n:
            pair = part[a], part[b]
            if pair not in known:
                r, m = vocab.look_up(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = int(r[0]), int(m[0])
            r, m = known[pair]
            if r != NONE:
                heapq.heappush(heap, (r, a, *pair, m))

    while heap:
        _, a, x, y, m = heapq.heappop(heap)
        b = after[a] if part[a] == x else n
        if b >= n or part[b] != y:
            continue  # one of the two has been merged meanwhile
        part[a], part[b], after[a] = m, -1, after[b]
        if after[b] < n:
            before[after[b]] = a
        push(before[a], a)
        push(a, after[a])
    return np.array([p for p in part if p >= 0], np.int32)


def word_starts(code: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where words begin, as marks over code points; nothing is joined over an ``edge``.

    A word is a contraction (``'s 't 'm 'd 're 've 'll``); or letters, numbers or other
    characters, with a space before them; or blanks, of which the last goes its own way
    where no blank follows.
    """
    n = len(code)
    kind = classes()[code]
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | edge[1:]
    out = begin.copy()
    k = np.flatnonzero(begin & (kind != BLANK) & ~edge)
    k = k[kind[k - 1] == BLANK]
    out[k - 1] = True
    out[k[code[k - 1] == 0x20]] = False
    q = np.flatnonzero(out[:-1] & (code[:-1] == 0x27) & (kind[1:] == LETTER) & ~edge[1:]) if n else np.zeros(0, np.int64)
    if len(q):
        one = code[q + 1]
        two = np.where((q + 2 < n) & ~edge[np.minimum(q + 2, n - 1)], code[np.minimum(q + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[q[short | long_] + 1] = False
        stop = np.concatenate([q[short] + 2, q[long_] + 3])
        out[stop[stop < n]] = True
    return out


class Encoder:
    """A vocabulary and the words that have been encoded with it."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.end = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def _add(self, words: list[bytes], flat: np.ndarray, count: np.ndarray) -> None:
        used = int(self.end[-1])
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(used + 2 * len(flat), np.int32)])
        self.flat[used : used + len(flat)] = flat
        n = len(self.end) - 1
        self.end = np.concatenate([self.end, used + np.cumsum(count)])
        self.at.update(zip(words, range(n, n + len(words))))

    def words(self, words: list[bytes]) -> np.ndarray:
        """Where each of some distinct words is kept: word k has ``flat[end[k]:end[k + 1]]``."""
        if len(self.end) > KEPT_WORDS or self.end[-1] > 8 * KEPT_WORDS:
            self.forget()
        new = [w for w in words if w not in self.at]
        if short := [w for w in new if len(w) <= SHORT]:
            ids, _ = merge_short(self.vocab, short)
            self._add(short, ids[ids >= 0], (ids >= 0).sum(1))
        if long_ := [w for w in new if len(w) > SHORT]:
            made = [merge_long(self.vocab, w) for w in long_]
            self._add(long_, np.concatenate(made), np.array([len(x) for x in made]))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def piece(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each text) of some texts of valid UTF-8."""
        n_docs = len(off) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        raw = data.tobytes()
        spans: list[tuple[int, int]] = []
        if self.vocab.added_re is not None and self.vocab.added_re.search(raw):
            spans = [m.span() for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in self.vocab.added_re.finditer(raw, a, b)]
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each code point
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.zeros(len(code) + 1, bool)
        edge[np.searchsorted(lead, off[:-1])] = True
        sides = np.searchsorted(lead, np.array(spans, np.int64).reshape(-1, 2))
        edge[sides.ravel()] = True
        edge = edge[:-1]
        begin = word_starts(code, edge)
        for a, b in sides.tolist():
            begin[a + 1 : b] = False
        start = lead[begin]
        end = np.append(start[1:], len(data))
        added = np.isin(start, np.array([a for a, _ in spans], np.int64)) if spans else None
        first, inverse = wg.distinct(data, start, end)
        at = self.words([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])[inverse]
        n = self.end[at + 1] - self.end[at]
        ids = self.flat[np.repeat(self.end[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        total = np.concatenate([[0], np.cumsum(n)])
        if added is not None:  # one id each, whatever their bytes would give
            which, keep = np.flatnonzero(added), np.ones(len(ids), bool)
            keep[np.repeat(added, n)] = False
            keep[total[which]] = True
            ids[total[which]] = [self.vocab.added[raw[a:b]] for a, b in spans]
            ids = ids[keep]
            total = np.concatenate([[0], np.cumsum(np.where(added, 1, n))])
        return ids, np.diff(total[np.searchsorted(start, off)])

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each text); bytes that aren't UTF-8 count as U+FFFD, and a long text is taken in pieces."""
        try:
            data.tobytes().decode("utf-8")
            valid = not ((data[off[1:-1][off[1:-1] < len(data)]] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            valid = False
        if not valid:
            texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:])]
            data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
        if len(data) <= 2 * PIECE:
            return self.piece(data, off)
        ids, counts = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            made, n = [], 0
            for x, y in _pieces(data[a:b]):
                part, k = self.piece(data[a + x : a + y], np.array([0, y - x]))
                made.append(part)
                n += int(k[0])
            ids += made
            counts.append(n)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(counts, np.int64)


def _pieces(text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about PIECE bytes; each but the first begins with a blank behind a visible ASCII character, where a word always begins."""
    blank = (text[1:] == 0x20) | (text[1:] == 0x0A)
    may = np.flatnonzero(blank & (text[:-1] > 0x20) & (text[:-1] < 0x7F)) + 1
    a = 0
    while a < len(text):
        k = int(np.searchsorted(may, a + PIECE))
        b = int(may[k]) if k < len(may) and a + PIECE < len(text) else len(text)
        yield a, b
        a = b


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, vocab: Vocabulary) -> Encoder:
    """The worker's encoder of a vocabulary, which keeps its words from task to task."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocab)
    return _encoders[name]


def _shared(spark: SparkSession, vocab: Vocabulary) -> tuple[str, object]:
    held = vocab.key.nbytes + vocab.token_bytes.nbytes
    if held > 256 << 20:
        raise ValueError("the vocabulary is too large to send to every executor")
    name = hashlib.sha256(vocab.key.tobytes() + vocab.rank.tobytes() + vocab.made.tobytes() + vocab.token_bytes.tobytes() + repr(vocab.added).encode()).hexdigest()
    return name, spark.sparkContext.broadcast(vocab)


def encode(docs: DataFrame, vocab: Vocabulary, *, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, the token ids of every text as ``array<int>``; no special tokens are put around it.

    The strings of the vocabulary's added tokens inside a text become those tokens.

    * Null text counts as empty: no ids.  Whole texts are encoded, however long.
    * Repeated rows are encoded alike; an input column named like ``ids`` gives way.
    * Empty input: empty result.  Columns not named in ``keep`` aren't read.
    """
    name, sent = _shared(docs.sparkSession, vocab)

    def make(data: np.ndarray, off: np.ndarray) -> dict[str, object]:
        values, counts = _encoder(name, sent.value).texts(data, off)
        return {ids: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values, pa.int32()))}

    return C.arrow_append(docs, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))], text, keep=keep)


def _lists(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray | None]:
    col = batch.column(column)
    values, off = col.values, col.offsets.to_numpy()
    if values.null_count:
        values = values.fill_null(-1)
    flat = values.to_numpy(zero_copy_only=False)
    for ok, a, b in zip(col.is_valid().to_pylist(), off[:-1].tolist(), off[1:].tolist()):
        yield flat[a:b] if ok else None


def decode(df: DataFrame, vocab: Vocabulary, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``, what the ids of each row stand for, added tokens included.

    Bytes that aren't UTF-8 become U+FFFD.  Null and unknown ids stand for nothing;
    null arrays give null, empty ones the empty text.  A column named like ``text`` gives way.
    """
    _, sent = _shared(df.sparkSession, vocab)
    C.small_batches(df.sparkSession)
    cols = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in cols] + [T.StructField(text, T.StringType())])

    def one(v: Vocabulary, x: np.ndarray) -> str:
        x = x[(x >= 0) & (x < v.size)]
        stop = v.token_end[x]
        n = stop - np.where(x > 0, v.token_end[x - 1], 0)
        at = np.arange(int(n.sum())) + np.repeat(stop - np.cumsum(n), n)
        return v.token_bytes[at].tobytes().decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if x is None else one(sent.value, x) for x in _lists(batch, ids)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in cols] + [made], names=[*cols, text])

    return df.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema)


def _digested(df: DataFrame) -> DataFrame:
    """``ids`` replaced by their number and the digest of them as little-endian unsigned 32-bit integers."""
    cols = [c for c in df.columns if c != "ids"]
    schema = T.StructType([df.schema[c] for c in cols] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest()) for x in _lists(batch, "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in cols] + [pa.array([n for n, _ in made], pa.int64()), pa.array([h for _, h in made], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def op11_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of what they decode to."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    vocab = Vocabulary.load(path)
    ids = encode(C.load(spark, sf_dir, "documents"), vocab, keep=["doc_id"])
    back = _digested(decode(ids, vocab))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
