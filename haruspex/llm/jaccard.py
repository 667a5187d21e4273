"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from haruspex.llm import common as C
from haruspex.llm import graph
from haruspex.llm import packed as P
from haruspex.llm import wordgrid as wg

#: Words of a shingle and per cent of similarity: what op 8's contract fixes, and what the pipeline's stage owes.
SHINGLE, PERCENT = 3, 90
STAGE_SHINGLE, STAGE_PERCENT = 5, 80
#: Least similarity for which combinations of three tokens are sure to exist in every prefix.
LEAST_PERCENT = 75
#: Sets that share a signature of level k: up to so many, all their pairs are candidates; beyond, the
#: signature is frequent and the next level extends its sets' prefixes.
LISTS = (8, 16, 32)
#: Bits of the filter that tells frequent signatures, whatever their number; a false positive only indexes more.
FILTER_BITS = 24
#: Sets of a block; one task compares two blocks at most.
BLOCK = 1024
#: Signatures that a task holds before it packs them, and sets that it remembers so as not to index copies again.
FLUSH, SEEN = 1 << 20, 1 << 20
#: Rows from which the rows of one set are spread over SALTS tasks where they are joined.
MANY, SALTS = 512, 64

_U = np.uint64


def shingles(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints, ascending in each document, and where each document's start (and one more)."""
    grid = wg.WordGrid(data, off, lower=True)
    g, at = grid.grams(shingle)
    doc = grid.doc[at]
    for k in range(1, shingle):  # fewer words: all of them
        h, where = grid.grams(k)
        on = grid.counts[grid.doc[where]] == k
        g, doc = np.concatenate([g, h[on]]), np.concatenate([doc, grid.doc[where[on]]])
    order = np.argsort(g)
    order = order[np.argsort(doc[order], kind="stable")]
    g, doc = g[order], doc[order]
    one = np.ones(len(g), bool)
    one[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[one], doc[one]
    return g, np.searchsorted(doc, np.arange(len(off)))


def differing(n: np.ndarray | int, percent: int = PERCENT):
    """Tokens at most of a set of ``n`` that a linked one lacks."""
    return n * (100 - percent) // 100


def pairable(n: np.ndarray | int, percent: int = PERCENT):
    """Whether a set of ``n`` tokens can be linked with one that isn't equal; if so, one with a token more is the nearest."""
    return n * (100 - percent) >= percent


def _single(tokens: np.ndarray) -> np.ndarray:
    return wg.mix(tokens + _U(1))


def _combined(common: np.ndarray, need: int, k: int, size: int) -> np.ndarray:
    """k-combinations inside the groups of a prefix of ``common`` that ``need`` - 1 missing tokens can't break.

    Tokens fall into groups by hash, about eight of each a set's tokens; ``size``
    (a bit length) fixes how many groups there are.  A group of c tokens keeps a
    whole combination until c - k + 1 of them are missing.
    """
    groups = _U(max(1, (1 << size) // 16))
    g = (wg.mix(common ^ _U(0x5851F42D4C957F2D)) % groups).astype(np.int64)
    order = np.argsort(g, kind="stable")
    first = np.flatnonzero(np.diff(g[order], prepend=-1))
    nth = np.empty(len(g), np.int64)
    nth[order] = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    end = int(np.searchsorted(np.cumsum(nth >= k - 1), need)) + 1
    order = order[order < end]
    g, t = g[order], common[order]
    out = []
    for far in range(k - 1, len(t)):
        same = g[far:] == g[:-far]
        if not same.any():
            break
        left, right = t[:-far][same], t[far:][same]
        if k == 2:
            out.append(wg.mix((left * _U(0xFF51AFD7ED558CCD) + right) ^ _U(2)))
        else:
            for near in range(1, far):
                middle = t[near : len(t) - far + near][same]
                out.append(wg.mix(((left * _U(0xFF51AFD7ED558CCD) + middle) * _U(0xFF51AFD7ED558CCD) + right) ^ _U(3)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def signatures(tokens: np.ndarray, k: int, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of level k of a set, at least one of which any linked set has too.

    In an order that all sets share, rare tokens come first, then frequent ones,
    both by fingerprint.  Rare tokens are signatures by themselves; of frequent
    ones combinations of k are.  The prefix is extended until d missing tokens,
    as many as a linked set may lack, leave one signature whole.  Of two linked
    sets, the one whose prefix ends first has a whole signature of common tokens,
    which then lies in the other's prefix too.
    """
    n = len(tokens)
    d = differing(n, percent)
    if k == 1:
        return _single(tokens[: d + 1])
    rare = tokens[~frequent][: d + 1]
    need = d + 1 - len(rare)
    if need <= 0:
        return _single(rare)
    # a linked set may be larger: its number of groups counts too
    sizes = range(int(n).bit_length(), int(n * 100 // percent).bit_length() + 1)
    made = [_combined(tokens[frequent], need, k, s) for s in sizes]
    return np.concatenate([_single(rare), made[0] if len(made) == 1 else np.unique(np.concatenate(made))])


def _bitmap(tokens: np.ndarray, bits: int) -> bytes:
    """Parities of the tokens' counts by bit."""
    odd = np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _width(n: int) -> int:
    """Bits of a set's bitmap: about one for a token, a power of two from 64 on."""
    return 1 << max(6, int(n - 1).bit_length())


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def _may_link(na: int, nb: int, a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """False only if the sets can't be linked: the bits that differ are at most the tokens that do."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
    return apart * (100 + percent) <= (100 - percent) * (na + nb)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _measured(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, where each document's start, and sizes and fingerprints of the sets."""
    g, first = shingles(data, off, shingle)
    n = np.diff(first)
    total = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(wg.mix(g), out=total[1:])
    sid = wg.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64) * _U(0x9FB21C651E98DF25)).astype(np.int64)
    return g, first, n.astype(np.int64), sid


def _sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """For each row: size, fingerprint and parity bitmap of its set; no bitmap where only equal sets are linked."""

    def make(data: np.ndarray, off: np.ndarray) -> dict[str, object]:
        g, first, n, sid = _measured(data, off, shingle)
        maps = [_bitmap(g[a:b], _width(b - a)) if m else b"" for a, b, m in zip(first[:-1].tolist(), first[1:].tolist(), pairable(n, percent).tolist())]
        return {"n": n, "sid": sid, "bitmap": pa.array(maps, pa.binary())}

    fields = [T.StructField("n", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("bitmap", T.BinaryType())]
    return C.arrow_append(docs, make, fields, keep=["id"])


def _filter_bits(keys: np.ndarray) -> np.ndarray:
    return (wg.mix(keys.astype(np.uint64) + _U(77)) >> _U(64 - FILTER_BITS)).astype(np.int64)


def _keys(found: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Bucket and 40 bits of signatures, in one number."""
    bucket = buckets[((found >> _U(40)) % _U(len(buckets))).astype(np.int64)]
    return bucket.astype(np.uint64) << _U(40) | found & _U((1 << 40) - 1)


class _Lists:
    """Collects (signature key, set, size); a flush sends no more of a key's sets than tell that it is frequent.

    On the last level the sets of a frequent key are tied to its smallest one
    before the others are left out.  So a key gets a bounded number of rows from
    each flush, whatever the number of its sets.
    """

    def __init__(self, limit: int, last: bool, spread: int) -> None:
        self.limit, self.last, self.spread = limit, last, spread
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, key: np.ndarray, sid: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((key, sid, size))
        self.n += len(key)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        key, sid, size = _distinct(*(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.n = [], 0
        first, count = _runs(key)
        nth = np.arange(len(key)) - np.repeat(first, count)
        if self.last:
            ties = _ties(sid, first, count, self.limit)
            if len(ties):
                # the sign tells them from a bucket's rows
                spread = (wg.mix(ties[:, 0].astype(np.uint64)) % _U(self.spread)).astype(np.int32)
                yield P.pack(-1 - spread, ties[:, 0], ties[:, 1].astype(np.uint64))
        on = nth <= self.limit
        value = (key[on] & _U((1 << 40) - 1)) << _U(24) | np.minimum(size[on], (1 << 24) - 1).astype(np.uint64)
        yield P.pack((key[on] >> _U(40)).astype(np.int32), sid[on], value)


def _distinct(key: np.ndarray, sid: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((sid, key))
    key, sid, size = key[order], sid[order], size[order]
    one = np.ones(len(key), bool)
    one[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    return key[one], sid[one], size[one]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and their lengths."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def _ties(sid: np.ndarray, first: np.ndarray, count: np.ndarray, limit: int) -> np.ndarray:
    """Distinct (smallest set, other set) of the runs that are longer than the limit."""
    lead = np.repeat(sid[first], count)
    on = np.repeat(count > limit, count) & (lead != sid)
    return np.unique(np.stack([lead[on], sid[on]], 1), axis=0)


def _index(docs: DataFrame, k: int, buckets: np.ndarray, hot: list[np.ndarray], shingle: int, percent: int) -> DataFrame:
    """Packed signatures of level k, of the sets that have a frequent one on each level before."""
    last = k == len(LISTS)
    limit = LISTS[k - 1]
    hot_b = docs.sparkSession.sparkContext.broadcast(hot)  # at most two filters of 2 ** FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.unpackbits(f, bitorder="little").astype(bool) for f in hot_b.value]
        out, seen = _Lists(limit, last, len(buckets)), set()
        for batch in batches:
            for _, _, data, off in wg.chunks(batch, "text"):
                g, first, n, sid = _measured(data, off, shingle)
                d = differing(n, percent)
                new = pairable(n, percent)
                for i, s in enumerate(sid.tolist()):
                    if new[i] and s in seen:
                        new[i] = False
                    seen.add(s)
                if len(seen) > SEEN:
                    seen.clear()
                doc = np.repeat(np.arange(len(n)), n)
                head = (np.arange(len(g)) - np.repeat(first[:-1], n) <= d[doc]) & new[doc]
                if k == 1:
                    yield from out.add(_keys(_single(g[head]), buckets), sid[doc[head]], n[doc[head]])
                    continue
                bits = _filter_bits(_keys(_single(g), buckets))
                frequent = masks[0][bits]
                for i in np.unique(doc[head & frequent]).tolist():
                    a, b = first[i], first[i + 1]
                    if k > 2:
                        before = _keys(signatures(g[a:b], 2, frequent[a:b], percent), buckets)
                        if not masks[1][_filter_bits(before)].any():
                            continue
                    known = frequent[a:b] | masks[1][bits[a:b]] if k > 2 else frequent[a:b]
                    key = _keys(signatures(g[a:b], k, known, percent), buckets)
                    yield from out.add(key, np.full(len(key), sid[i]), np.full(len(key), n[i]))
        yield from out.flush()

    C.small_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, P.SCHEMA)


_FOUND = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _candidates(rows: DataFrame, limit: int, last: bool, percent: int) -> DataFrame:
    """Of each signature's sets: the pairs (kind 0), or if they are many the signature (1); at the end, ties to one of them (2)."""

    def rows_of(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 100_000):
            x, y = np.ascontiguousarray(a[i : i + 100_000]), np.ascontiguousarray(b[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], schema=_FOUND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            bucket, sid, value = P.unpack([batch], np.uint64)
            tie = bucket < 0
            yield from rows_of(2, sid[tie], value[tie].astype(np.int64))
            held.append((bucket[~tie].astype(np.uint64) << _U(40) | value[~tie] >> _U(24), sid[~tie], (value[~tie] & _U((1 << 24) - 1)).astype(np.int64)))
        if not held:
            return
        key, sid, n = _distinct(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        first, size = _runs(key)
        if last:
            ties = _ties(sid, first, size, limit)
            yield from rows_of(2, ties[:, 0], ties[:, 1])
        else:
            hot = first[size > limit]
            yield from rows_of(1, _filter_bits(key[hot]), np.zeros(len(hot), np.int64))
        few = np.repeat((size > 1) & (size <= limit), size)
        key, sid, n = key[few], sid[few], n[few]
        made = []
        for step in range(1, min(limit, len(key))):
            on = key[step:] == key[:-step]
            if not on.any():
                break
            a, b, x, y = sid[:-step][on], sid[step:][on], n[:-step][on], n[step:][on]
            near = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
            made.append(np.stack([a[near], b[near]], 1))
        if made:
            pairs = np.unique(np.concatenate(made), axis=0)
            yield from rows_of(0, pairs[:, 0], pairs[:, 1])

    return rows.mapInArrow(run, _FOUND)


def _possible(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Pairs that the bitmaps don't rule out."""
    left = one.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma"))
    right = one.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(2, 6)]
            on = pa.array([_may_link(na, nb, ma, mb, percent) for na, nb, ma, mb in zip(*cols)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(on)

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb")
    return joined.mapInArrow(run, "a long, b long")


#: Roles of a set in a task: compared with all, with the task's lead, or leading; those of one ``side`` count as joined.
ALL, MEMBER, LEAD = 0, 1, 2


def _near_tasks(pairs: DataFrame) -> DataFrame:
    """``sid, task, role, side`` that bring each pair together.

    Both sets of a pair meet at the smaller of their smallest neighbours, so the
    sets of a clique meet once.  A meeting of more than BLOCK sets is parted again by pair.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("s"), F.least("a", "m").alias("m"))
    met = pairs.join(least.select(F.col("s").alias("a"), F.col("m").alias("x")), "a").join(least.select(F.col("s").alias("b"), F.col("m").alias("y")), "b")
    met = met.select("a", "b", F.least("x", "y").alias("t"))
    crowd = met.groupBy("t").agg(F.count(F.lit(1)).alias("m"))
    met = met.join(crowd, "t")
    few = met.where(F.col("m") <= BLOCK).select(F.concat_ws("/", F.lit("p"), "t").alias("task"), F.explode(F.array("a", "b")).alias("sid")).distinct()
    many = met.where(F.col("m") > BLOCK).select(F.concat_ws("/", F.lit("q"), "a", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / BLOCK))).alias("task"), "a", "b")
    led = many.select("task", F.col("b").alias("sid"), F.lit(MEMBER).alias("role")).unionByName(many.select("task", F.col("a").alias("sid"), F.lit(LEAD).alias("role"))).distinct()
    return few.withColumn("role", F.lit(ALL)).unionByName(led).withColumn("side", F.lit(None).cast("long"))


def _star_tasks(ties: DataFrame) -> DataFrame:
    """The same for ties: each set meets its lead, BLOCK sets to a task."""
    size = ties.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # one row for each lead
    dealt = ties.join(size, "a").select("b", F.concat_ws("/", F.lit("s"), "a", F.pmod(F.xxhash64("b"), F.col("blocks"))).alias("task"))
    leads = size.select(F.col("a").alias("sid"), F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.concat_ws("/", F.lit("s"), F.col("a"), i))).alias("task"))
    rows = dealt.select(F.col("b").alias("sid"), "task", F.lit(MEMBER).alias("role")).unionByName(leads.withColumn("role", F.lit(LEAD)))
    return rows.withColumn("side", F.lit(None).cast("long"))


def _size_class(n, percent: int) -> F.Column:
    """Linked sets lie in the same class or in adjoining ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def _across_tasks(groups: DataFrame, percent: int) -> DataFrame:
    """The same for ``grp, sid, n, side``: sets of a group meet unless they are of one side already or too different in size.

    In a group's size class, a side of at least BLOCK / 2 sets has blocks of its
    own, which don't meet each other; the other sides share blocks.
    """
    sized = groups.withColumn("c", F.explode(F.array(_size_class(F.col("n"), percent), _size_class(F.col("n"), percent) - 1)))
    counts = sized.groupBy("grp", "c", "side").agg(F.count(F.lit(1)).alias("m"))
    owned = counts.withColumn("owner", F.when(F.col("m") >= BLOCK / 2, F.col("side").cast("string")).otherwise("shared"))
    blocks = owned.groupBy("grp", "c", "owner").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks"))
    placed = sized.join(owned.select("grp", "c", "side", "owner"), ["grp", "c", "side"]).join(blocks, ["grp", "c", "owner"])
    placed = placed.select("grp", "c", "sid", "side", F.concat_ws("/", "owner", F.pmod(F.xxhash64("sid"), F.col("blocks"))).alias("block"))
    parts = blocks.select("grp", "c", "owner", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.concat_ws("/", "owner", i))).alias("block"))
    others = parts.select("grp", "c", F.col("owner").alias("owner2"), F.col("block").alias("block2"))
    meet = parts.join(others, ["grp", "c"]).where("block <= block2 AND (owner <> owner2 OR owner = 'shared')")
    meet = meet.select("grp", "c", F.concat_ws("/", F.lit("x"), "grp", "c", "block", "block2").alias("task"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return placed.join(meet, ["grp", "c", "block"]).select("sid", "task", F.lit(ALL).alias("role"), "side")


def _verified(docs: DataFrame, one: DataFrame, tasks: DataFrame, n_parts: int, shingle: int, percent: int) -> DataFrame:
    """Links that join each task's sets as all their links do; ``a`` and ``b`` are nodes."""
    wanted = tasks.groupBy("sid").agg(F.collect_list(F.struct("task", "role", "side")).alias("tasks")).join(one.select("sid", "rep"), "sid")
    wanted = C.cut(wanted)
    texts = C.marked(docs, "id", wanted.where("rep IS NOT NULL").select(F.col("rep").alias("id"))).where("marked OR id IS NULL").drop("marked")
    sent = texts.join(wanted.withColumnRenamed("rep", "id"), "id")
    if not wanted.where("rep IS NULL").isEmpty():  # sets of rows without an id are known by their texts alone

        def make(data: np.ndarray, off: np.ndarray) -> dict[str, object]:
            return {"sid": _measured(data, off, shingle)[3]}

        nameless = C.arrow_append(texts.where("id IS NULL"), make, [T.StructField("sid", T.LongType())], keep=["id", "text"]).groupBy("sid").agg(F.min("text").alias("text"))
        sent = sent.unionByName(nameless.join(wanted.where("rep IS NULL").withColumnRenamed("rep", "id"), "sid").select(*sent.columns))
    rows = sent.select(F.explode("tasks").alias("t"), "id", "sid", F.col("text").cast("binary").alias("text")).select("t.task", "t.role", "t.side", "id", "sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            made = compared({s: h[1:] for s, h in held.items()}, percent)
            if made:
                node = {s: s if h[0] is None else h[0] for s, h in held.items()}
                yield pa.RecordBatch.from_arrays([pa.array([node[x[k]] for x in made], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            names, roles, sides, ids, sids = (batch.column(i).to_pylist() for i in range(5))
            for a, b, data, off in wg.chunks(batch, "text"):
                g, first, _, own = _measured(data, off, shingle)
                for i in range(a, b):
                    if names[i] != task:
                        yield from done()
                        task, held = names[i], {}
                    if own[i - a] == sids[i]:  # of an id's several texts, the set's
                        held[sids[i]] = (ids[i], g[first[i - a] : first[i - a + 1]].copy(), roles[i], sides[i])
        yield from done()

    return rows.repartition(n_parts, "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def compared(held: dict[int, tuple[np.ndarray, int, int | None]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between a task's sets: with its leads, or if it has none enough of them to join all that their links join."""
    leads = [s for s, (_, role, _) in held.items() if role == LEAD]
    if not leads:
        return links({s: g for s, (g, _, _) in held.items()}, percent, {s: side for s, (_, _, side) in held.items()})
    return [(lead, s) for lead in leads for s, (g, role, _) in held.items() if role != LEAD and linked(held[lead][0], g, percent)]


def links(held: dict[int, np.ndarray], percent: int = PERCENT, sides: dict[int, int | None] | None = None) -> list[tuple[int, int]]:
    """Enough links between the sets to join all that their links join; every pair is linked, ruled out or already joined."""
    if len(held) < 2:
        return []
    sids = sorted(held, key=lambda s: (len(held[s]), s))
    sets = [held[s] for s in sids]
    n = np.array([len(s) for s in sets])
    width = min(1 << max(6, int(np.median(n)).bit_length()), 1 << 13)
    maps = np.stack([np.frombuffer(_bitmap(s, width), np.uint64) for s in sets])
    number, sides = {}, sides or {}
    root = np.array([number.setdefault(("own", s) if sides.get(s) is None else sides[s], i) for i, s in enumerate(sids)])
    out: list[tuple[int, int]] = []
    for i in range(len(sids)):
        # a set linked with the i-th, not smaller, has at most 100 / p times its tokens
        end = int(np.searchsorted(n * percent, n[i] * 100, "right"))
        if end <= i + 1:
            continue
        js = np.flatnonzero(root[i + 1 : end] != root[i]) + i + 1
        if not len(js):
            continue
        apart = np.bitwise_count(maps[js] ^ maps[i]).sum(1)
        js = js[apart * (100 + percent) <= (100 - percent) * (n[js] + n[i])]
        for j in js.tolist():
            if root[j] != root[i] and linked(sets[i], sets[j], percent):
                out.append((sids[i], sids[j]))
                root[root == root[j]] = root[i]
    return out


def _by_set(rows: DataFrame, known: DataFrame, many: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``known(sid, ...)``; the rows of sets among ``many`` are spread over SALTS tasks."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    left = C.marked(rows, "sid", many).withColumn("salt", F.when(F.col("marked"), salt).otherwise(0)).drop("marked")
    right = C.marked(known, "sid", many).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("marked"), SALTS - 1).otherwise(0)))).drop("marked")
    return left.join(right, ["sid", "salt"]).drop("salt")


def _labelled(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``id, n, sid``, and ``node, root, least`` of its set, of each row of ``docs(id, text)``.

    A set's node is the smallest id that has it, so rows of one id are one node
    and a component's root is its smallest id.  Sets of rows without ids are nodes
    by fingerprint; only where there are any, a component's smallest id is looked for.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"similarity from {LEAST_PERCENT} to 100 %")
    sets = C.cut(_sets(docs, shingle, percent))
    n_parts = P.n_partitions(docs.sparkSession, 8 * (sets.agg(F.sum("n")).first()[0] or 0))
    buckets = P.labels(docs, n_parts)
    reps = sets.groupBy("sid", "n").agg(F.min("id").alias("rep"), F.first("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("rows"))
    reps = C.cut(reps.withColumn("node", F.coalesce("rep", "sid")))
    one = reps.where("length(bitmap) > 0")
    hot: list[np.ndarray] = []
    levels: list[DataFrame] = []
    for k, limit in enumerate(LISTS, 1):
        rows = P.dealt(_index(docs, k, buckets, hot, shingle, percent), n_parts)
        levels.append(C.cut(_candidates(rows, limit, k == len(LISTS), percent)))
        if k < len(LISTS):
            bits = C.bitmap(levels[-1].where("kind = 1").select(F.col("a").alias("p")), FILTER_BITS)
            if not bits.any():
                break
            hot.append(bits)
        C.release(docs.sparkSession)
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    pairs = C.cut(_possible(every.where("kind = 0").select("a", "b").distinct(), one, percent))
    ties = every.where("kind = 2").select("a", "b").distinct()
    tasks = _near_tasks(pairs)
    tied = len(levels) == len(LISTS) and not ties.isEmpty()
    if tied:
        ties = C.cut(ties)
        tasks = tasks.unionByName(_star_tasks(_possible(ties, one, percent)))
    found = C.cut(_verified(docs, one, tasks, n_parts, shingle, percent))
    joined = graph.components(found)
    if tied:
        # sets that are tied but not joined yet
        groups = graph.components(ties).select(F.col("node").alias("sid"), F.col("root").alias("grp"))
        sided = groups.join(one.select("sid", "n", "node"), "sid").join(joined, "node", "left").select("grp", "sid", "n", F.coalesce("root", "node").alias("side"))
        sided = C.cut(sided)
        several = sided.groupBy("grp").agg(F.min("side").alias("x"), F.max("side").alias("y")).where("x <> y").select("grp")
        rest = sided.join(several, "grp")
        if not rest.isEmpty():
            # the stars that were found link what all links do
            known = joined.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b")
            joined = graph.components(known.unionByName(_verified(docs, one, _across_tasks(rest, percent), n_parts, shingle, percent)))
    known = reps.select("sid", "rep", "node", "rows").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if reps.where("rep IS NULL").isEmpty():
        known = known.withColumn("least", F.col("root"))
    else:
        known = known.join(known.groupBy("root").agg(F.min("rep").alias("least")), "root")
    many = reps.where(F.col("rows") >= MANY).select("sid")
    return _by_set(sets.select("id", "n", "sid"), known.select("sid", "node", "root", "least"), many)


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Each document's set size and component of links: sets of shingles of ``shingle`` words whose Jaccard similarity is at least ``percent`` / 100.

    1. Equal sets are found by fingerprint and stand for one.
    2. Level 1 indexes the tokens of each set's prefix.  A token of few sets (up
       to ``LISTS[0]``) gives all their pairs as candidates; others are frequent.
    3. Sets with a frequent token get a prefix in which rare tokens come first;
       those are indexed by themselves, and where they don't suffice the prefix is
       extended by frequent ones, of which combinations of two are indexed; on
       level 3, combinations of three (``signatures``).  Which signatures are
       frequent goes to the executors as a filter of fixed size.
    4. Pairs that parity bitmaps rule out are dropped; the others are compared
       exactly.  Sets of a triple that is frequent still are compared with the
       smallest of them; those that aren't joined then are compared with all sets
       of their group that are of another component, in blocks.

    A flush of a task sends a bounded number of rows for a signature, so no
    task's input grows with a frequent one.  Only step 4's last part can grow with
    a square: in the sets that share a frequent triple but belong to different components.

    Returns ``id, n_shingles, component_id``, one row for each input row.  Ids are whole numbers.

    * Null text or one without words: no shingles, a component of its own.
    * Fewer words than a shingle has: the whole sequence is the one shingle.
    * Null id: never the smallest; in a component without any id the result is null.
    * Rows of one id are one node: what links one of them links all.  Other columns aren't read.
    * Empty input: empty result.
    """
    rows = _labelled(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), shingle, percent)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


#: DuckDB SQL of ``op8_near_components``, by all pairs of documents with a common shingle.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT b, root FROM reach JOIN links ON a = doc_id)
SELECT reach.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""


def op8_near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(C.load(spark, sf_dir, "documents"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component of sets of 5-word shingles at a similarity of 0.8 stays, that of the smallest id.

    Rows whose id is kept and not repeated stay as they are read; only the others
    (dropped, repeated and null ids, told by a filter of fixed size) are joined
    with the verdicts.

    * Null or empty text: linked with nothing, stays.
    * Of the rows of one id, and of those of one set that lack an id, one stays.
    * Other columns are carried along; empty input: empty result.
    """
    small = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = C.cut(_labelled(small, STAGE_SHINGLE, STAGE_PERCENT).where("n > 0").select("id", "sid", F.expr("id <=> least AND (id IS NOT NULL OR sid = root)").alias("best")))
    named = rows.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.max("best").alias("best"))
    told = C.marked(docs.withColumn("__id", F.col("doc_id").cast("long")), "__id", named.where("m > 1 OR NOT best").select(F.col("id").alias("__id")))
    sure = told.where("NOT marked AND __id IS NOT NULL").select(*docs.columns)

    def make(data: np.ndarray, off: np.ndarray) -> dict[str, object]:
        _, _, n, sid = _measured(data, off, STAGE_SHINGLE)
        return {"__n": n, "__sid": sid}

    doubt = C.arrow_append(told.where("marked OR __id IS NULL"), make, [T.StructField("__n", T.LongType()), T.StructField("__sid", T.LongType())], keep=[*docs.columns, "__id"])
    by_id = doubt.where("__n > 0 AND __id IS NOT NULL").join(named.where("best").select(F.col("id").alias("__id")), "__id", "left_semi")
    by_set = doubt.where("__n > 0 AND __id IS NULL").join(rows.where("best AND id IS NULL").select(F.col("sid").alias("__sid")).distinct(), "__sid", "left_semi")
    chosen = by_id.unionByName(by_set).withColumn("__nth", F.row_number().over(W.partitionBy(F.coalesce("__id", "__sid")).orderBy("__id", "__sid"))).where("__nth = 1")
    return sure.unionByName(doubt.where("__n = 0").select(*docs.columns)).unionByName(chosen.select(*docs.columns))
