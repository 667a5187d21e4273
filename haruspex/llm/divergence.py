"""How far the sources of a language differ in their words, exactly, by a heavy-light split of the terms.

For each ordered pair of sources of a language the audit sums, over all kept terms,
the floor of (p - q)^2 / q of two smoothed shares in whole numbers.  A term that
more than LIGHT sources have is heavy: tiles of such terms are dense numpy arrays of
counts by source, which give the sums of all pairs.  Any other term is light.  Most
sources lack it, so all pairs first get what two lacking sources would, times the
light terms; then corrections are added, one for each source that has a term and,
from the term's posting list of at most LIGHT sources, one for each pair that has it.
Corrections depend on counts only, so equal ones are counted before they are
computed.  All partial sums are whole numbers that are added exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import common as C
from haruspex.llm import wordgrid as wg

#: Terms are runs of ASCII letters and of characters beyond ASCII.
NO_TERM = np.zeros(256, bool)
NO_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

MIN_DOCS, RANKS, SCALE = 3, 200, 1_000_000_000
#: A term of more sources than this is heavy.
LIGHT = 8
#: Terms and sources of a dense tile, about; a tile has at most their product of counts for its rows and again for its columns.
TILE_TERMS, TILE_SOURCES = 512, 256
#: Counts that a task gathers before it sends them.
FLUSH = 1 << 19
#: Bytes of the table of sources up to which it is sent to every executor; beyond, it is joined.
SMALL = 8 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


class _Gathered:
    """Counts by group and term of some chunks: occurrences, and documents that have the term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, data: np.ndarray, off: np.ndarray, group: np.ndarray) -> None:
        g = wg.WordGrid(data, off, lower=True, separators=NO_TERM)
        if not len(g.start):
            return
        first, which = wg.distinct(g.data, g.start, g.end)
        raw = g.data.tobytes()
        known = np.fromiter((self.terms.setdefault(raw[a:b], len(self.terms)) for a, b in zip(g.start[first].tolist(), g.end[first].tolist())), np.int64, len(first))
        by_doc, n = np.unique(g.doc * len(first) + which, return_counts=True)
        key = group[by_doc // len(first)] * len(first) + by_doc % len(first)
        pair, at, docs = np.unique(key, return_inverse=True, return_counts=True)
        self.held.append((pair // len(first), known[pair % len(first)], np.bincount(at, n).astype(np.int64), docs))
        self.size += len(pair)

    def flush(self) -> Iterator[pa.RecordBatch]:
        names, terms = list(self.groups), list(self.terms)
        if names:  # every group occurs, with or without terms
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in names], pa.string()) for k in (0, 1)] + [pa.nulls(len(names), pa.binary())] + [pa.array([0] * len(names), pa.int64())] * 2, schema=_COUNTS)
        if self.held:
            group, term, n, docs = (np.concatenate(x) for x in zip(*self.held))
            order = np.lexsort((term, group))
            group, term, n, docs = group[order], term[order], n[order], docs[order]
            cut = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (term[1:] != term[:-1])))
            group, term, n, docs = group[cut], term[cut], np.add.reduceat(n, cut), np.add.reduceat(docs, cut)
            words = pa.array(terms, pa.binary())
            sides = [pa.array([x[k] for x in names], pa.string()) for k in (0, 1)]
            for a in range(0, len(group), 50_000):
                b = a + 50_000
                yield pa.RecordBatch.from_arrays([sides[0].take(pa.array(group[a:b])), sides[1].take(pa.array(group[a:b])), words.take(pa.array(term[a:b])), pa.array(n[a:b]), pa.array(docs[a:b])], schema=_COUNTS)
        self.__init__()


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group, and a row without a term for each group."""
    C.small_batches(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    picked = docs.select(name(lang).alias("lang"), name(source).alias("source"), F.col(f"`{text}`").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Gathered()
        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            group = np.array([got.groups.setdefault(x, len(got.groups)) for x in names], np.int64)
            for a, b, data, off in wg.chunks(batch, "__text"):
                got.add(data, off, group[a:b])
            if got.size >= FLUSH:
                yield from got.flush()
        yield from got.flush()

    made = picked.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return made.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total) -> F.Column:
    """1 + floor(SCALE * (n + 1) / total) of whole numbers, a thousandfold at a time, so that nothing overflows."""
    out, left = F.lit(0).cast("long"), F.col(n).cast("long") + 1
    for _ in range(3):
        now = left * 1000
        out, left = out * 1000 + F.call_function("div", now, F.col(total)), now % F.col(total)
    return out + 1


def differ(p, q) -> F.Column:
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, left = 0, n.astype(np.int64) + 1
    for _ in range(3):
        out, left = out * 1000 + left * 1000 // total, left * 1000 % total
    return out + 1


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tile_sums(tile: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of a tile's pairs of sources.

    ``role``: 1 for rows, 2 for columns, 3 for both, 0 where only the term is told.
    A row with ``total`` is a source, with ``weight`` light terms that both of a pair may lack;
    one with ``term`` a count of a heavy term; any other a count that ``weight`` light terms have.
    """
    lang = tile["lang"].iloc[0]
    group = tile["total"].notna()
    sides, out = [], None
    for bit in (1, 2):
        here = tile[group & (tile["role"] & bit > 0)].drop_duplicates("source").sort_values("source")
        sides.append((pd.Index(here["source"]), here["total"].to_numpy(np.int64), here["weight"].to_numpy(np.int64)))
    (rows, m_row, both), (cols, m_col, _) = sides
    empty = pd.DataFrame({"lang": pd.Series(dtype=str), "source": pd.Series(dtype=str), "item": pd.Series(dtype=str), "value": pd.Series(dtype=np.int64)})
    if not len(rows) or not len(cols):
        return empty
    out = np.zeros((len(rows), len(cols)), np.int64)
    if m_row.max() > 0:  # otherwise the language keeps no term
        b_row, b_col = _share(np.zeros(len(rows)), m_row), _share(np.zeros(len(cols)), m_col)
        lacking = _differ(b_row[:, None], b_col[None, :])
        out += both[:, None] * lacking
        one = tile[~group & tile["term"].isna()]
        for bit, names, totals in ((1, rows, m_row), (2, cols, m_col)):
            mine = one[one["role"] & bit > 0]
            at = names.get_indexer(mine["source"])
            n, w = mine["n"].to_numpy(np.int64), mine["weight"].to_numpy(np.int64)
            for k in np.unique(at):
                on = at == k
                p, m = _share(n[on], totals[k]), w[on]
                if bit == 1:
                    out[k] += ((_differ(p[:, None], b_col[None, :]) - lacking[k]) * m[:, None]).sum(0)
                else:
                    out[:, k] += ((_differ(b_row[:, None], p[None, :]) - lacking[:, k, None]) * m).sum(1)
        dense = tile[tile["term"].notna()]
        if len(dense):
            term, words = pd.factorize(dense["term"])
            shares = []
            for bit, names, totals in ((1, rows, m_row), (2, cols, m_col)):
                on = (dense["role"] & bit > 0).to_numpy()
                counts = np.zeros((len(names), len(words)), np.int64)
                counts[names.get_indexer(dense["source"][on]), term[on]] = dense["n"][on]
                shares.append(_share(counts, totals[:, None]))
            for k in range(len(rows)):
                out[k] += _differ(shares[0][k], shares[1]).sum(1)
    made = pd.DataFrame({"lang": lang, "source": np.repeat(rows.to_numpy(), len(cols)), "item": np.tile(cols.to_numpy(), len(rows)), "value": out.ravel()})
    return made[made["source"] != made["item"]]


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and its terms that stand out.

    Part ``pair`` has every other source of the language, part ``term`` the ``ranks`` first
    of the terms that are more frequent in the source than in the language.  Terms that fewer
    than ``min_docs`` documents of the language have aren't kept.

    * Null text, language or source counts as the empty string; a group without terms has pairs.
    * A language without kept terms gives pairs of value 0.  Repeated rows are documents of their own.
    * Empty input: empty result.  Other columns aren't read, whatever their names.
    """
    spark = docs.sparkSession
    word = Window.partitionBy("lang", "term")
    has = F.col("term").isNotNull()
    every = term_counts(docs, text=text, lang=lang, source=source)
    every = every.withColumns({"lang_n": F.sum("n").over(word), "df": F.sum("docs").over(word), "k": F.count(F.lit(1)).over(word), "__first": F.min("source").over(word)})
    every = every.where(~has | (F.col("df") >= min_docs)).withColumn("lead", has & (F.col("source") == F.col("__first")))
    few = has & (F.col("k") <= LIGHT)
    # the posting list of a light term, of LIGHT sources at most, beside its first row
    mates = F.collect_list(F.when(few, F.struct("source", "n"))).over(word)
    kept = C.cut(every.withColumn("mates", F.when(few & F.col("lead"), mates)).select("lang", "source", "term", "n", "lang_n", "k", "lead", "mates"))

    lead = lambda c: F.sum((F.col("lead") & c).cast("long"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), lead(F.lit(True)).alias("v"), lead(F.col("k") <= LIGHT).alias("light"))
    of = Window.partitionBy("lang")
    groups = C.cut(own.select("lang", "source", (F.col("n") + F.sum("v").over(of)).alias("total"), (F.sum("n").over(of) + F.sum("v").over(of)).alias("lang_total"), F.sum("light").over(of).alias("light"), (F.sum("v").over(of) - F.sum("light").over(of)).alias("heavy"), F.count(F.lit(1)).over(of).alias("sources")))
    seen = groups.agg(F.max("heavy"), F.max("sources"), F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()
    tiles, blocks = max(1, -(-(seen[0] or 0) // TILE_TERMS)), max(1, -(-(seen[1] or 0) // TILE_SOURCES))
    side = F.broadcast(groups) if (seen[2] or 0) <= SMALL else groups

    # terms that stand out
    terms = kept.where(has).join(side.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    terms = terms.withColumns({"p": share("n", "total"), "q": share("lang_n", "lang_total")}).where("p > q").withColumn("value", differ("p", "q"))
    top = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term"))
    terms = terms.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= ranks)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # pairs that share a light term: equal corrections are counted first
    mate = kept.where("mates IS NOT NULL").select("lang", F.explode("mates").alias("a"), "mates").select("lang", "a", F.explode("mates").alias("b")).where("a.source < b.source")
    mate = mate.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.n").alias("n"), F.col("b.n").alias("o")).agg(F.count(F.lit(1)).alias("m"))
    for c, total in (("source", "total"), ("item", "item_total")):
        mate = mate.join(side.select("lang", F.col("source").alias(c), F.col("total").alias(total)), ["lang", c])
    mate = mate.withColumn("zero", F.lit(0)).withColumns({"p": share("n", "total"), "q": share("o", "item_total"), "p0": share("zero", "total"), "q0": share("zero", "item_total")})
    shared = lambda p, q, p0, q0: F.col("m") * (differ(p, q) - differ(p, q0) - differ(p0, q) + differ(p0, q0))
    ways = F.array(F.struct("source", "item", shared("p", "q", "p0", "q0").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), shared("q", "p", "q0", "p0").alias("value")))
    shared_pairs = mate.select("lang", F.explode(ways).alias("x")).select("lang", "x.source", "x.item", "x.value")

    # tiles: heavy terms, counts of light terms, and in each tile the sources
    null = lambda kind: F.lit(None).cast(kind)
    tile = lambda *c: F.pmod(F.xxhash64(*c), F.lit(tiles)).cast("int")
    heavy = kept.where(has & (F.col("k") > LIGHT)).select("lang", tile("term").alias("tile"), "source", "term", "n", F.lit(0).cast("long").alias("weight"), null("long").alias("total"), "lead")
    one = kept.where(few).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("weight"))
    one = one.select("lang", tile("source", "n").alias("tile"), "source", null("string").alias("term"), "n", "weight", null("long").alias("total"), F.lit(False).alias("lead"))
    ends = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "source", "light", "total")
    ends = ends.select("lang", "tile", "source", null("string").alias("term"), F.lit(0).cast("long").alias("n"), F.when(F.col("tile") == 0, F.col("light")).otherwise(0).alias("weight"), "total", F.lit(False).alias("lead"))
    spread = heavy.unionByName(one).unionByName(ends).withColumn("x", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int"))
    all_ = F.sequence(F.lit(0), F.lit(blocks - 1))
    pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    mine = F.array_union(F.transform(all_, lambda y: pair(F.col("x"), y)), F.transform(all_, lambda y: pair(y, F.col("x"))))
    everywhere = F.flatten(F.transform(all_, lambda a: F.transform(all_, lambda b: pair(a, b))))
    spread = spread.withColumn("at", F.explode(F.when(F.col("lead"), everywhere).otherwise(mine) if blocks > 1 else F.array(pair(F.lit(0), F.lit(0)))))
    role = (F.col("at.a") == F.col("x")).cast("int") + 2 * (F.col("at.b") == F.col("x")).cast("int")
    spread = spread.select("lang", "tile", F.col("at.a").alias("a"), F.col("at.b").alias("b"), "source", "term", "n", "weight", "total", role.alias("role"))
    sums = spread.groupBy("lang", "tile", "a", "b").applyInPandas(tile_sums, "lang string, source string, item string, value long")

    pairs = sums.unionByName(shared_pairs).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(C.load(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), words AS (SELECT doc, lang, source, unnest(words) AS term FROM docs),
terms AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
vocabulary AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM terms GROUP BY lang),
held AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN terms t USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(v.lang_total, 0) AS lang_total, coalesce(h.n, 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN vocabulary v USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM held GROUP BY ALL) h USING (lang, source)
), shares AS (
    SELECT g.lang, g.source, t.term, coalesce(h.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (g.total + g.v) AS p,
           1 + (1000000000::HUGEINT * (t.lang_n + 1)) // (g.lang_total + g.v) AS q
    FROM groups g JOIN terms t USING (lang) LEFT JOIN held h USING (lang, source, term)
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), own AS (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own)
) WHERE part = 'pair' OR rank <= 200
"""
