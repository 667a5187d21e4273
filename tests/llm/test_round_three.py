"""Byte-level BPE, source divergence, hard negatives, and texts that strain the lexer."""

import hashlib
import os
import random
import struct
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from haruspex.llm import bpe, chat, common, compression, divergence, mixing, negatives, rules, secrets
from haruspex.llm import wordgrid as wg

DOCS = "doc_id long, text string, lang string, source string"


def _same(got, want):
    cols = list(want.columns)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def _duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()


# -- byte-level BPE


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def vocab(path):
    return bpe.Vocabulary.load(path)


def _encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(t) for t in raw])
    ids, n = encoder.texts(np.frombuffer(b"".join(raw), np.uint8), off)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def _texts():
    rng = random.Random(3)
    bits = [*" \n\t'sstmdrelvLA1 ²!?.ñ文🙂\u00a0\u3000\x1c", "'s", "'re", "'ll", "  ", "<|endoftext|>", "'ve", "<|", "|>", "\r\n"]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(3000)]
    made += ["".join(chr(rng.choice(points)) for _ in range(30)) for _ in range(500)]
    return made + ["", "A" * 5000, " " * 3000, "loop " * 3000, "x" * 33, "y" * 32, "".join(map(chr, points))]


def test_bpe_encodes_as_the_library(vocab, library):
    texts, encoder = _texts(), bpe.Encoder(vocab)
    got = [x for k in range(0, len(texts), 300) for x in _encoded(encoder, texts[k : k + 300])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_in_pieces_and_with_forgotten_words(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    texts = ["\n  x 's it's  ñandú  <|endoftext|> 12 three\u00a0 four " * 20, "nospace" * 40] + _texts()[:200]
    assert _encoded(bpe.Encoder(vocab), texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rank_array_bounds_tile_the_word(vocab):
    words = [b"hello", b" the", b"x", b"\xf0\x9f\x99\x82\xf0\x9f", b"internationalization"]
    ids, bounds = bpe.merge_short(vocab, words)
    for w, row, b in zip(words, ids, bounds):
        row, b = row[row >= 0], b[b >= 0]
        assert row.tolist() == bpe.merge_long(vocab, w).tolist() and b[0] == 0 and b[-1] == len(w) and len(b) == len(row) + 1
        tokens = [vocab.token_bytes[vocab.token_end[i] - (vocab.token_end[i] - (vocab.token_end[i - 1] if i else 0)) : vocab.token_end[i]].tobytes() for i in row]
        assert tokens == [w[x:y] for x, y in zip(b, b[1:])]


def test_bpe_query_agrees_and_round_trips(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in bpe.op11_bpe(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_odd_rows(spark, vocab, library):
    docs = spark.createDataFrame([(1, None, "clash"), (2, "", "clash"), (2, "a b", None), (2, "a b", None)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, vocab), vocab).collect()
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in out) == [(1, [], ""), (2, [], ""), (2, [64, 275], "a b"), (2, [64, 275], "a b")]
    assert bpe.encode(docs.limit(0), vocab).count() == 0
    odd = spark.createDataFrame([([50256, None, 64, -3, 99999, 12520], "x"), (None, "y")], "ids array<int>, decoded string")
    assert [r["decoded"] for r in bpe.decode(odd, vocab).collect()] == [library.decode([50256, 64, 12520], skip_special_tokens=False), None]


def test_bpe_refuses_what_it_does_not_know(path):
    import json

    spec = json.load(open(path))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        bpe.Vocabulary(spec)


def test_distinct_with_clashing_fingerprints(monkeypatch):
    data, start, end = np.frombuffer(b"abcdabxyab", np.uint8), np.array([0, 2, 4, 6, 8]), np.array([2, 4, 6, 8, 10])
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(wg, "span_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
        first, which = wg.distinct(data, start, end)
        assert len(first) == 3 and [data[start[first[k]] : end[first[k]]].tobytes() for k in which] == [b"ab", b"cd", b"ab", b"xy", b"ab"]


# -- divergence of sources


@pytest.mark.parametrize(("light", "sources", "terms"), [(8, 256, 512), (2, 3, 40), (0, 256, 64), (99, 2, 64)])
def test_divergence_equals_sql(spark, sf_dir, monkeypatch, light, sources, terms):
    monkeypatch.setattr(divergence, "LIGHT", light)
    monkeypatch.setattr(divergence, "TILE_SOURCES", sources)
    monkeypatch.setattr(divergence, "TILE_TERMS", terms)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    _same(divergence.op12_source_divergence(spark, sf_dir).toPandas(), con.execute(divergence.SQL).df())


def test_divergence_odd_rows(spark, monkeypatch):
    rows = [(1, None, None, None), (2, "", None, "b"), (3, "Ab aB ÄB ab12cd", "x", "a"), (4, "ab ÄB äb", "x", "b"), (5, "ab cd", "x", "b"), (5, "ab cd", "x", "b"), (6, "nothing kept", "y", ""), (7, None, "y", "z"), (8, "äb", "x", None)]
    docs = spark.createDataFrame(rows, DOCS)
    want = _duck(divergence.SQL, documents=docs.toPandas().astype(object).where(lambda d: d.notna(), None))
    assert {tuple(r) for r in want[want.part == "pair"][["lang", "value"]].values.tolist()} >= {("", 0), ("y", 0)}
    for batch in (500, 2):
        monkeypatch.setattr(divergence, "FLUSH", batch)
        _same(divergence.divergence(docs.withColumn("term", F.lit("mine")).withColumn("n", F.lit(3))).toPandas(), want)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_do_not_overflow(spark):
    rows = [(0, 1), (10**13, 3 * 10**14), (8 * 10**12, 9 * 10**12), (5, 7), (10**12 - 1, 10**12)]
    want = [1 + 10**9 * (n + 1) // m for n, m in rows]
    got = spark.createDataFrame(rows, "n long, m long").withColumn("p", divergence.share("n", "m"))
    assert [r["p"] for r in got.collect()] == want
    n, m = np.array(rows).T
    assert divergence._share(n, m).tolist() == want


# -- hard negatives


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _mined(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    docs = _vectors(spark, rows).withColumn("label", label).withColumn("vec", F.lit("mine")).withColumn("score", F.lit(1))
    return negatives.hard_negatives(docs, F.col("vec_id") % 50 == 0).toPandas()


def _both(spark, rows):
    con = duckdb.connect()
    con.register("arrow_rows", _vectors(spark, rows).toArrow())
    return _mined(spark, rows), con.execute(negatives.SQL.replace("FROM embeddings", "FROM arrow_rows")).df()


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_sql(spark, sf_dir, monkeypatch, small):
    if small:
        for name, value in (("TILE_ANCHORS", 3), ("TILE_CLASSES", 40), ("HELD", 200), ("SAMPLE", 50), ("PER_PIVOT", 1)):
            monkeypatch.setattr(negatives, name, value)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    _same(negatives.op13_hard_negatives(spark, sf_dir).toPandas(), con.execute(negatives.SQL).df())


def test_hard_negatives_with_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 4)).astype(np.float32)
    rows = [(i, (base[i % 6] + (0 if i % 3 else 0.1 * rng.normal(size=4))).astype(np.float32).tolist(), int(i % 4)) for i in range(400)]
    rows += [(1000 + i, [0.0] * 4, i % 3) for i in range(120)]  # every score of these is nothing
    got, want = _both(spark, rows)
    assert len(want) > 50
    _same(got, want)


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.4], 1), (2, [0.8, None], 1), (3, [float("nan"), 0.1], 1), (4, None, 1), (5, [0.7, 0.3], None), (6, [0.6, 0.2], 2), (8, [float("inf"), 1.0], 2), (50, [-1.0, 0.0], 1), (51, [0.001, 1.0], 3)]
    got, want = _both(spark, rows)
    _same(got, want)
    assert negatives.hard_negatives(_vectors(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(_vectors(spark, rows), F.lit(False)).count() == 0
    short = _mined(spark, rows + [(52, [0.7], 2), (53, [], 2), (None, [1.0, 1.0], 2), (0, [1.0, 0.5], 1)])
    _same(short, _both(spark, rows + [(52, [0.7, 0.0], 2), (53, [0.0, 0.0], 2)])[1])


def test_far_groups_get_no_rows():
    """The triangle inequality keeps rows of one cluster from the anchors of another."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 8)) + 1000, rng.normal(size=(50, 8)) - 1000
    r2 = float(max((x * x).sum(1).max() for x in (a, b)))
    space = negatives.Space(8, r2, negatives.made_pivots(np.vstack([a, b]), r2, 2))
    far = space.far(a, True)
    cell = int(far.argmin(1)[0])
    outer = (far[:, cell] + space.distance((a * a).sum(1), np.partition(a @ a.T, -6, axis=1)[:, -6])).max()
    assert (space.far(a, False)[:, cell] <= outer + space.slack).all() and (space.far(b, False)[:, cell] > outer).all()


# -- the lexer


def _literals(t):
    t = t.encode()
    return [t[a:b].decode() for k, a, b in secrets.spans(t, []) if k == "literal"]


SECRET = "h7Kq!x92Lm#pZ"
STRAINING = {
    "escaped line breaks": ('password = "' + "\\\n" * 3000 + SECRET + '"', ["\\\n" * 3000 + SECRET]),
    "doubling constants": (f'a0 = "{SECRET}"\n' + "".join(f"a{k + 1} = a{k} + a{k}\n" for k in range(2000)) + "password = a2000\n", [SECRET]),
    "long element": ("<password>" + "k9" * 100_000 + "</password>", ["k9" * 100_000]),
    "far indented": (" " * 5000 + f"password: {SECRET} two", [SECRET + " two"]),
    "many blocks": ("".join(f"token_{k}: |\n  abc{k}defghijkLMNOP9xx\n" for k in range(5000)), [f"abc{k}defghijkLMNOP9xx" for k in range(5000)]),
    "chain of constants": (f'a0 = "{SECRET}"\n' + "".join(f"a{k + 1} = a{k}\n" for k in range(8000)) + "password = a8000\n", [SECRET]),
    "nested comments": ("# " * 50_000 + 'password = "' + SECRET + '"', [SECRET]),
    "assignments in a row": ("a=" * 20_000 + "password", []),
    "dots": ("password." * 20_000, []),
    "braces": ("{ this.password = 1; " * 10_000, []),
    "open strings": ('password = "' + "\\\n" * 5000 + "\n", []),
}


@pytest.mark.parametrize("form", STRAINING)
def test_straining_texts_are_lexed_in_time(form):
    text, want = STRAINING[form]
    began = time.perf_counter()
    assert _literals(text) == want
    assert time.perf_counter() - began < 5


def test_a_class_sees_its_own_names():
    assert _literals(f'class A:\n    def f(self):\n        self.k = "{SECRET}"\n    def g(self):\n        self.password = self.k\n') == [SECRET]
    assert _literals(f'class A:\n    def f(self):\n        self.k = "{SECRET}"\nclass B:\n    def g(self):\n        self.password = self.k\n') == []


# -- labels that disagree, and the last places of a mixture


def test_labels_that_disagree_are_left_out(spark):
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    for rows in (labels, labels.orderBy(F.desc("quality"))):
        assert sorted(map(tuple, common.agreed(rows, "quality").collect())) == [(1, 0), (3, 1)]


def test_training_does_not_depend_on_the_order_of_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    more = labels.unionByName(labels.limit(20).withColumn("quality", 1 - F.col("quality")))
    twice = docs.unionByName(docs.limit(50).withColumn("text", F.concat(F.lit("other "), "text")))
    for made in (lambda d, m: compression.labelled_sample(d, m), lambda d, m: rules.train(d, m)):
        a, b = made(twice, more), made(twice.repartition(5).orderBy(F.desc("text")), more.orderBy("quality"))
        if isinstance(a, tuple):
            assert sorted(a[0]) == sorted(b[0]) and a[1] == b[1]
        else:
            assert all(np.array_equal(x, y) for x, y in zip(vars(a).values(), vars(b).values()) if isinstance(x, np.ndarray))


def test_sources_of_fifty_documents_come_within_half_a_percent(spark):
    rng = np.random.default_rng(9)
    rows = [(s * 1000 + k, "w " * int(n), "en", f"s{s:02d}") for s in range(12) for k, n in enumerate(np.exp(rng.normal(5, 1.2, 50)).astype(int) + 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.pareto_mix(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.005 * g["target"].iloc[0]
    assert out["taken"].le(2 * out["size"]).all()
    again = mixing.pareto_mix(docs.repartition(9)).toPandas().set_index("doc_id")["taken"]
    assert (again.loc[out["doc_id"]].to_numpy() == out["taken"].to_numpy()).all()


# -- chat templates


TURNS = [("system", "s")] + [(("user", "assistant")[k % 2], f"t{k}") for k in range(299)]


@pytest.mark.parametrize("kept", [20, 90, 200, 299])
def test_templates_that_drop_old_turns_are_detected(kept):
    with pytest.raises(chat.RewritesHistory):
        list(chat.turn_spans(iter(TURNS), lambda ts: chat.default_template(ts[-kept:]), chat.CONTEXT))
    assert len(list(chat.turn_spans(iter(TURNS[:kept]), lambda ts: chat.default_template(ts[-kept:]), chat.CONTEXT))) == kept


def test_long_conversations_take_time_in_proportion():
    rendered = [0]

    def counted(ts):
        rendered[0] += len(ts)
        return chat.default_template(ts)

    turns = [(("user", "assistant", "odd:role")[k % 3], f"text {k} ### </turn>") for k in range(10_000)]
    began = time.perf_counter()
    got = list(chat.turn_spans(iter(turns), counted, chat.CONTEXT))
    assert time.perf_counter() - began < 10 and rendered[0] < 10_000 * (2 * chat.CONTEXT + 6)
    assert "".join(s for _, s, _ in got) == chat.default_template(turns)
    assert all(chat.unescape(s[a:b]) == t for (_, t), s, (a, b) in got)


def test_any_error_of_a_template_is_its_conversation_s(spark):
    def fussy(ts):
        if any("bad" in t for _, t in ts):
            raise KeyError("bad text")
        return chat.default_template(ts)

    rows = [(c, k, "user", t) for c, texts in ((1, ["a", "b"]), (2, ["a", "bad", "c"]), (3, ["x"])) for k, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for local in (False, True):
        out = {r["conv_id"]: r for r in chat.format_conversations(turns, fussy, turn_local=local).collect()}
        assert out[1]["n_turns"] == 2 and out[3]["n_turns"] == 1 and out[2]["error"] == "KeyError: 'bad text'" and out[2]["n_turns"] is None and out[2]["rewrites"] is None

    def strict(span):
        raise ValueError("unreadable")

    assert {r["error"] for r in chat.format_conversations(turns, parse=strict).collect()} == {"ValueError: unreadable"}


def test_every_operator_is_registered():
    from haruspex.llm import queries

    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and os.path.basename(queries.__file__) == "queries.py"
