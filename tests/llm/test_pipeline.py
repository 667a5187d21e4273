"""The pipeline's stages: columns, whole results, and decisions that take effect."""

import re

import corpus_pipeline
from haruspex.llm import queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == cols, name
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[5] == counts[4]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    first = spark.read.parquet(str(tmp_path / "0")).join(labels, "doc_id")
    assert first.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()
    second, third = spark.read.parquet(str(tmp_path / "1")), spark.read.parquet(str(tmp_path / "2"))
    items = [re.sub(r"[\W_]+", " ", r["text"].lower()).strip() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in re.sub(r"[\W_]+", " ", r["text"].lower()) for r in third.collect() for i in items)
    assert second.select("doc_id").distinct().count() == second.count()
    fourth = spark.read.parquet(str(tmp_path / "3"))
    assert set(r[0] for r in fourth.groupBy("doc_id").count().select("count").distinct().collect()) <= {1, 2}


def test_run_equals_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))


def test_release_returns_freed_memory(spark):
    """Blocks that were freed below one that is still held go back to the system."""
    import re
    from pathlib import Path

    from haruspex.llm import common

    held = lambda: int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
    blocks = [bytes(2000 + k % 7) for k in range(100_000)]
    last, full = blocks[-1], held()
    del blocks
    common.release(spark)
    assert last and held() < full - 100


def test_stars_need_no_round(spark, monkeypatch):
    """Components that are stars already aren't contracted once more to see that nothing changes."""
    from haruspex.llm import common, graph

    cuts, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: cuts.append(1) or cut(df))
    edges = [(7, k) for k in range(8, 40)] + [(50, 41), (41, 60), (3, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {7: 7, 41: 41, 50: 41, 60: 41} | {k: 7 for k in range(8, 40)} and len(cuts) == 1
    cuts.clear()
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame([(1, 3), (2, 3), (5, 4)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} and len(cuts) == 2


def test_training_holds_its_entries_once():
    """The driver's memory in training: at most 50 bytes an entry beyond the rows that were collected."""
    import tracemalloc

    import numpy as np

    from haruspex.llm import linear

    rng, n = np.random.default_rng(4), 5000
    rows = [(k, k % 2, rng.choice(linear.FAMILIES << linear.BITS, n, replace=False).astype(np.int32), np.full(n, 1 / n, np.float32)) for k in range(240)]
    tracemalloc.start()
    linear.train(rows, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * 240 * n
