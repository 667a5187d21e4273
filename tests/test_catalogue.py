"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from haruspex.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(frame, cols):
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, sf_dir, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalogue.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert _rows(got, cols) == _rows(want, cols)


@pytest.mark.parametrize("name", ["monte_carlo_moments", "environment_contour", "bootstrap_means", "linear_oscillator", "duffing_oscillator"])
def test_query_without_sql_repeats(spark, sf_dir, name):
    a, b = (catalogue.QUERIES[name](spark, sf_dir).toPandas() for _ in range(2))
    assert len(a) and _rows(a, sorted(a.columns)) == _rows(b, sorted(b.columns))


@pytest.mark.parametrize("name", ["linear_oscillator", "duffing_oscillator", "surge_response"])
def test_sea_queries_read_every_supplier(spark, name):
    sf = "/root/testdata/sf0.01"
    want = {(r[0], k) for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect() for k in (1, 2)}
    assert len(want) > 20 and {(r["sample_id"], r["seed_id"]) for r in catalogue.QUERIES[name](spark, sf).collect()} == want
