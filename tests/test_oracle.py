"""Round trip at scale: every registered query equals its DuckDB oracle on
the corpus rendered from the sf0.001 tables (order-insensitive)."""
import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["repo", "path", "n_refs", "n_contexts", "n_calls"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = queries()[name](spark, SF)
    res = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == sorted(sdf.columns)
    assert _norm([tuple(r) for r in sdf.collect()], sdf.columns) == _norm(res.fetchall(), ocols)


def test_every_query_has_a_result_schema(spark):
    for name, fn in queries().items():
        assert fn(spark, SF).columns, name


def test_every_query_has_an_oracle():
    plain = {q for q in queries() if not q.startswith("op") and q != "pipeline"}
    assert plain == {q for q in oracle_sql() if not q.startswith("op") and q != "pipeline"}
