"""Every catalogue query against its DuckDB statement on sf0.001 (the
driver's check, at the smallest scale)."""

import duckdb
import pytest

import __spark_entry__ as E
from codesim.plans import catalogue, oracle

from .conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for r in pdf[cols].itertuples(index=False):
        out.append(tuple(round(v, 6) if isinstance(v, float) else (v.item() if hasattr(v, "item") else v)
                         for v in r))
    return cols, sorted(out, key=repr)


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(oracle.sqls())
    assert set(catalogue.QUERIES) <= set(E.queries()) and set(oracle.sqls()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF001).toPandas()
    db = con.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(db)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["id_a", "id_b"] and df.count() >= 0
