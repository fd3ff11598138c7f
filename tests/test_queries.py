"""Every query against its SQL over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from foliant.plans import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def rows(f: pd.DataFrame) -> list:
    f = f[sorted(f.columns)]
    return sorted(tuple("~" if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in f.itertuples(index=False))


@pytest.mark.parametrize("name", ["document_line_stats", "document_normalize", "line_kinds"])
def test_documents_of_many_scripts(spark, name):
    """The larger table has lines that the smallest has none of."""
    larger = D.replace("0.001", "0.01")
    got, want = QUERIES[name](spark, larger).toPandas(), duckdb.sql(ORACLES[name].replace("FROM documents", f"FROM '{larger}/documents.parquet'")).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["book_quality", "book_gate"])
def test_some_books_pass(spark, name):
    assert {r.needs_attention for r in QUERIES[name](spark, D).collect()} == {True, False}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, D).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
