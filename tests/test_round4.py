"""Queries on made-up tables, against their SQL."""

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from test_queries import D, rows

from foliant.operators import folding, layout
from foliant.plans import ORACLES, QUERIES


def books(folder, orders: list[tuple[int, int]], items: list[tuple[int, int, int, int]]) -> str:
    """Tables of orders (book, order) and items (order, line, part, supplier); parts are 1..40."""
    held = {
        "orders": pd.DataFrame(orders, columns=["o_custkey", "o_orderkey"]),
        "lineitem": pd.DataFrame(items, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).assign(l_shipdate=pd.Timestamp("2020-01-01")),
        "part": pd.DataFrame({"p_partkey": range(1, 41), "p_name": [f"tin box {k}" for k in range(1, 41)], "p_size": range(1, 41)}),
    }
    for name, table in held.items():
        table.astype({c: "int64" for c in table.columns if table[c].dtype.kind in "iu"}).to_parquet(f"{folder}/{name}.parquet", index=False)
    return str(folder)


def both(spark, d: str, name: str) -> tuple[list, list]:
    c = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return rows(QUERIES[name](spark, d).toPandas()), rows(c.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["book_quality", "book_gate"])
def test_last_sections_without_text(spark, tmp_path, name):
    """A book whose last section has no text, one that has nothing else, and one with all texts."""
    orders = [(1, k) for k in range(1, 9)] + [(2, 20), (2, 21)] + [(3, k) for k in range(31, 39)]
    items = [(k, n, 1 + n % 2 * 12, 12) for _, k in orders if k not in (8, 20, 21) for n in range(1, 5)]
    got, want = both(spark, books(tmp_path, orders, items), name)
    assert got == want
    if name == "book_quality":
        assert len(got) == 2


def passes(df) -> int:
    """How often rows go through Python."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_words_go_through_python_once(spark):
    """Words to lines, and blocks to sections: two passes."""
    assert passes(QUERIES["extracted_sections"](spark, D)) == 2


def test_groups_are_turned_whole(monkeypatch):
    monkeypatch.setattr(folding, "AT_ONCE", 3)
    groups = [[], [{"k": 1, "x": 0.5, "t": "a", "b": True, "l": [1]}], [{"k": k, "x": None, "t": None, "b": None, "l": None} for k in range(5)], [], [{"k": None, "x": 2.0, "t": "ü", "b": False, "l": []}]]
    column = pa.array([[], *groups], pa.list_(pa.struct([("k", pa.int64()), ("x", pa.float64()), ("t", pa.string()), ("b", pa.bool_()), ("l", pa.list_(pa.int64()))]))).slice(1)
    assert list(folding._lists(column, False)) == groups
    assert list(folding._lists(column, True)) == [[tuple(r.values()) for r in g] for g in groups]


def test_words_of_one_height_and_words_upside_down(spark):
    """Words as high as the one before join its line; those whose top is below their bottom touch none, not even themselves."""
    words = [(1, 10.0, 20.0, 10.0, "b"), (1, 5.0, 20.0, 10.0, "a"), (1, 20.0, 19.0, 9.0, "c"), (1, 5.0, 1.0, 4.0, "x"), (1, 6.0, 1.0, 4.0, "y")]
    got = layout.group_lines(spark.createDataFrame(words, "page_id long, left double, top double, bottom double, text string")).collect()
    assert [(r.line, r.text, r.top, r.bottom, r.n_words) for r in sorted(got, key=lambda r: r.line)] == [(0, "a b c", 20.0, 9.0, 3), (1, "x", 1.0, 4.0, 1), (2, "y", 1.0, 4.0, 1)]


def test_books_go_through_python_three_times(spark):
    """Headers, lost sections, shifted ones: each book's blocks are folded once."""
    assert passes(QUERIES["parsed_books"](spark, D)) == 3
