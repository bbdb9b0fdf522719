"""Every query of the engine against the same in DuckDB SQL."""

import glob
import os

import duckdb
import pytest

from flowloom.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def table(columns, rows):
    """Columns by name and rows in an order of their own, as the two engines write values."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def text(v):
        return "null" if v is None else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert name in ORACLES
    got, want = QUERIES[name](spark, DATA), duck.execute(ORACLES[name])
    assert table(got.columns, got.collect()) == table([c[0] for c in want.description], want.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1500
    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())


def test_queries_are_pruned(spark):
    """The flagship's scans read only the columns it uses."""
    plan = QUERIES["fanout_order_revenue"](spark, DATA)._jdf.queryExecution().toString()
    assert "l_comment" not in plan and "l_tax" not in plan.split("Physical Plan")[-1]


def test_fan_out_node_doesn_t_shuffle(spark):
    """Instances are mapped inside the row: the only exchanges are those that build the input."""
    plan = QUERIES["fanout_count_mode"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
