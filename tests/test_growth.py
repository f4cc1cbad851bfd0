"""What the large tables pay for: moved columns, scans, joins and the size of compiled steps."""

import re

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import profile as P
from tallyglass.plans import cuts, selection
from workload import queries as W
from workload import queries_stats  # noqa: F401  (registers its queries on import)
from workload import views as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_values_of_a_number_move_alone(spark):
    df = spark.range(60).select((F.col("id") % 7).alias("a"), (F.col("id") / 4).alias("b"))
    found = P.distinct_counts(df)
    moved = re.findall(r"hashpartitioning\((.*?), \d+\)", plan(found))
    assert len(moved) == 2 and all(re.fullmatch(r"v#\d+L", k) for k in moved)
    assert sorted(tuple(r) for r in found.collect()) == [(0, "a", 7), (1, "b", 60)]


def test_distinct_counts_where_columns_share_scans(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_SCANS", 2)
    df = spark.createDataFrame(
        [(0.0, None, "x", 1), (-0.0, None, "y", 1), (float("nan"), None, "x", 2), (1.5, None, None, 3)], "a double, b string, c string, d int"
    )
    assert sorted(tuple(r) for r in P.distinct_counts(df).collect()) == [(0, "a", 2), (1, "b", 0), (2, "c", 2), (3, "d", 3)]


def test_staged_sales_write_stored_columns_alone(spark, data, monkeypatch):
    written = []
    monkeypatch.setattr(W, "stage", lambda df, tag: written.append(df) or df)
    got = W.staged_sales(spark, data, "profit", "cost", "sales")
    assert written[0].columns == ["l_extendedprice", "l_tax"] and got.columns == ["profit", "cost", "sales"]
    want = V.sales(spark, data).select("profit", "cost", "sales")
    assert not got.exceptAll(want).count() and not want.exceptAll(got).count()


def test_lines_are_joined_twice(spark, data):
    lines = [s for s in V.sales(spark, data)._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in s or "l_extendedprice" in s]
    above = lines[: next(i for i, s in enumerate(lines) if "Relation" in s)]
    assert sum("Join" in s for s in above) == 2


@pytest.mark.parametrize("name", ["summary_facts", "recommendations"])
def test_reports_join_their_tables_once(spark, data, monkeypatch, name):
    joined, whole = [], V.stored_sales
    monkeypatch.setattr(V, "stored_sales", lambda *a: joined.append(1) or whole(*a))
    W.QUERIES[name](spark, data)
    assert len(joined) == 1


def test_quantiles_where_sketches_are_coarse(spark, monkeypatch):
    monkeypatch.setattr(selection, "GRID_SKETCH", 8)
    monkeypatch.setattr(selection, "FINAL_ROWS", 50)
    df = spark.range(5001).select(((F.col("id") * 7919) % 5001).cast("double").alias("x"))
    assert selection.exact_quantiles(df, {"x": [0.25, 0.5, 0.75]}) == {"x": [1250.0, 2500.0, 3750.0]}


def test_places_of_rows_between_pivots(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "a"), (None, "a"), (None, None)], "k int, s string")
    kinds, keys = [f.dataType for f in df.schema], [F.col("k"), F.col("s")]
    key = cuts._struct(keys, [c.isNull() for c in keys])
    cut = cuts._Cut(3, 6, 6, pivots=((F.lit(1), F.lit("b")), (None, F.lit("a"))), hi=(None, None))
    assert [r[0] for r in df.select(cuts._place(F.col("k"), key, cut, kinds)).collect()] == [0, 1, 2, 2, 3, -1]
