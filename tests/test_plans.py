"""Plans: what reaches the scan, where Python runs, and what one task may be handed."""

import re

import pytest

import __spark_entry__ as entry_module
from tallyglass.operators import insights as I
from tallyglass.operators import query as Q
from tallyglass.operators import series as S
from tallyglass.operators import stats as A
from workload import views as V
from workload.queries import ORACLES, QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    got = entry_module.entry(spark).collect()
    assert 0 < len(got) <= 5 and got[0]["revenue"] >= got[-1]["revenue"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) - set(ORACLES) == {"forecast_fourier", "forecast_fourier_components"}


def test_columns_and_filters_reach_the_scan(spark, data):
    df = Q.aggregate(Q.filter_cmp(V.table(spark, data, "lineitem"), "l_quantity", "greater", 40), "l_tax", "sum", "l_returnflag")
    text = df._jdf.queryExecution().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_quantity", "l_tax", "l_returnflag"}
    assert "GreaterThan(l_quantity,40.0)" in text


def test_positional_cuts_are_filters_without_a_shuffle_of_rows(spark, data):
    df = V.table(spark, data, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    text = plan(S.trend_measures(df, ["l_quantity"], order))
    assert "Window" not in text and "Sort" not in text
    assert re.findall(r"Exchange (\w+)", text) in ([], ["SinglePartition"])
    assert "partial_avg" in text


def test_no_python_outside_the_fourier_fit(spark, data):
    for name in ("clean_table", "tag_questions", "change_drivers", "ttest_insight", "forecast", "histogram", "drill_down"):
        text = plan(QUERIES[name](spark, data))
        assert "Python" not in text and "InPandas" not in text and "Cartesian" not in text, name
    assert "FlatMapGroupsInPandas" in plan(QUERIES["forecast_fourier"](spark, data))


def test_insights_have_no_cross_join(spark, data):
    df = V.events(spark, data)
    roles = I.Roles(("value", "user_id"), ("event_type",), "ts")
    text = plan(I.all_insights(df, V.EVENT_ORDER, roles, staged=False))
    assert "Cartesian" not in text


def test_results_do_not_depend_on_partitions(spark, data):
    df = V.events(spark, data)
    want = None
    for parts in (1, 5):
        got = A.performance_gap_insight(df.repartition(parts), ["event_type"], ["value"], 0.0).select("leader", "laggard").collect()
        assert want is None or got == want
        want = got


@pytest.mark.parametrize("name", ["aggregate_sum_by", "trend_insight", "tag_questions", "drill_down", "quality_score", "forecast_by_type"])
def test_queries_equal_their_sql(spark, data, name):
    from check import compare, connect

    ok, note = compare(spark, connect(data), data, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_distinct_rows_move_as_digests(spark):
    """Of a text column only hashes are shuffled."""
    from tallyglass.operators import profile as P

    rows = [("a", None, 0.0), ("a", None, -0.0), (None, "a", 0.0), ("a", "", 1.0), ("", "a", 1.0), ("ab", "c", float("nan")), ("a", "bc", float("nan"))]
    df = spark.createDataFrame(rows, "a string, b string, x double")
    assert P.quality_score(df).first()["duplicate_rows"] == len(rows) - df.distinct().count()
    text = plan(P.quality_score(df))
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+L, (\w+)#", text) == [("h1", "h2")]
    assert text.count("Exchange hashpartitioning") == 1


def test_the_monotonic_check_moves_rows_once(spark, data):
    from tallyglass.operators import profile as P

    text = plan(P.is_monotonic(V.table(spark, data, "lineitem"), ["l_quantity", "l_orderkey"], ["l_orderkey", "l_linenumber"]))
    assert len(re.findall(r"Exchange rangepartitioning", text)) == 1 and "Exchange hashpartitioning" not in text and "Window" not in text
