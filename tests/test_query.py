import pytest
from pyspark.sql import functions as F

from tallyglass.functions import humanize
from tallyglass.operators import query as Q
from tallyglass.operators import questions as QU


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [("North", "a", 10.0), ("north", "b", 20.0), ("South", "a", None), ("South", "b", 5.0), (None, "a", 7.0), ("East", "a", float("nan"))],
        "region string, kind string, amount double",
    )


def test_filters(sales, rows):
    assert Q.filter_in(sales, {"region": ["North", "South"], "kind": ["a"]}).count() == 2
    assert Q.filter_in(sales, {"region": []}).count() == 6
    assert Q.filter_eq_ci(sales, "region", "NORTH").count() == 2
    assert Q.filter_cmp(sales, "amount", "greater", 7).count() == 2
    assert Q.filter_cmp(sales, "amount", "less", 7).count() == 1


@pytest.mark.parametrize(
    "agg, total, south",
    [("sum", 42.0, 5.0), ("average", 10.5, 5.0), ("max", 20.0, 5.0), ("min", 5.0, 5.0), ("count", 4, 1), ("median", 8.5, 5.0)],
)
def test_aggregates(sales, rows, agg, total, south):
    assert rows(Q.aggregate(sales, "amount", agg)) == [(total,)]
    groups = dict(rows(Q.aggregate(sales, "amount", agg, "region")))
    assert set(groups) == {"North", "north", "South", "East"}
    assert groups["South"] == south
    assert groups["East"] == {"sum": 0.0, "count": 0}.get(agg)


def test_sum_of_nothing_is_zero(sales, rows):
    assert rows(Q.aggregate(sales.limit(0), "amount", "sum")) == [(0.0,)]
    assert rows(Q.aggregate(sales.limit(0), "amount", "median")) == [(None,)]


def test_order_limit_and_ties(spark, rows):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5), ("d", 0)], "k string, v int")
    assert rows(Q.aggregate(df, "v", "sum", "k", order="desc", limit=3)) == [("c", 5), ("a", 1), ("b", 1)]
    assert rows(Q.aggregate(df, "v", "sum", "k", order="asc", limit=2)) == [("d", 0), ("a", 1)]
    assert rows(Q.aggregate(df, "v", "sum", "k", filters={"k": "A"})) == [("a", 1)]
    assert rows(Q.leader_laggard(df, "v", "sum", "k")) == [("c", 5, "d", 0)]
    assert rows(Q.leader_laggard(df.filter("k in ('a', 'b')"), "v", "sum", "k")) == [("a", 1, "a", 1)]


def test_breakdown_and_pivot(spark, rows):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0), ("c", None, 4.0)], "k string, s string, v double")
    assert rows(Q.category_breakdown(df, "k", "v", share=True)) == [("b", 1.0, 0.125), ("a", 3.0, 0.375), ("c", 4.0, 0.5)]
    assert sorted(rows(Q.pivot_mean(df, "s", "k", "v"))) == [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0)]
    wide = Q.pivot_mean(df, "s", "k", "v", wide=True).orderBy("k")
    assert wide.columns == ["k", "x", "y"] and rows(wide) == [("a", 1.0, 2.0), ("b", 1.0, None)]


@pytest.mark.parametrize(
    "value, text",
    [
        (None, "N/A"), (float("nan"), "N/A"), (0.0, "0.00"), (999.994, "999.99"), (999.999, "1,000.00"), (-999.996, "-1,000.00"), (999999.999, "1000.00K"), (1000.0, "1.00K"), (-1500.0, "-1.50K"),
        (2.5e6, "2.50M"), (7.891e9, "7.89B"), (3125.0, "3.12K"), (2.675, "2.67"), (0.125, "0.12"), (1.005, "1.00"), (-0.5, "-0.50"),
    ],
)
def test_humanize(spark, value, text):
    assert spark.createDataFrame([(value,)], "x double").select(humanize(F.col("x"))).first()[0] == text


COLUMNS = ["date", "sales", "quantity", "category", "region", "segment", "profit_margin", "profit", "revenue", "cost"]


@pytest.mark.parametrize(
    "term, column",
    [
        ("Region", "region"), ("regions", "region"), ("margin", "profit_margin"), ("income", "revenue"), ("earnings", "profit_margin"),
        ("qty", "quantity"), ("zone", "region"), ("group", "category"), ("nonsense", None), (" ", None), (None, None), ("volume", "quantity"),
    ],
)
def test_find_column(spark, term, column):
    df = spark.createDataFrame([(term,)], "t string")
    assert QU.match_columns(df, "t", COLUMNS).first()["matched"] == column


@pytest.mark.parametrize(
    "text, want",
    [
        ("Total sales by region", dict(intent="aggregate", aggregation="sum", metric="sales", groupby="region")),
        ("Average profit by category", dict(intent="aggregate", aggregation="average", groupby="category")),
        ("Trend of sales over time", dict(intent="trend", metric="sales")),
        ("Compare sales and profit", dict(intent="correlation", metric="sales")),
        ("Correlation between price and quantity", dict(intent="correlation", metric="cost", metric2="quantity")),
        ("Total sales where region is North by category", dict(filter_column="region", filter_value="north", groupby="category")),
        ("Top 5 regions by revenue", dict(intent="aggregate", aggregation="sum", metric="revenue", groupby="region", row_limit=5, sort_order="desc")),
        ("bottom 3 regions by cost", dict(metric="cost", row_limit=3, sort_order="asc")),
        ("Identify anomalies and outliers", dict(intent="anomaly")),
        ("What are the key insights from this data?", dict(intent="insight")),
        ("Values that remain", dict(intent=None)),
        ("Predict revenue", dict(intent="forecast", metric="revenue")),
        ("distribution of cost", dict(intent="distribution", metric="cost")),
    ],
)
def test_question_tags(spark, text, want):
    got = QU.tag_questions(spark.createDataFrame([(text,)], "text string"), COLUMNS).first().asDict()
    assert {k: got[k] for k in want} == want


def test_question_filters(spark, rows):
    asked = [
        (1, "Revenue by region where quantity > 10"),
        (2, "sales with profit greater than 2.5 and cost under 7"),
        (3, "where segment is north by region"),
        (4, "quantity is over 3, quantity <= 9"),
        (5, "weather above 30"),
        (6, "turnover 5"),
        (7, ""),
        (8, None),
    ]
    df = spark.createDataFrame(asked, "id int, text string")
    got = sorted(rows(QU.question_filters(df, ["revenue", "profit", "cost", "quantity", "segment"]), "id", "filter_column", "operator", "value"))
    assert got == [
        (1, "quantity", ">", "10"),
        (2, "cost", "<", "7"),
        (2, "profit", ">", "2.5"),
        (3, "segment", "=", "north"),
        (4, "quantity", "<=", "9"),
        (4, "quantity", ">", "3"),
    ]
