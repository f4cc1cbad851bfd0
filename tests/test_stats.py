import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import t_two_sided_p
from tallyglass.operators import insights as I
from tallyglass.operators import narratives as N
from tallyglass.operators import stats as A
from tallyglass.operators.roles import Roles


@pytest.mark.parametrize(
    "t, dof, p",
    # Published two-sided critical values.
    [(2.0017, 58, 0.05), (2.6633, 58, 0.01), (1.9840, 100, 0.05), (2.6259, 100, 0.01), (3.3905, 100, 0.001), (1.9600, 10**9, 0.05), (0.0, 60, 1.0)],
)
def test_p_values(spark, t, dof, p):
    got = spark.range(1).select(t_two_sided_p(F.lit(float(t)), F.lit(float(dof)))).first()[0]
    assert got == pytest.approx(p, rel=2e-4)
    assert spark.range(1).select(t_two_sided_p(F.lit(-float(t)), F.lit(float(dof)))).first()[0] == got


def test_correlations_match_pandas_with_and_without_gaps(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf["e"] = 1.0
    pdf.loc[::7, "c"] = np.nan
    pdf["a"] += 1e6
    got = {(r["col1"], r["col2"]): r["r"] for r in A.correlation_matrix(spark.createDataFrame(pdf), full=True).collect()}
    want = pdf.corr()
    for x in pdf.columns:
        for y in pdf.columns:
            if "e" in (x, y):
                assert got[x, y] is None or x == y
            else:
                assert got[x, y] == pytest.approx(want.loc[x, y], abs=1e-9)
    one = A.correlation(spark.createDataFrame(pdf), "a", "b").first()
    assert one["r"] == pytest.approx(want.loc["a", "b"]) and one["strength"] == "strong"


def test_many_columns_with_gaps_take_two_scans(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(size=(400, 40)) + rng.normal(size=(400, 1)) + 1e4
    values[rng.random(values.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(values, columns=[f"c{k}" for k in range(40)])
    matrix = A.correlation_matrix(spark.createDataFrame(pdf).repartition(5))
    want = pdf.corr()
    got = matrix.collect()
    assert len(got) == 40 * 39 // 2
    assert max(abs(r["r"] - want.loc[r["col1"], r["col2"]]) for r in got) < 1e-9
    assert matrix._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_correlation_of_pairs_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, 2.0), (None, 3.0, 2.5), (None, 4.0, 9.0)], "a double, b double, c double")
    got = {(r["col1"], r["col2"]): r["r"] for r in A.correlation_matrix(df).collect()}
    # c is constant where a is known
    assert got == {("a", "b"): None, ("a", "c"): None, ("b", "c"): pytest.approx(1.0)}
    assert [r["r"] for r in A.correlation_matrix(df.limit(0)).collect()] == [None] * 3
    assert A.correlation_matrix(df.select("a")).count() == 0


def test_correlation_thresholds(spark):
    xs = list(range(100))
    df = spark.createDataFrame([(float(x), float(-x), float((x * 37) % 100)) for x in xs], "a double, b double, c double")
    got = A.correlation_insight(df).collect()
    assert [(r["metric"], r["title"], r["priority"]) for r in got] == [("a_vs_b", "Strong Negative Correlation", "high")]
    assert got[0]["description"] == "A ↔ B (r=-1.000)"


@pytest.mark.parametrize("spikes, fires, priority", [(3, False, None), (4, True, "medium"), (9, True, "high")])
def test_anomaly_thresholds(spark, spikes, fires, priority):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100 - spikes)] + [(500.0,)] * spikes, "unit_price double")
    got = A.anomaly_insight(df).collect()
    assert bool(got) == fires
    assert A.anomaly_rows(df, "unit_price").count() == spikes
    if fires:
        assert got[0]["priority"] == priority
        assert got[0]["title"] == "Anomalies Detected in Unit Price"
        assert got[0]["description"] == f"{spikes} outliers ({spikes}.0% of data)"
    empty = df.filter("unit_price is null")
    assert A.anomaly_rows(empty, "unit_price").count() == 0 and A.anomaly_insight(empty).count() == 0


def test_distribution_and_histogram(spark):
    values = [1.0] * 90 + [100.0] * 10
    df = spark.createDataFrame([(v,) for v in values], "x double")
    s = A.distribution_summary(df, "x").first()
    assert s["skewness"] == pytest.approx(pd.Series(values).skew()) and s["shape"] == "right-skewed" and s["median"] == 1
    assert A.distribution_insight(df).first()["priority"] == "low"
    bins = A.histogram(df, "x", 10).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [90] + [0] * 8 + [10]
    assert bins[-1]["bin_end"] == pytest.approx(100)
    flat = A.histogram(df.filter("x = 1"), "x", 5).orderBy("bin").collect()
    assert [b["count"] for b in flat] == [90, 0, 0, 0, 0]
    assert A.histogram(df.filter("x < 0"), "x").count() == 0


@pytest.mark.parametrize("best, fires, priority", [(12.5, False, None), (12.6, True, "medium"), (15.1, True, "high")])
def test_gap_thresholds(spark, best, fires, priority):
    df = spark.createDataFrame([("a", best), ("b", 10.0), ("b", 10.0), (None, 900.0)], "k string, v double")
    got = A.performance_gap_insight(df, ["k"], ["v"]).collect()
    assert bool(got) == fires
    if fires:
        assert (got[0]["leader"], got[0]["laggard"], got[0]["priority"]) == ("a", "b", priority)
    assert A.performance_gap_insight(df.filter("k = 'a'"), ["k"], ["v"], 0.0).count() == 0


def _groups(spark, n1, n2, shift, hole=False):
    rows = [("a", float(i % 5)) for i in range(n1)] + [("b", float(i % 5) + shift) for i in range(n2)] + [("c", 1000.0)] * 40
    if hole:
        rows[0] = ("a", None)
    return spark.createDataFrame(rows, "g string, v double")


def test_ttest_against_the_textbook_formula(spark):
    df = _groups(spark, 40, 50, 0.5)
    got = A.ttest_measures(df, "g", ["v"]).first()
    a = np.array([i % 5 for i in range(40)], float)
    b = np.array([i % 5 for i in range(50)], float) + 0.5
    pooled = (39 * a.var(ddof=1) + 49 * b.var(ddof=1)) / 88
    assert (got["group1"], got["group2"], got["dof"]) == ("a", "b", 88)
    assert got["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(pooled * (1 / 40 + 1 / 50)))


@pytest.mark.parametrize("n1, hole, fires", [(29, False, False), (30, False, True), (30, True, False)])
def test_ttest_needs_thirty_complete_rows(spark, n1, hole, fires):
    got = A.ttest_insight(_groups(spark, n1, 30, 5.0, hole), "g", ["v"]).collect()
    assert bool(got) == fires
    if fires:
        assert got[0]["priority"] == "high" and got[0]["metric"] == "g_v_ttest"
        assert got[0]["description"].startswith("b vs a: 250.0% difference (p=0.0000)")


def test_ttest_with_named_groups_and_a_single_group(spark):
    df = _groups(spark, 30, 30, 0.0)
    assert A.ttest_measures(df, "g", ["v"], ["b", "a"]).first()["group1"] == "b"
    assert A.ttest_insight(df.filter("g = 'a'"), "g", ["v"], alpha=1.1).count() == 0


def test_lines(spark):
    df = spark.createDataFrame([("u", float(x), 2.0 * x + 1) for x in range(5)] + [("w", float(x), -x * 1.0) for x in range(5)] + [("u", None, 1.0)], "k string, x double, y double")
    got = {r["k"]: r for r in A.ols_line(df, "x", "y", "k").collect()}
    assert got["u"]["slope"] == pytest.approx(2) and got["u"]["intercept"] == pytest.approx(1) and got["u"]["n"] == 5
    assert got["w"]["slope"] == pytest.approx(-1) and got["w"]["r2"] == pytest.approx(1)


# --- Insight tables ---


@pytest.fixture(scope="module")
def shop(spark):
    rows = []
    for i in range(1200):
        weekend = i % 7 >= 5
        region = ("East", "West", "North")[i % 3]
        value = (10.0 + (20 if weekend else 0)) * (1.0 if i < 600 else 2.0) * (3.0 if region == "East" else 1.0)
        rows.append((i, region, "web" if i % 2 else "shop", value, value * 0.5 + (i % 3)))
    df = spark.createDataFrame(rows, "i long, region string, channel string, sales double, cost double")
    return df.withColumn("date", (F.lit("2022-01-01").cast("date") + F.col("i").cast("int")).cast("timestamp_ntz"))


ROLES = Roles(("sales", "cost"), ("region", "channel"), "date")


@pytest.fixture(scope="module")
def found(shop):
    return I.all_insights(shop, ["date", "i"], ROLES).toPandas()


def test_all_insights_in_order(found):
    assert list(found["seq"]) == list(range(1, len(found) + 1))
    kinds = list(dict.fromkeys(found["type"]))
    order = ["trend", "trend_weekly", "correlation", "anomaly", "performance_gap", "distribution", "statistical_test", "seasonality"]
    assert kinds == [k for k in order if k in kinds] and {"trend", "correlation", "performance_gap"} <= set(kinds)
    assert found["narrative"].notna().all() and found["title"].notna().all() and found["description"].notna().all()
    trend = found[found["type"] == "trend"].iloc[0]
    assert trend["metric"] == "sales" and trend["value"] == pytest.approx(100, abs=8) and trend["priority"] == "high"
    assert "significantly increased" in trend["narrative"] and "Main drivers: strong performance in region" in trend["narrative"]


def test_insights_do_not_depend_on_the_layout(shop, found):
    again = I.all_insights(shop.repartition(7, "i"), ["date", "i"], ROLES, staged=False).toPandas()
    assert list(again["title"]) == list(found["title"])
    assert np.allclose(again["value"], found["value"], rtol=1e-9)


def test_findings_recommendations_and_facts(spark, shop, found):
    insights = spark.createDataFrame(found)
    critical = I.critical_findings(insights, 2).toPandas()
    assert list(critical["seq"]) == list(found[found["priority"] == "high"]["seq"][:2])
    assert I.by_priority(insights, "medium").count() == (found["priority"] == "medium").sum()
    advice = [r["title"] for r in I.recommendations(insights, shop, ROLES).orderBy("seq").collect()]
    assert advice[-2:] == ["Enable Time Series Forecasting", "Perform Cross-Segment Analysis"]
    assert "Leverage Correlation for Prediction" in advice
    few = [r["title"] for r in I.recommendations(insights.limit(0), shop.limit(1000), ROLES).collect()]
    assert few == ["Perform Cross-Segment Analysis"]
    facts = I.summary_facts(shop, insights, "date").first()
    assert (facts["n_rows"], facts["n_columns"], facts["n_insights"]) == (1200, 6, len(found))
    assert facts["min_date"] == "January 01, 2022" and facts["n_critical"] == (found["priority"] == "high").sum()


@pytest.mark.parametrize("value, word", [(25.1, "significantly"), (25.0, "moderately"), (10.0, "slightly"), (-30.0, "significantly decreased")])
def test_trend_words(spark, value, word):
    df = spark.createDataFrame([("unit_cost", value)], "metric string, value double")
    text = N.narrate_trend(df).first()["narrative"]
    assert word in text and text.startswith("Unit Cost has")
    assert ("Look into" in text) == (value < -15) and ("repeat it" in text) == (value > 20)


@pytest.mark.parametrize("value, word", [(10.1, "concerning"), (10.0, "notable"), (5.0, "minor")])
def test_anomaly_words(spark, value, word):
    df = spark.createDataFrame([("m", value, 1234)], "metric string, value double, outliers long")
    assert word in N.narrate_anomaly(df).first()["narrative"] and "1,234 records" in N.narrate_anomaly(df).first()["narrative"]
