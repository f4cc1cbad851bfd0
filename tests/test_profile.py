import pandas as pd
import pytest

from tallyglass.operators import profile as P
from tallyglass.operators import semantic as M
from tallyglass.sources.catalog import Catalog, Metric


@pytest.fixture
def mixed():
    return pd.DataFrame(
        {
            "order_date": pd.date_range("2024-01-01", periods=40),
            "code": [f"c{i}" for i in range(40)],
            "margin": [0.1 * (i % 5) for i in range(40)],
            "amount": [float(i * i) for i in range(39)] + [None],
            "flat": [1.0] * 40,
            "kind": ["a", "b"] * 20,
        }
    )


def test_profile_matches_pandas(spark, mixed):
    got = P.data_profile(spark.createDataFrame(mixed)).toPandas().set_index("name")
    for c in mixed.columns:
        assert got.loc[c, "null_count"] == mixed[c].isna().sum()
        assert got.loc[c, "unique_count"] == mixed[c].nunique()
    for c in ("margin", "amount", "flat"):
        want = {"mean": mixed[c].mean(), "std": mixed[c].std(), "skewness": mixed[c].skew(), "kurtosis": mixed[c].kurtosis()}
        for k, v in want.items():
            assert got.loc[c, k] == pytest.approx(v, rel=1e-9, abs=1e-9), (c, k)
    assert got.loc["kind", "mean"] is None or pd.isna(got.loc["kind", "mean"])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_moments_of_short_columns(spark, n):
    pdf = pd.DataFrame({"x": pd.Series([1.0, 2.0, 4.0, 9.0][:n], dtype=float)})
    got = P.data_profile(spark.createDataFrame(pdf, "x double")).first()
    for name, want in (("skewness", pdf["x"].skew()), ("kurtosis", pdf["x"].kurtosis()), ("std", pdf["x"].std())):
        assert (got[name] is None) if pd.isna(want) else got[name] == pytest.approx(want)


def test_approximate_distinct_counts_are_close(spark):
    df = spark.range(20000).selectExpr("id", "id % 7 as few")
    got = {r["name"]: r["unique_count"] for r in P.distinct_counts(df, exact=False).collect()}
    assert abs(got["id"] - 20000) < 2000 and got["few"] == 7


def test_classes_and_kpis(spark, mixed):
    profile = M.classify_columns(P.column_profile(spark.createDataFrame(mixed), order_by=["order_date"]))
    roles = {r["name"]: r["role"] for r in profile.collect()}
    assert roles == {
        "order_date": "time", "code": "identifier", "margin": "rate", "amount": "measure", "flat": "dimension", "kind": "dimension",
    }
    assert [r["name"] for r in M.discover_kpis(profile).collect()] == ["amount"]
    monotonic = {r["name"]: r["monotonic"] for r in profile.collect()}
    assert monotonic["flat"] is True and monotonic["amount"] is False and monotonic["code"] is False


def test_quality_score_and_bands(spark, rows):
    df = spark.createDataFrame([(1, "5"), (1, "5"), (2, None), (3, "7")], "a int, b string")
    got = P.quality_band(P.quality_score(df)).first()
    assert got["completeness"] == pytest.approx(87.5)
    assert got["uniqueness"] == pytest.approx(75)
    assert got["consistency"] == 95
    assert got["overall"] == pytest.approx(87.5 * 0.4 + 75 * 0.3 + 95 * 0.3)
    assert (got["missing_cells"], got["duplicate_rows"], got["total_rows"], got["total_columns"]) == (1, 1, 4, 2)
    assert got["band"] == "good"
    scores = spark.createDataFrame([(90.0,), (89.9,), (70.0,), (69.9,)], "overall double")
    assert [r[1] for r in rows(P.quality_band(scores))] == ["excellent", "good", "good", "poor"]
    hollow = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert P.quality_score(hollow).first()["consistency"] == 95
    wide = spark.createDataFrame([tuple("1" * 25)], ", ".join(f"c{i} string" for i in range(25)))
    assert P.quality_score(wide).first()["consistency"] == 0


def test_issues_at_their_limits(spark):
    n = 100
    clean = [float(i % 10) for i in range(n)]
    nulls = [None] * 6 + clean[6:]
    few_nulls = [None] * 5 + clean[5:]
    spikes = [1000.0] * 6 + clean[6:]
    df = spark.createDataFrame(list(zip(clean, nulls, few_nulls, spikes)), "clean double, nulls double, few double, spikes double")
    got = {(r["name"], r["issue_type"]): r["issue"] for r in P.profile_issues(df).collect()}
    assert got == {
        ("nulls", "missing"): "High missing values in nulls (6.0%)",
        ("spikes", "skewness"): "High skewness in spikes",
        ("spikes", "outliers"): "6 outliers in spikes (6.0%)",
    }


def test_table_context_lists_the_smallest_categories(spark):
    df = spark.createDataFrame([(f"k{i:02d}", float(i)) for i in range(30)] + [(None, None)], "k string, v double")
    got = {r["name"]: r for r in P.table_context(df, 3).collect()}
    assert got["k"]["categories"] == ["k00", "k01", "k02"]
    assert (got["v"]["min"], got["v"]["max"], got["v"]["mean"]) == (0, 29, 14.5)


@pytest.mark.parametrize(
    "values, reason",
    [
        ([1.0] * 14, "Insufficient historical data"),
        ([1.0] * 15, "Forecast eligible"),
        ([0.0] * 20, "Zero mean series"),
        ([0.0] * 19 + [100.0], "Highly volatile series"),
        ([1.0] * 14 + [None], "Insufficient historical data"),
    ],
)
def test_forecast_eligibility(spark, values, reason):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "t int, v double")
    got = M.forecast_eligibility(df, "t", "v").first()
    assert got["reason"] == reason and got["eligible"] == (reason == "Forecast eligible")


def test_governed_metrics_and_drill_down(spark, rows):
    df = spark.createDataFrame([("e", "x", 1.0, 0.5), ("e", "y", 2.0, 0.1), ("w", "x", None, 0.3)], "r string, c string, v double, d double")
    catalog = Catalog(
        (Metric("Total", "v", "total"), Metric("Mean", "d", "median"), Metric("Gone", "gone")), hierarchies={"h": ("r", "c", "nowhere")}
    )
    got = {r["r"]: (r["Total"], r["Mean"]) for r in M.governed_metrics(df, catalog, ["r"]).collect()}
    assert got["e"] == (3.0, pytest.approx(0.3)) and got["w"] == (0.0, 0.3)
    levels = sorted((r["level"], r["r"] or "", r["c"] or "", r["Total"]) for r in M.drill_down(df, catalog, "h").collect())
    assert levels == [(0, "", "", 3.0), (1, "e", "", 3.0), (1, "w", "", 0.0), (2, "e", "x", 1.0), (2, "e", "y", 2.0), (2, "w", "x", 0.0)]
