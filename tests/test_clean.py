import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import clean as C
from tallyglass.operators import roles as R
from tallyglass.sources.catalog import Catalog, Metric


def test_symbols_numbers_and_dates(spark, rows):
    df = spark.createDataFrame(
        [(" ₹1,200 ", "5%", "2024-01-31", "a", None), ("₹3", "7.5%", "2024-02-29", "1", None), (None, None, None, None, None)],
        "money string, share string, day string, mixed string, nothing string",
    )
    got = C.clean_table(df)
    assert got.dtypes == [("money", "bigint"), ("share", "double"), ("day", "timestamp_ntz"), ("mixed", "string")]
    assert rows(got) == [
        (1200, 5.0, datetime.datetime(2024, 1, 31), "a"),
        (3, 7.5, datetime.datetime(2024, 2, 29), "1"),
    ]


def test_java_number_spellings_stay_text(spark):
    df = spark.createDataFrame([("1d",), ("2",)], "x string")
    assert C.promote_numeric(df).dtypes == [("x", "string")]
    assert C.promote_numeric(spark.createDataFrame([("1e3",), ("-.5",)], "x string")).dtypes == [("x", "double")]
    assert C.promote_numeric(spark.createDataFrame([(None,), ("",)], "x string")).dtypes == [("x", "string")]


def test_numbers_are_not_read_as_dates(spark):
    df = spark.createDataFrame([("2024",), ("2023",)], "x string")
    assert C.promote_timestamp(C.promote_numeric(df)).dtypes == [("x", "bigint")]


def test_named_dates_are_left_alone_on_failure(spark):
    df = spark.createDataFrame([("2024-01-01", "soon", "2024-01-01")], "order_date string, ship_time string, other string")
    assert dict(C.parse_named_dates(df).dtypes) == {"order_date": "timestamp_ntz", "ship_time": "string", "other": "string"}


VALUES = [1.0, 2.0, 2.0, 50.0, None, float("nan")]


@pytest.fixture
def holed(spark):
    return spark.createDataFrame([(i, v, "x" if i % 2 else None) for i, v in enumerate(VALUES)], "id int, v double, t string")


@pytest.mark.parametrize(
    "strategy, fill, text",
    [("mean", 13.75, None), ("median", 2.0, None), ("mode", 2.0, "x"), ("zero", 0.0, None), ("auto", 2.0, "x")],
)
def test_impute(holed, rows, strategy, fill, text):
    got = rows(C.impute(holed, strategy).orderBy("id"), "v", "t")
    assert [v for v, _ in got] == [1.0, 2.0, 2.0, 50.0, fill, fill]
    assert got[0][1] == text


def test_impute_drop_and_log(holed, rows):
    assert rows(C.impute(holed, "drop"), "id") == [(1,), (3,)]
    assert rows(C.impute_log(holed, "drop")) == [("v", 2, "drop rows"), ("t", 2, "drop rows")]
    assert rows(C.impute_log(holed, "auto")) == [("v", 2, "median"), ("t", 3, "mode")]
    assert rows(C.impute_log(holed, "mean", ["v"])) == [("v", 2, "mean")]


def test_impute_constant_for_an_empty_text_column(spark, rows):
    df = spark.createDataFrame([(None,), (None,)], "t string")
    assert rows(C.impute(df, "auto")) == [("Unknown",), ("Unknown",)]
    with pytest.raises(ValueError):
        C.impute(df, "magic")


def test_mean_of_whole_numbers_is_not_cut(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert rows(C.impute(df, "mean").orderBy("n")) == [(1.0,), (1.5,), (2.0,)]


def test_outliers_are_removed_column_after_column(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 5, 100.0, None], "b": [1, 1, 1, 1, 9, 1, 1.0]})
    kept = pdf.copy()
    for c in ("a", "b"):
        q1, q3 = kept[c].quantile([0.25, 0.75])
        kept = kept[(kept[c] >= q1 - 1.5 * (q3 - q1)) & (kept[c] <= q3 + 1.5 * (q3 - q1))]
    got = C.remove_outliers(spark.createDataFrame(pdf), "iqr").toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, kept.values))


def test_zscore_uses_the_population_spread(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    assert C.remove_outliers(df, "zscore", 1.9).count() == 4
    assert C.remove_outliers(df, "zscore", 2.01).count() == 5
    assert C.remove_outliers(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "zscore", 3).count() == 0


def test_date_features(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 12, 30),), (datetime.datetime(2023, 1, 1),)], "d timestamp_ntz")
    got = C.date_features(df).orderBy("d").collect()
    assert got[0].asDict() == {
        "d": datetime.datetime(2023, 1, 1), "year": 2023, "month": 1, "month_name": "January", "day_of_week": 6,
        "day_name": "Sunday", "is_weekend": 1, "quarter": 1, "week_of_year": 52,
    }
    assert (got[1]["week_of_year"], got[1]["day_of_week"], got[1]["is_weekend"]) == (1, 0, 0)


def test_roles(spark):
    df = spark.createDataFrame([("x", "2024-01-01", 1.0, 2)], "name string, day string, revenue double, n int")
    assert R.detect_date_column(df) == "day"
    assert R.numeric_columns(df) == ["revenue", "n"]
    assert R.categorical_columns(df) == ["name", "day"]
    assert R.detect_date_column(df.select("name", "n")) is None
    typed = df.withColumn("at", F.to_timestamp("day"))
    assert R.detect_date_column(typed.select("name", "at", "day")) == "at"
    late = spark.createDataFrame([(f"01/{k % 28 + 1:02d}/2024" if k < 150 else "no date", f"{k % 28 + 1:02d}.", f"{k % 12 + 1:02d}/28/1999") for k in range(300)], "a string, b string, c string")
    assert R.detect_date(late) == ("c", "MM/dd/yyyy")
    assert R.with_dates(late, "c").schema["c"].dataType.simpleString() == "timestamp_ntz"
    assert R.with_dates(late, "a").schema["a"].dataType.simpleString() == "string"
    catalog = Catalog((Metric("Revenue", "revenue"), Metric("Gone", "gone")), ("name", "nowhere"), "missing")
    found = R.resolve_schema(df, catalog)
    assert (found.numeric, found.categorical, found.date) == (("revenue",), ("name",), "day")
    empty = R.resolve_schema(df, Catalog())
    assert (empty.numeric, empty.categorical) == (("revenue", "n"), ("name", "day"))


@pytest.mark.parametrize(
    "fmt, fits, misfits",
    [
        ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", ["2024-01-02 03:04:05", "2024-01-02 03:04:05.6"], ["2024-01-02", "x"]),
        ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", ["2024-01-02T03:04:05"], ["2024-01-02 03:04:05"]),
        ("MM/dd/yyyy hh:mm[:ss] a", ["01/02/2024 03:04 PM", "01/02/2024 03:04:05 am"], ["01/02/2024 03:04"]),
        ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.1+02:00"], ["2024-01-02T03:04:05"]),
        ("yyyyMMdd", ["20240102"], ["2024-01-02"]),
        ("MMM d, yyyy", ["Jan 2, 2024", "Jan 12, 2024"], ["1 2, 2024"]),
    ],
)
def test_format_shapes(fmt, fits, misfits):
    import re

    shape = re.compile(C.format_shape(fmt))
    assert all(shape.match(t) for t in fits) and not any(shape.match(t) for t in misfits)
    assert C.format_shape("yyyy-MM-dd z") is None
