import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import forecast as FC
from tallyglass.sources.files import forecast_export

WEEK = np.array([3.0, -1.0, 0.0, 2.0, -4.0, 1.0, -1.0])


def signal(spark, n=140, keys=("a", "b")):
    rows = []
    for j, k in enumerate(keys):
        for i in range(n):
            day = datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
            rows.append((k, datetime.datetime(day.year, day.month, day.day, 5), float(100.0 * (j + 1) + 0.5 * i + WEEK[day.weekday()])))
    return spark.createDataFrame(rows, "k string, at timestamp_ntz, v double").repartition(6)


def test_forecast_recovers_line_and_week(spark):
    got = FC.forecast(signal(spark), "at", "v", 14, ["k"]).toPandas()
    future = got[(got["k"] == "b") & got["is_future"]].sort_values("ds")
    assert len(future) == 14 and len(got) == 2 * (140 + 14)
    want = [200 + 0.5 * (140 + i) + WEEK[d.weekday()] for i, d in enumerate(future["ds"])]
    assert np.allclose(future["yhat"], want, atol=0.2)
    assert (future["yhat_upper"] - future["yhat_lower"]).max() < 0.5
    assert future["ds"].iloc[0] == datetime.date(2024, 5, 20)


def test_single_series_summary_and_export(spark):
    rows = FC.forecast(signal(spark, keys=("a",)), "at", "v", 30)
    s = FC.forecast_summary(rows).first()
    future = rows.filter("is_future").toPandas()
    assert s["predicted_mean"] == pytest.approx(future["yhat"].mean())
    assert s["predicted_min"] == pytest.approx(future["yhat_lower"].min())
    assert s["trend_direction"] == "increasing"
    assert forecast_export(rows).columns == ["Date", "Forecast", "Lower", "Upper"]
    assert FC.forecast_components(rows).columns == ["ds", "trend", "weekly"]


def test_short_series(spark):
    one = spark.createDataFrame([(datetime.datetime(2024, 1, 1), 5.0)], "at timestamp_ntz, v double")
    got = FC.forecast(one, "at", "v", 3).orderBy("ds").collect()
    assert [r["yhat"] for r in got] == [5.0] * 4
    fitted = FC.forecast_fourier(one, "at", "v", 3).count()
    assert fitted == 4


def test_fourier_recovers_a_known_signal(spark):
    n = 800
    rows = []
    for i in range(n):
        day = datetime.datetime(2022, 1, 1) + datetime.timedelta(days=i)
        yearly = 20 * np.sin(2 * np.pi * i / 365.25)
        rows.append((day, float(500 + 0.3 * i + yearly + WEEK[day.weekday()])))
    df = spark.createDataFrame(rows, "at timestamp_ntz, v double")
    got = FC.forecast_fourier(df, "at", "v", 30).toPandas().sort_values("ds")
    assert {"trend", "yearly", "weekly"} <= set(got.columns)
    history, future = got[~got["is_future"]], got[got["is_future"]]
    assert np.abs(history["yhat"] - history["y"]).mean() < 1.5
    want = [500 + 0.3 * i + 20 * np.sin(2 * np.pi * i / 365.25) + WEEK[d.weekday()] for i, d in zip(range(n, n + 30), future["ds"])]
    assert np.abs(future["yhat"].to_numpy() - np.array(want)).mean() < 8
    plain = FC.forecast_fourier(df, "at", "v", 5, yearly=False, weekly=True)
    assert "yearly" not in plain.columns and plain.count() == n + 5


def test_fourier_per_key_and_daily_waves(spark):
    got = FC.forecast_fourier(signal(spark), "at", "v", 7, ["k"], yearly=False)
    assert {r["k"]: r["n"] for r in got.groupBy("k").agg(F.count("*").alias("n")).collect()} == {"a": 147, "b": 147}
    hourly = spark.range(24 * 20).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("at"),
        (10 + F.sin(F.col("id") * 2 * np.pi / 24)).alias("v"),
    )
    waves = FC.forecast_fourier(hourly, "at", "v", 2, yearly=False, weekly=False, daily=True).filter("not is_future").toPandas()
    assert np.abs(waves["yhat"] - waves["y"]).max() < 0.2


def plain_fourier(days, y, ahead, model):
    """The fit of one series at once, over the whole basis."""
    start, span, size = days.min(), max(days.max() - days.min(), 1.0), np.abs(y).max()
    known, later = (model.design((t - start) / span, t) for t in (days, ahead))
    weights = np.linalg.solve(known.T @ known + np.diag(model.penalty), known.T @ (y / size))
    return np.concatenate([known, later]) @ weights * size


def test_fourier_over_chunks_equals_the_fit_at_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, datetime.datetime(2021, 1, 1) + datetime.timedelta(days=i), float(v)) for k in "ab" for i, v in enumerate(rng.normal(50, 9, 500))]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, v double").repartition(5)
    monkeypatch.setattr(FC, "CHUNK_STEPS", 64)
    got = FC.forecast_fourier(df, "at", "v", 20, ["k"]).toPandas().sort_values(["k", "ds"])
    first = (datetime.date(2021, 1, 1) - datetime.date(1970, 1, 1)).days
    for k in "ab":
        y = np.array([v for x, _, v in rows if x == k])
        own = got[got["k"] == k]
        want = plain_fourier(first + np.arange(500.0), y, first + np.arange(500.0, 520.0), FC.WaveModel())
        assert np.allclose(own["yhat"], want, atol=1e-6)
        spread = (own["yhat_upper"] - own["yhat"]).iloc[0] / 1.959964
        assert spread == pytest.approx((y - want[:500]).std(ddof=1), rel=1e-6)


def test_fourier_gradient_is_zero(spark):
    got = FC.fourier_weights(signal(spark), "at", "v", ["k"]).toPandas()
    assert len(got) == 2 * 53 and got["gradient"].abs().max() < 1e-8
    assert got.groupby("part")["place"].min().to_dict() == {"trend": 0, "yearly": 27, "weekly": 47}
    assert FC.fourier_weights(signal(spark).limit(0), "at", "v", ["k"]).count() == 0


@pytest.mark.parametrize(
    "step,first,last",
    [("hour", (2024, 5, 19, 1), (2024, 5, 19, 3)), ("day", (2024, 5, 20), (2024, 5, 22)), ("week", (2024, 5, 26), (2024, 6, 9)), ("month", (2024, 6, 1), (2024, 8, 1))],
)
def test_fourier_steps(spark, step, first, last):
    rows = FC.forecast_fourier(signal(spark, keys=("a",)), "at", "v", 3, step=step)
    future = sorted(r["ds"] for r in rows.filter("is_future").collect())
    assert len(future) == 3 and (future[0], future[-1]) == (datetime.datetime(*first), datetime.datetime(*last))


def test_one_long_hourly_series_spreads_over_tasks(spark):
    hourly = spark.range(60_000).select(
        (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("at"),
        (10 + F.sin(F.col("id") * 2 * np.pi / 24)).alias("v"),
    )
    waves = FC.forecast_fourier(hourly, "at", "v", 5, yearly=False, daily=True).select(F.max(F.abs(F.col("yhat") - F.col("y"))).alias("e"), F.count("*").alias("n")).first()
    assert waves["n"] == 60_005 and waves["e"] < 0.05
