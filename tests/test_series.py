import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import series as S


def frame(spark, values, start=datetime.datetime(2024, 1, 1)):
    return spark.createDataFrame(
        [(start + datetime.timedelta(days=i), i, v) for i, v in enumerate(values)], "d timestamp_ntz, k long, v double"
    )


def test_series_and_moving_average(spark):
    values = [float(i * i % 17) for i in range(30)]
    df = frame(spark, values)
    twice = df.unionAll(df).repartition(4)
    points = S.series(twice, "d", "v", ordered=False)
    got = S.moving_average(points).orderBy("ds").toPandas()
    want = pd.Series(values) * 2
    assert list(got["y"]) == list(want)
    assert np.allclose(got["ma"], want.rolling(7, min_periods=1).mean())
    adaptive = S.moving_average(points.orderBy("ds").limit(20), "adaptive").orderBy("ds").toPandas()
    assert np.allclose(adaptive["ma"], want[:20].rolling(5, min_periods=1).mean())
    assert S.moving_average(points.limit(7), "adaptive").filter("ma is not null").count() == 0


def test_growth(spark):
    rising = S.growth_first_last(S.series(frame(spark, [10.0] * 7 + [13.0] * 7), "d", "v")).first()
    assert rising["growth_pct"] == pytest.approx(30) and rising["significant"] and rising["direction"] == "increase"
    zero = S.growth_first_last(S.series(frame(spark, [0.0] * 7 + [13.0] * 7), "d", "v")).first()
    assert zero["growth_pct"] == 0 and zero["direction"] == "decrease"


@pytest.mark.parametrize("late, fires, priority", [(108.0, False, None), (108.1, True, "medium"), (120.1, True, "high"), (79.0, True, "high")])
def test_trend_thresholds(spark, late, fires, priority):
    df = frame(spark, [100.0] * 20 + [100.0] * 60 + [late] * 20).repartition(5)
    got = S.trend_insight(df, ["v"], ["d", "k"]).collect()
    assert bool(got) == fires
    if fires:
        assert got[0]["priority"] == priority
        assert got[0]["value"] == pytest.approx(late - 100)
        assert got[0]["title"].startswith("V Increased by" if late > 100 else "V Decreased by")


def test_trend_needs_a_positive_base(spark):
    assert S.trend_insight(frame(spark, [0.0] * 50 + [9.0] * 50), ["v"], ["d"]).count() == 0
    assert S.trend_insight(frame(spark, [-5.0] * 50 + [9.0] * 50), ["v"], ["d"]).count() == 0


@pytest.mark.parametrize("n, late, fires", [(13, 200.0, False), (14, 200.0, True), (14, 112.0, False), (14, 112.2, True)])
def test_momentum_thresholds(spark, n, late, fires):
    df = frame(spark, [100.0] * (n - 7) + [late] * 7)
    assert bool(S.momentum_insight(df, ["v"], ["d"]).collect()) == fires


def test_momentum_by_days(spark):
    df = frame(spark, [100.0] * 7 + [150.0] * 7)
    many = df.unionAll(df.withColumn("d", F.col("d") + F.expr("interval 1 hour")))
    got = S.momentum_insight(many, ["v"], ["d", "k"], unit="days").first()
    assert got["value"] == pytest.approx(50)


def test_overview(spark):
    df = frame(spark, [1.0] * 4 + [2.0] * 5).withColumnRenamed("v", "revenue")
    whole = {r["metric"]: r for r in S.overview_kpis(df, ["d"], numeric=["k", "revenue"]).collect()}
    assert whole["revenue"]["seq"] == 0 and whole["revenue"]["value"] == 14
    assert whole["revenue"]["delta"] == pytest.approx((14 - 4) / 4 * 100)
    halves = S.overview_kpis(df, ["d"], numeric=["revenue"], mode="halves").first()
    assert halves["delta"] == pytest.approx((10 - 4) / 4 * 100)
    zero = S.overview_kpis(frame(spark, [0.0] * 4 + [2.0] * 4), ["d"], numeric=["v"]).first()
    assert zero["delta"] == 0


def test_drivers(spark):
    rows = []
    for i in range(40):
        late = i >= 20
        rows.append((i, "up", 10.0 if not late else 20.0))
        rows.append((i, "down", 10.0 if not late else 4.0))
        rows.append((i, "same", 10.0))
        rows.append((i, "zero", 0.0 if not late else 5.0))
    df = spark.createDataFrame([(k, s, v, j) for j, (k, s, v) in enumerate(rows)], "t long, s string, v double, j long").repartition(6)
    up = S.change_drivers(df, "v", ["s"], ["t", "j"], 1).first()
    assert (up["member"], up["change_pct"], up["driver"]) == ("up", 100.0, "strong performance in s 'up'")
    down = S.change_drivers(df, "v", ["s"], ["t", "j"], -1).first()
    assert (down["member"], down["change_pct"], down["driver"]) == ("down", -60.0, "underperformance in s 'down'")
    both = S.trend_drivers(df, ["v"], ["s"], ["t", "j"]).first()
    assert both["up_drivers"] == "strong performance in s 'up'" and both["down_drivers"] == "underperformance in s 'down'"
    assert S.change_drivers(df, "v", ["s"], ["t", "j"], 1, min_abs=100.0).count() == 0


@pytest.mark.parametrize("n, fires", [(29, False), (30, True)])
def test_seasonality(spark, n, fires):
    df = frame(spark, [float(i % 7) for i in range(n)])
    got = S.seasonality_insight(df, "d", ["v"]).collect()
    assert bool(got) == fires
    if fires:
        assert got[0]["value"] == pytest.approx(1.0)
    assert S.seasonality_insight(frame(spark, [5.0] * 40), "d", ["v"]).count() == 0
