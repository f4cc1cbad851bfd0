"""Forecasts of daily series, one or very many at once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyglass.functions.columns import clean
from tallyglass.operators.roles import with_dates
from tallyglass.plans.staging import stage


def forecast_input(df: DataFrame, date_col: str, metric: str, by: Sequence[str] = (), grain: str = "day") -> DataFrame:
    """Total per day (or hour) and series: keys, ds, y. Rows without a date or a key are left out."""
    df = with_dates(df, date_col)
    day = F.col(f"`{date_col}`")
    at = F.to_date(day) if grain == "day" else F.date_trunc(grain, day).cast("timestamp_ntz")
    keep = df.filter(reduce(lambda a, b: a & b, [clean(df, c).isNotNull() for c in (date_col, *by)]))
    return keep.groupBy(*[f"`{c}`" for c in by], at.alias("ds")).agg(F.coalesce(F.sum(clean(df, metric)), F.lit(0)).cast("double").alias("y"))


STEPS = {"day": "D", "week": "7D", "month": "MS"}


def _steps_after(last: str, periods: int, step: str) -> Column:
    """The dates of `periods` steps after a date: days, weeks, or the first days of the following months."""
    if step not in STEPS:
        raise ValueError(f"unknown step {step}")
    if step == "month":
        return F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda k: F.add_months(F.trunc(last, "month"), k))
    days = 7 if step == "week" else 1
    return F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda k: F.date_add(last, k * days))


def forecast(
    df: DataFrame,
    date_col: str,
    metric: str,
    periods: int = 30,
    by: Sequence[str] = (),
    interval: float = 0.95,
    step: str = "day",
) -> DataFrame:
    """Straight trend plus weekday effects, over the history and `periods` steps (day, week, month) beyond it.

    Each series is fitted on its own daily totals; calendar days bound what one series can hold.
    """
    keys = list(by)
    days = forecast_input(df, date_col, metric, keys)
    z = NormalDist().inv_cdf(0.5 + interval / 2)
    # Without keys there is one series of at most one row per calendar day.
    one = Window.partitionBy(*(keys or [F.lit(0)]))
    weekday = Window.partitionBy(*(keys or [F.lit(0)]), "dow")
    fitted = (
        days.withColumn("first_day", F.min("ds").over(one))
        .withColumn("t", F.datediff("ds", "first_day").cast("double"))
        .withColumn("dow", F.weekday("ds"))
        .withColumn("slope", F.coalesce(F.regr_slope("y", "t").over(one), F.lit(0.0)))
        .withColumn("level", F.avg("y").over(one) - F.col("slope") * F.avg("t").over(one))
        .withColumn("trend", F.col("level") + F.col("slope") * F.col("t"))
        .withColumn("weekly", F.avg(F.col("y") - F.col("trend")).over(weekday))
        .withColumn("spread", F.coalesce(F.stddev_samp(F.col("y") - F.col("trend") - F.col("weekly")).over(one), F.lit(0.0)))
    )
    history = fitted.select(*keys, "ds", "y", "trend", "weekly", "spread", F.lit(False).alias("is_future"))
    # At most seven weekday effects per series.
    effects = F.map_from_entries(F.collect_set(F.struct("dow", "weekly")))
    last = fitted.groupBy(*keys).agg(
        F.max("ds").alias("last_day"),
        *[F.first(c).alias(c) for c in ("first_day", "slope", "level", "spread")],
        effects.alias("effects"),
    )
    ahead = _steps_after("last_day", periods, step)
    future = (
        last.filter(F.col("last_day").isNotNull())
        .withColumn("ds", F.explode(ahead))
        .select(
            *keys,
            "ds",
            F.lit(None).cast("double").alias("y"),
            (F.col("level") + F.col("slope") * F.datediff("ds", "first_day")).alias("trend"),
            F.coalesce(F.col("effects")[F.weekday("ds")], F.lit(0.0)).alias("weekly"),
            "spread",
            F.lit(True).alias("is_future"),
        )
    )
    yhat = F.col("trend") + F.col("weekly")
    return history.unionByName(future).select(
        *keys,
        "ds",
        yhat.alias("yhat"),
        (yhat - z * F.col("spread")).alias("yhat_lower"),
        (yhat + z * F.col("spread")).alias("yhat_upper"),
        "trend",
        "weekly",
        "y",
        "is_future",
    )


#: Steps of a series whose sums are formed at a time; a longer series spreads over tasks.
CHUNK_STEPS = 4096


@dataclass(frozen=True)
class WaveModel:
    """A line that may bend at evenly spaced points in the first four fifths of the history, plus waves."""

    yearly: bool = True
    weekly: bool = True
    daily: bool = False
    changepoints: int = 25
    changepoint_scale: float = 0.05

    @property
    def waves(self) -> dict[str, tuple[float, int]]:
        # Period in days and number of waves.
        known = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}
        return {name: known[name] for name in known if getattr(self, name)}

    @property
    def knots(self) -> list[float]:
        return np.linspace(0, 0.8, self.changepoints + 2)[1:-1].tolist() if self.changepoints else []

    @property
    def penalty(self) -> list[float]:
        bends = [1 / (2 * self.changepoint_scale)] * self.changepoints
        return [0.0, 0.0, *bends, *[0.005] * sum(2 * order for _, order in self.waves.values())]

    def design(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """One row of basis values for each step, from its place in the history (0 to 1) and its day."""
        line = [np.ones_like(u), u, *[np.maximum(u - k, 0) for k in self.knots]]
        for period, order in self.waves.values():
            angle = 2 * np.pi * np.outer(np.arange(1, order + 1), t) / period
            line += [*np.sin(angle), *np.cos(angle)]
        return np.column_stack(line)

    def basis(self, u: Column, t: Column) -> dict[str, list[Column]]:
        """The same values as columns, by component."""
        out = {"trend": [F.lit(1.0), u, *[F.greatest(u - k, F.lit(0.0)) for k in self.knots]]}
        for name, (period, order) in self.waves.items():
            angles = [2 * math.pi * k / period * t for k in range(1, order + 1)]
            out[name] = [*map(F.sin, angles), *map(F.cos, angles)]
        return out


def _day_number(ds: str = "ds") -> Column:
    return F.date_diff(ds, F.lit("1970-01-01").cast("date")) + F.hour(ds) / 24.0


def _wave_totals(df: DataFrame, date_col: str, metric: str, keys: list[str], model: WaveModel) -> DataFrame:
    """Totals per day, or hour where daily waves are asked for, written once: they are read several times."""
    totals = forecast_input(df, date_col, metric, keys, "hour" if model.daily else "day")
    totals = totals.withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    return stage(totals if keys else totals.withColumn("__all", F.lit(0)), "totals")


def _wave_fit(totals: DataFrame, keys: list[str], model: WaveModel) -> DataFrame:
    """keys, start, span, size, last, spread and weights of each series: penalised least squares.

    Products of the basis are summed over chunks of a series first, so a task sees CHUNK_STEPS steps of it; the
    solve sees one small row for each chunk.
    """
    t, size = _day_number(), len(model.penalty) + 1
    reach = totals.groupBy(*keys).agg(
        F.min(t).alias("start"),
        F.greatest(F.max(t) - F.min(t), F.lit(1.0)).alias("span"),
        F.greatest(F.max(F.abs("y")), F.lit(1e-12)).alias("size"),
        F.max("ds").alias("last"),
    )
    steps = (t - F.col("start")) * (24 if model.daily else 1)
    placed = totals.join(reach, keys).select(
        *keys, F.floor(steps / CHUNK_STEPS).alias("chunk"), t.alias("t"), "y", "start", "span", "size", "last"
    )
    fixed = [totals.schema[k] for k in keys]
    head = [T.StructField(c, T.DoubleType()) for c in ("start", "span", "size")] + [T.StructField("last", T.TimestampNTZType())]
    numbers = T.ArrayType(T.DoubleType())
    upper = np.triu_indices(size)

    def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        first = rows.iloc[[0]][[*keys, "chunk", "start", "span", "size", "last"]].reset_index(drop=True)
        days = rows["t"].to_numpy()
        table = np.column_stack([model.design((days - first["start"][0]) / first["span"][0], days), rows["y"] / first["size"][0]])
        first["sums"] = [(table.T @ table)[upper]]
        return first

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        first = rows.iloc[[0]][[*keys, "start", "span", "size", "last"]].reset_index(drop=True)
        gram = np.zeros((size, size))
        gram[upper] = np.sum(np.stack(rows["sums"].to_list()), axis=0)
        gram = gram + np.triu(gram, 1).T
        known, target = gram[:-1, :-1], gram[:-1, -1]
        weights = np.linalg.lstsq(known + np.diag(model.penalty), target, rcond=None)[0]
        # The first column of the basis is one everywhere: its sums are counts and plain sums.
        n, rest = known[0, 0], target[0] - weights @ known[0]
        squares = gram[-1, -1] - 2 * weights @ target + weights @ known @ weights
        first["spread"] = math.sqrt(max(squares - rest**2 / n, 0.0) / (n - 1)) * first["size"][0] if n > 1 else 0.0
        first["weights"] = [weights]
        return first

    parts = T.StructType([*fixed, T.StructField("chunk", T.LongType()), *head, T.StructField("sums", numbers)])
    fitted = T.StructType([*fixed, *head, T.StructField("spread", T.DoubleType()), T.StructField("weights", numbers)])
    return placed.groupBy(*keys, "chunk").applyInPandas(sums, parts).groupBy(*keys).applyInPandas(solve, fitted)


def _weighted(basis: dict[str, list[Column]]) -> dict[str, Column]:
    """Each component as the sum of its weighted basis values, in units of the series' size."""
    out, at = {}, 0
    for name, columns in basis.items():
        out[name] = reduce(lambda a, b: a + b, [F.get("weights", F.lit(at + i)) * c for i, c in enumerate(columns)])
        at += len(columns)
    return out


def _steps_ahead(periods: int, step: str) -> Column:
    """The times of `periods` steps after `last`."""
    if step == "hour":
        return F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda k: F.timestamp_add("HOUR", k, F.col("last")))
    return F.transform(_steps_after("last", periods, step), lambda d: d.cast("timestamp_ntz"))


def forecast_fourier(
    df: DataFrame,
    date_col: str,
    metric: str,
    periods: int = 30,
    by: Sequence[str] = (),
    yearly: bool = True,
    weekly: bool = True,
    daily: bool = False,
    interval: float = 0.95,
    changepoints: int = 25,
    changepoint_scale: float = 0.05,
    step: str | None = None,
) -> DataFrame:
    """A trend that may bend, plus yearly, weekly and daily waves, fitted per series.

    Spark totals each series per day first (per hour where daily waves are asked for) and sums the products of the
    basis over chunks of it; the components are column expressions over the fitted weights. `step` (hour, day, week,
    month) is how the series goes on: by hours where daily waves are asked for, else by days.
    """
    model = WaveModel(yearly, weekly, daily, changepoints, changepoint_scale)
    wanted, keys = step or ("hour" if daily else "day"), list(by) or ["__all"]
    z = NormalDist().inv_cdf(0.5 + interval / 2)
    totals = _wave_totals(df, date_col, metric, list(by), model)
    fit = _wave_fit(totals, keys, model)
    ahead = fit.select(*keys, F.explode(_steps_ahead(periods, wanted)).alias("ds"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("is_future"))
    rows = totals.withColumn("is_future", F.lit(False)).unionByName(ahead).join(fit, keys)
    rows = rows.withColumns({"__t": _day_number(), "__u": (_day_number() - F.col("start")) / F.col("span")})
    components = _weighted(model.basis(F.col("__u"), F.col("__t")))
    rows = rows.withColumns({name: value * F.col("size") for name, value in components.items()})
    yhat = reduce(lambda a, b: a + b, [F.col(name) for name in components])
    return rows.select(
        *by,
        "ds",
        yhat.alias("yhat"),
        (yhat - z * F.col("spread")).alias("yhat_lower"),
        (yhat + z * F.col("spread")).alias("yhat_upper"),
        *components,
        "y",
        "is_future",
    )


def fourier_weights(df: DataFrame, date_col: str, metric: str, by: Sequence[str] = (), model: WaveModel | None = None) -> DataFrame:
    """The fitted weights as rows: keys, part, place (over all parts), weight, and the gradient of the penalised squares there.

    The gradient is summed anew over all steps, by column expressions; at the least-squares fit it is zero but for rounding.
    """
    model, keys = model or WaveModel(), list(by) or ["__all"]
    totals = _wave_totals(df, date_col, metric, list(by), model)
    rows = totals.join(_wave_fit(totals, keys, model), keys)
    rows = rows.withColumns({"__t": _day_number(), "__u": (_day_number() - F.col("start")) / F.col("span")})
    basis = model.basis(F.col("__u"), F.col("__t"))
    rest = F.col("y") / F.col("size") - reduce(lambda a, b: a + b, _weighted(basis).values())
    names = [name for name, columns in basis.items() for _ in columns]
    each = F.posexplode(F.array(*[c for columns in basis.values() for c in columns])).alias("place", "value")
    summed = (
        rows.withColumn("__rest", rest)
        .select(*keys, "weights", "__rest", each)
        .groupBy(*keys, "place")
        .agg(F.sum(F.col("value") * F.col("__rest")).alias("pull"), F.first(F.get("weights", "place")).alias("weight"))
    )
    return summed.select(
        *by,
        F.get(F.array(*map(F.lit, names)), "place").alias("part"),
        "place",
        "weight",
        (F.get(F.array(*map(F.lit, model.penalty)), "place") * F.col("weight") - F.col("pull")).alias("gradient"),
    )


def forecast_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, range, direction and half band width over the days ahead."""
    future = rows.filter("is_future")
    return future.groupBy(*by).agg(
        F.avg("yhat").alias("predicted_mean"),
        F.min("yhat_lower").alias("predicted_min"),
        F.max("yhat_upper").alias("predicted_max"),
        F.when(F.max_by("trend", "ds") > F.min_by("trend", "ds"), "increasing").otherwise("decreasing").alias("trend_direction"),
        ((F.avg("yhat_upper") - F.avg("yhat_lower")) / 2).alias("confidence_interval"),
    )


def forecast_components(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trend and the seasonal parts the model has, per date."""
    return rows.select(*by, "ds", "trend", *[c for c in ("weekly", "yearly", "daily") if c in rows.columns])
