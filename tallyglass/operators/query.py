"""Filters, aggregates, rankings and breakdowns that answer business questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import clean, is_above, is_below
from tallyglass.plans.selection import exact_quantiles, grouped_quantile

AGGREGATES = ("sum", "average", "max", "min", "count", "median")


def quoted(name: str) -> str:
    """A column name as a reference, also where it holds a dot."""
    return f"`{name}`"


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have a value in every key."""
    for k in keys:
        df = df.filter(clean(df, k).isNotNull())
    return df


def filter_in(df: DataFrame, members: dict[str, Sequence]) -> DataFrame:
    """Rows whose columns each hold one of the listed values; an empty list does not filter."""
    for column, values in members.items():
        if values:
            df = df.filter(F.col(f"`{column}`").isin(list(values)))
    return df


def filter_eq_ci(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column, read as text, equals the value in any letter case."""
    return df.filter(F.lower(F.col(f"`{column}`").cast("string")) == value.lower())


def filter_cmp(df: DataFrame, column: str, op: str, value: float) -> DataFrame:
    """Rows above (`greater`) or below (`less`) a number."""
    if op not in ("greater", "less"):
        raise ValueError(f"unknown comparison {op}")
    return df.filter(is_above(df, column, value) if op == "greater" else is_below(df, column, value))


def _aggregate_column(df: DataFrame, metric: str, agg: str) -> Column:
    c = clean(df, metric)
    return {
        "sum": F.coalesce(F.sum(c), F.lit(0)),
        "average": F.avg(c),
        "max": F.max(c),
        "min": F.min(c),
        "count": F.count(c),
    }[agg]


def aggregate(
    df: DataFrame,
    metric: str,
    agg: str = "sum",
    by: str | Sequence[str] | None = None,
    filters: dict[str, str] | None = None,
    order: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """sum, average, max, min, count or median of a metric, overall or per group.

    Groups without a key are left out. `order` desc or asc sorts by the result, keys break ties;
    `limit` keeps the first rows of that order.
    """
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg}")
    for column, value in (filters or {}).items():
        df = filter_eq_ci(df, column, value)
    keys = [by] if isinstance(by, str) else list(by or [])
    if not keys:
        if agg == "median":
            middle = exact_quantiles(df, {metric: [0.5]})[metric][0]
            return df.sparkSession.createDataFrame([(middle,)], f"`{metric}` double")
        return df.agg(_aggregate_column(df, metric, agg).alias(metric))
    if agg == "median":
        result = grouped_quantile(df, keys, metric, 0.5, metric)
    else:
        result = _with_keys(df, keys).groupBy(*map(quoted, keys)).agg(_aggregate_column(df, metric, agg).alias(metric))
    if order or limit is not None:
        first = F.asc(quoted(metric)) if order == "asc" else F.desc(quoted(metric))
        result = result.orderBy(first, *map(quoted, keys))
    return result if limit is None else result.limit(limit)


def count_by(df: DataFrame, by: str) -> DataFrame:
    """Rows per group, largest first; rows without a key are left out."""
    return _with_keys(df, [by]).groupBy(quoted(by)).count().orderBy(F.desc("count"), quoted(by))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def leader_laggard(df: DataFrame, metric: str, agg: str, by: str) -> DataFrame:
    """Best and worst group with their values; the smaller key wins a tie."""
    groups = aggregate(df, metric, agg, by)
    value = F.col(quoted(metric))
    # NULL sorts lowest, so groups without a value are set aside.
    filled = groups.filter(value.isNotNull())
    best = F.min(F.struct((-value.cast("double")).alias("o"), F.col(quoted(by)).alias("k"), value.alias("v")))
    worst = F.min(F.struct(value.cast("double").alias("o"), F.col(quoted(by)).alias("k"), value.alias("v")))
    return filled.agg(best.alias("b"), worst.alias("w")).select(
        F.col("b.k").alias("leader"),
        F.col("b.v").alias("leader_value"),
        F.col("w.k").alias("laggard"),
        F.col("w.v").alias("laggard_value"),
    )


def category_breakdown(df: DataFrame, category: str, metric: str, share: bool = False) -> DataFrame:
    """Sum per category, smallest first; `share` adds its part of the total.

    The total is an aggregate of its own: a window over all categories would sit in one task.
    """
    groups = aggregate(df, metric, "sum", category)
    if share:
        # One value from the grouped result; its shuffle serves both.
        total = groups.agg(F.sum(quoted(metric)).cast("double")).scalar()
        groups = groups.withColumn("share", F.try_divide(F.col(quoted(metric)).cast("double"), total))
    return groups.orderBy(quoted(metric), quoted(category))


def pivot_mean(df: DataFrame, x: str, y: str, value: str, wide: bool = False) -> DataFrame:
    """Mean of a value per y and x, as rows or with one column per x."""
    filled = _with_keys(df, [x, y]).withColumn("__v", clean(df, value))
    if wide:
        return filled.groupBy(quoted(y)).pivot(quoted(x)).agg(F.avg("__v"))
    return filled.groupBy(quoted(y), quoted(x)).agg(F.avg("__v").alias(value)).filter(F.col(quoted(value)).isNotNull())


