"""Semantic roles of columns, key figures, forecast eligibility and governed metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import clean
from tallyglass.sources.catalog import Catalog


def classify_columns(profile: DataFrame) -> DataFrame:
    """Adds the role of each profiled column: the first rule that fits wins."""
    name = F.lower("name")
    has = lambda *parts: name.rlike("|".join(parts))
    role = (
        F.when(F.col("is_datetime") | has("date", "time"), "time")
        .when((F.col("unique_ratio") > 0.9) & ~F.col("is_numeric"), "identifier")
        .when(has("%", "margin", "rate"), "rate")
        .when(F.col("is_numeric") & (F.col("variance") > 0), "measure")
        .otherwise("dimension")
    )
    return profile.withColumn("role", role)


def discover_kpis(profile: DataFrame, min_distinct: int = 10, max_null_ratio: float = 0.5) -> DataFrame:
    """Measures that vary, take many values and are mostly filled."""
    classed = profile if "role" in profile.columns else classify_columns(profile)
    return classed.filter(
        (F.col("role") == "measure")
        & (F.col("variance") > 0)
        & (F.col("unique_count") > min_distinct)
        & (F.col("null_ratio") < max_null_ratio)
    )


# Outcomes of the eligibility check.
TOO_SHORT = "Insufficient historical data"
ZERO_MEAN = "Zero mean series"
TOO_VOLATILE = "Highly volatile series"
ELIGIBLE = "Forecast eligible"


def forecast_eligibility(
    df: DataFrame,
    time_col: str,
    metric: str,
    by: Sequence[str] = (),
    min_rows: int = 15,
    max_variation: float = 2.5,
) -> DataFrame:
    """Whether a series (or each series in `by`) is long, non-zero and steady enough to forecast."""
    both = df.filter(clean(df, time_col).isNotNull() & clean(df, metric).isNotNull())
    value = clean(df, metric)
    stats = both.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    reason = (
        F.when(F.col("n") < min_rows, TOO_SHORT)
        .when(F.col("mean") == 0, ZERO_MEAN)
        .when(F.try_divide("std", "mean") > max_variation, TOO_VOLATILE)
        .otherwise(ELIGIBLE)
    )
    return stats.select(*by, "n", "mean", "std", (reason == ELIGIBLE).alias("eligible"), reason.alias("reason"))


def metric_columns(df: DataFrame, catalog: Catalog):
    """Aggregate expressions of the catalog's metrics: totals are summed, all else is averaged."""
    return [
        (
            F.coalesce(F.sum(clean(df, m.column)), F.lit(0)) if m.is_total else F.avg(clean(df, m.column))
        ).alias(m.name)
        for m in catalog.metrics
        if m.column in df.columns
    ]


def governed_metrics(
    df: DataFrame, catalog: Catalog, by: Sequence[str] = (), grain: str | None = None
) -> DataFrame:
    """All governed metrics, overall or per dimension and time grain (day, week, month, quarter, year)."""
    keys = [F.col(f"`{c}`") for c in by]
    if grain:
        if not catalog.time_column:
            raise ValueError("a grain needs a catalog with a time column")
        keys.append(F.date_trunc(grain, F.col(f"`{catalog.time_column}`")).cast("timestamp_ntz").alias("period"))
    return df.groupBy(*keys).agg(*metric_columns(df, catalog))


def drill_down(df: DataFrame, catalog: Catalog, hierarchy: str) -> DataFrame:
    """Governed metrics at every level of a hierarchy, from its finest level up to the grand total.

    `level` is the number of hierarchy columns in use, so 0 is the grand total.
    """
    levels = [c for c in catalog.hierarchies[hierarchy] if c in df.columns]
    if not levels:
        raise ValueError(f"the table has no column of hierarchy {hierarchy}")
    names = [f"`{c}`" for c in levels]
    used = sum((1 - F.grouping(c) for c in names), F.lit(0))
    return df.rollup(*names).agg(used.cast("int").alias("level"), *metric_columns(df, catalog))
