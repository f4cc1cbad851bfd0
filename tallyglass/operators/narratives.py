"""Plain-language text for insights, as projections over insight tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import plain_words, title_words


def _pct(value: Column) -> Column:
    return F.format_string("%.1f%%", F.abs(value))


def narrate_trend(insights: DataFrame, drivers: DataFrame | None = None) -> DataFrame:
    """How far a metric moved, what moved with it, and what to do about a large move.

    `drivers` has one row per metric (metric, up_drivers, down_drivers).
    """
    if drivers is None:
        joined = insights.withColumns({"up_drivers": F.lit(None).cast("string"), "down_drivers": F.lit(None).cast("string")})
    else:
        joined = insights.join(drivers, "metric", "left")
    change = F.col("value")
    cause = F.when(change > 0, F.col("up_drivers")).otherwise(F.col("down_drivers"))
    text = F.concat(
        title_words(F.col("metric")),
        F.lit(" has "),
        F.when(F.abs(change) > 25, "significantly").when(F.abs(change) > 10, "moderately").otherwise("slightly"),
        F.when(change > 0, " increased").otherwise(" decreased"),
        F.lit(" by "),
        _pct(change),
        F.lit(" between the earliest and the latest rows."),
        F.coalesce(F.concat(F.lit(" Main drivers: "), cause, F.lit(".")), F.lit("")),
        F.when(change < -15, " Look into the causes of this decline now.")
        .when(change > 20, " Find out what worked and repeat it elsewhere.")
        .otherwise(""),
    )
    return joined.withColumn("narrative", text).drop("up_drivers", "down_drivers")


def narrate_correlation(insights: DataFrame) -> DataFrame:
    r = F.col("value")
    text = F.concat(
        title_words(F.col("col1")),
        F.lit(" and "),
        title_words(F.col("col2")),
        F.lit(" show a "),
        F.when(F.abs(r) > 0.8, "very strong").when(F.abs(r) > 0.6, "strong").otherwise("moderate"),
        F.when(r > 0, " positive").otherwise(" negative"),
        F.format_string(" correlation (r = %.3f): when ", r),
        plain_words(F.col("col1")),
        F.lit(" rises, "),
        plain_words(F.col("col2")),
        F.when(r > 0, " tends to rise too.").otherwise(" tends to fall."),
    )
    return insights.withColumn("narrative", text)


def narrate_anomaly(insights: DataFrame) -> DataFrame:
    share = F.col("value")
    text = F.concat(
        F.when(share > 10, "A concerning").when(share > 5, "A notable").otherwise("A minor"),
        F.lit(" number of rows lie outside the usual range of "),
        title_words(F.col("metric")),
        F.format_string(": %,d records (%.1f%%). ", F.col("outliers"), share),
        F.lit("Check whether they are errors, one-off events or fraud."),
    )
    return insights.withColumn("narrative", text)


def narrate_gap(insights: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Across "),
        title_words(F.col("category")),
        F.lit(", "),
        F.col("leader"),
        F.lit(" leads in "),
        plain_words(F.col("measure")),
        F.lit(" and "),
        F.col("laggard"),
        F.lit(" comes last, a gap of "),
        _pct(F.col("value")),
        F.lit(". Carry over what the leader does differently."),
    )
    return insights.withColumn("narrative", text)


def narrate_other(insights: DataFrame) -> DataFrame:
    """Momentum, distribution, t-test and seasonality insights; columns a kind lacks are not needed."""
    have = set(insights.columns)
    v = F.col("value")
    name = plain_words(F.col("metric"))
    optional = lambda c, alt: F.col(c) if c in have else alt
    none = F.lit(None).cast("string")
    momentum = F.concat(
        F.lit("Short-term momentum: "), name,
        F.when(v > 0, " is accelerating, a gain of ").otherwise(" is decelerating, a decline of "),
        _pct(v), F.lit(" week over week."),
    )
    distribution = F.concat(
        title_words(F.col("metric")), F.lit(" is skewed "),
        F.when(v > 0, "right (positive): mostly low values with some high outliers.").otherwise(
            "left (negative): mostly high values with some low outliers."
        ),
        F.lit(" Prefer the median to the mean, or take logarithms."),
    )
    test = F.concat(
        F.lit("The difference in "), plain_words(optional("measure", none)), F.lit(" between "), optional("group2", none),
        F.lit(" and "), optional("group1", none), F.format_string(" is significant (p-value: %.4f): ", v),
        F.lit("a difference of "), _pct(optional("diff_pct", F.lit(None).cast("double"))), F.lit(" is unlikely to be chance."),
    )
    season = F.concat(
        F.lit("Weekly pattern in "), name, F.format_string(" (autocorrelation %.3f): values repeat on a 7-day cycle, ", v),
        F.lit("which forecasts and staffing should reflect."),
    )
    kind = F.col("type")
    return insights.withColumn(
        "narrative",
        F.when(kind == "trend_weekly", momentum)
        .when(kind == "distribution", distribution)
        .when(kind == "statistical_test", test)
        .when(kind == "seasonality", season),
    )
