"""All automatic insights of a table, the findings to read first, and what to do about them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions.columns import plain_words
from tallyglass.operators import narratives as N
from tallyglass.operators.members import Members, measure_members
from tallyglass.operators.profile import side_by_side
from tallyglass.operators.roles import Roles, resolve_schema, with_dates
from tallyglass.operators.series import momentum_insight, seasonality_insight, trend_cuts, trend_drivers, trend_insight
from tallyglass.operators.stats import (
    anomaly_insight,
    correlation_insight,
    distribution_insight,
    performance_gap_insight,
    ttest_insight,
)
from tallyglass.plans.cuts import rank_cuts
from tallyglass.plans.staging import stage

FIELDS = ("type", "title", "description", "narrative", "priority", "metric", "value")

# Reporting thresholds.
THRESHOLDS = {
    "trend": 8.0,
    "momentum": 12.0,
    "correlation": 0.6,
    "anomaly": 3.0,
    "gap": 25.0,
    "distribution": 1.5,
    "ttest": 0.05,
    "seasonality": 0.4,
}


def all_insights(
    df: DataFrame,
    order_by: Sequence[str],
    roles: Roles | None = None,
    thresholds: dict[str, float] | None = None,
    staged: bool = True,
    drivers_min_abs: float = 15.0,
    metrics: dict[str, Sequence[str]] | None = None,
    ttest: tuple[str, Sequence[str] | str] | None = None,
) -> DataFrame:
    """Every insight of a table in reading order, over all numeric and categorical columns.

    `metrics` narrows single analyses (trend, anomaly, distribution, gap, ttest, seasonality) to the columns
    named, and `ttest` names a category and the two groups to compare instead of each member with the rest.
    The analysers look at the table several times, so its needed columns are written once first
    (`staged=False` skips that for a table that is already a plain scan).
    """
    found = roles or resolve_schema(df)
    t = {**THRESHOLDS, **(thresholds or {})}
    numbers, cats, date = list(found.numeric), list(found.categorical), found.date
    needed = list(dict.fromkeys([*order_by, *numbers, *cats, *([date] if date else [])]))
    data = df.select(*[f"`{c}`" for c in needed])
    if date:
        data = with_dates(data, date)
    if staged:
        data = stage(data, "insights")

    chosen = {k: numbers for k in ("trend", "anomaly", "distribution", "gap", "ttest", "seasonality")} | (metrics or {})
    trended = list(chosen["trend"])

    def measured() -> tuple[list[Column], Members | None]:
        # One search finds all positions that the trends and their drivers compare at, and one pass over the table
        # all that drivers, gaps and tests need to know of the members of every category.
        found_cuts = rank_cuts(data, order_by, lambda n: (*trend_cuts(0.2, n), n // 2))[1] if date else [None] * 3
        asked = list(dict.fromkeys([*trended, *chosen["gap"], *chosen["ttest"]]))
        return found_cuts, measure_members(data, cats, asked, found_cuts[2]) if cats and asked else None

    def trends() -> list[DataFrame]:
        (first, body, _), members = shared.result()
        rows = trend_insight(data, trended, order_by, min_abs=t["trend"], cuts=(first, body))
        drivers = trend_drivers(data, trended, cats, order_by, drivers_min_abs, members=members) if members else None
        momentum = momentum_insight(data, trended, order_by, min_abs=t["momentum"])
        # Trend and momentum of a metric stand next to each other.
        return [placed(N.narrate_trend(rows, drivers), 1, 2), placed(N.narrate_other(momentum), 1, 2, 1)]

    def tests() -> DataFrame:
        if ttest:
            return ttest_insight(data, ttest[0], chosen["ttest"], ttest[1], alpha=t["ttest"])
        tested = [ttest_insight(data, c, chosen["ttest"], "rest", alpha=t["ttest"], members=shared.result()[1]).withColumn("seq", F.col("seq") + i * len(numbers)) for i, c in enumerate(cats)]
        return reduce(DataFrame.unionByName, tested)

    def placed(rows: DataFrame, group: int, step: int = 1, shift: int = 0) -> DataFrame:
        return rows.select((F.lit(group * 1_000_000 + shift) + F.col("seq") * step).alias("seq"), *FIELDS)

    analyses: list[Callable[[], list[DataFrame]]] = []
    if date and numbers:
        analyses.append(trends)
    if len(numbers) >= 2:
        analyses.append(lambda: [placed(N.narrate_correlation(correlation_insight(data, numbers, t["correlation"])), 2)])
    if numbers:
        analyses.append(lambda: [placed(N.narrate_anomaly(anomaly_insight(data, chosen["anomaly"], min_pct=t["anomaly"])), 3)])
        analyses.append(lambda: [placed(N.narrate_other(distribution_insight(data, chosen["distribution"], min_abs=t["distribution"])), 5)])
        if cats:
            analyses.append(lambda: [placed(N.narrate_gap(performance_gap_insight(data, cats, chosen["gap"], min_pct=t["gap"], members=shared.result()[1])), 4)])
            analyses.append(lambda: [placed(N.narrate_other(tests()), 6)])
        if date:
            analyses.append(lambda: [placed(N.narrate_other(seasonality_insight(data, date, chosen["seasonality"], min_abs=t["seasonality"])), 7)])
    if not analyses:
        raise ValueError("the table has no numeric column")
    # The analyses do not depend on each other, so their preparatory jobs may share the cluster.
    with ThreadPoolExecutor(max_workers=4) as pool:
        # Submitted first, so those that wait for it never hold it up.
        shared = pool.submit(inheritable_thread_target(df.sparkSession)(measured)) if numbers else None
        waiting = [pool.submit(inheritable_thread_target(df.sparkSession)(a)) for a in analyses]
        parts = [rows for w in waiting for rows in w.result()]
    # One row per metric, pair or category at most, so a single sorted window numbers them.
    everything = reduce(DataFrame.unionByName, parts)
    return everything.withColumn("seq", F.row_number().over(Window.orderBy("seq")))


def critical_findings(insights: DataFrame, n: int | None = 3) -> DataFrame:
    """High-priority insights in reading order, the first n of them (all where n is None)."""
    high = insights.filter(F.col("priority") == "high").orderBy("seq")
    return high if n is None else high.limit(n)


def by_priority(insights: DataFrame, priority: str) -> DataFrame:
    return insights.filter(F.col("priority") == priority).orderBy("seq")


# Title, action and priority of each recommendation.
ADVICE = {
    "trend": ("Investigate Declining Trend", "Schedule stakeholder meeting to review decline drivers", "high"),
    "correlation": ("Leverage Correlation for Prediction", "Develop regression model for forecasting", "medium"),
    "anomaly": ("Audit Anomalous Data", "Export anomalies for manual review", "high"),
    "performance_gap": ("Close Performance Gap", "Conduct best practices analysis", "high"),
    "forecast": ("Enable Time Series Forecasting", "Navigate to Predictions tab", "medium"),
    "segments": ("Perform Cross-Segment Analysis", "Use filters to compare segments", "low"),
}


def recommendations(insights: DataFrame, df: DataFrame, roles: Roles, n: int | None = None, min_rows: int = 1000) -> DataFrame:
    """One row of advice per high-priority finding (the first n where given) that calls for it, then advice on the table as a whole."""
    value, size = F.col("value"), F.format_string("%.1f%%", F.abs("value"))
    texts = {
        "trend": F.concat(F.lit("The "), size, F.lit(" decline in "), plain_words(F.col("metric")), F.lit(" needs attention: look for its cause.")),
        "correlation": F.lit("The two columns move together, so one can be used to predict the other."),
        "anomaly": F.concat(F.lit("Review the "), size, F.lit(" of outlier records and tell errors from real exceptions.")),
        "performance_gap": F.lit("Learn what sets the leaders apart and help the others catch up."),
    }
    rules = {
        "trend": (F.col("type") == "trend") & (value < -15),
        "correlation": (F.col("type") == "correlation") & (F.abs(value) > 0.7),
        "anomaly": F.col("type") == "anomaly",
        "performance_gap": F.col("type") == "performance_gap",
    }
    advice = F.lit(None)
    for kind, rule in rules.items():
        title, action, priority = ADVICE[kind]
        row = F.struct(
            F.lit(title).alias("title"), texts[kind].alias("description"), F.lit(action).alias("action"), F.lit(priority).alias("priority")
        )
        advice = F.when(rule, row).otherwise(advice)
    from_findings = (
        critical_findings(insights, n).withColumn("advice", advice).filter(F.col("advice").isNotNull()).select("seq", "advice.*")
    )
    general = []
    if roles.date:
        general.append(("forecast", F.lit("The history is long enough for a forecast with a confidence band."), F.col("n_rows") > min_rows))
    if len(roles.categorical) >= 2:
        general.append(("segments", F.lit("Several dimensions are there: compare metrics across their combinations."), F.lit(True)))
    if not general:
        return from_findings
    rows = F.array(
        *[
            F.when(
                test,
                F.struct(
                    F.lit(1_000_000 + i).alias("seq"), F.lit(ADVICE[k][0]).alias("title"), text.alias("description"),
                    F.lit(ADVICE[k][1]).alias("action"), F.lit(ADVICE[k][2]).alias("priority"),
                ),
            )
            for i, (k, text, test) in enumerate(general)
        ]
    )
    table_level = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(F.filter(rows, lambda x: x.isNotNull())))
    return from_findings.unionByName(table_level)


def summary_facts(df: DataFrame, insights: DataFrame, date_col: str | None = None, n_columns: int | None = None) -> DataFrame:
    """The facts at the head of a report; `n_columns` tells the width of a table of which `df` holds some columns."""
    date = F.col(f"`{date_col}`") if date_col else F.lit(None).cast("timestamp_ntz")
    table = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns) if n_columns is None else n_columns).alias("n_columns"),
        F.date_format(F.min(date), "MMMM dd, yyyy").alias("min_date"),
        F.date_format(F.max(date), "MMMM dd, yyyy").alias("max_date"),
    )
    found = insights.agg(
        F.count_if(F.col("priority") == "high").alias("n_critical"), F.count(F.lit(1)).alias("n_insights")
    )
    return side_by_side([table, found])
