"""Time series: totals per date, moving averages, growth and comparisons by row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions.columns import clean, label_of, pearson
from tallyglass.operators.members import Members
from tallyglass.operators.profile import per_column
from tallyglass.operators.roles import numeric_columns, with_dates
from tallyglass.plans.ordered import over_ordered
from tallyglass.plans.cuts import rank_cuts
from tallyglass.sources.catalog import Catalog


def series(df: DataFrame, date_col: str, metric: str, agg: str = "sum", ordered: bool = True) -> DataFrame:
    """One row per date: ds and the sum (or mean) y; rows without a date are left out, text dates are read first."""
    df = with_dates(df, date_col)
    value = clean(df, metric)
    y = F.coalesce(F.sum(value), F.lit(0)) if agg == "sum" else F.avg(value)
    rows = df.filter(F.col(f"`{date_col}`").isNotNull()).groupBy(F.col(f"`{date_col}`").alias("ds")).agg(y.alias("y"))
    return rows.orderBy("ds") if ordered else rows


def moving_average(points: DataFrame, window: int | str = 7, out: str = "ma") -> DataFrame:
    """Trailing mean of y over `window` points, shorter at the start.

    `adaptive` takes a quarter of the series, at most seven points, and adds NULL when that leaves a
    single point.
    """
    if window == "adaptive":
        window = min(7, points.count() // 4)
        if window <= 1:
            return points.withColumn(out, F.lit(None).cast("double"))
    size = int(window)
    return over_ordered(
        points, ["ds"], size - 1, lambda w: {out: F.avg("y").over(w.rowsBetween(-(size - 1), 0))}
    )


def growth_first_last(points: DataFrame, k: int = 7, significant: float = 20.0) -> DataFrame:
    """Mean of the last k points against the first k in percent; 0 where the base is 0."""
    ends = []
    for side, order in (("first", F.asc("ds")), ("last", F.desc("ds"))):
        ends.append(points.orderBy(order).limit(k).agg(F.avg("y").alias(f"{side}_mean")))
    from tallyglass.operators.profile import side_by_side

    growth = F.when(
        F.col("first_mean") != 0, (F.col("last_mean") - F.col("first_mean")) / F.col("first_mean") * 100
    ).otherwise(0.0)
    return side_by_side(ends).select(
        "first_mean",
        "last_mean",
        growth.alias("growth_pct"),
        F.when(growth > 0, "increase").otherwise("decrease").alias("direction"),
        (F.abs(growth) > significant).alias("significant"),
    )


def _default_metrics(df: DataFrame, metrics: Sequence[str] | None, n: int | None = None) -> list[str]:
    """The metrics asked for, else all numeric columns; n keeps the first of those."""
    return list(metrics) if metrics is not None else numeric_columns(df)[:n]


def trend_cuts(share: float, n: int) -> tuple[int, int]:
    """Row positions where the earliest share ends and the latest share starts."""
    return int(n * share), n - int(n * share)


def trend_measures(
    df: DataFrame,
    metrics: Sequence[str],
    order_by: Sequence[str],
    share: float = 0.2,
    cuts: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Per metric the means of the first and the last `share` of the rows, and the change in percent.

    The two ends are plain filters on the order columns, so this is one aggregate without a shuffle.
    """
    head, body = cuts or rank_cuts(df, order_by, lambda n: trend_cuts(share, n))[1]
    cells = {
        m: {
            "earlier": F.avg(F.when(head, clean(df, m))),
            "recent": F.avg(F.when(~body, clean(df, m))),
        }
        for m in metrics
    }
    change = (F.col("recent") - F.col("earlier")) / F.col("earlier") * 100
    return per_column(df, cells).select(
        "seq",
        F.col("name").alias("metric"),
        "earlier",
        "recent",
        F.when(F.col("earlier") > 0, change).alias("value"),
    )


def trend_insight(
    df: DataFrame,
    metrics: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    share: float = 0.2,
    min_abs: float = 8.0,
    high_abs: float = 20.0,
    max_metrics: int | None = None,
    cuts: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Metrics whose mean moved between the earliest and the latest rows."""
    names = _default_metrics(df, metrics, max_metrics)
    found = trend_measures(df, names, order_by, share, cuts).filter(F.abs("value") > min_abs)
    size = F.format_string("%.1f", F.abs("value"))
    # Titles and descriptions.
    return found.select(
        "seq",
        F.lit("trend").alias("type"),
        F.concat(
            _labels(names), F.when(F.col("value") > 0, " Increased by ").otherwise(" Decreased by "), size, F.lit("%")
        ).alias("title"),
        F.lit(f"Comparing recent {share * 100:.0f}% of data vs earliest {share * 100:.0f}%").alias("description"),
        F.when(F.abs("value") > high_abs, "high").otherwise("medium").alias("priority"),
        "metric",
        "value",
        "earlier",
        "recent",
    )


def _labels(names: Sequence[str], column: str = "metric") -> Column:
    """Display names of the metrics in a column, from the known list of names."""
    label = F.lit(None).cast("string")
    for c in names:
        label = F.when(F.col(column) == c, F.lit(label_of(c))).otherwise(label)
    return label


def momentum_insight(
    df: DataFrame,
    metrics: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    k: int = 7,
    min_abs: float = 12.0,
    max_metrics: int | None = None,
    unit: str = "rows",
) -> DataFrame:
    """The last k rows against the k before them; `unit="days"` compares calendar days of the first
    order column instead."""
    names = _default_metrics(df, metrics, max_metrics)
    if unit == "days":
        day = F.to_date(F.col(order_by[0]))
        newest = df.agg(F.max(day)).first()[0]
        age = F.datediff(F.lit(newest), day)
        recent, before, enough = age < k, (age >= k) & (age < 2 * k), F.lit(True)
        last = df.filter(age < 2 * k)
    else:
        # The 2k newest rows are a top-k; numbering them touches no more than that.
        last = (
            df.select(*dict.fromkeys([*order_by, *names]))
            .orderBy(*[F.desc_nulls_first(c) for c in order_by])
            .limit(2 * k)
            .withColumn("__age", F.row_number().over(Window.orderBy(*[F.desc_nulls_first(c) for c in order_by])))
        )
        recent, before = F.col("__age") <= k, F.col("__age") > k
        enough = F.count(F.lit(1)) >= 2 * k
    cells = {
        m: {
            "recent": F.avg(F.when(recent, clean(df, m))),
            "earlier": F.avg(F.when(before, clean(df, m))),
            "enough": enough,
        }
        for m in names
    }
    change = (F.col("recent") - F.col("earlier")) / F.col("earlier") * 100
    found = (
        per_column(last, cells)
        .withColumn("value", F.when(F.col("enough") & (F.col("earlier") > 0), change))
        .withColumn("metric", F.col("name"))
        .filter(F.abs("value") > min_abs)
    )
    size = F.format_string("%.1f", F.abs("value"))
    # Titles and descriptions.
    return found.select(
        "seq",
        F.lit("trend_weekly").alias("type"),
        F.concat(
            F.lit("Week-over-Week: "), _labels(names), F.when(F.col("value") > 0, " Up ").otherwise(" Down "), size, F.lit("%")
        ).alias("title"),
        F.lit(f"Comparing last {k} days vs previous {k} days").alias("description"),
        F.lit("medium").alias("priority"),
        "metric",
        "value",
        "earlier",
        "recent",
    )


# Metric names shown first when no catalog says otherwise.
PRIORITY_METRICS = ("sales", "revenue", "profit", "quantity", "amount")


def overview_kpis(
    df: DataFrame,
    order_by: Sequence[str],
    catalog: Catalog | None = None,
    n: int | None = None,
    mode: str = "whole",
    numeric: Sequence[str] | None = None,
) -> DataFrame:
    """Headline figures with their change against the first half of the rows.

    All metrics by default, those of PRIORITY_METRICS first; `n` keeps the first of them.
    `mode="whole"` compares the whole table with its first half; `halves` compares the two halves.
    """
    numbers = list(numeric) if numeric is not None else numeric_columns(df)
    if catalog and catalog.metrics:
        chosen = [(m.column, m.name, m.is_total) for m in catalog.metrics if m.column in numbers][:n]
    else:
        first = [c for c in PRIORITY_METRICS if c in numbers]
        chosen = [(c, label_of(c), True) for c in [*first, *[c for c in numbers if c not in first]]][:n]
    _, (head,) = rank_cuts(df, order_by, lambda rows: (rows // 2,))
    cells = {}
    for i, (column, label, total) in enumerate(chosen):
        c = clean(df, column)
        fold = (lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("double")) if total else F.avg
        cells[f"{i}:{column}"] = {
            "metric": F.lit(column),
            "label": F.lit(label),
            "value": fold(c),
            "first_half": fold(F.when(head, c)),
            "second_half": fold(F.when(~head, c)),
        }
    now = F.col("value") if mode == "whole" else F.col("second_half")
    delta = F.when(F.col("first_half") == 0, 0.0).otherwise(
        (now - F.col("first_half")) / F.abs("first_half") * 100
    )
    return per_column(df, cells).select("seq", "metric", "label", "value", delta.alias("delta"))


def half_changes(
    df: DataFrame,
    metrics: Sequence[str],
    categories: Sequence[str],
    order_by: Sequence[str],
    head: Column | None = None,
    members: Members | None = None,
) -> DataFrame:
    """Per metric, category column and member: change of the mean from the earlier to the later half."""
    if head is None and members is None:
        _, (head,) = rank_cuts(df, order_by, lambda rows: (rows // 2,))
    parts = []
    for i, category in enumerate(categories):
        if members:
            groups = members.of(category, metrics)
        else:
            folds = []
            for j, m in enumerate(metrics):
                folds += [
                    F.avg(F.when(head, clean(df, m))).alias(f"a{j}"),
                    F.avg(F.when(~head, clean(df, m))).alias(f"b{j}"),
                ]
            groups = df.filter(F.col(f"`{category}`").isNotNull()).groupBy(F.col(f"`{category}`").cast("string").alias("member")).agg(*folds)
        rows = [
            F.struct(
                F.lit(m).alias("metric"),
                F.lit(i).alias("category_seq"),
                F.lit(category).alias("category"),
                F.col("member"),
                (F.try_divide(F.col(f"b{j}") - F.col(f"a{j}"), F.col(f"a{j}")) * 100).alias("change_pct"),
            )
            for j, m in enumerate(metrics)
        ]
        parts.append(groups.select(F.inline(F.array(*rows))))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything.filter(F.col("change_pct").isNotNull())


def _largest_move(changes: DataFrame) -> DataFrame:
    """The member that moved most, up and down, per metric and category."""
    up = F.min(F.struct((-F.col("change_pct")).alias("o"), "member", "change_pct")).alias("up")
    down = F.min(F.struct(F.col("change_pct").alias("o"), "member", "change_pct")).alias("down")
    return changes.groupBy("metric", "category_seq", "category").agg(up, down)


def _driver_text(category: Column, member: Column, change: Column) -> Column:
    return F.concat(
        F.when(change > 0, "strong performance").otherwise("underperformance"),
        F.lit(" in "), category, F.lit(" '"), member, F.lit("'"),
    )


def change_drivers(
    df: DataFrame,
    metric: str,
    categories: Sequence[str],
    order_by: Sequence[str],
    direction: int = 1,
    min_abs: float = 15.0,
    max_categories: int | None = None,
) -> DataFrame:
    """Per category the member that moved most in the direction of change (above zero is up)."""
    changes = half_changes(df, [metric], list(categories)[:max_categories], order_by)
    pick = F.col("up") if direction > 0 else F.col("down")
    return (
        _largest_move(changes)
        .select("category_seq", "category", pick["member"].alias("member"), pick["change_pct"].alias("change_pct"))
        .filter(F.abs("change_pct") > min_abs)
        .withColumn("driver", _driver_text(F.col("category"), F.col("member"), F.col("change_pct")))
    )


def trend_drivers(
    df: DataFrame,
    metrics: Sequence[str],
    categories: Sequence[str],
    order_by: Sequence[str],
    min_abs: float = 15.0,
    max_categories: int | None = None,
    head: Column | None = None,
    members: Members | None = None,
) -> DataFrame:
    """The drivers of several metrics at once, as text for a rise and for a fall of each metric."""
    changes = half_changes(df, metrics, list(categories)[:max_categories], order_by, head, members)

    def listed(side: str) -> Column:
        change = F.col(f"{side}.change_pct")
        text = _driver_text(F.col("category"), F.col(f"{side}.member"), change)
        # At most one entry per category column and metric.
        kept = F.collect_list(F.when(F.abs(change) > min_abs, F.struct(F.col("category_seq"), text.alias("text"))))
        return F.nullif(F.array_join(F.transform(F.array_sort(kept), lambda x: x["text"]), ", "), F.lit(""))

    return _largest_move(changes).groupBy("metric").agg(listed("up").alias("up_drivers"), listed("down").alias("down_drivers"))


def autocorrelation(points: DataFrame, lag: int = 7) -> DataFrame:
    """Correlation of y with itself `lag` points earlier, and the number of points."""
    pairs = over_ordered(points, ["ds"], lag, lambda w: {"__before": F.lag("y", lag).over(w)})
    return pairs.agg(pearson(F.col("__before"), F.col("y")).alias("value"), F.count(F.lit(1)).alias("n_points"))


def seasonality_insight(
    df: DataFrame,
    date_col: str,
    metrics: Sequence[str] | None = None,
    lag: int = 7,
    min_points: int = 30,
    min_abs: float = 0.4,
    max_metrics: int | None = None,
) -> DataFrame:
    """Metrics whose totals per date repeat after `lag` points."""
    df = with_dates(df, date_col)
    names = _default_metrics(df, metrics, max_metrics)
    totals = (
        df.filter(F.col(f"`{date_col}`").isNotNull())
        .groupBy(F.col(f"`{date_col}`").alias("ds"))
        .agg(*[F.coalesce(F.sum(clean(df, m)), F.lit(0)).alias(f"y{i}") for i, m in enumerate(names)])
    )
    pairs = over_ordered(
        totals, ["ds"], lag, lambda w: {f"b{i}": F.lag(f"y{i}", lag).over(w) for i in range(len(names))}
    )
    cells = {
        m: {"value": pearson(F.col(f"b{i}"), F.col(f"y{i}")), "n_points": F.count(F.lit(1))} for i, m in enumerate(names)
    }
    found = (
        per_column(pairs, cells)
        .withColumnRenamed("name", "metric")
        .filter((F.col("n_points") >= min_points) & (F.abs("value") > min_abs))
    )
    return found.select(
        "seq",
        F.lit("seasonality").alias("type"),
        F.concat(F.lit("Weekly Seasonality in "), _labels(names)).alias("title"),
        F.format_string(f"Autocorrelation at lag {lag}: %.3f", F.col("value")).alias("description"),
        F.lit("medium").alias("priority"),
        "metric",
        "value",
        "n_points",
    )
