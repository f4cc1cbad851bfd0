"""Correlation, anomalies, distributions, group gaps, t-tests and fitted lines."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import clean, pearson, sample_kurtosis, sample_skewness, t_two_sided_p
from tallyglass.operators.members import Members
from tallyglass.operators.profile import outlier_tests, per_column
from tallyglass.operators.roles import categorical_columns, numeric_columns
from tallyglass.operators.series import _default_metrics, _labels
from tallyglass.plans.selection import exact_quantiles

# What rounding may leave of a constant's variance, in parts of its mean square.
ROUNDING = 1e-12


def strength(r: Column) -> Column:
    """Fixed words for the size of a correlation."""
    size = F.abs(r)
    return (
        F.when(size > 0.8, "very strong").when(size > 0.6, "strong").when(size > 0.4, "moderate").when(size.isNotNull(), "weak")
    )


def _corr(df: DataFrame, a: str, b: str) -> Column:
    return pearson(clean(df, a).cast("double"), clean(df, b).cast("double"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation over rows with both values, in number and words."""
    return df.agg(_corr(df, a, b).alias("r")).select(
        F.lit(a).alias("col1"),
        F.lit(b).alias("col2"),
        "r",
        strength(F.col("r")).alias("strength"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
    )


def _pair_sums(values: DataFrame, means: list[float]) -> DataFrame:
    """(i, j, n, sums and products of the centred values) over the rows with both values, for every i < j, in one scan.

    A task multiplies batches of its rows as matrices, values and presence; one row a pair and task leaves it.
    """
    k = len(means)
    first, second = np.triu_indices(k, 1)

    def run(batches):
        both, sums, squares, products = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            found = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            here = ~np.isnan(found)
            x, m = np.where(here, found - means, 0.0), here.astype(float)
            both, sums, squares, products = both + m.T @ m, sums + x.T @ m, squares + (x * x).T @ m, products + x.T @ x
        pairs = {"i": first, "j": second, "n": both[first, second], "xy": products[first, second]}
        pairs |= {"x": sums[first, second], "y": sums[second, first], "xx": squares[first, second], "yy": squares[second, first]}
        if both.any():
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c in "ij" else pa.float64()) for c, v in pairs.items()})

    names = ("n", "xy", "x", "y", "xx", "yy")
    parts = values.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, full: bool = False) -> DataFrame:
    """Correlation of every pair of numeric columns as rows (col1 before col2 in table order);
    `full` adds the mirrored half and the diagonal.

    Two scans, whatever the number of columns: means and constants, then all pairs. A pair is correlated over the rows
    that have both values. There a column whose variance is below ROUNDING of its mean square around the mean of all its
    values counts as constant; a constant has no correlation.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    spark, k = df.sparkSession, len(names)
    value = {c: clean(df, c).cast("double") for c in names}
    seen = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(value[c]).alias(f"m{i}") for i, c in enumerate(names)],
        *[(F.min(value[c]) < F.max(value[c])).alias(f"v{i}") for i, c in enumerate(names)],
    ).first()
    sums = _pair_sums(df.select(*[value[c].alias(f"c{i}") for i, c in enumerate(names)]), [seen[f"m{i}"] or 0.0 for i in range(k)])
    listed = F.array(*map(F.lit, names)).cast("array<string>")
    varied = F.array(*[F.lit(bool(seen[f"v{i}"])) for i in range(k)]).cast("array<boolean>")
    # One row per pair of columns, whatever the size of the table.
    pairs = spark.range(k * k).select(F.floor(F.col("id") / max(k, 1)).cast("int").alias("i"), (F.col("id") % max(k, 1)).cast("int").alias("j"))
    n = F.nullif(F.col("n"), F.lit(0.0))
    spread_x, spread_y = (F.col(c * 2) - F.col(c) * F.col(c) / n for c in "xy")
    known = F.get(varied, "i") & F.get(varied, "j") & (spread_x > ROUNDING * F.col("xx")) & (spread_y > ROUNDING * F.col("yy"))
    r = (F.col("xy") - F.col("x") * F.col("y") / n) / F.nullif(F.sqrt(spread_x) * F.sqrt(spread_y), F.lit(0.0))
    half = (
        pairs.filter("i < j")
        .join(sums, ["i", "j"], "left")
        .select("i", "j", F.get(listed, "i").alias("col1"), F.get(listed, "j").alias("col2"), F.when(known, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    )
    if not full:
        return half
    mirrored = half.select(
        F.inline(
            F.array(
                F.struct("i", "j", "col1", "col2", "r"),
                F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r"),
            )
        )
    )
    diagonal = spark.createDataFrame([(i, i, c, c, 1.0) for i, c in enumerate(names)], half.schema)
    return mirrored.unionAll(diagonal)


def correlation_insight(
    df: DataFrame, columns: Sequence[str] | None = None, min_abs: float = 0.6, high_abs: float = 0.8
) -> DataFrame:
    """Pairs of columns that move together."""
    names = list(columns) if columns is not None else numeric_columns(df)
    found = correlation_matrix(df, names).filter(F.abs("r") > min_abs)
    high = F.abs("r") > high_abs
    # Titles and descriptions.
    return found.select(
        (F.col("i") * len(names) + F.col("j")).alias("seq"),
        F.lit("correlation").alias("type"),
        F.concat(
            F.when(high, "Strong ").otherwise("Moderate "),
            F.when(F.col("r") > 0, "Positive").otherwise("Negative"),
            F.lit(" Correlation"),
        ).alias("title"),
        F.concat(
            _labels(names, "col1"), F.lit(" ↔ "), _labels(names, "col2"), F.format_string(" (r=%.3f)", F.col("r"))
        ).alias("description"),
        F.when(high, "high").otherwise("medium").alias("priority"),
        F.concat("col1", F.lit("_vs_"), "col2").alias("metric"),
        F.col("r").alias("value"),
        "col1",
        "col2",
    )


def anomaly_rows(
    df: DataFrame, metric: str, k: float = 1.5, limit: int | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Rows outside the interquartile fences, with the fences; `limit` shows the first of them."""
    tests = outlier_tests(df, [metric], k)
    if metric not in tests:
        return df.filter(F.lit(False)).withColumns(
            {"lower_bound": F.lit(None).cast("double"), "upper_bound": F.lit(None).cast("double")}
        )
    outside, lower, upper = tests[metric]
    rows = df.filter(outside).withColumns({"lower_bound": F.lit(lower), "upper_bound": F.lit(upper)})
    if order_by:
        rows = rows.orderBy(*order_by)
    return rows if limit is None else rows.limit(limit)


def anomaly_insight(
    df: DataFrame,
    metrics: Sequence[str] | None = None,
    k: float = 1.5,
    min_pct: float = 3.0,
    high_pct: float = 8.0,
    max_metrics: int | None = None,
) -> DataFrame:
    """Metrics with many rows outside their fences, as a share of all rows."""
    names = _default_metrics(df, metrics, max_metrics)
    tests = outlier_tests(df, names, k)
    cells = {
        m: {"outliers": F.count_if(tests[m][0]) if m in tests else F.lit(0).cast("long"), "n_rows": F.count(F.lit(1))}
        for m in names
    }
    found = (
        per_column(df, cells)
        .withColumnRenamed("name", "metric")
        .withColumn("value", F.try_divide("outliers", "n_rows") * 100)
        .filter(F.col("value") > min_pct)
    )
    # Titles and descriptions.
    return found.select(
        "seq",
        F.lit("anomaly").alias("type"),
        F.concat(F.lit("Anomalies Detected in "), _labels(names)).alias("title"),
        F.format_string("%,d outliers (%.1f%% of data)", F.col("outliers"), F.col("value")).alias("description"),
        F.when(F.col("value") > high_pct, "high").otherwise("medium").alias("priority"),
        "metric",
        "value",
        "outliers",
    )


def distribution_summary(df: DataFrame, metric: str) -> DataFrame:
    """Range, mean, median and skewness of a metric, with the name of its shape."""
    middle = exact_quantiles(df, {metric: [0.5]})[metric][0]
    c = clean(df, metric)
    stats = df.agg(
        F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max"),
        F.avg(c).alias("mean"),
        sample_skewness(c).alias("skewness"),
    )
    shape = (
        F.when(F.col("skewness") > 0.5, "right-skewed").when(F.col("skewness") < -0.5, "left-skewed").otherwise("approximately normal")
    )
    return stats.select(
        F.lit(metric).alias("metric"), "min", "max", "mean", F.lit(middle).cast("double").alias("median"), "skewness", shape.alias("shape")
    )


def histogram(df: DataFrame, metric: str, bins: int = 50) -> DataFrame:
    """Rows per equal-width bin from minimum to maximum, empty bins included, with mean and median.

    The maximum belongs to the last bin; a constant column has one filled bin.
    """
    c = clean(df, metric).cast("double")
    low, high, mean = df.agg(F.min(c), F.max(c), F.avg(c)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count long, mean double, median double")
    middle = exact_quantiles(df, {metric: [0.5]})[metric][0]
    width = (high - low) / bins
    place = F.least(F.floor((c - low) / width), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    counts = df.filter(c.isNotNull()).groupBy(place.alias("bin")).count()
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.lit(mean).alias("mean"),
        F.lit(middle).alias("median"),
    )


def distribution_insight(
    df: DataFrame, metrics: Sequence[str] | None = None, min_abs: float = 1.5, max_metrics: int | None = None
) -> DataFrame:
    """Metrics with a long tail."""
    names = _default_metrics(df, metrics, max_metrics)
    cells = {
        m: {"value": sample_skewness(clean(df, m)), "kurtosis": sample_kurtosis(clean(df, m))} for m in names
    }
    found = per_column(df, cells).withColumnRenamed("name", "metric").filter(F.abs("value") > min_abs)
    side = F.when(F.col("value") > 0, "right (positive)").otherwise("left (negative)")
    # Titles and descriptions.
    return found.select(
        "seq",
        F.lit("distribution").alias("type"),
        F.concat(_labels(names), F.lit(" is Heavily Skewed")).alias("title"),
        F.concat(F.format_string("Skewness: %.2f (", F.col("value")), side, F.lit(")")).alias("description"),
        F.lit("low").alias("priority"),
        "metric",
        "value",
        "kurtosis",
    )


def performance_gap_insight(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    metrics: Sequence[str] | None = None,
    min_pct: float = 25.0,
    high_pct: float = 50.0,
    max_categories: int | None = None,
    max_metrics: int | None = None,
    members: Members | None = None,
) -> DataFrame:
    """Categories whose best and worst members lie far apart in mean. One aggregate per category
    covers all metrics; none is needed where `members` were measured before."""
    cats = list(categories) if categories is not None else categorical_columns(df)[:max_categories]
    names = _default_metrics(df, metrics, max_metrics)
    parts = []
    for i, category in enumerate(cats):
        groups = members.of(category, names) if members else (
            df.filter(F.col(f"`{category}`").isNotNull())
            .groupBy(F.col(f"`{category}`").cast("string").alias("member"))
            .agg(*[F.avg(clean(df, m)).alias(f"m{j}") for j, m in enumerate(names)])
        )
        cells = []
        for j, m in enumerate(names):
            mean = F.col(f"m{j}")
            filled = F.when(mean.isNotNull(), F.struct((-mean).alias("o"), "member", mean.alias("v")))
            cells.append(
                F.struct(
                    F.lit(i * len(names) + j).alias("seq"),
                    F.lit(category).alias("category"),
                    F.lit(m).alias("measure"),
                    F.count(F.lit(1)).alias("n_groups"),
                    F.min(filled).alias("top"),
                    F.min(F.when(mean.isNotNull(), F.struct(mean.alias("o"), "member", mean.alias("v")))).alias("bottom"),
                )
            )
        parts.append(groups.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    gap = (F.col("top.v") - F.col("bottom.v")) / F.col("bottom.v") * 100
    found = (
        reduce(DataFrame.unionByName, parts)
        .withColumn("value", F.when((F.col("n_groups") >= 2) & (F.col("bottom.v") > 0), gap))
        .filter(F.col("value") > min_pct)
    )
    # Titles and descriptions.
    return found.select(
        "seq",
        F.lit("performance_gap").alias("type"),
        F.concat(F.lit("Performance Gap: "), _labels(cats, "category")).alias("title"),
        F.concat(
            F.col("top.member"), F.lit(" outperforms "), F.col("bottom.member"),
            F.format_string(" by %.1f%% in ", F.col("value")), F.replace("measure", F.lit("_"), F.lit(" ")),
        ).alias("description"),
        F.when(F.col("value") > high_pct, "high").otherwise("medium").alias("priority"),
        F.concat("category", F.lit("_"), "measure").alias("metric"),
        "value",
        "category",
        "measure",
        F.col("top.member").alias("leader"),
        F.col("top.v").alias("leader_mean"),
        F.col("bottom.member").alias("laggard"),
        F.col("bottom.v").alias("laggard_mean"),
    )


def ttest_measures(
    df: DataFrame,
    category: str,
    metrics: Sequence[str],
    groups: Sequence[str] | None = None,
    min_n: int = 30,
) -> DataFrame:
    """Pooled two-sample t-test between two groups of a category for each metric.

    The groups are the first two in sorted order unless named. Only counts, means and variances per
    group are kept. A missing value counts as a row of its group and leaves the test undefined.
    `ttest_against_rest` tests every member.
    """
    member = F.col(f"`{category}`")
    if groups is None:
        firsts = df.select(member.alias("g")).filter(F.col("g").isNotNull()).distinct().orderBy("g").limit(2).collect()
        groups = [r["g"] for r in firsts]
    if len(groups) < 2:
        groups = [*groups, None, None][:2]
    sides = [member == F.lit(g) for g in groups]
    cells = {}
    for m in metrics:
        c = clean(df, m).cast("double")
        cells[m] = {}
        for s, side in enumerate(sides, 1):
            cells[m][f"rows{s}"] = F.count_if(side)
            cells[m][f"n{s}"] = F.count(F.when(side, c))
            cells[m][f"mean{s}"] = F.avg(F.when(side, c))
            cells[m][f"var{s}"] = F.var_samp(F.when(side, c))
    stats = per_column(df.filter(sides[0] | sides[1]), cells).withColumnRenamed("name", "measure")
    n1, n2 = F.col("n1"), F.col("n2")
    complete = (F.col("rows1") >= min_n) & (F.col("rows2") >= min_n) & (n1 == F.col("rows1")) & (n2 == F.col("rows2"))
    dof = (n1 + n2 - 2).cast("double")
    pooled = ((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / dof
    stats = stats.withColumn("dof", F.when(complete, dof)).withColumn(
        "t",
        F.when(complete, F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled * (1 / n1 + 1 / n2)))),
    )
    return stats.select(
        "seq",
        F.lit(category).alias("category"),
        "measure",
        F.lit(groups[0]).cast("string").alias("group1"),
        F.lit(groups[1]).cast("string").alias("group2"),
        "n1", "n2", "mean1", "mean2", "t", "dof",
        t_two_sided_p(F.col("t"), F.col("dof")).alias("p_value"),
        F.coalesce(F.try_divide(F.col("mean2") - F.col("mean1"), F.col("mean1")) * 100, F.lit(0.0)).alias("diff_pct"),
    )


def ttest_against_rest(
    df: DataFrame, category: str, metrics: Sequence[str], min_n: int = 30, members: Members | None = None
) -> DataFrame:
    """Pooled t-test of every member of a category against all other rows, for each metric.

    One grouped aggregate keeps count, sum and sum of squared deviations of each member, unless `members` were
    measured before; those of the rest follow from the totals over the members. Rows without a member are left out.
    """
    member = F.col(f"`{category}`")
    values = [clean(df, m).cast("double") for m in metrics]
    cells = []
    for j, v in enumerate(values):
        cells += [F.count(v).alias(f"n{j}"), F.avg(v).alias(f"m{j}"), F.var_pop(v).alias(f"v{j}")]
    groups = members.of(category, metrics) if members else (
        df.filter(member.isNotNull()).groupBy(member.cast("string").alias("member")).agg(F.count(F.lit(1)).alias("rows"), *cells)
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(j).alias("seq"), F.lit(m).alias("measure"), F.col(f"n{j}").alias("n1"), F.col(f"m{j}").alias("mean1"),
                F.col(f"v{j}").alias("pop1"),
            )
            for j, m in enumerate(metrics)
        ]
    )
    listed = groups.select("member", "rows", F.inline(rows))
    whole = listed.groupBy("seq").agg(
        F.sum("n1").alias("n"),
        F.sum("rows").alias("all_rows"),
        F.try_divide(F.sum(F.col("n1") * F.col("mean1")), F.sum("n1")).alias("mean"),
        F.sum(F.col("n1") * F.col("pop1")).alias("inside"),
        F.sum(F.col("n1") * F.col("mean1") * F.col("mean1")).alias("squares"),
    )
    # One row per metric.
    both = listed.join(F.broadcast(whole), "seq").withColumn("n2", F.col("n") - F.col("n1"))
    between = F.greatest(F.col("squares") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    total = F.col("inside") + between
    both = both.withColumn("mean2", F.try_divide(F.col("n") * F.col("mean") - F.col("n1") * F.col("mean1"), F.col("n2")))
    # The spread within both sides is the total less what lies between the member and the rest.
    gap = F.col("mean1") - F.col("mean2")
    within = F.greatest(total - F.col("n1") * F.col("n2") / F.col("n") * gap * gap, F.lit(0.0))
    complete = (
        (F.col("n1") >= min_n) & (F.col("n2") >= min_n) & (F.col("n1") == F.col("rows")) & (F.col("n2") == F.col("all_rows") - F.col("rows"))
    )
    dof = (F.col("n") - 2).cast("double")
    both = both.withColumn("dof", F.when(complete, dof)).withColumn(
        "t", F.when(complete, F.try_divide(gap, F.sqrt(within / dof * (1 / F.col("n1") + 1 / F.col("n2")))))
    )
    return both.select(
        "seq",
        F.lit(category).alias("category"),
        "measure",
        F.lit("all others").alias("group1"),
        F.col("member").alias("group2"),
        F.col("n2").alias("n1"), F.col("n1").alias("n2"), F.col("mean2").alias("mean1"), F.col("mean1").alias("mean2"),
        (-F.col("t")).alias("t"), "dof",
        t_two_sided_p(F.col("t"), F.col("dof")).alias("p_value"),
        F.coalesce(F.try_divide(F.col("mean1") - F.col("mean2"), F.col("mean2")) * 100, F.lit(0.0)).alias("diff_pct"),
    )


def ttest_insight(
    df: DataFrame,
    category: str | None = None,
    metrics: Sequence[str] | None = None,
    groups: Sequence[str] | str | None = None,
    min_n: int = 30,
    alpha: float = 0.05,
    high_alpha: float = 0.01,
    max_metrics: int | None = None,
    members: Members | None = None,
) -> DataFrame:
    """Metrics whose means differ between groups of a category beyond chance.

    Without a category, all of them are tested, each member against all other rows; `groups="rest"` does so
    for a named category. Otherwise two groups are compared: those named, or the first two in sorted order.
    """
    names = _default_metrics(df, metrics, max_metrics)
    cats = [category] if category else categorical_columns(df)
    parts = []
    for i, name in enumerate(cats):
        if groups == "rest" or groups is None and category is None:
            part = ttest_against_rest(df, name, names, min_n, members)
        else:
            part = ttest_measures(df, name, names, None if groups == "first two" else groups, min_n)
        parts.append(part.withColumn("seq", F.col("seq") + i * len(names)))
    found = reduce(DataFrame.unionByName, parts).filter(F.col("p_value") < alpha)
    # Titles and descriptions.
    return found.select(
        "seq",
        F.lit("statistical_test").alias("type"),
        F.concat(F.lit("Statistically Significant Difference in "), _labels(names, "measure")).alias("title"),
        F.concat(
            F.col("group2"), F.lit(" vs "), F.col("group1"),
            F.format_string(": %.1f%% difference (p=%.4f)", F.abs("diff_pct"), F.col("p_value")),
        ).alias("description"),
        F.when(F.col("p_value") < high_alpha, "high").otherwise("medium").alias("priority"),
        F.concat("category", F.lit("_"), "measure", F.lit("_ttest")).alias("metric"),
        F.col("p_value").alias("value"),
        "category", "measure", "group1", "group2", "t", "dof", "diff_pct",
    )


def ols_line(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Least-squares line of y on x, overall or per group."""
    cx, cy = clean(df, x).cast("double"), clean(df, y).cast("double")
    both = df.filter(cx.isNotNull() & cy.isNotNull())
    if by:
        both = both.filter(clean(df, by).isNotNull())
    return both.groupBy(*([f"`{by}`"] if by else [])).agg(
        F.regr_slope(cy, cx).alias("slope"),
        F.regr_intercept(cy, cx).alias("intercept"),
        F.regr_r2(cy, cx).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


