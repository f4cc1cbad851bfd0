"""Column profiles, issues and the data quality score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyglass.functions.columns import clean, is_above, is_below, sample_kurtosis, sample_skewness
from tallyglass.operators.clean import number_text_columns
from tallyglass.operators.roles import categorical_columns, detect_date, is_date_type, numeric_columns, with_dates
from tallyglass.plans.ordered import never_decreases
from tallyglass.plans.selection import exact_quantiles

# Scans of a table that count the distinct values of its columns.
MOST_SCANS = 32


def side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    """One-row frames with different columns as a single row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for f in frames for c in f.columns])


def per_column(df: DataFrame, cells: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over the table, returned as one row per column name."""
    structs = [
        F.struct(F.lit(i).alias("seq"), F.lit(c).alias("name"), *[v.alias(k) for k, v in parts.items()])
        for i, (c, parts) in enumerate(cells.items())
    ]
    return df.agg(F.array(*structs).alias("cells")).select(F.inline("cells"))


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct non-missing values per column. Exact counting shuffles distinct values, never rows, and one frequent
    value is merged before it. Each column has a scan of its own, which reads no other and leaves a task the values of
    one column at a time; beyond MOST_SCANS columns several share a scan. Stage a table that is dear to compute.

    A value travels as one or two numbers: whole numbers and moments as themselves, other numbers by the 64-bit hash of
    their eight bytes, which is one to one, and all else by 128 bits of hashes."""
    if not exact:
        return per_column(df, {c: {"unique_count": F.approx_count_distinct(clean(df, c))} for c in df.columns})
    cells, zero = [], F.lit(0).cast("long")
    for i, f in enumerate(df.schema):
        c, kind, rest = clean(df, f.name), f.dataType, None
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.unix_micros(c.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            value = F.unix_date(c).cast("long")
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            value = c.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            # the two zeros are one value
            value = F.xxhash64(F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double")))
        else:
            same = c.cast("string")
            value, rest = F.xxhash64(same), F.xxhash64(F.lit(i), same)
        cells.append([F.when(c.isNotNull(), value).alias("v"), *([] if rest is None else [rest.alias("w")])])
    share, counts = -(-len(cells) // MOST_SCANS), []
    for at in range(0, len(cells), share):
        some = [F.struct(F.lit(at + i).alias("seq"), *(cell if len(cell) > 1 else [*cell, zero.alias("w")])) for i, cell in enumerate(cells[at : at + share])]
        if share > 1:
            values = df.select(F.inline(F.array(*some))).filter(F.col("v").isNotNull()).distinct()
            counts.append(values.groupBy("seq").agg(F.count(F.lit(1)).alias("n")))
        else:
            # Neither the number of the one column nor an unused second hash is moved.
            values = df.select(*cells[at]).filter(F.col("v").isNotNull()).distinct()
            counts.append(values.agg(F.lit(at).alias("seq"), F.count(F.lit(1)).alias("n")))
    names = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(c).alias("name")) for i, c in enumerate(df.columns)])
    listed = df.sparkSession.range(1).select(F.inline(names))
    found = listed.join(reduce(DataFrame.unionAll, counts), "seq", "left")
    return found.select("seq", "name", F.coalesce("n", F.lit(0)).alias("unique_count"))


def column_profile(df: DataFrame, exact: bool = True, order_by: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, missing and distinct ratio, variance of numbers, and, where an order is
    given, whether numbers never decrease along it."""
    none = F.lit(None).cast("double")
    numbers = numeric_columns(df)
    cells = {}
    for f in df.schema:
        c = clean(df, f.name)
        cells[f.name] = {
            "dtype": F.lit(f.dataType.simpleString()),
            "n_rows": F.count(F.lit(1)),
            "null_count": F.count_if(c.isNull()),
            "is_numeric": F.lit(f.name in numbers),
            "is_datetime": F.lit(is_date_type(f.dataType)),
            "variance": F.var_samp(c) if f.name in numbers else none,
        }
    profile = per_column(df, cells).join(distinct_counts(df, exact).drop("seq"), "name")
    if order_by and numbers:
        profile = profile.join(never_decreases(df, numbers, order_by), "name", "left")
        monotonic = F.coalesce("monotonic", F.lit(False))
    else:
        monotonic = F.when(F.col("is_numeric"), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return profile.select(
        "seq",
        "name",
        "dtype",
        F.coalesce(F.try_divide("null_count", "n_rows"), F.lit(0.0)).alias("null_ratio"),
        (F.col("unique_count") / F.greatest("n_rows", F.lit(1))).alias("unique_ratio"),
        "is_numeric",
        "is_datetime",
        "variance",
        monotonic.alias("monotonic"),
        "unique_count",
    )


def is_monotonic(df: DataFrame, columns: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Whether numeric columns never decrease along the order; false where a value is missing."""
    return never_decreases(df, [columns] if isinstance(columns, str) else list(columns), order_by)


def data_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: table size, missing and distinct counts and shares, moments of numbers."""
    none = F.lit(None).cast("double")
    numbers = numeric_columns(df)
    cells = {}
    for f in df.schema:
        c = clean(df, f.name)
        number = f.name in numbers
        cells[f.name] = {
            "dtype": F.lit(f.dataType.simpleString()),
            "n_rows": F.count(F.lit(1)),
            "n_columns": F.lit(len(df.columns)),
            "null_count": F.count_if(c.isNull()),
            "mean": F.avg(c) if number else none,
            "std": F.stddev_samp(c) if number else none,
            "min": F.min(c).cast("double") if number else none,
            "max": F.max(c).cast("double") if number else none,
            "skewness": sample_skewness(c) if number else none,
            "kurtosis": sample_kurtosis(c) if number else none,
        }
    profile = per_column(df, cells).join(distinct_counts(df, exact).drop("seq"), "name")
    return profile.select(
        "seq",
        "name",
        "dtype",
        "n_rows",
        "n_columns",
        "null_count",
        (F.try_divide("null_count", "n_rows") * 100).alias("null_pct"),
        "unique_count",
        (F.try_divide("unique_count", "n_rows") * 100).alias("unique_pct"),
        "mean",
        "std",
        "min",
        "max",
        "skewness",
        "kurtosis",
    )


def outlier_tests(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[Column, float, float]]:
    """Per column with values: the test for lying outside the interquartile fences, and the fences."""
    tests = {}
    for c, (q1, q3) in exact_quantiles(df, {c: [0.25, 0.75] for c in columns}).items():
        if q1 is not None:
            lower, upper = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
            tests[c] = (is_below(df, c, lower) | is_above(df, c, upper), lower, upper)
    return tests


def profile_issues(df: DataFrame, max_skew: float = 2.0, max_outlier_share: float = 0.05, max_null_pct: float = 5.0) -> DataFrame:
    """Skewed columns, columns with many outliers and columns with many missing values."""
    numbers = numeric_columns(df)
    tests = outlier_tests(df, numbers)
    none = F.lit(None).cast("double")
    cells = {}
    for name in df.columns:
        c = clean(df, name)
        cells[name] = {
            "n_rows": F.count(F.lit(1)),
            "nulls": F.count_if(c.isNull()),
            "skewness": sample_skewness(c) if name in numbers else none,
            "outliers": F.count_if(tests[name][0]) if name in tests else F.lit(None).cast("long"),
        }
    outlier_pct = F.try_divide("outliers", "n_rows") * 100
    null_pct = F.try_divide("nulls", "n_rows") * 100
    name = F.col("name")
    found = F.array(
        F.when(
            F.abs("skewness") > max_skew,
            F.struct(F.lit(1).alias("rule"), F.lit("skewness").alias("issue_type"), F.col("skewness").alias("value"),
                     F.concat(F.lit("High skewness in "), name).alias("issue")),
        ),
        F.when(
            F.col("outliers") > F.col("n_rows") * max_outlier_share,
            F.struct(F.lit(2).alias("rule"), F.lit("outliers").alias("issue_type"), outlier_pct.alias("value"),
                     F.format_string("%d outliers in %s (%.1f%%)", F.col("outliers"), name, outlier_pct).alias("issue")),
        ),
        F.when(
            null_pct > max_null_pct,
            F.struct(F.lit(3).alias("rule"), F.lit("missing").alias("issue_type"), null_pct.alias("value"),
                     F.format_string("High missing values in %s (%.1f%%)", name, null_pct).alias("issue")),
        ),
    )
    return (
        per_column(df, cells)
        .withColumn("hit", F.explode(F.filter(found, lambda x: x.isNotNull())))
        .select("seq", "name", "hit.rule", "hit.issue_type", "hit.value", "hit.issue")
    )


def row_digest(df: DataFrame) -> list[Column]:
    """Two hashes of a row's cells, 128 bits that are equal for rows that `distinct` holds for equal."""
    cells, missing = [], []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(F.struct(c.alias("c")), {"ignoreNullFields": "false"})
        cells.append(c)
        missing.append(F.when(F.col(f"`{f.name}`").isNull(), "1").otherwise("0"))
    # a hash passes over missing cells, so which are missing is hashed as well
    holes = F.concat(*missing)
    return [F.xxhash64(holes, *cells).alias("h1"), F.xxhash64(*cells[::-1], F.lit(1), holes).alias("h2")]


def quality_score(df: DataFrame) -> DataFrame:
    """Completeness, row uniqueness and type consistency in percent, and their weighted total.

    Rows are told apart by 128 bits of hashes, so only those are shuffled, copies merged before it.
    """
    width = len(df.columns)
    missing = reduce(lambda a, b: a + b, [clean(df, c).isNull().cast("long") for c in df.columns])
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"))
    distinct = df.select(*row_digest(df)).distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    consistency = max(100.0 - 5.0 * len(number_text_columns(df, empty=True)), 0.0)
    cells = F.col("total_rows") * width
    return (
        side_by_side([counts, distinct])
        .select(
            F.coalesce(F.try_divide(cells - F.col("missing_cells"), cells) * 100, F.lit(0.0)).alias("completeness"),
            F.coalesce(F.try_divide("distinct_rows", "total_rows") * 100, F.lit(0.0)).alias("uniqueness"),
            F.lit(consistency).alias("consistency"),
            F.col("missing_cells"),
            (F.col("total_rows") - F.col("distinct_rows")).alias("duplicate_rows"),
            F.col("total_rows"),
            F.lit(width).alias("total_columns"),
        )
        .select(
            (F.col("completeness") * 0.4 + F.col("uniqueness") * 0.3 + F.col("consistency") * 0.3).alias("overall"), "*"
        )
    )


def quality_band(score: DataFrame) -> DataFrame:
    """Adds excellent (from 90), good (from 70) or poor."""
    return score.withColumn(
        "band", F.when(F.col("overall") >= 90, "excellent").when(F.col("overall") >= 70, "good").otherwise("poor")
    )


def quick_stats(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """One row: table size, columns by kind and the date range."""
    name, fmt = (date_col, None) if date_col else detect_date(df)
    date = F.col(f"`{name}`") if name else F.lit(None).cast("timestamp_ntz")
    texts = categorical_columns(df)
    df = with_dates(df, name, fmt) if name else df
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(texts)).alias("n_categories"),
        F.date_format(F.min(date), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max(date), "yyyy-MM-dd").alias("max_date"),
    )


def table_context(df: DataFrame, max_categories: int = 10, date_col: str | None = None) -> DataFrame:
    """Per column: missing share, range and mean of numbers, first categories of text, date range.

    The listed categories are the `max_categories` smallest ones, a top-n of the distinct values.
    """
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    numbers, names = numeric_columns(df), categorical_columns(df)
    date, fmt = (date_col, None) if date_col else detect_date(df)
    dated = with_dates(df, date, fmt) if date else df
    cells = {}
    for f in df.schema:
        c = clean(dated, f.name)
        number, is_date = f.name in numbers, f.name == date
        cells[f.name] = {
            "dtype": F.lit(f.dataType.simpleString()),
            "null_pct": F.try_divide(F.count_if(c.isNull()), F.count(F.lit(1))) * 100,
            "min": F.min(c).cast("double") if number else none,
            "max": F.max(c).cast("double") if number else none,
            "mean": F.avg(c) if number else none,
            "range_start": F.min(c).cast("string") if is_date else text,
            "range_end": F.max(c).cast("string") if is_date else text,
        }
    context = per_column(dated, cells)
    if not names:
        return context.withColumn("categories", F.lit(None).cast("array<string>"))
    # All text columns in one pass, as (column, value); the cut is taken before the shuffle as well as after it.
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("category")) for c in names])
    values = df.select(F.inline(cells)).filter(F.col("category").isNotNull()).distinct()
    first = Window.partitionBy("name").orderBy("category")
    smallest = values.withColumn("__place", F.row_number().over(first)).filter(F.col("__place") <= max_categories)
    listed = smallest.groupBy("name").agg(F.array_sort(F.collect_list("category")).alias("categories"))
    return context.join(listed, "name", "left")
