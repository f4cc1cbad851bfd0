"""Cleaning, type promotion, imputation, outlier removal and date features."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.columns import clean, is_number_text, sample_skewness
from tallyglass.plans.selection import exact_quantiles, most_frequent_of

# Symbols removed from text cells.
SYMBOLS = "[,₹%—]"
# No date under the formats below is longer.
LONGEST_DATE = 40
# Date spellings tried, in this order.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "dd-MM-yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
    "yyyyMMdd",
    "yyyy/M/d",
    "M/d/yyyy",
    "d/M/yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MM/dd/yyyy HH:mm[:ss]",
    "MM/dd/yyyy hh:mm[:ss] a",
    "dd/MM/yyyy HH:mm[:ss]",
)


def _text_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]


def _numeric_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and (columns is None or f.name in columns)
    ]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with a value in at least one column."""
    return df.na.drop(how="all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns with a value in at least one row; one pass counts them all."""
    filled = df.agg(*[F.count(clean(df, c)).alias(c) for c in df.columns]).first()
    return df.select(*[f"`{c}`" for c in df.columns if filled[c] > 0])


def strip_symbols(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Thousands separators, currency and percent signs and dashes leave text cells, then padding."""
    return df.withColumns(
        {c: F.trim(F.regexp_replace(F.col(f"`{c}`"), SYMBOLS, "")) for c in _text_columns(df, columns)}
    )


def _filled_text(column):
    return F.when(F.trim(column) != "", F.trim(column))


def number_text_columns(df: DataFrame, columns: Sequence[str] | None = None, empty: bool = False) -> dict[str, str]:
    """Text columns whose every value is a number -> "bigint" or "double"; `empty` also takes those without a value."""
    names = _text_columns(df, columns)
    if not names:
        return {}
    checks = []
    for i, c in enumerate(names):
        text = _filled_text(F.col(f"`{c}`"))
        whole = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
        checks += [
            F.count(text).alias(f"n{i}"),
            F.count(F.when(is_number_text(text), text)).alias(f"d{i}"),
            F.count(whole).alias(f"l{i}"),
        ]
    row = df.agg(*checks).first()
    kinds = {}
    for i, c in enumerate(names):
        if (row[f"n{i}"] or empty) and row[f"d{i}"] == row[f"n{i}"]:
            kinds[c] = "bigint" if row[f"l{i}"] == row[f"n{i}"] else "double"
    return kinds


def promote_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns become numbers where every value parses; missing values stay missing."""
    kinds = number_text_columns(df, columns)
    return df.withColumns({c: _filled_text(F.col(f"`{c}`")).try_cast(kind) for c, kind in kinds.items()})


def format_shape(fmt: str) -> str | None:
    """A regular expression for texts that could follow a date format; None for letters it does not know.

    A failed parse costs an exception per row, so texts of another shape are told apart first.
    """
    known = {"yyyy": "[0-9]{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]+", "d": "[0-9]{1,2}", "SSSSSS": "[0-9]{1,6}"}
    known.update({two: "[0-9]{2}" for two in ("MM", "dd", "HH", "hh", "mm", "ss")})
    known.update({"M": "[0-9]{1,2}", "a": "[AaPp][Mm]", "XXX": "(Z|[+-][0-9]{2}:[0-9]{2})"})
    out = []
    for token in re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|[^A-Za-z']", fmt):
        quoted, run, mark = token.group(1), token.group(2), token.group(0)
        if quoted is not None:
            out.append(re.escape(quoted))
        elif run:
            if run not in known:
                return None
            out.append(known[run])
        else:
            out.append({"[": "(", "]": ")?"}.get(mark, re.escape(mark)))
    return "^" + "".join(out) + "$"


def _parsed(text, fmt: str):
    """The text as a timestamp under one format, NULL where it does not fit."""
    moment, shape = F.try_to_timestamp(text, F.lit(fmt)), format_shape(fmt)
    return moment if shape is None else F.when(text.rlike(shape), moment)


def date_text_columns(
    df: DataFrame, formats: Sequence[str] = DATE_FORMATS, columns: Sequence[str] | None = None
) -> dict[str, str]:
    """Text columns whose every value parses under one of the formats -> that format."""
    names = _text_columns(df, columns)
    if not names:
        return {}
    checks = []
    for i, c in enumerate(names):
        text = _filled_text(F.col(f"`{c}`"))
        checks.append(F.count(text).alias(f"n{i}"))
        checks += [F.count(_parsed(text, f)).alias(f"f{i}_{j}") for j, f in enumerate(formats)]
    row = df.agg(*checks).first()
    found = {}
    for i, c in enumerate(names):
        fits = [f for j, f in enumerate(formats) if row[f"n{i}"] and row[f"f{i}_{j}"] == row[f"n{i}"]]
        if fits:
            found[c] = fits[0]
    return found


def parsed_text(df: DataFrame, name: str, fmt: str):
    """A text column as timestamps under one format."""
    return _parsed(_filled_text(F.col(f"`{name}`")), fmt).cast("timestamp_ntz")


def promote_timestamp(
    df: DataFrame, formats: Sequence[str] = DATE_FORMATS, columns: Sequence[str] | None = None
) -> DataFrame:
    """Text columns become timestamps where one format fits every value."""
    found = date_text_columns(df, formats, columns)
    return df.withColumns({c: parsed_text(df, c, f) for c, f in found.items()})


def settle_types(df: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """`promote_numeric` and then `promote_timestamp`, from one look at the table.

    A cell's date formats are a bit mask, and the masks of a column are combined by a bitwise and. A number counts for
    no format: where all cells are numbers the column is numeric, and no format fits both a number and another text.
    Only cells as short as a date and with a digit are tried.
    """
    names = _text_columns(df, None)
    if not names:
        return df
    # the cells of all columns as rows, so that one small expression looks at them
    cells = F.array(*[F.struct(F.lit(i).alias("seq"), _filled_text(F.col(f"`{c}`")).alias("text")) for i, c in enumerate(names)])
    text, number = F.col("text"), is_number_text(F.col("text"))
    fits = [F.when(_parsed(text, f).isNotNull(), F.lit(1 << j)).otherwise(0).cast("long") for j, f in enumerate(formats)]
    likely = (F.length(text) <= LONGEST_DATE) & text.rlike("[0-9]")
    rows = df.select(F.inline(cells)).filter(text.isNotNull()).withColumn("number", number)
    rows = rows.withColumn("mask", F.when(~F.col("number") & likely, reduce(lambda a, b: a.bitwiseOR(b), fits)).otherwise(0))
    whole = F.col("number") & text.rlike("^[+-]?[0-9]+$") & text.try_cast("bigint").isNotNull()
    counted = rows.groupBy("seq").agg(F.count("*"), F.count_if("number"), F.count_if(whole), F.bit_and("mask"))
    found, out = {r[0]: tuple(r)[1:] for r in counted.collect()}, {}
    for i, (filled, numbers, longs, mask) in found.items():
        c = names[i]
        if numbers == filled:
            out[c] = _filled_text(F.col(f"`{c}`")).try_cast("bigint" if longs == filled else "double")
        elif mask:
            out[c] = parsed_text(df, c, formats[(mask & -mask).bit_length() - 1])
    return df.withColumns(out)


def parse_named_dates(df: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Text columns with date or time in their name are parsed, and left alone where that fails."""
    named = [c for c in df.columns if "date" in c.lower() or "time" in c.lower()]
    return promote_timestamp(df, formats, named)


def clean_table(df: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """The whole cleaning sequence: empty rows and columns, symbols, numbers, then dates."""
    tidy = strip_symbols(drop_empty_columns(drop_empty_rows(df)))
    return promote_timestamp(promote_numeric(tidy), formats)


def _fill_plan(df: DataFrame, strategy: str, columns: Sequence[str] | None) -> list[tuple[str, int, str, object]]:
    """(column, missing values, method, fill value) for every column with something to fill."""
    names = [c for c in df.columns if columns is None or c in columns]
    counts = df.agg(*[F.count_if(clean(df, c).isNull()).alias(c) for c in names]).first()
    holes = [c for c in names if counts[c] > 0]
    numeric = _numeric_columns(df, holes)
    method = {c: strategy for c in holes}
    if strategy == "auto":
        skews = df.agg(*[sample_skewness(clean(df, c)).alias(c) for c in numeric]).first() if numeric else {}
        for c in holes:
            if c in numeric:
                method[c] = "median" if skews[c] is not None and abs(skews[c]) > 1 else "mean"
            else:
                method[c] = "mode"
    elif strategy in ("mean", "median", "zero"):
        # A mean, a median and a zero exist for numbers only.
        holes = numeric
    means = [c for c in holes if method[c] == "mean"]
    value: dict[str, object] = {}
    if means:
        value.update(df.agg(*[F.avg(clean(df, c)).alias(c) for c in means]).first().asDict())
    medians = exact_quantiles(df, {c: [0.5] for c in holes if method[c] == "median"})
    value.update({c: v[0] for c, v in medians.items()})
    value.update(most_frequent_of(df, [c for c in holes if method[c] == "mode"]))
    for c in holes:
        if method[c] == "mode":
            if value[c] is None and strategy == "auto" and isinstance(df.schema[c].dataType, T.StringType):
                method[c], value[c] = "constant", "Unknown"
        elif method[c] == "zero":
            value[c] = 0
    return [(c, counts[c], method[c], value.get(c)) for c in holes]


def impute(df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None) -> DataFrame:
    """Fill or drop missing values: auto, mean, median, mode, drop or zero."""
    if strategy not in ("auto", "mean", "median", "mode", "drop", "zero"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "drop":
        kept = F.lit(True)
        for c in df.columns if columns is None else columns:
            kept = kept & clean(df, c).isNotNull()
        return df.filter(kept)
    fills = {}
    for c, _, method, value in _fill_plan(df, strategy, columns):
        if value is None:
            continue
        kind = df.schema[c].dataType
        # A mean or median of whole numbers need not be whole.
        kind = T.DoubleType() if method in ("mean", "median") else kind
        fills[c] = F.coalesce(clean(df, c).cast(kind), F.lit(value).cast(kind))
    return df.withColumns(fills)


def impute_log(df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None) -> DataFrame:
    """What `impute` does to each column with missing values: column, n_filled, method."""
    if strategy == "drop":
        names = list(df.columns if columns is None else columns)
        rows, kept = [], F.lit(True)
        # Later columns only lose the rows that earlier ones left.
        checks = []
        for i, c in enumerate(names):
            checks.append(F.count_if(kept & clean(df, c).isNull()).alias(f"c{i}"))
            kept = kept & clean(df, c).isNotNull()
        counts = df.agg(*checks).first()
        rows = [(c, counts[i], "drop rows") for i, c in enumerate(names) if counts[i]]
    else:
        rows = [(c, n, method) for c, n, method, _ in _fill_plan(df, strategy, columns)]
    return df.sparkSession.createDataFrame(rows, "column string, n_filled long, method string")


def outlier_bounds(df: DataFrame, name: str, k: float) -> tuple[float, float] | None:
    q1, q3 = exact_quantiles(df, {name: [0.25, 0.75]})[name]
    return None if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))


def remove_outliers(
    df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns: Sequence[str] | None = None
) -> DataFrame:
    """Keep rows inside the bounds, column after column; each column sees what the ones before left."""
    names = _numeric_columns(df, columns)
    if columns is not None:
        names = [c for c in columns if c in names]
    for c in names:
        value = clean(df, c)
        if method == "iqr":
            bounds = outlier_bounds(df, c, threshold)
            # NaN sorts above every bound, so the stored column serves and the scan can use the filter.
            keep = F.lit(False) if bounds is None else F.col(f"`{c}`").between(*bounds)
        elif method == "zscore":
            mean, spread = df.agg(F.avg(value), F.stddev_pop(value)).first()
            # A constant column has no z-scores, so nothing lies within the threshold.
            keep = F.abs((value - F.lit(mean)) / F.lit(spread)) < threshold if spread else F.lit(False)
        else:
            raise ValueError(f"unknown method {method}")
        df = df.filter(keep)
    return df


def outlier_log(before: DataFrame, after: DataFrame, method: str) -> DataFrame:
    """Rows removed between two versions of a table."""
    both = before.select(F.lit(1).alias("side")).unionAll(after.select(F.lit(-1).alias("side")))
    return both.agg(F.coalesce(F.sum("side"), F.lit(0)).alias("n_removed")).select("n_removed", F.lit(method).alias("method"))


def date_features(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """Calendar parts of the date column: Monday is 0, Saturday and Sunday are the weekend, ISO weeks."""
    from tallyglass.operators.roles import detect_date_column

    name = date_col or detect_date_column(df)
    if name is None:
        return df
    if isinstance(df.schema[name].dataType, T.StringType):
        df = promote_timestamp(df, columns=[name])
    d = F.col(f"`{name}`")
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "month_name": F.date_format(d, "MMMM"),
            "day_of_week": F.weekday(d),
            "day_name": F.date_format(d, "EEEE"),
            "is_weekend": F.weekday(d).isin(5, 6).cast("int"),
            "quarter": F.quarter(d),
            "week_of_year": F.weekofyear(d),
        }
    )
