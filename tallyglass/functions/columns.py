"""Column expressions shared by the operators. Everything here stays inside Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal number, optionally signed and with an exponent. Guards the casts, which would also
# take Java spellings such as "1d".
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL, so both spellings of "missing" behave alike."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(column, F.lit(None).cast("double"))
    return column


def is_above(df: DataFrame, name: str, value: float) -> Column:
    """`column > value` without NaN, written on the stored column so that the scan can use it."""
    column = F.col(f"`{name}`")
    above = column > value
    return above & ~F.isnan(column) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else above


def is_below(df: DataFrame, name: str, value: float) -> Column:
    return F.col(f"`{name}`") < value


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows with both values, NULL where a side is constant (the built-in raises)."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def label_of(name: str) -> str:
    """Display form of a column name: profit_margin -> Profit Margin."""
    return name.replace("_", " ").title()


def title_words(column: Column) -> Column:
    """`label_of` for a column that holds column names."""
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))


def plain_words(column: Column) -> Column:
    return F.replace(column, F.lit("_"), F.lit(" "))


def two_decimals(value: Column, mark: str = "") -> Column:
    """Text with two decimals (and a thousands mark before them), rounded on the exact binary value with ties to even.

    `format_string` rounds the shortest decimal spelling half up, so 3.125 and 2.675 come out
    differently from what most languages print. Scaled by a power of two the fraction is a whole
    number, and its hundredths are the upper bits of a hundred times it.
    """
    size = F.abs(value)
    scaled = ((size - F.floor(size)) * float(2**52)).cast("long") * 100
    rest, half = scaled.bitwiseAND(F.lit(2**52 - 1)), F.lit(2**51)
    down = F.shiftright(scaled, 52)
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    cents = F.floor(size) * 100 + down + up.cast("long")
    return F.format_string(f"%s%{mark}d.%02d", F.when(value < 0, "-").otherwise(""), F.floor(cents / 100), cents % 100)


def humanize(column: Column) -> Column:
    """1.23K / 4.56M / 7.89B, two decimals below a thousand (rounded up to it: 1,000.00), N/A for missing."""
    value = column.cast("double")
    size = F.abs(value)
    unit = F.when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).when(size >= 1e3, 1e3).otherwise(1.0)
    mark = F.when(size >= 1e9, "B").when(size >= 1e6, "M").when(size >= 1e3, "K").otherwise("")
    shown = F.when(size < 1e3, two_decimals(value, ",")).otherwise(F.concat(two_decimals(value / unit), mark))
    return F.when(value.isNull() | F.isnan(value), F.lit("N/A")).otherwise(shown)


def is_number_text(column: Column) -> Column:
    return F.trim(column).rlike(NUMBER_TEXT)


def sample_skewness(column: Column) -> Column:
    """Bias-corrected skewness: NULL below three values, 0 for a constant column."""
    n = F.count(column).cast("double")
    corrected = F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(F.nanvl(corrected, F.lit(0.0)), F.lit(0.0)))


def sample_kurtosis(column: Column) -> Column:
    """Bias-corrected excess kurtosis: NULL below four values, 0 for a constant column."""
    n = F.count(column).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6)
    return F.when(n >= 4, F.coalesce(F.nanvl(corrected, F.lit(0.0)), F.lit(0.0)))


def t_two_sided_p(t: Column, dof: Column, steps: int = 1000) -> Column:
    """Two-sided p-value of Student's t.

    With x = sqrt(dof) tan(a) the density becomes cos(a)^(dof-1), so p is the share of that curve's
    area beyond atan(|t|/sqrt(dof)). Simpson's rule over at most 40 standard deviations keeps the
    grid fine for any sample size.
    """
    top = F.least(F.lit(math.pi / 2), 40.0 / F.sqrt(dof))
    start = F.atan(F.abs(t) / F.sqrt(dof))

    def area(a: Column, b: Column) -> Column:
        h = (b - a) / steps
        total = F.aggregate(
            F.sequence(F.lit(0), F.lit(steps)),
            F.lit(0.0),
            lambda acc, i: acc
            + F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            * F.coalesce(
                F.exp((dof - 1) * 0.5 * F.log1p(-F.pow(F.sin(a + h * i), F.lit(2.0)))), F.lit(0.0)
            ),
        )
        return total * h / 3

    return F.when(t.isNull() | F.isnan(t), F.lit(None).cast("double")).otherwise(
        F.when(start >= top, F.lit(0.0)).otherwise(area(start, top) / area(F.lit(0.0), top))
    )
