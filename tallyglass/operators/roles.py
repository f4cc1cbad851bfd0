"""Which columns are numbers, categories and dates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.sources.catalog import Catalog, Metric

@dataclass(frozen=True)
class Roles:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    date: str | None
    metrics: tuple[Metric, ...] = ()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def is_date_type(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def detect_date(df: DataFrame, formats: Sequence[str] | None = None) -> tuple[str | None, str | None]:
    """(column, format) of the first column that is a date, or text whose every value parses under one format.

    One aggregate tests the whole of all text columns that come before a date column; the format is None for
    a column that has a date type.
    """
    from tallyglass.operators.clean import DATE_FORMATS, date_text_columns

    before: list[str] = []
    typed = None
    for f in df.schema:
        if is_date_type(f.dataType):
            typed = f.name
            break
        if isinstance(f.dataType, T.StringType):
            before.append(f.name)
    if before:
        found = date_text_columns(df.select(*[f"`{c}`" for c in before]), formats or DATE_FORMATS)
        for c in before:
            if c in found:
                return c, found[c]
    return typed, None


def detect_date_column(df: DataFrame, formats: Sequence[str] | None = None) -> str | None:
    """The name alone that `detect_date` finds."""
    return detect_date(df, formats)[0]


def with_dates(df: DataFrame, name: str, fmt: str | None = None) -> DataFrame:
    """The table with a text date column read as timestamps; a column of another kind stays as it is.

    Without a format the column is tested as a whole; text that is no date is left alone.
    """
    from tallyglass.operators.clean import parsed_text, promote_timestamp

    if not isinstance(df.schema[name].dataType, T.StringType):
        return df
    return df.withColumn(name, parsed_text(df, name, fmt)) if fmt else promote_timestamp(df, columns=[name])


def resolve_schema(df: DataFrame, catalog: Catalog | None = None) -> Roles:
    """Catalog columns that the table has win; whatever they leave open is detected."""
    if catalog is None:
        return Roles(tuple(numeric_columns(df)), tuple(categorical_columns(df)), detect_date_column(df))
    have = set(df.columns)
    metrics = tuple(m.column for m in catalog.metrics if m.column in have)
    dimensions = tuple(d for d in catalog.dimensions if d in have)
    return Roles(
        metrics or tuple(numeric_columns(df)),
        dimensions or tuple(categorical_columns(df)),
        catalog.time_column if catalog.time_column in have else detect_date_column(df),
        catalog.metrics,
    )


def role_table(df: DataFrame, found: Roles) -> DataFrame:
    """The resolved roles as rows, each with how many values its column holds."""
    from tallyglass.functions.columns import clean

    listed = [("metric", c) for c in found.numeric] + [("dimension", c) for c in found.categorical]
    if found.date:
        listed.append(("time", found.date))
    cells = [
        F.struct(
            F.lit(i).alias("seq"), F.lit(role).alias("role"), F.lit(c).alias("column"), F.count(clean(df, c)).alias("n_values")
        )
        for i, (role, c) in enumerate(listed)
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
