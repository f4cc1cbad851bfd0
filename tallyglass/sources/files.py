"""Reading tables, and writing tables, insights, forecasts and saved results."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.operators import roles
from tallyglass.operators.profile import quality_score
from tallyglass.plans.staging import stage
from tallyglass.sources.quoted import cut_records, joined_pieces

# Spellings read as missing in CSV input.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    na_tokens: Sequence[str] = NA_TOKENS,
    schema: T.StructType | str | None = None,
    quoted_breaks: bool = True,
) -> DataFrame:
    """CSV with a header. Without a schema every column is read as text and its type settled after
    the missing-value spellings are gone, so one "N/A" does not turn a number column into text.

    Values in quotes may hold line breaks. The files are still read by byte ranges (see `quoted`), and their records
    written once to the shared folder, where all later reads find them. `quoted_breaks=False` leaves that out for files
    whose values are known to hold none. Lines end in a line feed, with or without a carriage return.
    """
    reader = spark.read.option("header", True).option("multiLine", quoted_breaks).option("escape", '"')
    if schema is not None:
        typed = reader.schema(schema).option("nullValue", "")
        return _parsed_records(spark, path, typed.csv(path).schema, nullValue="") if quoted_breaks else typed.csv(path)
    from tallyglass.operators.clean import settle_types

    # only the first record is read for the names
    raw = reader.option("inferSchema", False).csv(path)
    if quoted_breaks:
        raw = _parsed_records(spark, path, raw.schema)
    tokens = list(na_tokens)
    cleared = raw.select(
        *[F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    )
    return settle_types(cleared)


def _parsed_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, **options: str) -> DataFrame:
    # plain names inside, whatever the columns are called
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    # a carriage return may stand before a line's end
    text = F.regexp_replace("record", r"\r\z", "")
    cells = F.from_csv(text, plain.toDDL(), {"escape": '"', "multiLine": "true", **options}).alias("cells")
    cut = cut_records(spark, path).withColumn("whole", F.col("side").isNull())
    kept = cut.filter("not whole or not header and record <> '' and record <> '\\r'")
    read = stage(kept.withColumn("cells", F.when(F.col("whole"), cells)).withColumn("record", F.when(~F.col("whole"), F.col("record"))), "csv")
    joined = joined_pieces(read.filter("not whole").drop("cells")).filter(~F.col("header"))
    every = read.filter("whole").select("cells").unionByName(joined.select(cells))
    return every.select(*[F.col(f"cells.c{i}").alias(f.name) for i, f in enumerate(schema)])


def register(
    spark: SparkSession, paths: dict[str, str | Sequence[str]], fmt: str = "csv"
) -> dict[str, str]:
    """Make each file a temp view; returns name -> "ok" or the error, one bad file stops no other."""
    outcome = {}
    for name, path in paths.items():
        try:
            table = read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
            table.createOrReplaceTempView(name)
            outcome[name] = "ok"
        except (AnalysisException, PySparkException) as error:
            outcome[name] = str(error).splitlines()[0]
    return outcome


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """The whole table, one file per partition; CSV carries a header and full-precision timestamps."""
    if fmt == "csv":
        df = df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema if roles.is_date_type(f.dataType)})
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def insights_csv(insights: DataFrame, path: str | None = None) -> DataFrame:
    """Insights under their export headings; written as CSV when a path is given."""
    table = insights.select(
        F.col("type").alias("Type"),
        F.coalesce("priority", F.lit("medium")).alias("Priority"),
        F.col("title").alias("Title"),
        F.col("description").alias("Description"),
        F.coalesce("metric", F.lit("")).alias("Metric"),
        F.col("value").alias("Value"),
    )
    if path:
        write_table(table, path)
    return table


def forecast_export(forecast: DataFrame, path: str | None = None) -> DataFrame:
    """Forecast under its export headings, series keys kept in front."""
    keys = forecast.columns[: forecast.columns.index("ds")]
    table = forecast.select(
        *keys,
        F.col("ds").alias("Date"),
        F.col("yhat").alias("Forecast"),
        F.col("yhat_lower").alias("Lower"),
        F.col("yhat_upper").alias("Upper"),
    )
    if path:
        write_table(table, path)
    return table


def schema_summary(df: DataFrame, catalog=None, path: str | None = None) -> DataFrame:
    """One row: size, column names by role and the quality block; written as JSON when a path is given."""
    found = roles.resolve_schema(df, catalog)
    names = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    summary = quality_score(df).select(
        F.col("total_rows"),
        F.col("total_columns"),
        names(df.columns).alias("columns"),
        names(found.numeric).alias("numeric_columns"),
        names(found.categorical).alias("categorical_columns"),
        F.lit(found.date).cast("string").alias("date_column"),
        F.struct("*").alias("data_quality"),
    )
    if path:
        summary.write.json(path)
    return summary


def result_key(query: str) -> str:
    import hashlib

    return hashlib.md5(query.encode()).hexdigest()[:8]


def save_result(df: DataFrame, folder: str, query: str, title: str | None = None, text: str = "") -> str:
    """Keep a query result under an eight-character key of its question, with title and text beside it.

    Data goes to a folder of its own version, then one card file publishes that version: a writer lost before that
    leaves the former result as it was. The version before the published one stays for those who still read it.
    """
    key, spark = result_key(query), df.sparkSession
    # Fixed value: the title a saved result gets by default.
    shown = title or f"Insight: {query[:45]}{'...' if len(query) > 45 else ''}"
    before = _versions(spark, folder, key)
    # A number for the order, an id that keeps writers of the same number apart.
    version = f"{int(before[-1].split('-')[0]) + 1 if before else 1:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/data/key={key}/version={version}")
    card = spark.createDataFrame([(shown, query, text)], "title string, query string, text string").coalesce(1)
    card.write.parquet(f"{folder}/cards/key={key}/version={version}")
    for old in before[:-1]:
        for part in ("cards", "data"):
            _delete(spark, f"{folder}/{part}/key={key}/version={old}")
    return key


def _published(spark: SparkSession, folder: str) -> DataFrame:
    kinds = "title string, query string, text string, key string, version string"
    return spark.read.schema(kinds).option("basePath", f"{folder}/cards").parquet(f"{folder}/cards")


def _versions(spark: SparkSession, folder: str, key: str) -> list[str]:
    """The published versions of a key in their order: at most a few."""
    if not _exists(spark, f"{folder}/cards"):
        return []
    return sorted(r["version"] for r in _published(spark, folder).filter(F.col("key") == key).select("version").collect())


def saved_results(spark: SparkSession, folder: str) -> DataFrame:
    """Title, query, text and key of every result, as last published."""
    last = F.max_by(F.struct("title", "query", "text"), "version").alias("card")
    return _published(spark, folder).groupBy("key").agg(last).select("card.title", "card.query", "card.text", "key")


def load_result(spark: SparkSession, folder: str, key: str) -> DataFrame:
    found = _versions(spark, folder, key)
    if not found:
        raise FileNotFoundError(f"no saved result {key} in {folder}")
    return spark.read.parquet(f"{folder}/data/key={key}/version={found[-1]}")


def drop_result(spark: SparkSession, folder: str, key: str) -> None:
    """Remove one saved result, its cards first; the others stay."""
    for part in ("cards", "data"):
        _delete(spark, f"{folder}/{part}/key={key}")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def preview(df: DataFrame, n: int = 100, order_by: Sequence[str] = ()) -> DataFrame:
    """First n rows in the given order."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
