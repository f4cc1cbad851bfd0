"""The semantic catalog: governed metrics, dimensions, the time column and hierarchies, kept as JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
  time_column string,
  dimensions array<string>,
  metrics array<struct<name:string,column:string,aggregation:string,format:string,description:string,unit:string>>,
  hierarchies map<string,array<string>>
"""


@dataclass(frozen=True)
class Metric:
    name: str
    column: str
    aggregation: str = "sum"
    format: str = "number"
    description: str = ""
    unit: str = ""

    @property
    def is_total(self) -> bool:
        return self.aggregation in ("sum", "total")


@dataclass(frozen=True)
class Catalog:
    metrics: tuple[Metric, ...] = ()
    dimensions: tuple[str, ...] = ()
    time_column: str | None = None
    hierarchies: dict[str, tuple[str, ...]] = field(default_factory=dict)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per metric definition, defaults filled in, with the catalog-level fields beside it."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    m = F.col("metric")
    return raw.withColumn("metric", F.explode_outer("metrics")).select(
        F.coalesce(m["name"], m["column"], F.lit("")).alias("name"),
        F.coalesce(m["column"], F.lit("")).alias("column"),
        F.coalesce(m["aggregation"], F.lit("sum")).alias("aggregation"),
        F.coalesce(m["format"], F.lit("number")).alias("format"),
        F.coalesce(m["description"], F.lit("")).alias("description"),
        F.coalesce(m["unit"], F.lit("")).alias("unit"),
        F.coalesce("dimensions", F.array().cast("array<string>")).alias("dimensions"),
        "time_column",
        F.coalesce("hierarchies", F.create_map().cast("map<string,array<string>>")).alias("hierarchies"),
        m.isNotNull().alias("is_metric"),
    )


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """The catalog as plain definitions; a catalog is a small hand-written file."""
    rows = read_catalog(spark, path).collect()
    if not rows:
        return Catalog()
    keys = ("name", "column", "aggregation", "format", "description", "unit")
    return Catalog(
        metrics=tuple(Metric(*(r[k] for k in keys)) for r in rows if r["is_metric"]),
        dimensions=tuple(rows[0]["dimensions"]),
        time_column=rows[0]["time_column"],
        hierarchies={k: tuple(v) for k, v in rows[0]["hierarchies"].items()},
    )


def validate_catalog(df: DataFrame, catalog: Catalog) -> DataFrame:
    """One row per definition that names no column, or one the table does not have."""
    spark = df.sparkSession
    # The wording of the issues.
    wanted = [
        (i, m.column or None, f"Metric '{m.name}' is missing a column mapping.", f"Metric '{m.name}' column '{m.column}' not found.")
        for i, m in enumerate(catalog.metrics)
    ]
    wanted += [
        (len(wanted) + i, d, "", f"Dimension '{d}' not found in dataset.") for i, d in enumerate(catalog.dimensions)
    ]
    if catalog.time_column:
        wanted.append((len(wanted), catalog.time_column, "", f"Time column '{catalog.time_column}' not found in dataset."))
    definitions = spark.createDataFrame(wanted, "seq int, column string, unmapped string, absent string")
    present = spark.createDataFrame([(c,) for c in df.columns], "column string")
    return (
        definitions.join(present, "column", "left_anti")
        .select("seq", F.when(F.col("column").isNull(), F.col("unmapped")).otherwise(F.col("absent")).alias("issue"))
        .orderBy("seq")
    )
