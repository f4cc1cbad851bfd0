"""Flat business tables built from the provided Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.sources.catalog import Catalog, Metric


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The stored columns of each order line with its order, customer and part.

    Orders meet their customers first, so lines are moved for orders and parts alone. No side is forced: the optimizer
    broadcasts what it measures to be small and splits hot keys.
    """
    t = lambda name: table(spark, folder, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    bought = t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        t("lineitem")
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(*dict.fromkeys(c for stored in SALES_STORED.values() for c in stored))
    )


def computed_sales(stored: DataFrame, *columns: str) -> DataFrame:
    """Columns of `sales` from the stored ones they need."""
    margin = F.lit(0.10) + 3 * F.col("l_tax")
    price = F.col("l_extendedprice")
    formulas = {
        "profit_margin": margin,
        "returns": F.when(F.col("l_returnflag") == "R", 1).otherwise(0),
        "satisfaction_score": F.lit(3.0) + (F.col("p_size") % 21).cast("double") / 10,
        "profit": price * margin,
        "revenue": price * (1 - F.col("l_discount")),
        "cost": price - price * margin,
    }
    return stored.select(*[formulas.get(c, F.col(SALES_STORED[c][0])).alias(c) for c in columns])


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line with its customer's region and segment and its part's type."""
    return computed_sales(stored_sales(spark, folder), *SALES_COLUMNS)


# An order that tells all rows of `sales` apart.
SALES_ORDER = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sales"]
EVENT_ORDER = ["ts", "event_id"]


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def events_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Events with missing values, numbers and dates as text, and an empty column."""
    return events(spark, folder).select(
        "event_id",
        "ts",
        F.when(F.col("event_id") % 20 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 33 != 0, F.col("event_type")).alias("segment"),
        F.concat(F.lit("₹"), F.col("user_id").cast("string"), F.lit(",500 ")).alias("amount_text"),
        F.concat((F.col("event_id") % 100).cast("string"), F.lit("%")).alias("pct_text"),
        F.to_date("ts").cast("string").alias("date_text"),
        F.lit(None).cast("string").alias("empty_col"),
    )


def question_log(spark: SparkSession, folder: str) -> DataFrame:
    """A question per order, with its wording, group, number and segment taken from the order."""
    k = F.col("o_orderkey")
    dim = F.element_at(F.array(*[F.lit(d) for d in ("region", "category", "segment", "channel")]), (F.floor(k / 16) % 4 + 1).cast("int"))
    number = (k % 9 + 1).cast("string")
    wordings = [
        F.concat(F.lit("Total sales by "), dim),
        F.concat(F.lit("Average profit by "), dim),
        F.lit("Maximum quantity by month"),
        F.lit("Trend of sales over time"),
        F.lit("Show revenue growth"),
        F.lit("Compare sales and profit"),
        F.lit("Correlation between price and quantity"),
        F.concat(F.lit("Total revenue where segment is "), F.col("c_mktsegment"), F.lit(" by region")),
        F.concat(F.lit("Top "), number, F.lit(" products by revenue")),
        F.lit("Identify anomalies and outliers"),
        F.lit("What are the key insights from this data?"),
        F.lit("Monthly growth rate of sales"),
        F.lit("Show top performers and bottom performers"),
        F.concat(F.lit("Bottom "), number, F.lit(" regions by profit")),
        F.concat(F.lit("Median cost per "), dim),
        F.concat(F.lit("Sales where channel = '"), F.col("o_orderpriority"), F.lit("'")),
    ]
    text = wordings[-1]
    for i, wording in reversed(list(enumerate(wordings[:-1]))):
        text = F.when(k % 16 == i, wording).otherwise(text)
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(k.alias("id"), text.alias("text"))
    )


# The columns of `sales`, and the stored ones that each is computed from.
SALES_STORED = {
    "l_orderkey": ("l_orderkey",),
    "l_linenumber": ("l_linenumber",),
    "l_partkey": ("l_partkey",),
    "l_suppkey": ("l_suppkey",),
    "date": ("l_shipdate",),
    "sales": ("l_extendedprice",),
    "quantity": ("l_quantity",),
    "category": ("p_type",),
    "region": ("r_name",),
    "channel": ("o_orderpriority",),
    "segment": ("c_mktsegment",),
    "customer_id": ("o_custkey",),
    "profit_margin": ("l_tax",),
    "discount": ("l_discount",),
    "returns": ("l_returnflag",),
    "satisfaction_score": ("p_size",),
    "profit": ("l_extendedprice", "l_tax"),
    "revenue": ("l_extendedprice", "l_discount"),
    "cost": ("l_extendedprice", "l_tax"),
}
SALES_COLUMNS = list(SALES_STORED)

CATALOG = Catalog(
    metrics=(
        Metric("Revenue", "revenue", "sum", "currency", "Net revenue after discounts", "USD"),
        Metric("Profit", "profit", "sum", "currency", "Gross profit", "USD"),
        Metric("Average Discount", "discount", "average", "percent", "Mean discount rate", ""),
    ),
    dimensions=("region", "category", "segment"),
    time_column="date",
    hierarchies={"market": ("region", "segment", "channel")},
)
