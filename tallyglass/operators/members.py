"""What several analyses need to know of the members of categories, from one pass over the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import clean
from tallyglass.plans.staging import stage


@dataclass
class Members:
    """A row per category and member: rows, and per metric count n, mean m, spread v, and the means of the earlier rows
    a and the later rows b where a cut was given."""

    table: DataFrame
    categories: list[str]
    metrics: list[str]

    def of(self, category: str, metrics: Sequence[str]) -> DataFrame:
        """Members of one category; the fields of its j-th metric are nj, mj, vj (aj, bj)."""
        fields = [f for f in "nmvab" if f"{f}0" in self.table.columns]
        chosen = [F.col(f"{f}{self.metrics.index(m)}").alias(f"{f}{j}") for j, m in enumerate(metrics) for f in fields]
        return self.table.filter(F.col("category_seq") == self.categories.index(category)).select("member", "rows", *chosen)


def measure_members(df: DataFrame, categories: Sequence[str], metrics: Sequence[str], head: Column | None = None) -> Members:
    """Reads the table once for all categories and metrics; `head` is a test for the earlier rows.

    A row counts for its member in each category, before the shuffle merges members. Members are text; rows without a
    member are left out of its category. The result, a row per member, is written once.
    """
    cells = [F.struct(F.lit(i).alias("category_seq"), F.col(f"`{c}`").cast("string").alias("member")) for i, c in enumerate(categories)]
    values = [clean(df, m).cast("double").alias(f"x{j}") for j, m in enumerate(metrics)]
    rows = df.select(F.inline(F.array(*cells)), *values, *([] if head is None else [head.alias("head")]))
    folds = [F.count(F.lit(1)).alias("rows")]
    for j in range(len(metrics)):
        x = F.col(f"x{j}")
        folds += [F.count(x).alias(f"n{j}"), F.avg(x).alias(f"m{j}"), F.var_pop(x).alias(f"v{j}")]
        if head is not None:
            folds += [F.avg(F.when(F.col("head"), x)).alias(f"a{j}"), F.avg(F.when(~F.col("head"), x)).alias(f"b{j}")]
    table = rows.filter(F.col("member").isNotNull()).groupBy("category_seq", "member").agg(*folds)
    return Members(stage(table, "members"), list(categories), list(metrics))
