"""Windows over a whole ordered table, spread over many tasks when the table is large."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions.columns import clean
from tallyglass.plans.staging import stage

# Consecutive rows that one task holds.
BLOCK_ROWS = 200_000
# Rows of a block of running sums: 2^16.
SUM_BITS = 16


def number_rows(df: DataFrame, order_by: Sequence[str], out: str = "position", ties: Sequence[str] = ()) -> DataFrame:
    """Adds 0-based positions in order: one range shuffle, then an offset per partition.

    The sorted rows are written before they are counted, so both reads see the same partitions. `ties` order rows that
    are equal in `order_by`; they are too long to be sampled as range borders.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by, *ties)
    numbered = stage(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    slot = F.shiftright("__id", 33)
    offsets = numbered.groupBy(slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__rows"))
    # One row per shuffle partition.
    offsets = offsets.select(
        "__slot", (F.sum("__rows").over(Window.orderBy("__slot")) - F.col("__rows")).alias("__before")
    )
    return (
        numbered.withColumn("__slot", slot)
        .join(F.broadcast(offsets), "__slot")
        .withColumn(out, F.col("__before") + F.col("__id").bitwiseAND(F.lit(2**33 - 1)))
        .drop("__slot", "__id", "__before")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the sum of `value` up to and with each row of its key's order, whatever a key's share of the rows.

    Rows are range-partitioned by key and order and written, so a large key spreads over many tasks. Blocks of
    consecutive rows are summed; the sums of a key's earlier blocks are carried into each, where the rows are added up.
    """
    ranged = df.repartitionByRange(*keys, *order_by).sortWithinPartitions(*keys, *order_by)
    placed = stage(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn("__block", F.shiftright("__id", SUM_BITS))
    blocks = placed.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__carry"))
    inside = Window.partitionBy(*keys, "__block").orderBy("__id")
    summed = placed.join(carried, [*keys, "__block"]).withColumn(out, F.sum(value).over(inside) + F.col("__carry"))
    return summed.drop("__id", "__block", "__carry")


def over_ordered(
    df: DataFrame,
    order_by: Sequence[str],
    lookback: int,
    columns: Callable[[Window], dict[str, Column]],
) -> DataFrame:
    """Adds window columns that look back at most `lookback` rows in the given order.

    The table is cut into blocks of consecutive positions, each with the last `lookback` rows of the block before it.
    """
    if lookback >= BLOCK_ROWS:
        raise ValueError(f"a window of {lookback} rows does not fit blocks of {BLOCK_ROWS}")
    block = F.floor(F.col("__at") / BLOCK_ROWS)
    late = F.col("__at") % BLOCK_ROWS >= BLOCK_ROWS - lookback
    copies = number_rows(df, order_by, "__at").withColumn(
        "__block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    return (
        copies.withColumns(columns(Window.partitionBy("__block").orderBy("__at")))
        .filter(F.col("__block") == block)
        .drop("__block", "__at")
    )


def never_decreases(df: DataFrame, names: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Per column whether its values never fall from one row to the next, false where any is missing.

    Rows move once, into partitions by range of the order. Each sorted partition is summed up as its first and last
    values and whether they rise in between; such summaries are joined in the order of the partitions.
    """
    order, values = list(order_by), [f"v{i}" for i in range(len(names))]
    ranged = (
        df.select(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], *[clean(df, c).alias(v) for v, c in zip(values, names, strict=True)])
        .repartitionByRange(*[f"o{i}" for i in range(len(order))])
        .sortWithinPartitions(*[f"o{i}" for i in range(len(order))])
        .select(F.spark_partition_id().alias("part"), *values)
    )
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema}
    schema = "part int, " + ", ".join(f"ok_{v} boolean, first_{v} {kinds[v]}, last_{v} {kinds[v]}" for v in values)
    parts = ranged.mapInArrow(_summed_up(values), schema)
    listed = parts.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("p"))
    p, n = F.col("p"), F.greatest(F.size("p") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(p, 1, n).alias("a"), F.slice(p, F.lit(2), n).alias("b"))

    def rises(v: str) -> Column:
        across = F.forall(pairs, lambda x: F.coalesce(x["a"][f"last_{v}"] <= x["b"][f"first_{v}"], F.lit(False)))
        return F.forall(p, lambda x: x[f"ok_{v}"]) & across

    cells = [F.struct(F.lit(c).alias("name"), rises(v).alias("monotonic")) for c, v in zip(names, values, strict=True)]
    return listed.select(F.inline(F.array(*cells)))


def _summed_up(values: Sequence[str]) -> Callable:
    """One row for a sorted partition: per column whether it never falls and misses nothing, its first and last value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rising, first, last, part, schema = dict.fromkeys(values, True), {}, {}, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, schema = batch.column("part")[0], batch.schema
            for v in values:
                column = batch.column(v)
                rising[v] = rising[v] and not column.null_count
                if not rising[v]:
                    continue
                n = len(column)
                first.setdefault(v, column[0])
                rising[v] = not pc.any(pc.less(column.slice(1), column.slice(0, n - 1))).as_py() and not (v in last and pc.less(column[0], last[v]).as_py())
                last[v] = column[n - 1]
        if part is not None:
            fields, cells = [pa.field("part", pa.int32())], [pa.array([part.as_py()], pa.int32())]
            for v in values:
                kind = schema.field(v).type
                ends = [x.get(v) if rising[v] else None for x in (first, last)]
                fields += [pa.field(f"ok_{v}", pa.bool_()), pa.field(f"first_{v}", kind), pa.field(f"last_{v}", kind)]
                cells += [pa.array([rising[v]]), *[pa.array([e.as_py() if e is not None else None], kind) for e in ends]]
            yield pa.RecordBatch.from_arrays(cells, schema=pa.schema(fields))

    return run
