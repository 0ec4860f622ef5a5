"""Places and running totals over whole tables and over keys of any size, without sorting one key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.shared import settle

#: Places of one block of a running total.
BLOCK = 4096


def _in_order(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df, settled, with `_at` = 0, 1, ... in this order: ranges are sorted apart, and ids that grow within each are settled with the rows, so that a
    rerun of a task can't change them; a row for each range tells where it starts."""
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order)
    ranged = settle(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    placed = ranged.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return placed.withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")).drop("_part", "_before")


def global_rank(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """df with 1, 2, ... in the given order. The order should be total; equal rows are placed in any order."""
    return _in_order(df, list(order)).withColumn(name, F.col("_at") + 1).drop("_at")


def numbered(df: DataFrame, keys: list[str], *order, name: str = "place") -> DataFrame:
    """df with 0, 1, ... in the given order within each key; a key of any size is spread over ranges."""
    placed = _in_order(df, [*keys, *order])
    starts = placed.groupBy(*keys).agg(F.min("_at").alias("_start"))
    return settle(placed.join(starts, keys).withColumn(name, F.col("_at") - F.col("_start")).drop("_at", "_start"))


SUM = (F.sum, lambda a, b: a + b)
XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def running(rows: DataFrame, keys: list[str], place: str, totals: dict[str, tuple[Callable, Callable]], last_first: bool = False, block: int = 0) -> DataFrame:
    """Inclusive running totals over the places of each key, in two levels: within blocks of places, then over the blocks' totals. totals: column (without
    nulls) -> (aggregate, how two totals join); the column is replaced."""
    order = (lambda c: F.col(c).desc()) if last_first else F.col
    rows = rows.withColumn("_block", F.floor(F.col(place) / (block or BLOCK)))
    span = Window.partitionBy(*keys, "_block").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "_block").agg(*[total(c).alias(c) for c, (total, _) in totals.items()])
    blocks = blocks.select(*keys, "_block", *[total(c).over(before).alias(f"_{c}_before") for c, (total, _) in totals.items()]).where(F.col(f"_{next(iter(totals))}_before").isNotNull())
    kept = [c for c in rows.columns if c not in totals]
    here = rows.select(*kept, *[total(c).over(span).alias(c) for c, (total, _) in totals.items()])
    both = here.join(blocks, [*keys, "_block"], "left")
    return both.select(*[c for c in kept if c != "_block"], *[F.coalesce(join(F.col(c), F.col(f"_{c}_before")), F.col(c)).alias(c) for c, (_, join) in totals.items()])
