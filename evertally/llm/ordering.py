"""Global positions of sorted rows, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evertally.llm.tables import written

#: Bits below the partition in `monotonically_increasing_id` (fixed by Spark)
ROW_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str, column: str) -> DataFrame:
    """`rows` as a written table, with their place (from 0) in the global order as `column`.

    Rows are dealt by ranges of the order and sorted there; what a range starts with is the sum of the rows of
    the ranges before it. `rows` are evaluated twice, once for the range borders: pass a written table. Rows
    equal in `order` land in one range, so end it with something that tells many equal rows apart.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn(column, F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col(column), ROW_BITS)
    parts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = F.col(column).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    found = placed.join(F.broadcast(parts), part == F.col("_part"))
    return found.withColumn(column, F.col("_start") + within).drop("_part", "_start")
