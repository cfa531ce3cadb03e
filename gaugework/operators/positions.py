"""Dense row numbers of large tables, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.storage import written


def number_rows(df: DataFrame, *order: str, out: str = "position") -> DataFrame:
    """df with `out`: 0, 1, 2, ... in the order of the columns, which should tell all rows apart. Rows are dealt by ranges, sorted, written once with their number in
    their partition, and moved by the rows of the partitions before; the window runs over partitions."""
    local = F.monotonically_increasing_id()  # partition << 33 | row
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__local", local))
    part = F.shiftright("__local", 33).alias("__part")
    counts = rows.groupBy(part).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = rows.withColumn("__part", F.shiftright("__local", 33)).join(F.broadcast(starts), "__part")  # a row per partition
    return joined.withColumn(out, (F.col("__start") + F.col("__local").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("__part", "__local", "__start")
