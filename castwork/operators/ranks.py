"""Positions in a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of monotonically_increasing_id that count the rows of a partition.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[str | Column], out: str = "position", ranges: int | None = None) -> DataFrame:
    """Add ``out``, the 0-based position of each row in ``order``.

    The rows are range-partitioned and sorted within ranges, which names each by (range, place in it); one count per
    range gives the offsets. The ranged rows are checkpointed, so that a lost executor does not change the names, and
    only one row a range meets in one task. Rows that tie in ``order`` are numbered in any order among themselves."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    ranged = named.withColumn("_range", F.shiftright("_at", ROW_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return ranged.join(offsets.drop("_n"), "_range").withColumn(out, F.col("_first") + place).drop("_at", "_range", "_first")
