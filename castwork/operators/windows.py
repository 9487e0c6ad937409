"""Running sums and counts that stay parallel when one partition key is hot.

A running total over ``partitionBy(k).orderBy(o)`` sorts every row of a key
in one task. ``prefix_sum`` splits it in three steps:

1. totals per (key, bucket) - a hash aggregate with map-side combine;
2. a running total over the buckets of each key - at most as many rows as
   buckets (days, minutes), whatever the data size;
3. the running total inside each (key, bucket) plus the bucket's offset.

Step 1 reads the input a second time, but column-pruned to (key, bucket,
value) and combined map-side, so what it shuffles is one row per (key,
bucket) per task - not the rows. The join and the inner window share one
(key, bucket) exchange of the rows.

The bucket must be non-decreasing in the order (a coarser form of it: the
due day, the minute of a timestamp). With exact (integer or decimal) values the
result is identical to the one-window form.

A (key, bucket) can itself be hot: a third of all requests in one minute.
Where the size of what is read lets one bucket outgrow a task
(``SPLIT_BYTES``), ``prefix_sum`` therefore cuts by ranges of the whole order
instead of buckets. The rows are range-partitioned on (key, order), which
gives every task the same share whatever is hot; a running total over the
ranges of each key (a row per key and range) gives the offsets, and the inner
window runs within one range of one key. Both forms are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castwork.operators.ranks import ROW_BITS

# Bytes of input below which all rows of one bucket fit a task.
SPLIT_BYTES = 256 << 20
# Bytes of input for each part of ``spread``, and those up to which it leaves rows as they are.
TASK_BYTES = 8 << 20
SPREAD_FROM = 32 << 20
# What Catalyst states for a source of unknown size is above this.
UNKNOWN_BYTES = 1 << 50


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the sources that the plan reads, by Catalyst's statistics (no job is run); None where there are none.
    A source of unknown size counts as a very large one."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001 - a remote session has no plan here
        return None


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned on ``keys`` into one part for each ``TASK_BYTES`` of the sources it reads, at least
    ``spark.sql.shuffle.partitions``; unchanged where those are small.

    Left to itself, AQE merges the parts of an exchange up to 64 MB as compressed, and columns of repeating names and
    numbers are many times that in the sorts and hash tables of a task. Parts of a stated number are not merged, so
    what one task holds does not grow with the input. Joins and groups on ``keys`` that follow add no exchange."""
    size = input_bytes(df)
    if size is None or size <= SPREAD_FROM:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(least if size >= UNKNOWN_BYTES else max(least, size // TASK_BYTES), *keys)


def prefix_sum(df: DataFrame, value: Column, *, partition: list[str], bucket: Column,
               order: list[str | Column], out: str, inclusive: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Add ``out`` = running sum of ``value`` within ``partition`` in ``order``
    (including the current row unless ``inclusive=False``)."""
    size = input_bytes(df)
    if size is None or size > split_bytes:
        return _by_ranges(df, value, partition, [bucket, *order], out, inclusive)
    d = df.withColumn("_pb", bucket).withColumn("_pv", value)
    totals = d.groupBy(*partition, "_pb").agg(F.sum("_pv").alias("_bt"))
    before = Window.partitionBy(*partition).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.sum("_bt").over(before)).drop("_bt")
    inner = Window.partitionBy(*partition, "_pb").orderBy(*order)
    frame = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0).cast(d.schema["_pv"].dataType)
    return (d.join(offsets, [*partition, "_pb"])
            .withColumn(out, F.coalesce(F.col("_off"), zero) + F.coalesce(F.sum("_pv").over(frame), zero))
            .drop("_pb", "_pv", "_off"))


def _by_ranges(df: DataFrame, value: Column, partition: list[str], order: list[str | Column], out: str, inclusive: bool) -> DataFrame:
    """``prefix_sum`` over ranges of (key, order). The ranged rows are checkpointed, so that all that follows, and a
    task that is run again, sees the same ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_pv", value)
    ranged = (d.repartitionByRange(n, *partition, *order).sortWithinPartitions(*partition, *order)
              .withColumn("_at", F.monotonically_increasing_id()).checkpoint().withColumn("_r", F.shiftright("_at", ROW_BITS)))
    totals = ranged.groupBy(*partition, "_r").agg(F.sum("_pv").alias("_bt"))
    before = Window.partitionBy(*partition).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.sum("_bt").over(before)).drop("_bt")
    frame = Window.partitionBy(*partition, "_r").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0).cast(d.schema["_pv"].dataType)
    return (ranged.join(offsets, [*partition, "_r"])
            .withColumn(out, F.coalesce(F.col("_off"), zero) + F.coalesce(F.sum("_pv").over(frame), zero))
            .drop("_at", "_r", "_pv", "_off"))


def prefix_count(df: DataFrame, *, partition: list[str], bucket: Column, order: list[str | Column],
                 out: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """1-based position of each row within ``partition`` in ``order``
    (``row_number`` computed bucket by bucket)."""
    return prefix_sum(df, F.lit(1).cast("bigint"), partition=partition, bucket=bucket, order=order, out=out, split_bytes=split_bytes)
