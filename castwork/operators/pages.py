"""Deep pages of a relation through a rank index.

A page far into a relation would make one task sort and skip everything before it. The index sorts the relation
once by ranges of its key, writes the ranges to the shared folder, and keeps one count a range; a page then reads
the one range (or the few neighbouring ranges) that it lies in, and of that only its own rows.
"""

from __future__ import annotations

import bisect
import itertools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwork.operators.ranks import ROW_BITS
from castwork.session import ensure_checkpoint_dir


class PageIndex:
    """``df`` in the order of ``keys``, written by ranges. Rows that tie in all keys keep the order they were written in."""

    def __init__(self, df: DataFrame, keys: list[str], ranges: int | None = None):
        spark = df.sparkSession
        self.columns = df.columns
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/castwork-pages-{uuid.uuid4().hex}"
        at = F.monotonically_increasing_id()
        ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", at)
                  .withColumn("_range", F.shiftright("_at", ROW_BITS)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))))
        ranged.write.partitionBy("_range").parquet(path)
        self.rows = spark.read.schema(ranged.schema).parquet(path)
        counts = sorted(map(tuple, self.rows.groupBy("_range").count().collect()))  # a row a range
        self.ranges = [r for r, _ in counts]
        self.firsts = [0, *itertools.accumulate(c for _, c in counts)]

    @property
    def total(self) -> int:
        return self.firsts[-1]

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in key order: only the ranges they lie in are read."""
        lo, hi = bisect.bisect_right(self.firsts, offset) - 1, min(len(self.ranges), bisect.bisect_left(self.firsts, offset + limit))
        mine = None
        for r, first, after in zip(self.ranges[lo:hi], self.firsts[lo:hi], self.firsts[lo + 1:hi + 1], strict=True):
            begin, end = max(offset, first) - first, min(offset + limit, after) - first
            part = (F.col("_range") == r) & (F.col("_at") >= begin) & (F.col("_at") < end)
            mine = part if mine is None else mine | part
        return self.rows.where(mine if mine is not None else F.lit(False)).orderBy("_range", "_at").select(*self.columns)
