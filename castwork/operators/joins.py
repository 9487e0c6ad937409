"""Join patterns Spark has no single operator for, built from equi joins.

prefix_join
    ``path LIKE prefix || '/%'`` as an equi join. A LIKE/startswith condition
    plans as a nested-loop join; instead every row's path is exploded into the
    prefixes that end at a ``/`` boundary ("a/b/c" -> "a", "a/b") and
    equi-joined to the bridge. The bridge (tag prefixes per work centre) is
    plant configuration, so it is broadcast and the big side streams through
    one map-side hash join with no shuffle. Prefixes are literals: ``_``,
    ``%`` and ``\\`` in a prefix mean themselves, not LIKE wildcards.

range_join
    ``key = key AND lo <= t <= hi``. A plain equi join on a hot key would pair
    every window with every event of that key. Windows are exploded into the
    calendar days they cover, events get their one day, the join runs on
    (key, day) and the exact range is a residual. Each surviving pair is met
    exactly once (an event has one day), so no distinct is needed for pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwork.functions.exprs import small
from castwork.operators.windows import spread


def path_prefixes(path: Column) -> Column:
    """Array of the proper prefixes of ``path`` that end right before a '/'."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1),
                                     lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
                  ).otherwise(F.array().cast("array<string>"))


def prefix_join(df: DataFrame, path_col: str, bridge: DataFrame, prefix_col: str = "tag_prefix",
                how: str = "inner", broadcast_bridge: bool = True) -> DataFrame:
    """Rows of ``df`` paired with every bridge row whose prefix is a '/'-prefix
    of ``df[path_col]``. ``how='left_semi'``/``'left_anti'`` give EXISTS / NOT EXISTS.
    """
    b = small(bridge) if broadcast_bridge else bridge
    if how in ("left_semi", "left_anti"):
        keys = b.select(F.col(prefix_col).alias("_pfx")).distinct()
        cand = df.select(F.col(path_col).alias("_p")).distinct() \
            .select("_p", F.explode(path_prefixes(F.col("_p"))).alias("_pfx"))
        hit = cand.join(keys, "_pfx", "left_semi").select(F.col("_p").alias("_hit")).distinct()
        return df.join(hit, df[path_col] == hit["_hit"], how)
    exploded = df.withColumn("_pfx", F.explode(path_prefixes(F.col(path_col))))
    out = exploded.join(b, exploded["_pfx"] == b[prefix_col], "inner")
    return out.drop("_pfx")


def day_span(lo: Column, hi: Column) -> Column:
    """Calendar days covered by [lo, hi] (empty when hi < lo or either is NULL)."""
    d0, d1 = lo.cast("date"), hi.cast("date")
    return F.when(d0.isNotNull() & d1.isNotNull() & (d1 >= d0), F.sequence(d0, d1)) \
        .otherwise(F.array().cast("array<date>"))


def range_join(windows: DataFrame, events: DataFrame, *, key: str, lo: str, hi: str, t: str,
               event_key: str | None = None) -> DataFrame:
    """Pairs (window row, event row) with equal key and ``lo <= t <= hi``.

    Both inputs must not share column names other than ``key``.
    """
    ek = event_key or key
    w = spread(windows.withColumn("_day", F.explode(day_span(F.col(lo), F.col(hi)))), key, "_day")
    e = events.withColumn("_day", F.col(t).cast("date"))
    if ek != key:
        e = e.withColumnRenamed(ek, key)
    j = w.join(e, [key, "_day"]).where((F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi)))
    return j.drop("_day")
