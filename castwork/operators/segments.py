"""Time segments: windows over a long series answered from a roll-up.

A series is rolled up once into segments of nested lengths (a second, ten seconds, a minute ... 64 days: each
length divides the next) by one hash aggregate with map-side combine. A window is covered by the fewest such
segments: from each end outward in short ones until a longer one fits, at most twice (ratio - 1) of each length,
so the cover grows with the logarithm of the window. A window that starts and ends at midnight is covered by days
and longer segments alone.

What is shorter than a second - the instants of a window's first and last, partly covered second - is the roll-up's
lowest level, a row per instant, keyed by its second. So every join is an equi join on (key, length, segment), and
no window meets the samples of its first or last day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Lengths in seconds; each divides the next. 0 stands for single instants.
UNITS = (1, 10, 60, 600, 3600, 21600, 86400, 8 * 86400, 64 * 86400)
INSTANT = 0
MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a naive timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _floor(x: Column, unit: int) -> Column:
    return x - F.pmod(x, F.lit(unit))


def _div(x: Column, unit: int) -> Column:
    """Whole number of units below ``x``, exact on longs."""
    return (_floor(x, unit) / unit).cast("bigint")


def _segments(unit: int, lo: Column, hi: Column) -> Column:
    """Segments of a length from ``lo`` (in) to ``hi`` (out), both multiples of it."""
    found = F.transform(F.sequence(_div(lo, unit), _div(hi, unit) - 1), lambda s: F.struct(F.lit(unit).alias("unit"), s.alias("segment")))
    return F.when(lo < hi, found).otherwise(F.array().cast("array<struct<unit:int,segment:bigint>>"))


def cover(start: Column, stop: Column) -> Column:
    """Array of (unit, segment) that covers the seconds from ``start`` (in) to ``stop`` (out), each once.

    Lengths nest, so a length's part lies between its first multiple from ``start`` on and its last one up to
    ``stop``; the next longer length takes the middle, where it has a multiple there."""
    parts = []
    for i, unit in enumerate(UNITS):
        at, to = _floor(start + (unit - 1), unit), _floor(stop, unit)
        if i + 1 == len(UNITS):
            parts.append(_segments(unit, at, to))
            continue
        longer = UNITS[i + 1]
        up, down = _floor(start + (longer - 1), longer), _floor(stop, longer)
        parts += [_segments(unit, at, F.when(up <= down, up).otherwise(to)), _segments(unit, F.when(up <= down, down).otherwise(to), to)]
    return F.concat(*parts)


def covered(windows: DataFrame, lo: str, hi: str) -> DataFrame:
    """``windows`` once per (unit, segment) of what lies between ``lo`` and ``hi``, both included: whole seconds by
    ``cover``, and unit 0 for the first and last second where they are covered in part. A window with a null end, or
    whose end comes first, has none."""
    ends = F.array(F.struct(micros(F.col(lo)).alias("a"), micros(F.col(hi)).alias("b")))
    # Bound as lambda variables, each is worked out once. The last second is whole only if its last microsecond is in.
    bounds = F.transform(ends, lambda x: F.struct(
        _div(x["a"] + (MICROS - 1), MICROS).alias("start"), _div(x["b"] + 1, MICROS).alias("stop"),
        _div(x["a"], MICROS).alias("first"), _div(x["b"], MICROS).alias("last")))

    def cells(x: Column) -> Column:
        parts = F.array(F.when(x["first"] < x["start"], x["first"]), F.when(x["last"] >= x["stop"], x["last"]))
        partial = F.transform(F.array_compact(F.array_distinct(parts)), lambda s: F.struct(F.lit(INSTANT).alias("unit"), s.alias("segment")))
        return F.concat(partial, cover(x["start"], x["stop"]))

    every = windows.where(F.col(lo) <= F.col(hi)).withColumn("_c", F.explode(F.flatten(F.transform(bounds, cells))))
    return every.withColumns({"unit": F.col("_c.unit"), "segment": F.col("_c.segment")}).drop("_c")


def rolled_up(samples: DataFrame, ts: str, keys: list[str], value: str) -> DataFrame:
    """``keys``, unit, segment, instant (of unit 0, else null), n, total, n_values, least, most of ``value``."""
    at = micros(F.col(ts))
    second = _div(at, MICROS)
    levels = [F.struct(F.lit(INSTANT).alias("unit"), second.alias("segment"), F.col(ts).alias("instant"))]
    none = F.lit(None).cast("timestamp_ntz")
    levels += [F.struct(F.lit(u).alias("unit"), _div(second, u).alias("segment"), none.alias("instant")) for u in UNITS]
    flat = samples.select(*keys, value, F.explode(F.array(*levels)).alias("_s")).select(*keys, value, "_s.*")
    total = F.sum(value) if isinstance(samples.schema[value].dataType, NumericType) else F.lit(None).cast("double")
    return flat.groupBy(*keys, "unit", "segment", "instant").agg(
        F.count(F.lit(1)).alias("n"), total.alias("total"), F.count(value).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("most"))


def within(windows: DataFrame, rollup: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """``windows`` joined to the segments that cover them: one row per window and segment with samples."""
    met = covered(windows, lo, hi).join(rollup, [key, "unit", "segment"])
    return met.where(F.col("instant").isNull() | F.col("instant").between(F.col(lo), F.col(hi))).drop("unit", "segment", "instant")
