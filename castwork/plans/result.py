"""Result envelope, row cap, notes and fingerprints.

A ``Result`` holds lazy DataFrames plus the systems they came from and the
caveats a reader must see. Capping (R01) is a presentation step: the query
stays whole, and only the rows shown are limited, with a note giving the
total.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 60


@dataclasses.dataclass
class Result:
    data: dict[str, DataFrame]
    sources: tuple[str, ...]
    notes: list[str] = dataclasses.field(default_factory=list)
    error: str | None = None
    rows: dict[str, list] = dataclasses.field(default_factory=dict)  # shown rows, where asked for

    @property
    def ok(self) -> bool:
        return self.error is None


def sort_keys(df: DataFrame, order: tuple[str, ...]) -> list[Column]:
    """``order`` ("-x": descending; nulls last), then every other column, so
    that ties always fall the same way."""
    named = [c.removeprefix("-") for c in order]
    first = [F.col(n).desc_nulls_last() if c.startswith("-") else F.col(n).asc_nulls_last()
             for c, n in zip(order, named, strict=True)]
    return first + [F.col(c) for c in df.columns if c not in named]


def cap_rows(df: DataFrame, order: list[str | Column], notes: list[str], limit: int = MAX_ROWS) -> list:
    """The first ``limit`` rows in ``order``; if there were more, a note
    with the total. Reads ``limit + 1`` rows (a top-k), counts only when
    truncated."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        total = df.count()
        notes.append(f"Showing the first {limit} of {total} rows. Narrow the filters for the rest.")
        rows = rows[:limit]
    return rows


def findings_fingerprint(findings: DataFrame) -> DataFrame:
    """R06 for the dashboard: sha256 over ``id:detail`` of the findings in
    their order, '|'-joined. The findings are at most a handful of rows."""
    parts = F.sort_array(F.collect_list(F.struct("position", F.concat_ws(":", "id", "detail").alias("t"))))
    return findings.agg(F.sha2(F.array_join(F.transform(parts, lambda s: s["t"]), "|"), 256).alias("fingerprint"),
                        F.count(F.lit(1)).alias("findings"))


def _row_digests(df: DataFrame, cols: list[str], name: str | None = None) -> DataFrame:
    """Per row, the first 15 hex digits of the sha256 of its columns (and of the frame's name) as a number."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in cols]
    row = F.sha2(F.concat_ws("|", *([F.lit(name)] if name else []), *text), 256)
    return df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))


def table_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """R06 for a large result (a schedule): an order-free digest - the sum of
    the first 15 hex digits of each row's sha256 - that is computed with a
    map-side partial aggregate and never gathers the rows."""
    return _row_digests(df, cols).agg(F.sum("h").cast("string").alias("digest"), F.count(F.lit(1)).alias("rows"))


def frames_fingerprint(frames: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """R06 over several named frames of one result: the digests of all their
    rows add up (sums merge in any order, over any number of partitions), and
    a row counts under its frame's name, so that the same values in another
    frame are another result."""
    parts = [_row_digests(df, cols, name) for name, (df, cols) in frames.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(F.sum("h").cast("string").alias("digest"), F.count(F.lit(1)).alias("rows"))


# What identifies a weekly plan: its segments, centres, totals and what did not fit.
SCHEDULE_FRAMES = {
    "segment": ["wc_code", "day", "job_num", "oper_seq", "hours", "changeover", "late"],
    "centre": ["wc_code", "dept", "hours_scheduled", "utilization_pct", "effective_per_day", "capacity_per_day",
               "downtime_discount_pct", "changeovers", "setups_saved", "resequenced"],
    "total": ["operations_scheduled", "hours_scheduled", "operations_unscheduled", "hours_unscheduled", "late_operations"],
    "unscheduled": ["job_num", "oper_seq", "wc_code", "hours_needed", "due_date"],
}


def schedule_fingerprint(frames: dict[str, DataFrame]) -> DataFrame:
    """R06 of a weekly plan, over all of ``SCHEDULE_FRAMES``."""
    return frames_fingerprint({n: (frames[n], cols) for n, cols in SCHEDULE_FRAMES.items()})
