"""Scrap analysis: T04 scrap_by_reason, T05 scrap_trend.

Both are one scan of scrap detail (time predicate pushed to Parquet), joined
to jobs and operations, then a hash aggregate. Totals are 1-row aggregates
cross-joined back (a broadcast of one row), never a global window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castwork.functions.exprs import midnight_minus_days, pct, round_half_up, ts_ntz, week_start, small
from castwork.sources.tables import Tables


def scoped_scrap(t: Tables, *, as_of: dt.date, days_back: int, part_num: str | None = None,
                 wc_code: str | None = None, dept: str | None = None,
                 customer_code: str | None = None, masters: bool = True) -> DataFrame:
    """Scrap rows logged in [as_of - days_back days, as_of 00:00] with job,
    part and operation attached. Rows whose operation or job is unknown drop
    out (inner joins). Optional filters are applied only when given.
    ``masters=False`` skips the part and work-centre joins (T05 has none)."""
    sd = t.scrap_dtl.where((F.col("logged_at") >= midnight_minus_days(as_of, days_back))
                           & (F.col("logged_at") <= ts_ntz(as_of)))
    jh = t.job_head.select("job_num", "part_num", "qty_ordered")
    if part_num is not None:
        jh = jh.where(F.col("part_num") == part_num)
    jo = t.job_oper.select("job_num", "oper_seq", "wc_code")
    if wc_code is not None:
        jo = jo.where(F.col("wc_code") == wc_code)
    wc = t.work_center.select("wc_code", "dept")
    if dept is not None:
        wc = wc.where(F.col("dept") == dept)
    p = t.part.select("part_num", "customer_code")
    if customer_code is not None:
        p = p.where(F.col("customer_code") == customer_code)
    out = sd.join(jo, ["job_num", "oper_seq"]).join(jh, "job_num")
    if masters or customer_code is not None:
        out = out.join(p, "part_num")
    if masters or dept is not None:
        out = out.join(small(wc), "wc_code")
    return (out
            .select("job_num", "part_num", "qty_ordered", "reason_code", "scrap_qty", "logged_at"))


def scrap_by_reason(t: Tables, *, as_of: dt.date, days_back: int = 90, group_by_part: bool = False,
                    **filters) -> DataFrame:
    """Scrap by reason (optionally by part), its share of all scrap, and
    the scope totals on every row: total scrap, ordered quantity over the
    distinct jobs in scope, and the overall scrap rate.

    Quirk kept: the window ends at midnight at the start of ``as_of``.
    """
    s = scoped_scrap(t, as_of=as_of, days_back=days_back, **filters)
    keys = ["reason_code", "description", "category"] + (["part_num"] if group_by_part else [])
    by = (s.join(small(t.scrap_reason), "reason_code")
          .groupBy(*keys).agg(F.sum("scrap_qty").cast("bigint").alias("scrap_qty")))
    ordered = (s.select("job_num", "qty_ordered").distinct()
               .agg(F.sum("qty_ordered").cast("bigint").alias("qty_ordered_in_scope")))
    total = by.agg(F.sum("scrap_qty").cast("bigint").alias("total_scrap_qty"))
    return (by.crossJoin(total).crossJoin(ordered)
            .select(*keys, "scrap_qty",
                    pct(F.col("scrap_qty"), F.col("total_scrap_qty")).alias("pct_of_scrap"),
                    "total_scrap_qty", "qty_ordered_in_scope",
                    pct(F.col("total_scrap_qty"), F.col("qty_ordered_in_scope")).alias("overall_scrap_rate_pct")))


def weekly_scrap(t: Tables, *, as_of: dt.date, weeks_back: int, part_num: str | None = None,
                 wc_code: str | None = None) -> DataFrame:
    """Per (week, reason) scrap and per-week total scrap in the window."""
    s = scoped_scrap(t, as_of=as_of, days_back=7 * weeks_back, part_num=part_num,
                     wc_code=wc_code, masters=False)
    per = s.groupBy(week_start(F.col("logged_at")).alias("week"), "reason_code").agg(
        F.sum("scrap_qty").cast("bigint").alias("qty"))
    return per


def scrap_trend(t: Tables, *, as_of: dt.date, reason_code: str | None = None, weeks_back: int = 16,
                part_num: str | None = None, wc_code: str | None = None) -> DataFrame:
    """T05 for every reason at once (or one, if given).

    Series: weeks with any scrap in scope; qty of the reason (0 if none that
    week), all scrap, share. Summary per reason, over its ordered weeks:
    third = max(1, floor(n/3)); baseline = mean of the first third, recent =
    mean of the last third; change % and direction (WORSENING above 1.25x,
    IMPROVING below 0.75x, else FLAT, on unrounded means).

    The window is partitioned by reason and runs over weekly rows (at most
    weeks_back per reason), so it stays small at any data size.
    """
    per = weekly_scrap(t, as_of=as_of, weeks_back=weeks_back, part_num=part_num, wc_code=wc_code)
    weeks = per.groupBy("week").agg(F.sum("qty").cast("bigint").alias("all_scrap_qty"))
    reasons = per.select("reason_code").distinct()
    if reason_code is not None:
        # The series covers every week in scope, with 0 where the reason is absent.
        reasons = weeks.select(F.lit(reason_code).alias("reason_code")).distinct()
    # weeks holds at most weeks_back + 1 rows: a bound by construction.
    grid = (reasons.crossJoin(F.broadcast(weeks))
            .join(per, ["week", "reason_code"], "left")
            .select("reason_code", "week", F.coalesce("qty", F.lit(0)).cast("bigint").alias("qty"),
                    "all_scrap_qty"))
    w = Window.partitionBy("reason_code")
    ordered = Window.partitionBy("reason_code").orderBy("week")
    g = (grid.withColumn("i", F.row_number().over(ordered))
         .withColumn("n", F.count(F.lit(1)).over(w))
         .withColumn("third", F.greatest(F.lit(1), F.floor(F.col("n") / 3))))
    g = g.withColumn("is_early", F.col("i") <= F.col("third")) \
         .withColumn("is_recent", F.col("i") > F.col("n") - F.col("third"))
    early = F.sum(F.when(F.col("is_early"), F.col("qty"))).over(w) / F.col("third")
    recent = F.sum(F.when(F.col("is_recent"), F.col("qty"))).over(w) / F.col("third")
    g = g.withColumn("early_avg", early.cast("double")).withColumn("recent_avg", recent.cast("double"))
    return g.select(
        "reason_code", "week", "qty", "all_scrap_qty",
        pct(F.col("qty"), F.col("all_scrap_qty")).alias("pct_of_scrap"),
        F.col("n").cast("bigint").alias("weeks"),
        round_half_up(F.col("early_avg"), 1).alias("baseline_weekly_avg"),
        round_half_up(F.col("recent_avg"), 1).alias("recent_weekly_avg"),
        F.when(F.col("early_avg") > 0,
               round_half_up((F.col("recent_avg") - F.col("early_avg")) / F.col("early_avg") * F.lit(100.0), 1))
         .alias("change_pct"),
        F.when(F.col("recent_avg") > F.col("early_avg") * 1.25, "WORSENING")
         .when(F.col("recent_avg") < F.col("early_avg") * 0.75, "IMPROVING")
         .otherwise("FLAT").alias("direction"),
    )
