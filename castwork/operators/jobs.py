"""Job tools: T01 open_jobs, T02 job_detail (a-f), T03 at_risk_jobs (a-g).

Everything is computed for all jobs in one pass; the single-job form of a
tool is a filter on the result (``for_job``). No per-job loops.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwork.functions.exprs import (
    ALUMINUM_COST_PER_LB, MAX_DOWNTIME_DISCOUNT, WORKING_DAYS_IN_21, days_between, hours_between,
    is_unplanned, labor_rate, lit_date, midnight_minus_days, pct, round_dec, round_half_up,
    weekdays_inclusive, small,
)
from castwork.operators.joins import prefix_join
from castwork.operators.windows import prefix_sum, spread
from castwork.sources.tables import Tables


# How a verdict explains itself (printf-style).
WHY_TEXT = {
    "late": "Due date passed %s days ago with %s hrs still to run.",
    "at_risk": "%s has ~%s hrs of capacity before this due date%s, but %s hrs of work are queued ahead of or including this job%s",
    "discount": " (after discounting %s hrs of unplanned downtime logged there in the last 21 days)",
    "contended": " — %s hrs of that belongs to jobs due sooner.",
    "on_track": "%s hrs queued at %s against ~%s hrs available before the due date.",
}


def js_num(x: Column) -> Column:
    """A double as JavaScript prints it: integers without '.0'."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def for_job(df: DataFrame, job_num: str | None, col: str = "job_num") -> DataFrame:
    """Single-job form of an all-jobs result (``job_num`` in any spelling)."""
    if job_num is None:
        return df
    from castwork.functions.exprs import resolve_job_num
    return df.where(F.col(col) == resolve_job_num(F.lit(job_num)))


# ---------------------------------------------------------------------------
# T01
# ---------------------------------------------------------------------------
def open_jobs(t: Tables, *, as_of: dt.date, dept: str | None = None, wc_code: str | None = None,
              part_num: str | None = None, customer_code: str | None = None,
              due_within_days: int | None = None) -> DataFrame:
    """Open jobs that have at least one operation (at the given work
    centre / department when filtered). A semi join replaces join + DISTINCT."""
    jh = t.job_head.where(~F.col("job_closed"))
    if part_num is not None:
        jh = jh.where(F.col("part_num") == part_num)
    if due_within_days is not None:
        jh = jh.where(F.col("req_due_date") <= F.date_add(lit_date(as_of), due_within_days))
    p = t.part.select("part_num", "description", "customer_code", "process")
    if customer_code is not None:
        p = p.where(F.col("customer_code") == customer_code)
    ops = t.job_oper.select("job_num", "wc_code").join(small(t.work_center.select("wc_code", "dept")), "wc_code")
    if wc_code is not None:
        ops = ops.where(F.col("wc_code") == wc_code)
    if dept is not None:
        ops = ops.where(F.col("dept") == dept)
    return (jh.join(p, "part_num").join(ops.select("job_num"), "job_num", "left_semi")
            .select("job_num", "part_num", "description", "customer_code", "process", "qty_ordered",
                    "qty_completed", "req_due_date",
                    days_between(lit_date(as_of), F.col("req_due_date")).alias("days_to_due")))


# ---------------------------------------------------------------------------
# T02 a-f
# ---------------------------------------------------------------------------
def job_header(t: Tables, *, as_of: dt.date) -> DataFrame:
    """T02a."""
    return t.job_head.join(t.part, "part_num").select(
        "job_num", "part_num", "description", "alloy", "process", "customer_code", "industry",
        F.col("target_wt_lbs").cast("double").alias("target_wt_lbs"), "cavities", "qty_ordered",
        "qty_completed", "job_closed", "req_due_date",
        days_between(lit_date(as_of), F.col("req_due_date")).alias("days_to_due"), "created_at")


def job_operations(t: Tables) -> DataFrame:
    """Operations with their work centre; not started = no actual hours."""
    return t.job_oper.join(small(t.work_center.select("wc_code", "description", "dept")), "wc_code").select(
        "job_num", "oper_seq", "wc_code", F.col("description").alias("wc_description"), "dept",
        *[F.col(c).cast("double").alias(c) for c in ("est_setup_hrs", "est_prod_hrs", "act_setup_hrs", "act_prod_hrs")],
        "qty_completed", "scrap_qty", (F.col("act_prod_hrs") == 0).alias("not_started"))


def job_scrap_by_reason(t: Tables) -> DataFrame:
    """Scrap per job and reason (reasons outside the lookup drop out).

    Few rows share a (job, reason), so the rows meet by job before they are added up, in parts that grow in number
    with the scrap and not in size."""
    return (spread(t.scrap_dtl.select("job_num", "reason_code", "scrap_qty"), "job_num").join(small(t.scrap_reason), "reason_code")
            .groupBy("job_num", "reason_code", "description", "category")
            .agg(F.sum("scrap_qty").cast("bigint").alias("qty")))


def job_labor_by_shift(t: Tables) -> DataFrame:
    """T02d: operators and labour hours (1 dp) per job and shift."""
    return t.labor_dtl.groupBy("job_num", "shift").agg(
        F.countDistinct("employee_num").alias("operators"),
        round_dec(F.sum("labor_hrs"), 1).alias("labor_hrs"))


def job_labor_cost(t: Tables) -> DataFrame:
    """Per job: estimated and actual labour dollars, rate-weighted by the
    department of each operation (exact decimals), aggregated before any join."""
    jo = t.job_oper.join(small(t.work_center.select("wc_code", "dept")), "wc_code")
    rate = labor_rate(F.col("dept"))
    return jo.groupBy("job_num").agg(
        F.sum((F.col("est_setup_hrs") + F.col("est_prod_hrs")) * rate).alias("est_labor"),
        F.sum((F.col("act_setup_hrs") + F.col("act_prod_hrs")) * rate).alias("act_labor"))


def job_cost(t: Tables) -> DataFrame:
    """T02e: labour, material (qty x weight x metal price), variance, total
    and cost per good casting (NULL with no good castings), 2 dp."""
    lab = job_labor_cost(t)
    base = (t.job_head.select("job_num", "part_num", "qty_ordered", "qty_completed")
            .join(t.part.select("part_num", "target_wt_lbs"), "part_num")
            .join(lab, "job_num", "left"))
    zero = F.lit(0)  # an integer zero keeps each side's decimal scale
    est = F.coalesce(F.col("est_labor"), zero)
    act = F.coalesce(F.col("act_labor"), zero)
    material = F.col("qty_ordered") * F.col("target_wt_lbs") * F.lit(ALUMINUM_COST_PER_LB).cast("decimal(3,2)")
    return base.select(
        "job_num",
        round_dec(est, 2).alias("est_labor_usd"),
        round_dec(act, 2).alias("act_labor_usd"),
        round_dec(act - est, 2).alias("labor_variance_usd"),
        round_dec(material, 2).alias("material_usd"),
        round_dec(act + material, 2).alias("total_actual_usd"),
        F.when(F.col("qty_completed") > 0,
               round_half_up((act + material).cast("double") / F.col("qty_completed"), 2))
         .alias("cost_per_good_casting_usd"))


def job_scrap_pct(t: Tables) -> DataFrame:
    """T02f: total scrap per job and its share of the ordered quantity."""
    per = job_scrap_by_reason(t).groupBy("job_num").agg(F.sum("qty").alias("scrap_total"))
    return (t.job_head.select("job_num", "qty_ordered").join(per, "job_num", "left")
            .select("job_num", F.coalesce("scrap_total", F.lit(0)).cast("bigint").alias("scrap_total"),
                    pct(F.coalesce("scrap_total", F.lit(0)), F.col("qty_ordered")).alias("scrap_pct_of_ordered")))


# ---------------------------------------------------------------------------
# T03 a-g
# ---------------------------------------------------------------------------
def unplanned_downtime(t: Tables, *, as_of: dt.date, days: int = 21) -> DataFrame:
    """Per work centre, hours of closed unplanned downtime that started
    in the last ``days`` days, reached through the tag-prefix bridge.

    Quirks kept: the planned test is a substring match ("unscheduled stop"
    counts as planned) and a NULL reason is dropped.
    """
    de = t.downtime_event.where((F.col("started_at") >= midnight_minus_days(as_of, days))
                                & F.col("ended_at").isNotNull() & is_unplanned(F.col("reason_text")))
    return (prefix_join(de, "tag_path", t.wc_tag.select("wc_code", "tag_prefix"))
            .groupBy("wc_code").agg(F.sum(hours_between(F.col("started_at"), F.col("ended_at"))).alias("down_hrs")))


def remaining_hours(t: Tables) -> DataFrame:
    """Open jobs' unstarted operations, estimated hours per (job, wc)."""
    jo = t.job_oper.where(F.col("act_prod_hrs") == 0)
    open_jobs_ = t.job_head.where(~F.col("job_closed")).select("job_num")
    return (jo.join(open_jobs_, "job_num", "left_semi")
            .groupBy("job_num", "wc_code")
            .agg(F.sum(F.col("est_setup_hrs") + F.col("est_prod_hrs")).alias("rem_hrs")))


def bottleneck(t: Tables) -> DataFrame:
    """Per job, total remaining hours, the work centre holding most of
    them (ties to the smallest wc_code) and its hours. A hash aggregate with
    ``min_by`` over a (-hours, wc) struct - no sort, no window."""
    rem = remaining_hours(t)
    key = F.struct((-F.col("rem_hrs")).alias("h"), F.col("wc_code").alias("w"))
    return rem.groupBy("job_num").agg(
        F.sum("rem_hrs").alias("total_rem_hrs"),
        F.min_by("wc_code", key).alias("bottleneck_wc"),
        F.max("rem_hrs").alias("bottleneck_hrs"))


def at_risk_jobs(t: Tables, *, as_of: dt.date, horizon_days: int = 30, dept: str | None = None,
                 downtime_days: int = 21, with_text: bool = True) -> DataFrame:
    """Open jobs due within the horizon, assessed against contended
    capacity at their bottleneck.

    capacity_to_due = hrs/day x working days left (Mon-Fri, today..due) x
    (1 - loss), loss = min(0.6, down_hrs_21d / (hrs/day x 15)). At each
    bottleneck, jobs queue earliest due first (tie: job_num); a job's queue
    is the running sum of bottleneck hours up to and including it. Verdict:
    LATE if past due, AT_RISK if the queue exceeds its capacity, else
    ON_TRACK. Hours are rounded to 1 dp before they are accumulated, and the
    accumulation is exact (decimal). ``dept`` filters the bottleneck's
    department. The queue is built after the filters.
    """
    today = lit_date(as_of)
    pj = bottleneck(t)
    wc = t.work_center.select("wc_code", "dept",
                              (F.col("shifts_per_day") * F.col("hrs_per_shift") * F.col("resources")).alias("hpd"))
    if dept is not None:
        wc = wc.where(F.col("dept") == dept)
    down = unplanned_downtime(t, as_of=as_of, days=downtime_days)
    jh = t.job_head.where((~F.col("job_closed")) & (F.col("req_due_date") <= F.date_add(today, horizon_days)))
    rows = (jh.join(t.part.select("part_num", "description", "customer_code"), "part_num")
            .join(pj, "job_num")
            .join(small(wc.withColumnRenamed("wc_code", "bottleneck_wc")), "bottleneck_wc")
            .join(small(down.withColumnRenamed("wc_code", "bottleneck_wc")), "bottleneck_wc", "left"))
    hpd = F.col("hpd").cast("double")
    rows = rows.select(
        "job_num", "part_num", "description", "customer_code", "req_due_date", "qty_ordered", "qty_completed",
        "bottleneck_wc",
        days_between(today, F.col("req_due_date")).alias("days_to_due"),
        F.round(F.col("total_rem_hrs"), 1).alias("rem_dec"),
        F.round(F.col("bottleneck_hrs"), 1).alias("wc_dec"),
        hpd.alias("hrs_per_day"),
        round_half_up(F.coalesce(F.col("down_hrs"), F.lit(0.0)), 1).alias("down_r"),
        weekdays_inclusive(today, F.greatest(F.col("req_due_date"), today)).alias("working_days"),
    )
    nameplate21 = F.col("hrs_per_day") * WORKING_DAYS_IN_21
    loss = F.when(nameplate21 > 0, F.least(F.lit(MAX_DOWNTIME_DISCOUNT), F.col("down_r") / nameplate21)).otherwise(F.lit(0.0))
    rows = rows.withColumn("loss", loss).withColumn(
        "cap", F.col("hrs_per_day") * F.col("working_days") * (F.lit(1.0) - F.col("loss")))
    q = prefix_sum(rows, F.col("wc_dec"), partition=["bottleneck_wc"], bucket=F.col("days_to_due"),
                   order=["days_to_due", "job_num"], out="cum_dec")
    q = q.withColumn("ahead_dec", F.col("cum_dec") - F.col("wc_dec"))
    cum = F.col("cum_dec").cast("double")
    verdict = (F.when(F.col("days_to_due") < 0, "LATE").when(cum > F.col("cap"), "AT_RISK").otherwise("ON_TRACK"))
    q = q.withColumn("verdict", verdict)
    cols = [
        "job_num", "part_num", "description", "customer_code", "req_due_date", "days_to_due", "qty_ordered",
        "qty_completed",
        F.col("rem_dec").cast("double").alias("remaining_est_hrs"),
        "bottleneck_wc",
        F.col("wc_dec").cast("double").alias("hrs_at_bottleneck"),
        round_half_up(F.col("ahead_dec").cast("double"), 1).alias("hrs_queued_ahead"),
        round_half_up(F.col("cap"), 1).alias("capacity_before_due"),
        F.col("down_r").alias("unplanned_down_hrs_21d"),
        round_half_up(F.col("loss") * 100, 1).alias("capacity_loss_pct"),
        "verdict",
        F.when(F.col("verdict") == "LATE", 0).when(F.col("verdict") == "AT_RISK", 1).otherwise(2).alias("verdict_rank"),
    ]
    if with_text:
        cap_s = js_num(round_half_up(F.col("cap"), 1))
        cum_s = js_num(round_half_up(cum, 1))
        ahead = F.col("ahead_dec").cast("double")
        discount = F.when(F.col("loss") > 0.05, F.format_string(WHY_TEXT["discount"], js_num(F.col("down_r")))) \
            .otherwise(F.lit(""))
        contended = F.when(ahead > 0, F.format_string(WHY_TEXT["contended"], js_num(round_half_up(ahead, 1)))) \
            .otherwise(F.lit("."))
        why = (F.when(F.col("verdict") == "LATE", F.format_string(
                   WHY_TEXT["late"], F.abs(F.col("days_to_due")), js_num(F.col("rem_dec").cast("double"))))
               .when(F.col("verdict") == "AT_RISK", F.format_string(
                   WHY_TEXT["at_risk"], F.col("bottleneck_wc"), cap_s, discount, cum_s, contended))
               .otherwise(F.format_string(WHY_TEXT["on_track"], cum_s, F.col("bottleneck_wc"), cap_s)))
        cols.append(why.alias("why"))
    return q.select(*cols)


def at_risk_summary(t: Tables, *, as_of: dt.date, horizon_days: int = 30, dept: str | None = None) -> DataFrame:
    """T03g: assessed jobs and how many are flagged (LATE or AT_RISK)."""
    a = at_risk_jobs(t, as_of=as_of, horizon_days=horizon_days, dept=dept, with_text=False)
    return a.agg(F.count(F.lit(1)).alias("assessed_jobs"),
                 F.count_if(F.col("verdict") != "ON_TRACK").alias("at_risk_or_late"),
                 F.count_if(F.col("verdict") == "LATE").alias("late"))
