"""Operations tools: T06 labor_efficiency (+T06b), T07 work_center_load,
T08 job_cost_summary.

Labour is collapsed to one row per (job, operation) before any grouping, so
an operation's hours are never multiplied by its crew size, and job costs are
collapsed per job before joining headers (no quantity fan-out).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwork.functions.exprs import (
    ALUMINUM_COST_PER_LB, labor_rate, lit_date, midnight_minus_days, pct, round_dec, round_half_up,
    week_start, small,
)
from castwork.operators.jobs import unplanned_downtime
from castwork.sources.tables import Tables

GROUP_COLUMNS = {"employee": "employee_num", "shift": "shift", "work_center": "wc_code", "part": "part_num"}
COST_GROUPS = ("part", "customer", "industry", "month")


def op_labor(t: Tables, *, as_of: dt.date | None = None, days_back: int | None = None,
             wc_code: str | None = None, dept: str | None = None, part_num: str | None = None,
             oper_seq: int | None = None) -> DataFrame:
    """One row per (job, operation) with estimate and actual hours and the
    minimum shift, employee and clock-in of its labour in the window. Only
    operations with both estimated and actual production hours."""
    jo = t.job_oper.where((F.col("est_prod_hrs") > 0) & (F.col("act_prod_hrs") > 0))
    if wc_code is not None:
        jo = jo.where(F.col("wc_code") == wc_code)
    if oper_seq is not None:
        jo = jo.where(F.col("oper_seq") == oper_seq)
    if dept is not None:
        jo = jo.join(small(t.work_center.where(F.col("dept") == dept).select("wc_code")), "wc_code", "left_semi")
    ld = t.labor_dtl
    if days_back is not None:
        ld = ld.where(F.col("clock_in") >= midnight_minus_days(as_of, days_back))
    lab = ld.groupBy("job_num", "oper_seq").agg(F.min("shift").alias("shift"),
                                                 F.min("employee_num").alias("employee_num"),
                                                 F.min("clock_in").alias("started"))
    jh = t.job_head.select("job_num", "part_num")
    if part_num is not None:
        jh = jh.where(F.col("part_num") == part_num)
    return (jo.join(lab, ["job_num", "oper_seq"]).join(jh, "job_num")
            .select("job_num", "oper_seq", "wc_code", "part_num",
                    (F.col("est_setup_hrs") + F.col("est_prod_hrs")).alias("est_hrs"),
                    (F.col("act_setup_hrs") + F.col("act_prod_hrs")).alias("act_hrs"),
                    "shift", "employee_num", "started"))


def labor_efficiency(t: Tables, *, as_of: dt.date, group_by: str = "employee", days_back: int = 120,
                     min_ops: int = 3, **filters) -> DataFrame:
    """Per group, operations, estimate and actual hours (1 dp), ratio
    (3 dp) and % over standard; groups with fewer than ``min_ops`` dropped."""
    col = GROUP_COLUMNS[group_by]
    ol = op_labor(t, as_of=as_of, days_back=days_back, **filters)
    g = ol.groupBy(F.col(col).cast("string").alias(group_by)).agg(
        F.count(F.lit(1)).alias("operations"), F.sum("est_hrs").alias("e"), F.sum("act_hrs").alias("a"))
    ratio = F.when(F.col("e") != 0, round_half_up(F.col("a").cast("double") / F.col("e").cast("double"), 3))
    return (g.where(F.col("operations") >= min_ops)
            .select(group_by, "operations", round_dec(F.col("e"), 1).alias("est_hrs"),
                    round_dec(F.col("a"), 1).alias("act_hrs"), ratio.alias("ratio"))
            .withColumn("over_standard_pct",
                        round_half_up((F.coalesce(F.col("ratio"), F.lit(1.0)) - 1) * 100, 1)))


def standard_vs_crew(t: Tables, *, as_of: dt.date, scope: tuple[str, ...] = ("wc_code",),
                     days_back: int = 120, min_ops: int = 3, min_groups: int = 3) -> DataFrame:
    """T06b, per scope (default: per work centre): employee ratios as in T06,
    then fastest, slowest and spread. WRONG_STANDARD when even the fastest
    operator is over 1.10x; else TRAINING when the spread exceeds 0.25; else
    IN_LINE. Scopes with fewer than ``min_groups`` operators get no verdict."""
    ol = op_labor(t, as_of=as_of, days_back=days_back)
    per = ol.groupBy(*scope, "employee_num").agg(
        F.count(F.lit(1)).alias("ops"), F.sum("est_hrs").alias("e"), F.sum("act_hrs").alias("a"))
    per = per.where(F.col("ops") >= min_ops).withColumn(
        "ratio", F.coalesce(F.when(F.col("e") != 0, round_half_up(F.col("a").cast("double") / F.col("e").cast("double"), 3)),
                            F.lit(1.0)))
    s = per.groupBy(*scope).agg(F.count(F.lit(1)).alias("operators"), F.min("ratio").alias("fastest"),
                                F.max("ratio").alias("slowest"))
    s = s.withColumn("spread", round_half_up(F.col("slowest") - F.col("fastest"), 2))
    verdict = (F.when(F.col("operators") < min_groups, F.lit(None).cast("string"))
               .when(F.col("fastest") > 1.10, "WRONG_STANDARD")
               .when(F.col("spread") > 0.25, "TRAINING").otherwise("IN_LINE"))
    return s.select(*scope, "operators", round_half_up(F.col("fastest"), 2).alias("fastest"),
                    round_half_up(F.col("slowest"), 2).alias("slowest"), "spread", verdict.alias("verdict"))


def work_center_load(t: Tables, *, as_of: dt.date, weeks_ahead: int = 4, dept: str | None = None) -> DataFrame:
    """Open, unstarted hours per (work centre, week of the due date) for
    jobs due in [as_of, as_of + 7 x weeks], against nameplate capacity less a
    weekly share (1/3) of the last 21 days' unplanned downtime."""
    today = lit_date(as_of)
    jh = t.job_head.where((~F.col("job_closed")) & F.col("req_due_date").between(today, F.date_add(today, 7 * weeks_ahead)))
    wc = t.work_center
    if dept is not None:
        wc = wc.where(F.col("dept") == dept)
    committed = (t.job_oper.where(F.col("act_prod_hrs") == 0).join(jh.select("job_num", "req_due_date"), "job_num")
                 .join(small(wc.select("wc_code")), "wc_code", "left_semi")
                 .groupBy("wc_code", week_start(F.col("req_due_date")).alias("week"))
                 .agg(F.sum(F.col("est_setup_hrs") + F.col("est_prod_hrs")).alias("c"),
                      F.countDistinct("job_num").alias("open_jobs")))
    down = unplanned_downtime(t, as_of=as_of)
    rows = (committed.join(small(wc.select("wc_code", "description", "dept", "shifts_per_day", "hrs_per_shift", "resources")), "wc_code")
            .join(small(down), "wc_code", "left"))
    nameplate = F.round(F.col("shifts_per_day") * F.col("hrs_per_shift") * F.col("resources") * 5, 1).cast("double")
    down_r = round_half_up(F.coalesce(F.col("down_hrs"), F.lit(0.0)), 1)
    rows = rows.select("week", "wc_code", "description", "dept", "open_jobs",
                       round_dec(F.col("c"), 1).alias("committed_hrs"), nameplate.alias("np"), down_r.alias("dr"))
    eff = F.greatest(F.lit(0.0), F.col("np") - F.col("dr") / 3)
    return rows.select("week", "wc_code", "description", "dept", "open_jobs", "committed_hrs",
                       round_half_up(F.col("np"), 1).alias("nameplate_hrs"),
                       round_half_up(eff, 1).alias("effective_hrs"),
                       pct(F.col("committed_hrs"), eff).alias("utilization_pct"),
                       (F.col("committed_hrs") > eff).alias("over_committed"))


def job_cost_summary(t: Tables, *, as_of: dt.date, group_by: str = "part", days_back: int = 180,
                     closed_only: bool = True, part_num: str | None = None,
                     customer_code: str | None = None) -> DataFrame:
    """Cost roll-up per part / customer / industry / month of jobs
    created in the window. Labour is summed per job first (rate by dept)."""
    jo = t.job_oper.join(small(t.work_center.select("wc_code", "dept")), "wc_code")
    rate = labor_rate(F.col("dept"))
    jl = jo.groupBy("job_num").agg(F.sum((F.col("est_setup_hrs") + F.col("est_prod_hrs")) * rate).alias("el"),
                                   F.sum((F.col("act_setup_hrs") + F.col("act_prod_hrs")) * rate).alias("al"))
    jh = t.job_head.where(F.col("created_at") >= midnight_minus_days(as_of, days_back))
    if closed_only:
        jh = jh.where(F.col("job_closed"))
    if part_num is not None:
        jh = jh.where(F.col("part_num") == part_num)
    p = t.part.select("part_num", "customer_code", "industry", "target_wt_lbs")
    if customer_code is not None:
        p = p.where(F.col("customer_code") == customer_code)
    base = jh.join(p, "part_num").join(jl, "job_num", "left").select(
        "part_num", "customer_code", "industry", "created_at", "qty_ordered", "qty_completed",
        (F.col("qty_ordered") * F.col("target_wt_lbs") * F.lit(ALUMINUM_COST_PER_LB).cast("decimal(3,2)")).alias("material"),
        F.coalesce("el", F.lit(0)).alias("el"), F.coalesce("al", F.lit(0)).alias("al"))
    key = {"part": F.col("part_num"), "customer": F.col("customer_code"), "industry": F.col("industry"),
           "month": F.date_format(F.col("created_at"), "yyyy-MM")}[group_by]
    g = base.groupBy(key.alias(group_by)).agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("qty_ordered").cast("bigint").alias("qty_ordered"),
        F.sum("qty_completed").cast("bigint").alias("qty_completed"),
        F.round(F.sum("el"), 2).alias("est"), F.round(F.sum("al"), 2).alias("act"),
        F.round(F.sum("material"), 2).alias("mat"))
    est, act, mat = (F.col(c).cast("double") for c in ("est", "act", "mat"))
    return g.select(
        group_by, "jobs", "qty_ordered", "qty_completed",
        round_half_up(est, 2).alias("est_labor_usd"), round_half_up(act, 2).alias("act_labor_usd"),
        round_half_up(act - est, 2).alias("labor_variance_usd"),
        F.when(est > 0, round_half_up((act - est) / est * 100, 1)).alias("labor_variance_pct"),
        round_half_up(mat, 2).alias("material_usd"), round_half_up(act + mat, 2).alias("total_cost_usd"),
        F.when(F.col("qty_completed") > 0, round_half_up((act + mat) / F.col("qty_completed"), 2))
         .alias("cost_per_good_casting_usd"))
