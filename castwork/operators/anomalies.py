"""Deterministic anomaly detectors (D01-D05), the merged findings (D06) and
the dashboard aggregates (D07-D14).

Detectors return the scored table with ``flagged`` and ``severity``; the
reference's filter is ``where(flagged)``. Findings are a ``unionByName`` of
the flagged rows with one (id, severity, title, detail, sources, ask) shape.
All numbers that feed a threshold are computed from exact sums, so the same
rows are flagged in any engine.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castwork.functions.exprs import (
    hours_between, is_unplanned, lit_date, midnight_minus_days, round_half_up, ts_ntz, week_start, small,
)
from castwork.operators import bridges
from castwork.operators.jobs import bottleneck, js_num, unplanned_downtime
from castwork.operators.joins import prefix_join
from castwork.operators.windows import SPLIT_BYTES, input_bytes
from castwork.session import ensure_checkpoint_dir
from castwork.sources.tables import Tables

SEVERITY_RANK = {"critical": 0, "warning": 1, "watch": 2}
# Days of labour that a standard is judged by.
STANDARD_DAYS = 270
DETECTORS = ("scrap", "downtime", "eff", "standard", "recon")


def _severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "warning", 1).otherwise(2)


# ---------------------------------------------------------------------------
# D01
# ---------------------------------------------------------------------------
def scrap_spikes(t: Tables, *, as_of: dt.date, weeks: int = 26, recent_weeks: int = 4, min_base_weeks: int = 8,
                 z_min: float = 2.0) -> DataFrame:
    """Weekly scrap per reason over ``weeks`` weeks; the last
    ``recent_weeks`` are recent, the rest baseline. z = (recent mean - base
    mean) / base sample sd. Weeks without scrap are absent, not zero."""
    sd = t.scrap_dtl.where((F.col("logged_at") >= midnight_minus_days(as_of, 7 * weeks))
                           & (F.col("logged_at") <= ts_ntz(as_of)))
    weekly = sd.groupBy("reason_code", week_start(F.col("logged_at")).alias("week")).agg(
        F.sum("scrap_qty").cast("bigint").alias("qty"))
    recent = F.col("week") >= lit_date(as_of - dt.timedelta(weeks=recent_weeks))
    base_q = F.when(~recent, F.col("qty"))
    s = weekly.groupBy("reason_code").agg(
        F.count(base_q).alias("base_weeks"), F.sum(base_q).alias("bs"), F.sum(base_q * base_q).alias("bss"),
        F.count(F.when(recent, 1)).alias("recent_weeks"), F.sum(F.when(recent, F.col("qty"))).alias("rs"))
    n = F.col("base_weeks")
    base_mean = F.when(n > 0, F.col("bs") / n)
    recent_mean = F.when(F.col("recent_weeks") > 0, F.col("rs") / F.col("recent_weeks"))
    var = F.when(n > 1, (n * F.col("bss") - F.col("bs") * F.col("bs")).cast("double") / (n * (n - 1)))
    s = s.select("reason_code", "base_weeks", base_mean.alias("bm"), recent_mean.alias("rm"), F.sqrt(var).alias("sdv"))
    z_raw = (F.col("rm") - F.col("bm")) / F.col("sdv")
    s = s.withColumn("z_raw", F.when(F.col("sdv") != 0, z_raw))
    z = round_half_up(F.col("z_raw"), 1)
    flagged = ((F.col("base_weeks") >= min_base_weeks) & (F.col("sdv") > 0) & (F.col("rm") > F.col("bm"))
               & (F.col("z_raw") >= z_min))
    return (s.join(small(t.scrap_reason), "reason_code")
            .select("reason_code", "description", "category",
                    round_half_up(F.col("bm"), 1).alias("base_mean"), round_half_up(F.col("rm"), 1).alias("recent_mean"),
                    z.alias("z"), F.col("base_weeks").cast("bigint").alias("base_weeks"),
                    F.coalesce(flagged, F.lit(False)).alias("flagged"),
                    F.when(z >= 4, "critical").when(z >= 3, "warning").otherwise("watch").alias("severity")))


# ---------------------------------------------------------------------------
# D02
# ---------------------------------------------------------------------------
def downtime_spikes(t: Tables, *, as_of: dt.date, recent_days: int = 21, base_days: int = 525) -> DataFrame:
    """Unplanned downtime rate per work centre, last ``recent_days``
    against a fixed ``base_days`` baseline (hours per day). Flag when the
    recent rate exceeds max(3 x base, 0.5); ratio >= 8 is critical."""
    de = t.downtime_event.where(F.col("ended_at").isNotNull() & is_unplanned(F.col("reason_text")))
    s = prefix_join(de, "tag_path", t.wc_tag.select("wc_code", "tag_prefix")).select(
        "wc_code", "started_at", hours_between(F.col("started_at"), F.col("ended_at")).alias("hrs"))
    recent = F.col("started_at") >= midnight_minus_days(as_of, recent_days)
    g = s.groupBy("wc_code").agg(F.sum(F.when(recent, F.col("hrs"))).alias("rh"),
                                 F.sum(F.when(~recent, F.col("hrs"))).alias("bh"),
                                 F.count(F.when(recent, 1)).alias("events"))
    g = g.where(F.col("rh") > 0).join(small(t.work_center.select("wc_code", "description")), "wc_code")
    rr = round_half_up(F.col("rh") / float(recent_days), 2)
    br = round_half_up(F.col("bh") / float(base_days), 2)
    g = g.select("wc_code", "description", rr.alias("recent_rate"), br.alias("base_rate"),
                 round_half_up(F.col("rh"), 1).alias("recent_hrs"), F.col("events").cast("bigint").alias("events"))
    base0 = F.coalesce(F.col("base_rate"), F.lit(0.0))
    ratio = F.when(base0 > 0, F.col("recent_rate") / base0).otherwise(F.lit(0.0))
    return g.select("*", round_half_up(ratio, 1).alias("ratio"),
                    (F.col("recent_rate") > F.greatest(base0 * 3, F.lit(0.5))).alias("flagged"),
                    F.when(ratio >= 8, "critical").otherwise("warning").alias("severity"))


# ---------------------------------------------------------------------------
# D03
# ---------------------------------------------------------------------------
def operation_runs(t: Tables, *, crew_since: Column | None = None) -> DataFrame:
    """Per (job, op) with production hours, from one aggregate of its labour:
    wc, min shift, first clock-in, estimates and actuals, and the labour rows
    and distinct operators (``crew``, bounded by the people who work on one
    operation) that clocked in from ``crew_since`` on."""
    jo = t.job_oper.where((F.col("est_prod_hrs") > 0) & (F.col("act_prod_hrs") > 0))
    now = F.lit(True) if crew_since is None else F.col("clock_in") >= crew_since
    lab = t.labor_dtl.groupBy("job_num", "oper_seq").agg(
        F.min("shift").alias("shift"), F.min("clock_in").alias("started"), F.count_if(now).alias("crew_rows"),
        F.collect_set(F.when(now, F.col("employee_num"))).alias("crew"))
    return jo.join(lab, ["job_num", "oper_seq"]).select(
        "job_num", "oper_seq", "wc_code", "shift", "started", "est_setup_hrs", "est_prod_hrs", "act_setup_hrs", "act_prod_hrs",
        (F.col("est_setup_hrs") + F.col("est_prod_hrs")).alias("est"),
        (F.col("act_setup_hrs") + F.col("act_prod_hrs")).alias("act"), "crew_rows", "crew")


def efficiency_drift(t: Tables, *, as_of: dt.date, recent_days: int = 60, min_recent_ops: int = 5,
                     runs: DataFrame | None = None) -> DataFrame:
    """actual/estimate per (work centre, shift), last ``recent_days``
    against earlier. Flag when recent > 1.08 and recent - base > 0.08 (a
    missing base counts as 0); 20 % or more over is a warning. ``runs``:
    ``operation_runs`` where it has been computed already."""
    o = operation_runs(t) if runs is None else runs
    recent = F.col("started") >= midnight_minus_days(as_of, recent_days)
    g = o.groupBy("wc_code", "shift").agg(
        F.sum(F.when(recent, F.col("act"))).alias("ra"), F.sum(F.when(recent, F.col("est"))).alias("re"),
        F.sum(F.when(~recent, F.col("act"))).alias("ba"), F.sum(F.when(~recent, F.col("est"))).alias("be"),
        F.count(F.when(recent, 1)).alias("recent_ops"))
    g = g.where(F.col("recent_ops") >= min_recent_ops)
    ratio = lambda a, e: F.when(F.col(e) != 0, round_half_up(F.col(a).cast("double") / F.col(e).cast("double"), 3))
    g = g.select("wc_code", "shift", ratio("ra", "re").alias("recent_ratio"), ratio("ba", "be").alias("base_ratio"),
                 F.col("recent_ops").cast("bigint").alias("recent_ops"))
    rr = F.coalesce(F.col("recent_ratio"), F.lit(0.0))
    br = F.coalesce(F.col("base_ratio"), F.lit(0.0))
    over = (rr - 1) * 100
    return g.select("*", ((rr > 1.08) & (rr - br > 0.08)).alias("flagged"),
                    F.when(over >= 20, "warning").otherwise("watch").alias("severity"))


# ---------------------------------------------------------------------------
# D04
# ---------------------------------------------------------------------------
def wrong_standards(t: Tables, *, as_of: dt.date, days: int = STANDARD_DAYS, min_runs: int = 8, min_ratio: float = 1.15,
                    min_share: float = 0.7, per_job: bool = False, operations: DataFrame | None = None) -> DataFrame:
    """Per (part, operation), runs over standard across many jobs and
    operators. Operation rows are grouped by (part, seq, wc, est, act) with
    their distinct operators - the job is not in the key, so identical runs
    collapse (``per_job=True`` keeps them apart). Flag when at least
    ``min_runs`` runs, ratio > 1.15 and more than 70 % of runs over 1.1x.
    ``operations``: ``operation_runs`` with the crew since ``days`` ago where
    it has been computed already."""
    if operations is None:
        jo = t.job_oper.where((F.col("est_prod_hrs") > 0) & (F.col("act_prod_hrs") > 0))
        ld = t.labor_dtl.where(F.col("clock_in") >= midnight_minus_days(as_of, days)).select("job_num", "oper_seq", "employee_num")
        worked = jo.join(ld, ["job_num", "oper_seq"])
    else:
        worked = operations.where(F.col("crew_rows") > 0).withColumn("employee_num", F.explode_outer("crew"))
    rows = worked.join(t.job_head.select("job_num", "part_num"), "job_num")
    keys = ["part_num", "oper_seq", "wc_code", "est_setup_hrs", "est_prod_hrs", "act_setup_hrs", "act_prod_hrs"]
    if per_job:
        keys.append("job_num")
    runs = rows.groupBy(*keys).agg(F.countDistinct("employee_num").alias("operators")).select(
        "part_num", "oper_seq", "wc_code", "operators",
        (F.col("est_setup_hrs") + F.col("est_prod_hrs")).alias("est"),
        (F.col("act_setup_hrs") + F.col("act_prod_hrs")).alias("act"))
    g = runs.groupBy("part_num", "oper_seq").agg(
        F.array_join(F.array_sort(F.collect_set("wc_code")), ", ").alias("work_centres"),
        F.count(F.lit(1)).alias("jobs"), F.sum("operators").cast("bigint").alias("operator_touches"),
        F.sum("act").alias("sa"), F.sum("est").alias("se"),
        F.count(F.when(F.col("act") > F.col("est") * F.lit(1.1).cast("decimal(2,1)"), 1)).alias("over"))
    ratio_raw = F.when(F.col("se") != 0, F.col("sa").cast("double") / F.col("se").cast("double"))
    share_raw = F.when(F.col("jobs") > 0, F.col("over") / F.col("jobs"))
    return g.select(
        "part_num", "oper_seq", "work_centres", F.col("jobs").cast("bigint").alias("jobs"), "operator_touches",
        round_half_up(ratio_raw, 3).alias("ratio"), round_half_up(share_raw, 2).alias("share_over"),
        F.coalesce((F.col("jobs") >= min_runs) & (ratio_raw > min_ratio) & (share_raw > min_share), F.lit(False)).alias("flagged"),
        F.when((round_half_up(ratio_raw, 3) - 1) * 100 >= 20, "warning").otherwise("watch").alias("severity"))


# ---------------------------------------------------------------------------
# D05
# ---------------------------------------------------------------------------
def reconciliation_gaps(t: Tables) -> DataFrame:
    """Total unmatched and the worst source pair (ties: pair name)."""
    s = bridges.unmatched_summary(t)
    return s.agg(F.sum("unmatched_count").cast("bigint").alias("total_unmatched"),
                 F.min_by("source_pair", F.struct((-F.col("unmatched_count")).alias("n"), F.col("source_pair").alias("p"))).alias("worst_pair"),
                 F.max("unmatched_count").alias("worst_count")).withColumn("flagged", F.col("total_unmatched") > 0)


# ---------------------------------------------------------------------------
# D06
# ---------------------------------------------------------------------------
# The finding texts (printf-style; numbers arrive already
# formatted the way the reference prints them).
FINDING_TEXT = {
    "scrap_id": "scrap-%s",
    "scrap_title": "%s scrap rising",
    "scrap_detail": "%s averaged %s pcs/week over the last 4 weeks against a %s pcs/week baseline — %s standard deviations above normal.",
    "scrap_ask_melt": "%s scrap is up. Which parts and work centres, and do the heats behind them explain it?",
    "scrap_ask": "%s scrap is up. What is driving it?",
    "downtime_id": "downtime-%s",
    "downtime_title": "Unplanned downtime on %s",
    "downtime_detail": "%s hrs across %s unplanned events in the last 21 days (%s hrs/day against a %s hrs/day baseline%s).",
    "downtime_ratio": ", %sx",
    "downtime_ask": "%s has been down a lot recently. What happened, and which jobs does it put at risk?",
    "eff_id": "eff-%s-s%s",
    "eff_title": "Shift %s running over standard on %s",
    "eff_detail": "%s%% over standard across %s operations in the last 60 days, against %s%% historically.",
    "eff_ask": "Shift %s on %s is running over standard. Is that the standard or the crew?",
    "standard_id": "standard-%s-%s",
    "standard_title": "Standard looks wrong on %s op %s",
    "standard_detail": "Runs %s%% over standard across %s jobs at %s, missed on %s%% of runs and spread across %s operator assignments — not one crew.",
    "standard_ask": "%s operation %s runs over standard. Is that the standard or the crew?",
    "recon_id": "recon-gaps",
    "recon_title": "%s records do not reconcile across systems",
    "recon_detail": "Largest gap is %s with %s unmatched. Any answer touching those records is incomplete.",
    "recon_ask": "How well do the four source systems reconcile, and what specifically does not match?",
}


def _fmt(key: str, *cols: Column) -> Column:
    return F.format_string(FINDING_TEXT[key], *cols)


def findings(t: Tables, *, as_of: dt.date, top: int = 8, share_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Flagged rows of D01-D05 in one shape, ordered by severity, then
    detector, then the detector's own order; the first ``top``. D03 and D04
    read the same operations with their labour: where the labour's files are
    over ``share_bytes`` these meet once and are checkpointed (a job that runs
    while the frame is built); below, two scans cost less than the table."""
    size, runs = input_bytes(t.labor_dtl), None
    if size is None or size > share_bytes:
        ensure_checkpoint_dir(t.job_oper.sparkSession)
        runs = operation_runs(t, crew_since=midnight_minus_days(as_of, STANDARD_DAYS)).checkpoint()

    def shape(df: DataFrame, det: int, order: Column, fid: Column, title: Column, detail: Column,
              sources: str, ask: Column) -> DataFrame:
        return df.select(F.lit(det).alias("detector"), order.alias("det_order"), fid.alias("id"),
                         F.col("severity"), title.alias("title"), detail.alias("detail"),
                         F.lit(sources).alias("sources"), ask.alias("ask"))

    c = F.col
    s = scrap_spikes(t, as_of=as_of).where("flagged")
    f1 = shape(s, 0, -c("z"), _fmt("scrap_id", c("reason_code")), _fmt("scrap_title", c("description")),
               _fmt("scrap_detail", c("reason_code"), js_num(c("recent_mean")), js_num(c("base_mean")), js_num(c("z"))),
               "erp",
               F.when(c("category") == "MELT", _fmt("scrap_ask_melt", c("description")))
                .otherwise(_fmt("scrap_ask", c("description"))))
    d = downtime_spikes(t, as_of=as_of).where("flagged")
    base0 = F.coalesce(c("base_rate"), F.lit(0.0))
    raw_ratio = F.when(base0 > 0, c("recent_rate") / base0).otherwise(F.lit(0.0))
    ratio_txt = F.when(raw_ratio != 0, _fmt("downtime_ratio", F.floor(raw_ratio + 0.5).cast("bigint"))).otherwise(F.lit(""))
    f2 = shape(d, 1, -c("recent_rate"), _fmt("downtime_id", c("wc_code")), _fmt("downtime_title", c("wc_code")),
               _fmt("downtime_detail", js_num(c("recent_hrs")), c("events"), js_num(c("recent_rate")), js_num(base0),
                    ratio_txt),
               "historian,xref", _fmt("downtime_ask", c("wc_code")))
    e = efficiency_drift(t, as_of=as_of, runs=runs).where("flagged")
    over = round_half_up((c("recent_ratio") - 1) * 100, 1)
    base_over = round_half_up((F.coalesce(c("base_ratio"), F.lit(0.0)) - 1) * 100, 1)
    f3 = shape(e, 2, F.lit(0.0), _fmt("eff_id", c("wc_code"), c("shift")), _fmt("eff_title", c("shift"), c("wc_code")),
               _fmt("eff_detail", js_num(over), c("recent_ops"), js_num(base_over)),
               "erp", _fmt("eff_ask", c("shift"), c("wc_code")))
    w = wrong_standards(t, as_of=as_of, operations=runs).where("flagged")
    w = w.orderBy(F.desc("ratio"), "part_num", "oper_seq").limit(2)
    over4 = round_half_up((c("ratio") - 1) * 100, 1)
    f4 = shape(w, 3, -c("ratio"), _fmt("standard_id", c("part_num"), c("oper_seq")),
               _fmt("standard_title", c("part_num"), c("oper_seq")),
               _fmt("standard_detail", js_num(over4), c("jobs"), c("work_centres"),
                    F.floor(c("share_over") * 100 + 0.5).cast("bigint"), c("operator_touches")),
               "erp", _fmt("standard_ask", c("part_num"), c("oper_seq")))
    g = reconciliation_gaps(t).where("flagged").withColumn("severity", F.lit("watch"))
    f5 = shape(g, 4, F.lit(0.0), F.lit(FINDING_TEXT["recon_id"]), _fmt("recon_title", c("total_unmatched")),
               _fmt("recon_detail", c("worst_pair"), c("worst_count")),
               "xref,erp,melt,historian,board", F.lit(FINDING_TEXT["recon_ask"]))
    allf = f1.unionByName(f2).unionByName(f3).unionByName(f4).unionByName(f5)
    keys = ["severity_rank", "detector", "det_order", "id"]
    top_rows = allf.withColumn("severity_rank", _severity_rank(c("severity"))).orderBy(*keys).limit(top)
    # A window over the (at most ``top``) kept rows only.
    return (top_rows.withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
            .select("position", "id", "severity", "title", "detail", "sources", "ask", "severity_rank", "detector"))


# ---------------------------------------------------------------------------
# D07-D14
# ---------------------------------------------------------------------------
def top_reasons(t: Tables, *, as_of: dt.date, weeks: int = 16, top: int = 4) -> DataFrame:
    """The ``top`` reasons by scrap since as_of - ``weeks`` weeks (no
    upper bound, as in the reference); ties by reason code."""
    g = (t.scrap_dtl.where(F.col("logged_at") >= midnight_minus_days(as_of, 7 * weeks))
         .groupBy("reason_code").agg(F.sum("scrap_qty").cast("bigint").alias("qty")))
    return g.orderBy(F.desc("qty"), "reason_code").limit(top)


def scrap_series(t: Tables, *, as_of: dt.date, weeks: int = 16, top: int = 4) -> DataFrame:
    """Weekly scrap of the top reasons in [as_of - weeks, as_of 00:00]."""
    reasons = top_reasons(t, as_of=as_of, weeks=weeks, top=top).select("reason_code")
    sd = t.scrap_dtl.where((F.col("logged_at") >= midnight_minus_days(as_of, 7 * weeks))
                           & (F.col("logged_at") <= ts_ntz(as_of)))
    return (sd.join(F.broadcast(reasons), "reason_code", "left_semi")  # at most ``top`` rows
            .groupBy(week_start(F.col("logged_at")).alias("week"), "reason_code")
            .agg(F.sum("scrap_qty").cast("bigint").alias("qty")))


def dense_series(t: Tables, *, as_of: dt.date, weeks: int = 16, top: int = 4) -> DataFrame:
    """The week x reason grid over the weeks present, zero-filled.
    Both sides are bounded (weeks x top reasons)."""
    s = scrap_series(t, as_of=as_of, weeks=weeks, top=top)
    # Both sides are bounded by construction: weeks in the window x ``top`` reasons.
    grid = s.select("week").distinct().crossJoin(F.broadcast(top_reasons(t, as_of=as_of, weeks=weeks, top=top)
                                                             .select("reason_code")))
    return grid.join(s, ["week", "reason_code"], "left").select(
        "week", "reason_code", F.coalesce("qty", F.lit(0)).cast("bigint").alias("qty"))


def load_overview(t: Tables, *, as_of: dt.date) -> DataFrame:
    """All-horizon committed open hours per work centre against the
    effective weekly capacity; centres with committed hours only."""
    jo = t.job_oper.where(F.col("act_prod_hrs") == 0).join(
        t.job_head.where(~F.col("job_closed")).select("job_num"), "job_num", "left_semi")
    c = jo.groupBy("wc_code").agg(F.sum(F.col("est_setup_hrs") + F.col("est_prod_hrs")).alias("hrs"))
    down = unplanned_downtime(t, as_of=as_of)
    wc = t.work_center.join(c, "wc_code", "left").join(small(down), "wc_code", "left")
    committed = F.round(F.coalesce(F.col("hrs"), F.lit(0)), 1).cast("double")
    nameplate = (F.col("shifts_per_day") * F.col("hrs_per_shift") * F.col("resources") * 5).cast("double")
    eff = round_half_up(F.greatest(F.lit(0.0), nameplate - F.coalesce(F.col("down_hrs"), F.lit(0.0)) / 3), 1)
    out = wc.where(F.coalesce(F.col("hrs"), F.lit(0)) > 0).select(
        "wc_code", "dept", committed.alias("committed_hrs"), eff.alias("effective_hrs"))
    return out.withColumn("utilization_pct", F.when(F.col("effective_hrs") > 0, round_half_up(
        F.col("committed_hrs") / F.col("effective_hrs") * 100, 1)))


def load_share(t: Tables, *, as_of: dt.date, top: int = 8) -> DataFrame:
    """The ``top`` most committed centres with committed and effective
    hours as % of the largest of either among them."""
    lo = load_overview(t, as_of=as_of).orderBy(F.desc("committed_hrs"), "wc_code").limit(top)
    mx = lo.agg(F.max(F.greatest("committed_hrs", "effective_hrs")).alias("mx"))
    share = lambda c: F.when(F.col("mx") > 0, round_half_up(F.col(c) / F.col("mx") * 100, 1))
    return lo.crossJoin(mx).select(
        "wc_code", "committed_hrs", "effective_hrs",
        share("committed_hrs").alias("committed_share_pct"), share("effective_hrs").alias("capacity_share_pct"),
        (F.col("utilization_pct") > 100).alias("over"))


def due_soon(t: Tables, *, as_of: dt.date, top: int = 12) -> DataFrame:
    """The ``top`` earliest-due open jobs with remaining hours (their
    total, 1 dp) and bottleneck; no contention. Ties by job number."""
    pj = bottleneck(t)
    jh = t.job_head.where(~F.col("job_closed")).join(t.part.select("part_num", "customer_code"), "part_num")
    rows = jh.join(pj, "job_num").select(
        "job_num", "part_num", "customer_code", "req_due_date",
        F.datediff(F.col("req_due_date"), lit_date(as_of)).cast("int").alias("days_to_due"),
        "bottleneck_wc", F.round(F.col("total_rem_hrs"), 1).cast("double").alias("remaining_hrs"))
    return rows.orderBy("days_to_due", "job_num").limit(top)


def kpi_counts(t: Tables, *, as_of: dt.date) -> DataFrame:
    """Open jobs, unmatched records, and non-watch findings in the top 8
    (the reference's "at risk" count counts findings, not jobs)."""
    open_n = t.job_head.where(~F.col("job_closed")).agg(F.count(F.lit(1)).alias("open_jobs"))
    um = bridges.unmatched(t).agg(F.count(F.lit(1)).alias("unmatched"))
    fr = findings(t, as_of=as_of).agg(F.count_if(F.col("severity") != "watch").alias("at_risk"))
    return open_n.crossJoin(um).crossJoin(fr)
