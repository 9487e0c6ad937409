"""Signal and data-quality queries (V01-V18) as parameterised operators.

Each returns the scored numbers plus a ``flagged`` column (the reference's
threshold test), so an unflagged result is still a checkable result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwork.operators import bridges
from castwork.sources.tables import Tables


def match_rate_bounds(t: Tables, lo: float = 50.0, hi: float = 100.0) -> DataFrame:
    """Every bridge's match rate lies strictly inside (lo, hi)."""
    return bridges.match_pct(t).select(
        "source_pair", "match_pct", ((F.col("match_pct") > lo) & (F.col("match_pct") < hi)).alias("in_bounds"))


def unmatched_coverage(t: Tables, min_pairs: int = 3) -> DataFrame:
    """How many source pairs report gaps (flag when >= min_pairs)."""
    return bridges.unmatched(t).agg(
        F.countDistinct("source_pair").alias("pairs_with_gaps"),
        F.count(F.lit(1)).alias("unmatched_total"),
    ).withColumn("flagged", F.col("pairs_with_gaps") >= min_pairs)


def job_heat_count(t: Tables) -> DataFrame:
    """Resolved job/heat pairs (flag when any), counted without building them."""
    return bridges.job_heat_sizes(t).agg(F.coalesce(F.sum("pours"), F.lit(0)).alias("pairs"),
                                         F.countDistinct("job_num").alias("jobs")) \
        .withColumn("flagged", F.col("pairs") > 0)


# ---------------------------------------------------------------------------
# Period splits, cohort deltas, rate ratios and correlation.
# ---------------------------------------------------------------------------
from castwork.functions.exprs import hours_between, round_half_up, round_mean, small  # noqa: E402
from castwork.sources.tables import TABLE_NAMES  # noqa: E402


def _max_of(df: DataFrame, col: str, alias: str) -> DataFrame:
    return df.agg(F.max(col).alias(alias))


def row_counts(t: Tables) -> DataFrame:
    """Rows per model table (flag when a table is empty)."""
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("relation"), "rows")
             for n in TABLE_NAMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("flagged", F.col("rows") == 0)


def reason_share_shift(t: Tables, *, recent_days: int = 56, factor: float = 1.8,
                       parts: list[str] | None = None) -> DataFrame:
    """V02 for every reason: its share of scrap in the last ``recent_days``
    before the latest scrap record vs. before that (optionally for a part
    set); flag when the recent share exceeds ``factor`` x baseline."""
    sd = t.scrap_dtl.join(t.job_head.select("job_num", "part_num"), "job_num")
    if parts:
        sd = sd.where(F.col("part_num").isin(parts))
    last = _max_of(t.scrap_dtl, "logged_at", "last")
    sd = sd.crossJoin(last).withColumn(
        "recent", F.col("logged_at") >= F.col("last") - F.make_dt_interval(F.lit(recent_days)))
    per = sd.groupBy("recent", "reason_code").agg(F.sum("scrap_qty").alias("q"))
    tot = sd.groupBy("recent").agg(F.sum("scrap_qty").alias("tq"))
    sh = per.join(tot, "recent").withColumn("share", F.when(F.col("tq") != 0, F.col("q").cast("double") / F.col("tq")))
    g = sh.groupBy("reason_code").agg(F.max(F.when(~F.col("recent"), F.col("share"))).alias("baseline_share"),
                                      F.max(F.when(F.col("recent"), F.col("share"))).alias("recent_share"))
    return g.withColumn("flagged", F.coalesce(F.col("recent_share") > F.col("baseline_share") * factor, F.lit(False)))


def level_decay(t: Tables, *, base_gap_days: int = 56, recent_days: int = 14, factor: float = 0.75) -> DataFrame:
    """V03 per furnace: mean degas before (latest pour - 56 d) vs the last
    14 days; flag when recent < 0.75 x baseline."""
    last = _max_of(t.heat, "poured_at", "last")
    h = t.heat.crossJoin(last)
    base = F.col("poured_at") < F.col("last") - F.make_dt_interval(F.lit(base_gap_days))
    rec = F.col("poured_at") >= F.col("last") - F.make_dt_interval(F.lit(recent_days))
    g = h.groupBy("furnace_id").agg(F.sum(F.when(base, F.col("degas_minutes"))).alias("bs"),
                                    F.count(F.when(base, F.col("degas_minutes"))).alias("bn"),
                                    F.sum(F.when(rec, F.col("degas_minutes"))).alias("rs"),
                                    F.count(F.when(rec, F.col("degas_minutes"))).alias("rn"))
    return _decay(g, "furnace_id", factor)


def _decay(g: DataFrame, key: str, factor: float) -> DataFrame:
    b = F.when(F.col("bn") > 0, F.col("bs").cast("double") / F.col("bn"))
    r = F.when(F.col("rn") > 0, F.col("rs").cast("double") / F.col("rn"))
    return g.select(key, round_mean(b, 4).alias("baseline"), round_mean(r, 4).alias("recent"),
                    F.coalesce(r < b * factor, F.lit(False)).alias("flagged"))


def tag_decay(t: Tables, *, base_gap_days: int = 56, recent_days: int = 14, factor: float = 0.75) -> DataFrame:
    """V03 on every historian tag (latest sample of the whole historian)."""
    last = _max_of(t.tag_history, "ts", "last")
    h = t.tag_history.crossJoin(last)
    base = F.col("ts") < F.col("last") - F.make_dt_interval(F.lit(base_gap_days))
    rec = F.col("ts") >= F.col("last") - F.make_dt_interval(F.lit(recent_days))
    g = h.groupBy("tag_path").agg(F.sum(F.when(base, F.col("value_float"))).alias("bs"),
                                  F.count(F.when(base, F.col("value_float"))).alias("bn"),
                                  F.sum(F.when(rec, F.col("value_float"))).alias("rs"),
                                  F.count(F.when(rec, F.col("value_float"))).alias("rn"))
    return _decay(g, "tag_path", factor)


def mechanism_corr(t: Tables, *, threshold: float = 0.4) -> DataFrame:
    """Pearson r of degas minutes and density per furnace (heats with a
    density), from exact decimal sums, so every engine gives the same r."""
    h = t.heat.where(F.col("rpt_density").isNotNull())
    x, y = F.col("degas_minutes"), F.col("rpt_density")
    g = h.groupBy("furnace_id").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                                    F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    d = lambda c: F.col(c).cast("double")
    n = d("n")
    cov = n * d("sxy") - d("sx") * d("sy")
    vx = n * d("sxx") - d("sx") * d("sx")
    vy = n * d("syy") - d("sy") * d("sy")
    r = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return g.select("furnace_id", F.col("n").cast("bigint").alias("heats"), round_half_up(r, 6).alias("r"),
                    F.coalesce(r > threshold, F.lit(False)).alias("flagged"))


def linked_items(t: Tables) -> DataFrame:
    """Board items linked to a real job, per (part, status)."""
    m = bridges.job_board_item(t).join(t.job_head.select(F.col("job_num").alias("resolved_job_num"), "part_num"),
                                       "resolved_job_num")
    return m.groupBy("part_num", "status").agg(F.count(F.lit(1)).alias("items"))


def cohort_delta(t: Tables, *, cohort_days: int = 380, margin: float = 0.05) -> DataFrame:
    """V07 per (work centre, shift): mean actual/estimated production ratio
    before and after (first start at that centre + ``cohort_days``). Flag a
    shift whose change exceeds the best shift's change at its centre by
    more than ``margin``."""
    jo = t.job_oper.where(F.col("est_prod_hrs") > 0)
    lab = t.labor_dtl.groupBy("job_num", "oper_seq").agg(F.min("shift").alias("shift"), F.min("clock_in").alias("started"))
    o = jo.join(lab, ["job_num", "oper_seq"]).select(
        "wc_code", "shift", "started",
        (F.col("act_prod_hrs").cast("double") / F.col("est_prod_hrs").cast("double")).alias("ratio"))
    first = o.groupBy("wc_code").agg(F.min("started").alias("first"))
    o = o.join(small(first), "wc_code").withColumn(
        "after", F.col("started") >= F.col("first") + F.make_dt_interval(F.lit(cohort_days)))
    g = o.groupBy("wc_code", "shift").agg(F.avg(F.when(~F.col("after"), F.col("ratio"))).alias("b"),
                                          F.avg(F.when(F.col("after"), F.col("ratio"))).alias("a"))
    g = g.select("wc_code", "shift", round_mean(F.col("b"), 4).alias("before_cohort"),
                 round_mean(F.col("a"), 4).alias("after_cohort"))
    g = g.withColumn("delta", round_mean(F.col("after_cohort") - F.col("before_cohort"), 4))
    best = g.groupBy("wc_code").agg(F.min("delta").alias("best"))
    return g.join(small(best), "wc_code").select(
        "wc_code", "shift", "before_cohort", "after_cohort", "delta",
        F.coalesce(F.col("delta") > F.col("best") + margin, F.lit(False)).alias("flagged"))


def operator_prefix_count(t: Tables, *, prefix: str = "E-10") -> DataFrame:
    """Distinct operators whose employee number starts with ``prefix``."""
    return (t.labor_dtl.where(F.col("employee_num").startswith(prefix))
            .agg(F.countDistinct("employee_num").alias("operators"))
            .select(F.lit(prefix).alias("prefix"), "operators", (F.col("operators") > 0).alias("flagged")))


def family_overrun(t: Tables, *, factor: float = 1.15) -> DataFrame:
    """V09 per (operation, part family = pattern number): mean actual /
    estimated production of the family vs every other family at that
    operation; flag when the family runs ``factor`` x the rest."""
    jo = t.job_oper.where(F.col("est_prod_hrs") > 0)
    fam = t.job_head.select("job_num", "part_num").join(t.part.select("part_num", F.col("pattern_num").alias("family")), "part_num")
    o = jo.join(fam, "job_num").select(
        "oper_seq", "family", (F.col("act_prod_hrs").cast("double") / F.col("est_prod_hrs").cast("double")).alias("ratio"))
    g = o.groupBy("oper_seq", "family").agg(F.sum("ratio").alias("s"), F.count(F.lit(1)).alias("n"))
    tot = g.groupBy("oper_seq").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    j = g.join(small(tot), "oper_seq")
    fam_mean = F.col("s") / F.col("n")
    rest_mean = F.when(F.col("tn") > F.col("n"), (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")))
    return j.select("oper_seq", "family", round_mean(fam_mean, 4).alias("family_ratio"),
                    round_mean(rest_mean, 4).alias("rest_ratio"),
                    F.coalesce(fam_mean > rest_mean * factor, F.lit(False)).alias("flagged"))


def overrun_operators(t: Tables, *, factor: float = 1.15, min_operators: int = 6) -> DataFrame:
    """V10 per (operation, family): distinct operators who logged labour on
    runs over ``factor`` x estimate; flag when many (a standard problem)."""
    jo = t.job_oper.where(F.col("act_prod_hrs") > F.col("est_prod_hrs") * F.lit(factor).cast("decimal(3,2)"))
    fam = t.job_head.select("job_num", "part_num").join(t.part.select("part_num", F.col("pattern_num").alias("family")), "part_num")
    o = jo.join(fam, "job_num").join(t.labor_dtl.select("job_num", "oper_seq", "employee_num"), ["job_num", "oper_seq"])
    return (o.groupBy("oper_seq", "family").agg(F.countDistinct("employee_num").alias("operators"))
            .withColumn("flagged", F.col("operators") >= min_operators))


def event_rate_ratio(t: Tables, *, recent_days: int = 21, factor: float = 5.0) -> DataFrame:
    """V11 per tag: downtime hours per day in the last ``recent_days`` before
    the latest event vs the elapsed-day rate before that (from the first
    event); recent event count. Bounds are over all events."""
    de = t.downtime_event
    b = de.agg(F.max("started_at").alias("last_evt"), F.min("started_at").alias("first_evt"))
    cut = F.col("last_evt") - F.make_dt_interval(F.lit(recent_days))
    d = de.crossJoin(b).withColumn("hrs", hours_between(F.col("started_at"), F.col("ended_at"))) \
        .withColumn("recent", F.col("started_at") >= cut) \
        .withColumn("span_days", F.timestamp_diff("MICROSECOND", F.col("first_evt"), cut).cast("double") / F.lit(8.64e10))
    g = d.groupBy("tag_path").agg(F.sum(F.when(F.col("recent"), F.col("hrs"))).alias("rh"),
                                  F.sum(F.when(~F.col("recent"), F.col("hrs"))).alias("eh"),
                                  F.count(F.when(F.col("recent"), 1)).alias("recent_events"),
                                  F.max("span_days").alias("span"))
    recent = F.col("rh") / float(recent_days)
    earlier = F.when(F.col("span") != 0, F.col("eh") / F.col("span"))
    return g.select("tag_path", round_mean(recent, 4).alias("recent_hrs_per_day"),
                    round_mean(earlier, 4).alias("earlier_hrs_per_day"),
                    F.col("recent_events").cast("bigint").alias("recent_events"),
                    F.coalesce(recent > earlier * factor, F.lit(False)).alias("flagged"))


def open_jobs_at_wc(t: Tables) -> DataFrame:
    """Open jobs with an operation at each work centre (due no later
    than the latest due date of all jobs)."""
    last = t.job_head.agg(F.max("req_due_date").alias("last_due"))
    jh = t.job_head.where(~F.col("job_closed")).crossJoin(last).where(F.col("req_due_date") <= F.col("last_due"))
    return (t.job_oper.select("job_num", "wc_code").join(jh.select("job_num"), "job_num")
            .groupBy("wc_code").agg(F.countDistinct("job_num").alias("open_jobs")))


def reason_variants(t: Tables, *, min_variants: int = 3) -> DataFrame:
    """Distinct free-text downtime reasons per tag."""
    return (t.downtime_event.groupBy("tag_path").agg(F.countDistinct("reason_text").alias("variants"))
            .withColumn("flagged", F.col("variants") >= min_variants))


def ratio_drift(t: Tables, *, days: int = 90, factor: float = 1.15) -> DataFrame:
    """Mean returns / charged over the first ``days`` days of heats vs
    the last ``days`` days; flag an upward drift beyond ``factor``."""
    b = t.heat.agg(F.min("poured_at").alias("first"), F.max("poured_at").alias("last"))
    h = t.heat.crossJoin(b).withColumn(
        "ratio", F.when(F.col("lbs_charged") != 0, F.col("lbs_returns").cast("double") / F.col("lbs_charged").cast("double")))
    g = h.agg(F.avg(F.when(F.col("poured_at") < F.col("first") + F.make_dt_interval(F.lit(days)), F.col("ratio"))).alias("e"),
              F.avg(F.when(F.col("poured_at") >= F.col("last") - F.make_dt_interval(F.lit(days)), F.col("ratio"))).alias("l"))
    return g.select(round_mean(F.col("e"), 6).alias("early"), round_mean(F.col("l"), 6).alias("late"),
                    F.coalesce(F.col("l") > F.col("e") * factor, F.lit(False)).alias("flagged"))
