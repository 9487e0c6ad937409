"""Cross-source tools: T09 heat history, T10 machine signal and downtime,
T11 customer commitments. All jobs in one pass; ``jobs.for_job`` narrows.

The historian carries no job key, so T10 crosses two bridges at once: the
work centre's tag prefix (equi join on exploded path prefixes) and the job's
time window (equi join on calendar day, exact range as a residual).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwork.functions.exprs import (
    days_between, hours_between, lit_date, midnight_minus_days, round_half_up, round_mean, small,
)
from castwork.operators import bridges, segments
from castwork.operators.joins import day_span, path_prefixes
from castwork.operators.windows import input_bytes, spread
from castwork.sources.tables import Tables


def job_heats(t: Tables) -> DataFrame:
    """T09 heats: per job, the distinct heats that poured its pattern inside
    its window, with the melt record and yield % (1 dp)."""
    h = t.heat.select("heat_num", "furnace_id", "alloy_spec", "poured_at", "degas_minutes", "rpt_density",
                      "lbs_charged", "lbs_poured", "lbs_returns")
    return bridges.heats_of_jobs(t, h).select(
        "job_num", "heat_num", "furnace_id", "alloy_spec", "poured_at",
        *[F.col(c).cast("double").alias(c) for c in ("degas_minutes", "rpt_density", "lbs_charged", "lbs_poured", "lbs_returns")],
        F.when(F.col("lbs_charged") != 0, round_half_up(
            F.col("lbs_poured").cast("double") / F.col("lbs_charged").cast("double") * 100, 1)).alias("yield_pct"))


def heat_summary(t: Tables, *, as_of: dt.date, baseline_days: int = 90) -> DataFrame:
    """T09 summary per job: pattern (NULL = unmapped, no heats can resolve),
    heat count, mean degas over heats with a value (2 dp), and - only when
    all its heats come from one furnace - that furnace's mean degas (2 dp) and
    density (3 dp) over heats poured before as_of - ``baseline_days``."""
    heats = job_heats(t)
    per = heats.groupBy("job_num").agg(
        F.count(F.lit(1)).alias("heat_count"),
        F.sum("degas_minutes").alias("ds"), F.count("degas_minutes").alias("dn"),
        F.min("furnace_id").alias("furnace_id"), F.max("furnace_id").alias("other_furnace"))
    base = (t.heat.where(F.col("poured_at") < midnight_minus_days(as_of, baseline_days))
            .groupBy("furnace_id").agg(F.sum("degas_minutes").alias("bd"), F.count("degas_minutes").alias("bdn"),
                                       F.sum("rpt_density").alias("br"), F.count("rpt_density").alias("brn")))
    jp = bridges.job_pattern(t)
    out = (jp.join(per, "job_num", "left").join(small(base), "furnace_id", "left"))
    one = F.col("furnace_id") == F.col("other_furnace")
    return out.select(
        "job_num", "part_num", "pattern_code",
        F.coalesce(F.col("heat_count"), F.lit(0)).cast("bigint").alias("heat_count"),
        F.when(F.col("dn") > 0, round_half_up(F.col("ds").cast("double") / F.col("dn"), 2)).alias("avg_degas_minutes"),
        F.when(one & (F.col("bdn") > 0), round_half_up(F.col("bd").cast("double") / F.col("bdn"), 2)).alias("baseline_degas_minutes"),
        F.when(one & (F.col("brn") > 0), round_half_up(F.col("br").cast("double") / F.col("brn"), 3)).alias("baseline_rpt_density"))


def _job_tags(t: Tables, times: DataFrame) -> DataFrame:
    """(job, wc, role, prefix, window) for every operation of every job whose window meets the span of ``times``, a
    column of instants: one row per operation, so two operations on one centre count twice. The windows before and
    after all of ``times``, which would meet nothing, are left out before operations join them."""
    span = times.toDF("_t")
    windows = bridges.job_window(t).where((F.col("ended_at") >= span.agg(F.min("_t")).scalar()) & (F.col("started_at") <= span.agg(F.max("_t")).scalar()))
    return (t.job_oper.select("job_num", "wc_code")
            .join(small(t.wc_tag.select("wc_code", "tag_prefix", "signal_role")), "wc_code")
            .join(windows, "job_num"))


def _bridged(df: DataFrame, t: Tables) -> DataFrame:
    """``df`` once per '/'-prefix of its tag_path that some work centre owns.
    Prefixes nobody owns (the plant, a cell) are dropped before any shuffle:
    they would gather every sample of a day under one key and match nothing."""
    owned = t.wc_tag.select("tag_prefix").distinct()
    return df.withColumn("tag_prefix", F.explode(path_prefixes(F.col("tag_path")))) \
        .join(small(owned), "tag_prefix", "left_semi")


def _by_segments(jt: DataFrame, samples: DataFrame) -> DataFrame:
    """Partials per job and tag from nested time segments: no join sees raw samples. Operations of a job on one
    centre share a window and count by weight."""
    rollup = segments.rolled_up(samples, "ts", ["tag_prefix", "tag_path"], "value_float")
    windows = jt.groupBy("job_num", "wc_code", "signal_role", "tag_prefix", "started_at", "ended_at").agg(F.count(F.lit(1)).alias("times"))
    met = segments.within(windows, rollup, "tag_prefix", "started_at", "ended_at")
    return met.select(*SIGNAL_KEYS, (F.col("n") * F.col("times")).alias("n"), (F.col("total") * F.col("times")).alias("sv"),
                      (F.col("n_values") * F.col("times")).alias("nv"), F.col("least").alias("mn"), F.col("most").alias("mx"))


def _by_days(jt: DataFrame, samples: DataFrame) -> DataFrame:
    """Partials per job and tag from whole days, and from the samples of a window's first and last day."""
    s = samples.withColumn("_day", F.col("ts").cast("date"))
    d0, d1 = F.col("started_at").cast("date"), F.col("ended_at").cast("date")
    inner = jt.where(F.date_add(d0, 1) <= F.date_sub(d1, 1)).withColumn("_day", F.explode(F.sequence(F.date_add(d0, 1), F.date_sub(d1, 1))))
    daily = s.groupBy("tag_prefix", "tag_path", "_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value_float").alias("sv"), F.count("value_float").alias("nv"),
        F.min("value_float").alias("mn"), F.max("value_float").alias("mx"))
    whole = inner.join(daily, ["tag_prefix", "_day"]).select(*SIGNAL_KEYS, "n", "sv", "nv", "mn", "mx")
    edge = jt.where(d1 >= d0).withColumn("_day", F.explode(F.array_distinct(F.array(d0, d1))))
    v = F.col("value_float")
    part = (edge.join(s, ["tag_prefix", "_day"]).where((F.col("ts") >= F.col("started_at")) & (F.col("ts") <= F.col("ended_at")))
            .select(*SIGNAL_KEYS, F.lit(1).cast("bigint").alias("n"), v.alias("sv"), v.isNotNull().cast("bigint").alias("nv"), v.alias("mn"), v.alias("mx")))
    return whole.unionByName(part)


SIGNAL_KEYS = ("job_num", "wc_code", "signal_role", "tag_path")
# Bytes of historian up to which windows meet the samples of their first and last day: such pairs grow with the product.
DAY_BYTES = 4 << 20


def machine_signal(t: Tables, *, signal_role: str | None = None, good_only: bool = False, day_bytes: int = DAY_BYTES) -> DataFrame:
    """Per (job, wc, role, tag) the historian samples inside the job's
    window: count, mean, min, max (2 dp). Quality is not filtered unless
    ``good_only`` (192 = good).

    Where the sources read are over ``day_bytes``, windows meet the few nested
    time segments that cover them, their first and last day included. Below,
    a day holds few samples, and its edge days meet those, which costs less
    than working out covers. Both are exact.
    """
    th = t.tag_history
    if good_only:
        th = th.where(F.col("quality") == 192)
    jt = _job_tags(t, th.select("ts"))
    if signal_role is not None:
        jt = jt.where(F.col("signal_role") == signal_role)
    samples = _bridged(th.select("tag_path", "ts", "value_float"), t)
    size = input_bytes(th)
    partials = _by_days(jt, samples) if size is not None and size <= day_bytes else _by_segments(jt, samples)
    g = partials.groupBy(*SIGNAL_KEYS).agg(
        F.sum("n").alias("samples"), F.sum("sv").alias("sv"), F.sum("nv").alias("nv"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    return g.select(*SIGNAL_KEYS, "samples",
                    round_mean(F.when(F.col("nv") > 0, F.col("sv") / F.col("nv")), 2).alias("avg_value"),
                    round_half_up(F.col("mn"), 2).alias("min_value"),
                    round_half_up(F.col("mx"), 2).alias("max_value"))


def machine_downtime(t: Tables) -> DataFrame:
    """Downtime events on the job's centres that started inside its
    window (no reason filter); open events have NULL hours."""
    jt = _job_tags(t, t.downtime_event.select("started_at")).withColumn("_day", F.explode(day_span(F.col("started_at"), F.col("ended_at"))))
    jt = spread(jt.drop("signal_role"), "tag_prefix", "_day")  # parts of what is read may be small, their pairs are not
    de = _bridged(t.downtime_event.select(
        "tag_path", F.col("started_at").alias("ev_start"), F.col("ended_at").alias("ev_end"), "reason_text",
        round_half_up(hours_between(F.col("started_at"), F.col("ended_at")), 2).alias("down_hrs")), t) \
        .withColumn("_day", F.col("ev_start").cast("date"))
    pairs = jt.join(de, ["tag_prefix", "_day"]).where(
        (F.col("ev_start") >= F.col("started_at")) & (F.col("ev_start") <= F.col("ended_at")))
    return pairs.select("job_num", "wc_code", "tag_path", F.col("ev_start").alias("started_at"),
                        F.col("ev_end").alias("ended_at"),
                        "down_hrs", "reason_text")


def customer_commitments(t: Tables, *, as_of: dt.date, open_only: bool = True, status: str | None = None,
                         customer: str | None = None) -> DataFrame:
    """Board items with their job reference resolved, the job's part
    and due date, days to the promise, and the Notes / Priority attributes
    (one pivot of the attribute table instead of two correlated lookups).
    ``open_only`` keeps items on open jobs (the tool without a job number)."""
    m = bridges.job_board_item(t)
    if status is not None:
        m = m.where(F.col("status") == status)
    if customer is not None:
        m = m.where(F.col("customer") == customer)
    attrs = (t.column_value.where(F.col("column_title").isin("Notes", "Priority"))
             .groupBy("item_id").agg(F.max(F.when(F.col("column_title") == "Notes", F.col("text_value"))).alias("notes_text"),
                                     F.max(F.when(F.col("column_title") == "Priority", F.col("text_value"))).alias("priority")))
    jh = t.job_head.select(F.col("job_num").alias("resolved_job_num"), "part_num", F.col("req_due_date").alias("job_due_date"),
                           "job_closed")
    out = m.join(jh, "resolved_job_num", "left")
    if open_only:
        out = out.where(~F.col("job_closed"))
    return out.join(attrs, "item_id", "left").select(
        "item_id", "board_name", "item_name", "status", "customer", "promised_date", "raw_job_ref", "resolved_job_num",
        "part_num", "job_due_date", days_between(lit_date(as_of), F.col("promised_date")).alias("days_to_promise"),
        "notes_text", "priority")
