"""Registered queries: every operator bound to the driver data set.

Each entry is ``key -> fn(Tables) -> DataFrame`` with the binding's pinned
``as_of`` and the reference's default parameters. ``__spark_entry__`` wraps
these as ``(spark, sf_dir) -> DataFrame``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from castwork.functions.exprs import week_start
from castwork.operators import anomalies, bridges, catalog, cross, jobs, metering, ops, schedule, scrap, signals
from castwork.plans import result
from castwork.sources.binding import AS_OF
from castwork.sources.tables import TABLE_NAMES, Tables

Q = AS_OF


def decimals_to_double(df: DataFrame) -> DataFrame:
    return df.select([F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                      else F.col(f.name) for f in df.schema.fields])


def _src(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: decimals_to_double(getattr(t, name))


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
for _n in TABLE_NAMES:
    if _n != "scrap_reason":
        QUERIES[f"src_{_n}"] = _src(_n)

QUERIES.update({
    "scrap_by_reason": lambda t: scrap.scrap_by_reason(t, as_of=Q, days_back=90),
    "scrap_by_reason_part": lambda t: scrap.scrap_by_reason(t, as_of=Q, days_back=365, group_by_part=True),
    "scrap_trend": lambda t: scrap.scrap_trend(t, as_of=Q, weeks_back=16),
})


QUERIES.update({
    "job_window": bridges.job_window,
    "job_pattern": bridges.job_pattern,
    "job_heat": bridges.job_heat,
    "job_board_item": bridges.job_board_item,
    "wc_tag_resolved": bridges.wc_tag_resolved,
    "match_rate": bridges.match_rate,
    "match_pct": bridges.match_pct,
    "unmatched": bridges.unmatched,
    "unmatched_summary": bridges.unmatched_summary,
    "multi_mapped_patterns": bridges.multi_mapped_patterns,
    "ref_formats": bridges.ref_formats,
    "reconciliation_report": bridges.reconciliation_report,
    "match_rate_bounds": signals.match_rate_bounds,
    "unmatched_coverage": signals.unmatched_coverage,
    "job_heat_count": signals.job_heat_count,
})


QUERIES.update({
    "open_jobs": lambda t: jobs.open_jobs(t, as_of=Q),
    "open_jobs_machine_30d": lambda t: jobs.open_jobs(t, as_of=Q, dept="MACHINE", due_within_days=30),
    "job_header": lambda t: jobs.job_header(t, as_of=Q),
    "job_operations": jobs.job_operations,
    "job_scrap_by_reason": jobs.job_scrap_by_reason,
    "job_labor_by_shift": jobs.job_labor_by_shift,
    "job_cost": jobs.job_cost,
    "job_scrap_pct": jobs.job_scrap_pct,
    "unplanned_downtime": lambda t: jobs.unplanned_downtime(t, as_of=Q),
    "remaining_hours": lambda t: decimals_to_double(jobs.remaining_hours(t)),
    "bottleneck": lambda t: decimals_to_double(jobs.bottleneck(t)),
    "at_risk_jobs": lambda t: jobs.at_risk_jobs(t, as_of=Q, horizon_days=30),
    "at_risk_jobs_120d": lambda t: jobs.at_risk_jobs(t, as_of=Q, horizon_days=120),
    "at_risk_summary": lambda t: jobs.at_risk_summary(t, as_of=Q),
})


QUERIES.update({
    "labor_efficiency_employee": lambda t: ops.labor_efficiency(t, as_of=Q, group_by="employee", days_back=120),
    "labor_efficiency_shift": lambda t: ops.labor_efficiency(t, as_of=Q, group_by="shift", days_back=600),
    "labor_efficiency_work_center": lambda t: ops.labor_efficiency(t, as_of=Q, group_by="work_center", days_back=600),
    "labor_efficiency_part": lambda t: ops.labor_efficiency(t, as_of=Q, group_by="part", days_back=600),
    "standard_vs_crew": lambda t: ops.standard_vs_crew(t, as_of=Q),
    "standard_vs_crew_part_op": lambda t: ops.standard_vs_crew(t, as_of=Q, scope=("part_num", "oper_seq"), days_back=600),
    "work_center_load": lambda t: ops.work_center_load(t, as_of=Q, weeks_ahead=4),
    "job_cost_summary_part": lambda t: ops.job_cost_summary(t, as_of=Q, group_by="part"),
    "job_cost_summary_customer": lambda t: ops.job_cost_summary(t, as_of=Q, group_by="customer", days_back=600,
                                                                closed_only=False),
    "job_cost_summary_industry": lambda t: ops.job_cost_summary(t, as_of=Q, group_by="industry", days_back=600),
    "job_cost_summary_month": lambda t: ops.job_cost_summary(t, as_of=Q, group_by="month", days_back=600,
                                                             closed_only=False),
})


QUERIES.update({
    "scrap_spikes": lambda t: anomalies.scrap_spikes(t, as_of=Q),
    "downtime_spikes": lambda t: anomalies.downtime_spikes(t, as_of=Q),
    "efficiency_drift": lambda t: anomalies.efficiency_drift(t, as_of=Q),
    "wrong_standards": lambda t: anomalies.wrong_standards(t, as_of=Q),
    "reconciliation_gaps": anomalies.reconciliation_gaps,
    "findings": lambda t: anomalies.findings(t, as_of=Q),
    "top_reasons": lambda t: anomalies.top_reasons(t, as_of=Q),
    "scrap_series": lambda t: anomalies.scrap_series(t, as_of=Q),
    "dense_series": lambda t: anomalies.dense_series(t, as_of=Q),
    "load_overview": lambda t: anomalies.load_overview(t, as_of=Q),
    "load_share": lambda t: anomalies.load_share(t, as_of=Q),
    "due_soon": lambda t: anomalies.due_soon(t, as_of=Q),
    "kpi_counts": lambda t: anomalies.kpi_counts(t, as_of=Q),
})


QUERIES.update({
    "job_heats": cross.job_heats,
    "heat_summary": lambda t: cross.heat_summary(t, as_of=Q),
    "machine_signal": lambda t: cross.machine_signal(t),
    "machine_downtime": cross.machine_downtime,
    "customer_commitments": lambda t: cross.customer_commitments(t, as_of=Q),
    "row_counts": signals.row_counts,
    "reason_share_shift": lambda t: signals.reason_share_shift(t),
    "level_decay": lambda t: signals.level_decay(t),
    "tag_decay": lambda t: signals.tag_decay(t),
    "mechanism_corr": lambda t: signals.mechanism_corr(t),
    "linked_items": signals.linked_items,
    "cohort_delta": lambda t: signals.cohort_delta(t),
    "operator_prefix_count": lambda t: signals.operator_prefix_count(t, prefix="E-101"),
    "family_overrun": lambda t: signals.family_overrun(t),
    "overrun_operators": lambda t: signals.overrun_operators(t),
    "event_rate_ratio": lambda t: signals.event_rate_ratio(t),
    "open_jobs_at_wc": signals.open_jobs_at_wc,
    "reason_variants": lambda t: signals.reason_variants(t),
    "ratio_drift": lambda t: signals.ratio_drift(t),
})


QUERIES.update({
    "week_starts": lambda t: t.job_head.select(
        "job_num", "req_due_date", week_start(F.col("req_due_date")).alias("week_start")),
    "pending_ops": lambda t: schedule.pending_ops(t),
    "centre_capacity": lambda t: schedule.centre_capacity(t, as_of=Q),
    "schedule_segments": lambda t: schedule.segments(t, as_of=Q),
    "schedule_centres": lambda t: schedule.centre_rollup(t, as_of=Q),
    "schedule_totals": lambda t: schedule.schedule_totals(t, as_of=Q),
    "schedule_unscheduled": lambda t: schedule.unscheduled(t, as_of=Q),
    "schedule_day_usage": lambda t: schedule.day_usage(t, as_of=Q),
    "schedule_families": lambda t: schedule.families(t, as_of=Q),
})


QUERIES.update({
    "findings_fingerprint": lambda t: result.findings_fingerprint(anomalies.findings(t, as_of=Q)),
    "schedule_fingerprint": lambda t: result.schedule_fingerprint({
        "segment": schedule.segments(t, as_of=Q), "centre": schedule.centre_rollup(t, as_of=Q),
        "total": schedule.schedule_totals(t, as_of=Q), "unscheduled": schedule.unscheduled(t, as_of=Q)}),
    "catalog": catalog.catalog,
    "page_job_oper": lambda t: decimals_to_double(catalog.page(t, "job_oper", limit=50, offset=100)),
    "visitor_hash": lambda t: metering.visitors(t).select("event_id", "visitor"),
    "daily_admission": metering.daily_admission,
    "channel_admission": metering.channel_admission,
    "monthly_budget": metering.monthly_budget,
    "remaining_quota": metering.remaining_quota,
})

# Parameter paths: the same tools with their optional filters set.
QUERIES.update({
    "at_risk_jobs_machine_60d": lambda t: jobs.at_risk_jobs(t, as_of=Q, horizon_days=60, dept="MACHINE"),
    "scrap_by_reason_clean": lambda t: scrap.scrap_by_reason(t, as_of=Q, days_back=600, dept="CLEAN"),
    "scrap_by_reason_brand_part": lambda t: scrap.scrap_by_reason(t, as_of=Q, days_back=600, group_by_part=True,
                                                                  customer_code="Brand#4"),
    "scrap_trend_rc1_wc": lambda t: scrap.scrap_trend(t, as_of=Q, reason_code="RC1", weeks_back=78, wc_code="NATION_1"),
    "labor_efficiency_wc": lambda t: ops.labor_efficiency(t, as_of=Q, group_by="employee", days_back=600,
                                                          wc_code="NATION_3"),
    "labor_efficiency_mold_op30": lambda t: ops.labor_efficiency(t, as_of=Q, group_by="part", days_back=600,
                                                                 dept="MOLD", oper_seq=30),
    "work_center_load_melt_12w": lambda t: ops.work_center_load(t, as_of=Q, weeks_ahead=12, dept="MELT"),
    "customer_commitments_stuck": lambda t: cross.customer_commitments(t, as_of=Q, status="Stuck"),
    "job_cost_summary_brand": lambda t: ops.job_cost_summary(t, as_of=Q, group_by="part", days_back=600,
                                                             closed_only=False, customer_code="Brand#4"),
    "open_jobs_brand_machine": lambda t: jobs.open_jobs(t, as_of=Q, customer_code="Brand#4", dept="MACHINE"),
})
