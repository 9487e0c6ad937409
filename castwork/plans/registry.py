"""Tool registry (R04, R05): look up an operator by name, validate its
parameters against a declared spec (types, allowed values, ranges,
defaults), and run it. Unknown names and bad input come back as error
results before any Spark job is started.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwork.operators import anomalies, bridges, cross, jobs, ops, scrap
from castwork.plans.result import Result, cap_rows, sort_keys
from castwork.sources.tables import Tables

DEPTS = ("MELT", "MOLD", "CORE", "CLEAN", "HEAT_TREAT", "MACHINE")


@dataclasses.dataclass(frozen=True)
class Param:
    type: type
    default: Any = None
    choices: tuple | None = None
    lo: int | None = None
    hi: int | None = None
    required: bool = False


@dataclasses.dataclass(frozen=True)
class Tool:
    name: str
    sources: tuple[str, ...]
    params: dict[str, Param]
    run: Callable[..., dict[str, DataFrame]]
    uses_as_of: bool = True


def _one(key: str, fn):
    return lambda t, **kw: {key: fn(t, **kw)}


def _job_detail(t: Tables, *, as_of: dt.date, job_num: str) -> dict[str, DataFrame]:
    f = lambda df: jobs.for_job(df, job_num)
    return {"header": f(jobs.job_header(t, as_of=as_of)), "operations": f(jobs.job_operations(t)),
            "scrap_by_reason": f(jobs.job_scrap_by_reason(t)), "labor_by_shift": f(jobs.job_labor_by_shift(t)),
            "cost": f(jobs.job_cost(t)), "scrap": f(jobs.job_scrap_pct(t))}


def _heat_history(t: Tables, *, as_of: dt.date, job_num: str) -> dict[str, DataFrame]:
    return {"summary": jobs.for_job(cross.heat_summary(t, as_of=as_of), job_num),
            "heats": jobs.for_job(cross.job_heats(t), job_num)}


def _machine(t: Tables, *, job_num: str, signal_role: str | None = None) -> dict[str, DataFrame]:
    """One job: its window (one row) is read first, so that the historian is
    scanned for that time only instead of from end to end."""
    window = jobs.for_job(bridges.job_window(t), job_num)
    span = window.first()
    if span is not None and span["started_at"] is not None and span["ended_at"] is not None:
        def within(df: DataFrame, col: str) -> DataFrame:
            kind = df.schema[col].dataType
            lo, hi = (F.lit(span[c].isoformat(" ")).cast(kind) for c in ("started_at", "ended_at"))
            return df.where(F.col(col).between(lo, hi))
        t = dataclasses.replace(t, tag_history=within(t.tag_history, "ts"), downtime_event=within(t.downtime_event, "started_at"))
    return {"window": window,
            "tags": jobs.for_job(cross.machine_signal(t, signal_role=signal_role), job_num),
            "downtime_events": jobs.for_job(cross.machine_downtime(t), job_num)}


def _commitments(t: Tables, *, as_of: dt.date, job_num: str | None = None, status: str | None = None,
                 customer: str | None = None) -> dict[str, DataFrame]:
    df = cross.customer_commitments(t, as_of=as_of, open_only=job_num is None, status=status, customer=customer)
    return {"items": jobs.for_job(df, job_num, col="resolved_job_num")}


def _recon(t: Tables, *, include_unmatched_detail: bool = True) -> dict[str, DataFrame]:
    out = {"match_rates": bridges.match_pct(t), "unmatched_summary": bridges.unmatched_summary(t)}
    if include_unmatched_detail:
        out["unmatched_detail"] = bridges.unmatched(t)
    return out


TOOLS: dict[str, Tool] = {t.name: t for t in [
    Tool("get_open_jobs", ("erp",), {
        "dept": Param(str, choices=DEPTS), "wc_code": Param(str), "part_num": Param(str),
        "customer_code": Param(str), "due_within_days": Param(int, lo=0, hi=180)}, _one("jobs", jobs.open_jobs)),
    Tool("get_job_detail", ("erp",), {"job_num": Param(str, required=True)}, _job_detail),
    Tool("at_risk_jobs", ("erp", "historian", "xref"), {
        "dept": Param(str, choices=DEPTS), "horizon_days": Param(int, 30, lo=1, hi=120)},
        lambda t, **kw: {"jobs": jobs.at_risk_jobs(t, **kw), "totals": jobs.at_risk_summary(t, **kw)}),
    Tool("scrap_by_reason", ("erp",), {
        "part_num": Param(str), "wc_code": Param(str), "dept": Param(str, choices=DEPTS), "customer_code": Param(str),
        "days_back": Param(int, 90, lo=1, hi=600), "group_by_part": Param(bool, False)},
        _one("by_reason", scrap.scrap_by_reason)),
    Tool("scrap_trend", ("erp",), {
        "reason_code": Param(str, required=True), "part_num": Param(str), "wc_code": Param(str),
        "weeks_back": Param(int, 16, lo=4, hi=78)}, _one("series", scrap.scrap_trend)),
    Tool("labor_efficiency", ("erp",), {
        "group_by": Param(str, choices=("employee", "shift", "work_center", "part"), required=True),
        "wc_code": Param(str), "dept": Param(str, choices=DEPTS), "part_num": Param(str), "oper_seq": Param(int),
        "days_back": Param(int, 120, lo=7, hi=600)}, _one("groups", ops.labor_efficiency)),
    Tool("work_center_load", ("erp", "historian", "xref"), {
        "dept": Param(str, choices=DEPTS), "weeks_ahead": Param(int, 4, lo=1, hi=12)},
        _one("rows", ops.work_center_load)),
    Tool("job_cost_summary", ("erp",), {
        "group_by": Param(str, "part", choices=("part", "customer", "industry", "month")), "part_num": Param(str),
        "customer_code": Param(str), "days_back": Param(int, 180, lo=7, hi=600), "closed_only": Param(bool, True)},
        _one("groups", ops.job_cost_summary)),
    Tool("heat_history_for_job", ("erp", "melt", "xref"), {"job_num": Param(str, required=True)}, _heat_history),
    Tool("machine_signal_for_job", ("erp", "historian", "xref"), {
        "job_num": Param(str, required=True),
        "signal_role": Param(str, choices=("DEGAS", "TEMP", "CYCLE", "COUNT", "STATE"))}, _machine, uses_as_of=False),
    Tool("customer_commitments_for_job", ("erp", "board", "xref"), {
        "job_num": Param(str), "status": Param(str), "customer": Param(str)}, _commitments),
    Tool("reconciliation_report", ("xref", "erp", "melt", "historian", "board"), {
        "include_unmatched_detail": Param(bool, True)}, _recon, uses_as_of=False),
    Tool("dashboard_findings", ("erp", "melt", "historian", "board", "xref"), {}, _one("findings", anomalies.findings)),
]}


# The order in which each frame of a result is read ("-x": descending).
ORDER: dict[str, dict[str, tuple[str, ...]]] = {
    "get_open_jobs": {"jobs": ("days_to_due", "job_num")},
    "get_job_detail": {"header": ("job_num",), "operations": ("oper_seq",), "scrap_by_reason": ("-qty", "reason_code"),
                       "labor_by_shift": ("shift",), "cost": ("job_num",), "scrap": ("job_num",)},
    "at_risk_jobs": {"jobs": ("verdict_rank", "days_to_due", "job_num"), "totals": ("assessed_jobs",)},
    "scrap_by_reason": {"by_reason": ("-scrap_qty", "reason_code")},
    "scrap_trend": {"series": ("week",)},
    "labor_efficiency": {"groups": ("-ratio",)},
    "work_center_load": {"rows": ("week", "wc_code")},
    "job_cost_summary": {"groups": ("-act_labor_usd",)},
    "heat_history_for_job": {"summary": ("pattern_code",), "heats": ("poured_at", "heat_num")},
    "machine_signal_for_job": {"window": ("job_num",), "tags": ("wc_code", "tag_path"), "downtime_events": ("started_at", "tag_path")},
    "customer_commitments_for_job": {"items": ("promised_date", "item_id")},
    "reconciliation_report": {"match_rates": ("match_pct",), "unmatched_summary": ("source_pair",),
                              "unmatched_detail": ("source_pair", "identifier")},
    "dashboard_findings": {"findings": ("position",)},
}


def validate(tool: Tool, raw: dict[str, Any]) -> dict[str, Any]:
    """Typed parameters with defaults; raises ValueError on bad input.
    Parameters the tool does not declare are dropped."""
    out: dict[str, Any] = {}
    for name, p in tool.params.items():
        v = raw.get(name, p.default)
        if v is None:
            if p.required:
                raise ValueError(f"{name} is required")
            if p.default is None:
                continue
        if p.type is int and (isinstance(v, bool) or not isinstance(v, int)):
            raise ValueError(f"{name} must be an integer")
        if p.type is bool and not isinstance(v, bool):
            raise ValueError(f"{name} must be true or false")
        if p.type is str and not isinstance(v, str):
            raise ValueError(f"{name} must be a string")
        if p.choices is not None and v not in p.choices:
            raise ValueError(f"{name} must be one of {', '.join(p.choices)}")
        if p.lo is not None and v < p.lo or p.hi is not None and v > p.hi:
            raise ValueError(f"{name} must be between {p.lo} and {p.hi}")
        out[name] = v
    return out


def run_tool(t: Tables, name: str, raw: dict[str, Any] | None = None, *, as_of: dt.date,
             with_notes: bool = False, with_rows: bool = False) -> Result:
    """Errors are values, those met while running too; the DataFrames in
    a good result are lazy and whole. ``with_rows`` adds what a reader sees:
    each frame's first rows in the tool's order, capped (R01). ``with_notes``
    adds the R07 caveats (small probes on the result)."""
    tool = TOOLS.get(name)
    if tool is None:
        return Result({}, (), [], error=f"Unknown tool: {name}")
    try:
        params = validate(tool, raw or {})
    except ValueError as e:
        return Result({}, tool.sources, [], error=f"Invalid input for {name}: {e}")
    if tool.uses_as_of:
        params["as_of"] = as_of
    res = Result({}, tool.sources, [])
    try:
        res.data = tool.run(t, **params)
        if with_rows:
            for key, df in res.data.items():
                res.rows[key] = cap_rows(df, sort_keys(df, ORDER[name][key]), res.notes)
        if with_notes:
            from castwork.plans.notes import add_notes
            add_notes(name, res, params)
    except Exception as e:  # a tool that fails is an answer to its caller
        return Result({}, tool.sources, [], error=f"{name} failed: {e}")
    return res
