"""What a tool's caller sees: ordered and capped rows, totals, errors as values,
the reading of crew ratios, and scans narrowed to one job's window."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from castwork.operators import bridges, catalog, cross
from castwork.plans import registry
from castwork.plans.notes import _crew_or_standard
from castwork.plans.registry import ORDER, TOOLS, Tool, run_tool
from castwork.plans.result import MAX_ROWS
from castwork.sources.binding import AS_OF

WIDE = [("get_open_jobs", {}), ("scrap_by_reason", {"days_back": 540}), ("at_risk_jobs", {"horizon_days": 120}),
        ("work_center_load", {"weeks_ahead": 12}), ("job_cost_summary", {"group_by": "part", "days_back": 540}),
        ("labor_efficiency", {"group_by": "employee", "days_back": 600}), ("reconciliation_report", {})]


def test_every_tool_has_an_order():
    assert set(ORDER) == set(TOOLS)


@pytest.mark.parametrize("name,params", WIDE)
def test_rows_are_ordered_and_capped(bound, name, params):
    r = run_tool(bound, name, params, as_of=AS_OF, with_rows=True)
    assert r.ok, r.error
    for key, df in r.data.items():
        rows, total = r.rows[key], df.count()
        assert len(rows) == min(total, MAX_ROWS)
        if total > MAX_ROWS:
            assert any(f"of {total} rows" in n for n in r.notes)
        lead = ORDER[name][key][0]
        got = [x[lead.removeprefix("-")] for x in rows]
        have = [x for x in got if x is not None]
        assert have == sorted(have, reverse=lead.startswith("-"))
        assert got[:len(have)] == have  # nulls last


def test_at_risk_totals_cover_all_jobs(bound):
    r = run_tool(bound, "at_risk_jobs", {"horizon_days": 120}, as_of=AS_OF, with_rows=True)
    all_jobs = r.data["jobs"].collect()
    assert r.rows["totals"][0]["assessed_jobs"] == len(all_jobs)
    assert r.rows["totals"][0]["at_risk_or_late"] == sum(x["verdict"] != "ON_TRACK" for x in all_jobs)


def test_a_failure_while_running_is_a_value(bound, monkeypatch):
    late = Tool("late", ("erp",), {}, lambda t, as_of: {"x": t.job_head.select(F.raise_error(F.lit("broken")).alias("y"))})
    early = Tool("early", ("erp",), {}, lambda t, as_of: {"x": t.job_head.select("no_such_column")})
    for tool in (late, early):
        monkeypatch.setitem(registry.TOOLS, tool.name, tool)
        monkeypatch.setitem(registry.ORDER, tool.name, {"x": ("y",)})
        r = run_tool(bound, tool.name, {}, as_of=AS_OF, with_rows=True)
        assert not r.ok and r.error.startswith(f"{tool.name} failed") and r.data == {}


@pytest.mark.parametrize("ratios,words", [
    ([1.2, 1.3, 1.25], "standard being wrong rather than at any individual"),
    ([1.0, 1.1, 1.4], "training or staffing"), ([1.0, 1.1, None], "close to the standard"),
    ([1.2, 1.3], None), ([], "No group")])
def test_crew_or_standard(spark, ratios, words):
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(ratios)], "employee string, ratio double")
    notes = _crew_or_standard(df, "employee")
    assert (notes == []) if words is None else (len(notes) == 1 and words in notes[0])
    if len(ratios) > 2:
        assert _crew_or_standard(df, "shift") == []


def test_one_jobs_window_reaches_the_scan(bound, spark):
    t = bound.materialize(os.path.join(tempfile.mkdtemp(prefix="castwork-tool-"), "m"))
    whole = cross.machine_signal(t)
    job = whole.orderBy("job_num").first()["job_num"]
    r = run_tool(t, "machine_signal_for_job", {"job_num": job}, as_of=AS_OF, with_rows=True)
    assert r.ok, r.error
    assert len(r.rows["window"]) == 1
    plan = r.data["tags"]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan
    assert sorted(map(str, r.data["tags"].collect())) == sorted(map(str, whole.where(F.col("job_num") == job).collect()))
    down = cross.machine_downtime(t).where(F.col("job_num") == job)
    assert sorted(map(str, r.data["downtime_events"].collect())) == sorted(map(str, down.collect()))


def test_only_owned_prefixes_are_shuffled(bound):
    owned = {r["tag_prefix"] for r in bound.wc_tag.select("tag_prefix").collect()}
    got = {r["tag_prefix"] for r in cross._bridged(bound.tag_history, bound).select("tag_prefix").distinct().collect()}
    assert got and got <= owned


def test_catalog_counts_are_the_views_counts(bound):
    for name, count in catalog.COUNTS.items():
        assert count(bound).first()["rows"] == catalog.VIEWS[name](bound).count()


def test_jobs_with_heat_are_those_of_the_pairs(bound):
    pairs = bridges.job_heat(bound)
    assert pairs.count() == pairs.distinct().count()
    assert sorted(map(str, bridges._jobs_with_heat(bound).collect())) == sorted(map(str, pairs.select("job_num").distinct().collect()))
