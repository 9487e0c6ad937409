from castwork.plans.registry import TOOLS, run_tool
from castwork.sources.binding import AS_OF


def test_unknown_tool_is_an_error_value(bound):
    r = run_tool(bound, "no_such_tool", {}, as_of=AS_OF)
    assert not r.ok and "Unknown tool" in r.error


def test_bad_input_is_an_error_value(bound):
    assert "between" in run_tool(bound, "at_risk_jobs", {"horizon_days": 500}, as_of=AS_OF).error
    assert "one of" in run_tool(bound, "get_open_jobs", {"dept": "PAINT"}, as_of=AS_OF).error
    assert "required" in run_tool(bound, "get_job_detail", {}, as_of=AS_OF).error
    assert run_tool(bound, "scrap_by_reason", {"foo": 1}, as_of=AS_OF).ok  # undeclared parameters are dropped


def test_every_tool_declares_sources():
    for t in TOOLS.values():
        assert t.sources and set(t.sources) <= {"erp", "melt", "historian", "board", "xref"}


def test_job_detail_accepts_any_spelling(bound):
    some = bound.job_head.orderBy("job_num").first()["job_num"]
    digits = some[2:]
    for spelling in (some, "J" + digits, digits, "Job " + digits, "  j-" + digits + " "):
        r = run_tool(bound, "get_job_detail", {"job_num": spelling}, as_of=AS_OF)
        assert r.ok and r.data["header"].count() == 1


def test_unknown_job_gives_empty(bound):
    r = run_tool(bound, "get_job_detail", {"job_num": "J-999999"}, as_of=AS_OF)
    assert r.ok and r.data["header"].count() == 0


def test_cap_rows_notes_truncation(bound):
    from castwork.plans.result import cap_rows
    notes = []
    rows = cap_rows(bound.job_head.select("job_num"), ["job_num"], notes, limit=5)
    total = bound.job_head.count()
    assert len(rows) == 5 and notes == [f"Showing the first 5 of {total} rows. Narrow the filters for the rest."]
    notes2 = []
    assert len(cap_rows(bound.work_center.select("wc_code"), ["wc_code"], notes2, limit=60)) == 25 and notes2 == []
