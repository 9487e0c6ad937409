"""Hand-made edge rows per operator (FIXTURES.md section 3)."""
import datetime as dt
from decimal import Decimal as Dm

from castwork.operators import anomalies, bridges, jobs, metering, scrap

AS_OF = dt.date(2001, 8, 1)  # Wednesday
T = dt.datetime


def _part(p, **kw):
    return dict(dict(part_num=p, description=p, alloy="X", process="SAND", pattern_num="PN", cavities=1,
                     target_wt_lbs=Dm("2.00"), customer_code="C", industry="I"), **kw)


def _wc(w, shifts=1, res=1, dept="MOLD"):
    return dict(wc_code=w, description=w, dept=dept, shifts_per_day=shifts, hrs_per_shift=Dm("8.00"), resources=res)


def _job(j, p="P1", due=AS_OF, closed=False, created=T(2001, 7, 1), qty=10):
    return dict(job_num=j, part_num=p, qty_ordered=qty, qty_completed=0, req_due_date=due, job_closed=closed,
                created_at=created)


def _op(j, seq, w, setup="1.00", prod="2.00", act="0"):
    return dict(job_num=j, oper_seq=seq, wc_code=w, est_setup_hrs=Dm(setup), est_prod_hrs=Dm(prod),
                act_setup_hrs=Dm("0"), act_prod_hrs=Dm(act), qty_completed=0, scrap_qty=0)


def test_job_window_and_job_heat_edges(make_tables):
    t = make_tables(
        part=[_part("P1"), _part("P2")],
        part_pattern=[dict(part_num="P1", pattern_code="PT1")],  # P2 unmapped
        job_head=[_job("J-000001", created=T(2001, 7, 1)), _job("J-000002", created=T(2001, 7, 1)),
                  _job("J-000003", p="P2"), _job("J-000004", created=T(2001, 7, 20))],
        labor_dtl=[dict(employee_num="E1", job_num="J-000001", oper_seq=10, clock_in=T(2001, 7, 2, 8),
                        clock_out=T(2001, 7, 2, 16), labor_hrs=Dm("8.00"), shift=1),
                   dict(employee_num="E2", job_num="J-000001", oper_seq=20, clock_in=T(2001, 7, 3, 8),
                        clock_out=T(2001, 7, 4, 9), labor_hrs=Dm("8.00"), shift=2)],
        pour_record=[dict(heat_num="H1", pattern_code="PT1", molds_poured=1, poured_at=T(2001, 7, 2, 8)),   # at start
                     dict(heat_num="H2", pattern_code="PT1", molds_poured=1, poured_at=T(2001, 7, 4, 9)),   # at end
                     dict(heat_num="H2", pattern_code="PT1", molds_poured=2, poured_at=T(2001, 7, 4, 9)),   # same pour twice
                     dict(heat_num="H3", pattern_code="PT1", molds_poured=1, poured_at=T(2001, 7, 4, 9, 0, 1))],
    )
    w = {r["job_num"]: (r["started_at"], r["ended_at"]) for r in bridges.job_window(t).collect()}
    assert w["J-000001"] == (T(2001, 7, 2, 8), T(2001, 7, 4, 9))          # several labour rows
    assert w["J-000002"] == (T(2001, 7, 1), T(2001, 7, 15))               # no labour: created + 14 days
    got = sorted((r["job_num"], r["heat_num"]) for r in bridges.job_heat(t).collect())
    # Ends inclusive, duplicates collapse, J-000002 shares the pattern (window to 07-15: all
    # three heats), J-000003's part is unmapped, J-000004's window starts after the pours.
    assert got == [("J-000001", "H1"), ("J-000001", "H2"), ("J-000002", "H1"), ("J-000002", "H2"),
                   ("J-000002", "H3")]


def test_unmatched_branches_and_quote(make_tables):
    t = make_tables(
        part=[_part("P1"), _part("P2")],
        part_pattern=[dict(part_num="P1", pattern_code="PT1"), dict(part_num="P1", pattern_code="PT2")],
        pour_record=[dict(heat_num="H1", pattern_code="PT9", molds_poured=1, poured_at=T(2001, 7, 2))],
        job_head=[_job("J-104829")],
        board_item=[dict(item_id=i, board_name="B", item_name="I", status="Stuck", customer="C",
                         promised_date=None, created_at=T(2001, 7, 1)) for i in (1, 2, 3, 4, 5)],
        column_value=[dict(item_id=1, column_title="Job #", text_value="  j-104829 "),
                      dict(item_id=2, column_title="Job #", text_value=""),
                      dict(item_id=3, column_title="Job #", text_value="O'Brien"),
                      dict(item_id=4, column_title="Job #", text_value="J-999999"),
                      dict(item_id=5, column_title="Notes", text_value="x")],
        tag_history=[dict(tag_id=1, tag_path="Cell1/temp", ts=T(2001, 7, 2), value_float=1.0, quality=192),
                     dict(tag_id=2, tag_path="Cell9/temp", ts=T(2001, 7, 2), value_float=1.0, quality=192)],
        wc_tag=[dict(wc_code="W1", tag_prefix="Cell1", signal_role="TEMP")],
    )
    um = sorted((r["source_pair"], r["identifier"], r["reason"]) for r in bridges.unmatched(t).collect())
    assert um == sorted([
        (bridges.PAIR_PART_PATTERN, "P2", bridges.REASON_NO_PATTERN),
        (bridges.PAIR_PATTERN_PART, "PT9", bridges.REASON_NO_PART),
        (bridges.PAIR_BOARD_JOB, "2", bridges.REASON_BLANK),
        (bridges.PAIR_BOARD_JOB, "3", "Job # value 'O''Brien' could not be parsed"),
        (bridges.PAIR_BOARD_JOB, "4", "Job # parsed to J-999999 but no such job exists in the ERP"),
        (bridges.PAIR_TAG_WC, "Cell9/temp", bridges.REASON_NO_TAG)])
    mr = {r["source_pair"]: (r["matched"], r["total"]) for r in bridges.match_rate(t).collect()}
    assert mr[bridges.PAIR_PART_PATTERN] == (2, 3)   # P1 has two patterns: counted twice
    assert mr[bridges.PAIR_BOARD_JOB] == (1, 4)
    assert mr[bridges.PAIR_TAG_WC] == (1, 2)


def test_unplanned_downtime_edges(make_tables):
    cut = T(2001, 7, 11)  # as_of - 21 days
    ev = [(1, cut, T(2001, 7, 11, 2), "spindle fault"),            # exactly 21 days old: in
          (2, T(2001, 7, 20), None, "spindle fault"),              # still open: out
          (3, T(2001, 7, 20), T(2001, 7, 20, 5), None),            # NULL reason: out
          (4, T(2001, 7, 20), T(2001, 7, 20, 5), "PM - scheduled"),
          (5, T(2001, 7, 20), T(2001, 7, 20, 5), "equipment fault"),  # substring 'pm' -> planned
          (6, T(2001, 7, 10, 23), T(2001, 7, 11, 5), "sand jam"),  # before the window
          (7, T(2001, 7, 25), T(2001, 7, 25, 3, 30), "Coolant pump failure")]
    t = make_tables(downtime_event=[dict(event_id=i, tag_path="Cell1/err", started_at=s, ended_at=e, reason_text=r)
                                    for i, s, e, r in ev],
                    wc_tag=[dict(wc_code="W1", tag_prefix="Cell1", signal_role="STATE")])
    assert [(r["wc_code"], r["down_hrs"]) for r in jobs.unplanned_downtime(t, as_of=AS_OF).collect()] == [("W1", 5.5)]


def test_at_risk_edges(make_tables):
    t = make_tables(
        part=[_part("P1")],
        work_center=[_wc("WA"), _wc("WB"), _wc("WC", shifts=1, res=1)],
        wc_tag=[dict(wc_code="WC", tag_prefix="CellC", signal_role="STATE")],
        downtime_event=[dict(event_id=1, tag_path="CellC/e", started_at=T(2001, 7, 20), ended_at=T(2001, 7, 25),
                             reason_text="fault")],   # 120 h > 60 % of 8 x 15
        job_head=[_job("J-000001", due=dt.date(2001, 7, 25)),              # past due
                  _job("J-000002", due=dt.date(2001, 8, 4)),               # Saturday
                  _job("J-000003", due=dt.date(2001, 8, 4)),               # tied due date
                  _job("J-000004", due=dt.date(2001, 8, 10))],
        job_oper=[_op("J-000001", 10, "WA"), _op("J-000002", 10, "WB", "1.00", "4.00"),
                  _op("J-000002", 20, "WA", "1.00", "4.00"),                # tie 5 h at WA and WB -> WA
                  _op("J-000003", 10, "WA", "1.00", "10.00"), _op("J-000004", 10, "WC", "1.00", "1.00")])
    r = {x["job_num"]: x for x in jobs.at_risk_jobs(t, as_of=AS_OF).collect()}
    assert r["J-000001"]["verdict"] == "LATE" and r["J-000001"]["days_to_due"] == -7
    assert r["J-000002"]["bottleneck_wc"] == "WA" and r["J-000002"]["remaining_est_hrs"] == 10.0
    # Queue at WA in (due, job) order: J-000001 (3 h), J-000002 (5 h), J-000003 (11 h).
    assert r["J-000002"]["hrs_queued_ahead"] == 3.0 and r["J-000003"]["hrs_queued_ahead"] == 8.0
    # Wed..Fri before a Saturday due date: 3 working days x 8 h = 24 h; 19 h queued -> on track.
    assert r["J-000003"]["capacity_before_due"] == 24.0 and r["J-000003"]["verdict"] == "ON_TRACK"
    assert r["J-000004"]["capacity_loss_pct"] == 60.0   # capped
    assert r["J-000004"]["capacity_before_due"] == round(8 * 8 * 0.4, 1)


def test_scrap_by_reason_edges(make_tables):
    t = make_tables(
        part=[_part("P1")], work_center=[_wc("W1")],
        scrap_reason=[dict(reason_code="R1", description="d", category="MELT")],
        job_head=[_job("J-000001", qty=100)], job_oper=[_op("J-000001", 10, "W1")],
        scrap_dtl=[dict(job_num="J-000001", oper_seq=10, scrap_qty=3, reason_code="R1", logged_at=T(2001, 7, 30)),
                   dict(job_num="J-000001", oper_seq=10, scrap_qty=2, reason_code="R1", logged_at=T(2001, 8, 1)),
                   dict(job_num="J-000001", oper_seq=10, scrap_qty=7, reason_code="R1", logged_at=T(2001, 8, 1, 0, 0, 1)),
                   dict(job_num="J-000001", oper_seq=99, scrap_qty=5, reason_code="R1", logged_at=T(2001, 7, 30))])
    rows = scrap.scrap_by_reason(t, as_of=AS_OF).collect()
    # After midnight of as_of is out; no operation 99 -> dropped; ordered qty counted once.
    assert [(x["scrap_qty"], x["qty_ordered_in_scope"], x["overall_scrap_rate_pct"]) for x in rows] == [(5, 100, 5.0)]


def test_scrap_trend_thirds(make_tables):
    weeks = [dt.datetime(2001, 7, 2) + dt.timedelta(weeks=i) for i in range(4)]
    qty = [4, 0, 5, 5]   # reason R1 per week; another reason keeps week 2 present
    sd = [dict(job_num="J-000001", oper_seq=10, scrap_qty=q, reason_code="R1", logged_at=w) for w, q in zip(weeks, qty) if q]
    sd.append(dict(job_num="J-000001", oper_seq=10, scrap_qty=1, reason_code="R2", logged_at=weeks[1]))
    t = make_tables(job_head=[_job("J-000001")], job_oper=[_op("J-000001", 10, "W1")], scrap_dtl=sd)
    r = [x for x in scrap.scrap_trend(t, as_of=AS_OF, weeks_back=8).collect() if x["reason_code"] == "R1"]
    assert len(r) == 4 and {x["weeks"] for x in r} == {4}
    one = r[0]  # third = 1: first week 4 vs last week 5 -> exactly 1.25x is FLAT
    assert (one["baseline_weekly_avg"], one["recent_weekly_avg"], one["change_pct"], one["direction"]) == (4.0, 5.0, 25.0, "FLAT")


def test_scrap_spike_z_above_two_is_watch(make_tables):
    # Eight baseline weeks alternating 10/12 (mean 11, sd ~1.069), recent mean 14 gives z = 2.8: flagged, below the warning level.
    base = [dt.datetime(2001, 5, 7) + dt.timedelta(weeks=i) for i in range(8)]
    rec = [dt.datetime(2001, 7, 9) + dt.timedelta(weeks=i) for i in range(3)]
    sd = [dict(job_num="J-000001", oper_seq=10, scrap_qty=10 + 2 * (i % 2), reason_code="R1", logged_at=w)
          for i, w in enumerate(base)]
    sd += [dict(job_num="J-000001", oper_seq=10, scrap_qty=14, reason_code="R1", logged_at=w) for w in rec]
    t = make_tables(scrap_dtl=sd, scrap_reason=[dict(reason_code="R1", description="d", category="MELT")])
    r = anomalies.scrap_spikes(t, as_of=AS_OF).collect()[0]
    assert r["base_weeks"] == 8 and r["flagged"] and r["z"] == 2.8 and r["severity"] == "watch"


def test_admission_cap_and_budget(make_tables):
    ev = [dict(event_id=i, ts=T(2001, 7, 30, 9, 0, i), x_forwarded_for="10.0.0.1", x_real_ip=None, channel="chat",
               input_tokens=1000, output_tokens=0) for i in range(1, 23)]
    t = make_tables(request_event=ev)
    a = {r["event_id"]: r for r in metering.daily_admission(t).collect()}
    assert a[20]["allowed"] and a[20]["remaining"] == 0 and not a[21]["allowed"] and a[21]["n"] == 21
    # Budget met exactly: with a 3,000-token cap the 4th request sees 3,000 used and is blocked.
    b = {r["event_id"]: r for r in metering.daily_admission(t, monthly_cap=3000).collect()}
    assert b[3]["allowed"] and b[4]["blocked"] and not b[4]["allowed"] and b[4]["n"] is None
    m = metering.monthly_budget(t, monthly_cap=3000).collect()[0]
    assert (m["queries"], m["input_tokens"], m["blocked"]) == (3, 3000, 19)
