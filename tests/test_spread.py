"""Parts that grow in number and not in size: sizes by Catalyst, spread rows, scrap's few reasons, heats met once."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from castwork.functions.exprs import small
from castwork.operators import bridges, cross, jobs, schedule, windows
from castwork.sources import binding


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sizes_of_files_are_known(bound):
    assert 0 < windows.input_bytes(bound.tag_history) < 1 << 30
    assert "BroadcastHashJoin" in plan(bound.job_oper.join(small(bound.wc_tag.hint("merge")), "wc_code"))


def test_spread_states_its_parts(bound, monkeypatch):
    assert windows.spread(bound.scrap_dtl, "job_num") is bound.scrap_dtl
    monkeypatch.setattr(windows, "SPREAD_FROM", 0)
    monkeypatch.setattr(windows, "TASK_BYTES", windows.input_bytes(bound.scrap_dtl) // 23)
    out = windows.spread(bound.scrap_dtl, "job_num")
    assert out.rdd.getNumPartitions() == 23
    assert sorted(out.collect(), key=str) == sorted(bound.scrap_dtl.collect(), key=str)


def test_scrap_is_not_shuffled_by_its_few_reasons(bound):
    assert "hashpartitioning(reason_code" not in plan(jobs.job_scrap_by_reason(bound))


def test_heats_of_jobs_equal_the_distinct_pairs(bound):
    heats = bound.heat.select("heat_num", "furnace_id", "poured_at")
    plain = bridges.job_heat(bound).select("job_num", "heat_num").distinct().join(heats, "heat_num")
    got = bridges.heats_of_jobs(bound, heats)
    assert got.columns == ["job_num", "heat_num", "furnace_id", "poured_at"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select(*got.columns).collect()))
    # Pairs of jobs with one window are made once, without a distinct over all of them.
    aggregated = plan(cross.job_heats(bound)).count("keys=[job_num#")
    assert aggregated and bridges._pattern_windows(bound).groupBy("job_num").count().where("count > 1").count() > 0


def test_windows_beyond_the_historian_are_left_out_before_operations(bound):
    times = bound.tag_history.select("ts")
    first, last = times.agg(F.min("ts"), F.max("ts")).first()
    kept = cross._job_tags(bound, times)
    every = bound.job_oper.join(bound.wc_tag, "wc_code").join(bridges.job_window(bound), "job_num")
    meet = every.where((F.col("ended_at") >= F.lit(first)) & (F.col("started_at") <= F.lit(last)))
    assert kept.count() == meet.count() < every.count()
    assert cross._job_tags(bound, times.where(F.col("ts") < F.lit(dt.datetime(1900, 1, 1)))).count() == 0


@pytest.fixture
def spread_model(spark, tmp_path, monkeypatch):
    """The model over hand-made rows, as if they were large: nothing is broadcast, and 23 parts are stated (a session's 8
    otherwise). All lines but a few are of one supplier; keys repeat or are null."""
    at, open_day = dt.datetime(2001, 7, 1), dt.datetime(2001, 7, 20)
    rows = {
        "nation": ([(i, f"NATION_{i}", i % 5) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(1, "a", 0), (2, "b", 1), (2, "b again", 2), (None, "c", 0)], "s_suppkey bigint, s_name string, s_nationkey int"),
        "part": ([(i, f"part {i}", "Brand#1", f"type {i % 2}", 5) for i in range(1, 9)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"),
        "orders": ([(k, k % 7, "O", open_day + dt.timedelta(days=k % 5), "1-URGENT") for k in range(1, 60)] + [(3, 3, "O", at, "1-URGENT"), (None, 1, "O", at, "2-HIGH")],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(k, 1 + k % 8, 2 if k % 20 == 0 else 1, n, float(3 + k % 9), 0.05, "N", "O") for k in range(1, 62) for n in (1, 2, 3)]
                     + [(5, 5, 1, 2, 7.0, 0.1, "R", "F"), (None, 1, 1, 1, 2.0, 0.0, "N", "O"), (9, 1, None, 4, 2.0, 0.0, "N", "O")],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"),
        "events": ([(i, open_day, i % 4, "error", 1.5) for i in range(20)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = binding.bind(spark, str(tmp_path))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in kept:
        spark.conf.set(k, "-1")
    monkeypatch.setattr(windows, "SPREAD_FROM", 0)
    monkeypatch.setattr(windows, "input_bytes", lambda df: 23 * windows.TASK_BYTES)
    yield plain, binding.bind(spark, f"{tmp_path}/")
    for k, v in kept.items():
        spark.conf.set(k, v)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_lines_meet_suppliers_and_orders_in_stated_parts(spread_model):
    """What one task holds does not follow from the session's number of parts, nor from a hot supplier."""
    plain, spread = spread_model
    for table in ("job_head", "job_oper"):
        df = getattr(spread, table)
        dealt = re.findall(r"hashpartitioning\((l_\w+?|deal|o_\w+?|s_\w+?)#[^)]*?, (\d+)\)", plan(df))
        assert dealt and all(n == "23" for k, n in dealt), dealt
        assert _rows(df) == _rows(getattr(plain, table)) != []
    assert re.search(r"hashpartitioning\(l_suppkey#\w+, deal#\w+, 23\)", plan(spread.job_oper))


def test_schedule_over_spread_lines_is_the_same(spread_model):
    plain, spread = spread_model
    assert _rows(schedule.day_usage(spread, as_of=binding.AS_OF)) == _rows(schedule.day_usage(plain, as_of=binding.AS_OF)) != []
