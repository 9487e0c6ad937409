"""Plan checks: no cartesian products, nested-loop joins only against
1-row aggregates, Python only in the dispatcher, filters reach the scan."""
import os
import tempfile

import pytest

from castwork.plans.queries import QUERIES
from castwork.sources.binding import AS_OF

# Keys whose cross join is against a global (1-row) aggregate or a grid of
# bounded size (weeks x reasons), planned as a broadcast nested loop.
BNLJ_OK = {"scrap_by_reason", "scrap_by_reason_part", "scrap_by_reason_clean", "scrap_by_reason_brand_part",
           "scrap_trend", "scrap_trend_rc1_wc", "dense_series", "load_share", "kpi_counts",
           "schedule_totals", "reason_share_shift", "level_decay", "tag_decay", "event_rate_ratio",
           "open_jobs_at_wc", "ratio_drift"}
PY_OK = {k for k in QUERIES if k.startswith("schedule_")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if not k.startswith("schedule_")))
def test_plan_shape(bound, key):
    p = _plan(QUERIES[key](bound))
    assert "CartesianProduct" not in p
    if key not in BNLJ_OK:
        assert "BroadcastNestedLoopJoin" not in p, key
    if key not in PY_OK:
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas"):
            assert node not in p, (key, node)


def test_filters_and_columns_reach_parquet(bound, spark):
    root = tempfile.mkdtemp(prefix="castwork-plan-")
    t = bound.materialize(os.path.join(root, "m"))
    from castwork.operators import scrap
    p = _plan(scrap.scrap_by_reason(t, as_of=AS_OF))
    assert "PushedFilters: [IsNotNull(logged_at), GreaterThanOrEqual(logged_at" in p
    assert "ReadSchema: struct<job_num:string,oper_seq:int,scrap_qty:bigint,reason_code:string,logged_at:timestamp_ntz>" in p


def test_bucketed_model_joins_jobs_without_shuffle(bound, spark):
    from castwork.operators import jobs
    root = tempfile.mkdtemp(prefix="castwork-bkt-")
    t = bound.materialize(os.path.join(root, "m"), job_buckets=4, database="castwork_test_bkt")
    for df in (jobs.job_cost(t), jobs.job_labor_by_shift(t)):
        assert "Exchange hashpartitioning" not in _plan(df)
    # Same answer as the unbucketed model.
    assert sorted(map(str, jobs.job_cost(t).collect())) == sorted(map(str, jobs.job_cost(bound).collect()))
