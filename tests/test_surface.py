from castwork.plans.registry import run_tool
from castwork.plans.sql import register_sql
from castwork.sources.binding import AS_OF


def test_sql_surface(spark, bound):
    register_sql(spark, bound, prefix="cw_")
    got = spark.sql("SELECT cw_normalize_job_ref('  j-104829 ') AS a, cw_normalize_job_ref('TBD') AS b").first()
    assert (got["a"], got["b"]) == ("J-104829", None)
    n = spark.sql("SELECT count(*) AS n FROM cw_job_head WHERE NOT job_closed").first()["n"]
    assert n == bound.job_head.where("NOT job_closed").count()
    assert spark.sql("SELECT count(*) AS n FROM cw_unmatched").first()["n"] > 0


def test_notes(bound):
    r = run_tool(bound, "at_risk_jobs", {}, as_of=AS_OF, with_notes=True)
    assert any("order of due date" in n for n in r.notes)
    r = run_tool(bound, "get_job_detail", {"job_num": "J-999999"}, as_of=AS_OF, with_notes=True)
    assert r.notes == ["The ERP holds no job J-999999."]
    r = run_tool(bound, "customer_commitments_for_job", {}, as_of=AS_OF, with_notes=True)
    assert any("several ways" in n for n in r.notes)
    r = run_tool(bound, "reconciliation_report", {}, as_of=AS_OF, with_notes=True)
    assert any("Match rates below 100%" in n for n in r.notes)


def test_dashboard_pieces_are_bounded(bound):
    from castwork.plans.dashboard import build_dashboard
    d = build_dashboard(bound, as_of=AS_OF)
    assert len(d["findings"]) <= 8 and len(d["at_risk"]) <= 12 and len(d["counts"]) == 1
    assert len(d["reconciliation"]) == 4


def test_deep_pages_read_their_own_range(bound, spark, monkeypatch):
    """Pages through the rank index equal the top-k ones, for keyed, tied and empty relations, at every edge."""
    from castwork.operators import catalog

    for name in ("job_oper", "work_center", "match_rate", "column_value"):
        df = catalog.relations(bound)[name][2]
        keys = catalog.PAGE_KEYS.get(name) or df.columns
        rows = df.orderBy(*keys).collect()
        index = catalog.PageIndex(df, keys, ranges=5)
        assert index.total == len(rows)
        for offset in {0, 1, len(rows) // 2, max(0, len(rows) - 3), len(rows), len(rows) + 10}:
            assert index.page(offset, 7).collect() == rows[offset:offset + 7]
    monkeypatch.setattr(catalog, "TOP_ROWS", 10)
    deep = catalog.page(bound, "job_oper", limit=20, offset=300)
    assert deep.collect() == catalog.relations(bound)["job_oper"][2].orderBy("job_num", "oper_seq").offset(300).limit(20).collect()
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters")[1].splitlines()[0]
    assert catalog.PageIndex(spark.createDataFrame([], "a int"), ["a"]).page(0, 5).collect() == []


def test_a_wrong_schema_fails_at_loading(bound, spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from castwork.sources.tables import MODEL, TABLE_NAMES, Tables, checked

    assert set(MODEL) == set(TABLE_NAMES)
    for name, df in bound.items():
        assert checked(df.withColumn("more", F.lit(1)), name).columns == [c.split(":")[0] for c in MODEL[name].split()]
    with pytest.raises(ValueError, match="table heat: poured_at is string, degas_minutes is missing"):
        checked(bound.heat.drop("degas_minutes").withColumn("poured_at", F.lit("then")), "heat")
    t = bound.materialize(f"{tmp_path}/m")
    t.inspect_result.drop("pass_qty").write.mode("overwrite").parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="pass_qty is missing"):
        checked(spark.read.parquet(f"{tmp_path}/other"), "inspect_result")
    assert Tables.from_parquet(spark, f"{tmp_path}/m").inspect_result.count() == bound.inspect_result.count()
