import datetime as dt
import random

from pyspark.sql import functions as F

from castwork.operators.joins import prefix_join, range_join


def test_prefix_join_edges(spark):
    paths = spark.createDataFrame([("Line2/Temp",), ("Line20/Temp",), ("Line2",), ("NoSlash",), ("A_B/x",),
                                   ("AxB/x",), ("Line2/Sub/Deep",)], "tag_path string")
    bridge = spark.createDataFrame([("WC2", "Line2"), ("WCU", "A_B")], "wc_code string, tag_prefix string")
    got = sorted((r["tag_path"], r["wc_code"]) for r in prefix_join(paths, "tag_path", bridge).collect())
    # A prefix equal to the whole path does not match (needs a '/' after it);
    # Line20 is not under Line2; '_' is a literal, not a wildcard.
    assert got == [("A_B/x", "WCU"), ("Line2/Sub/Deep", "WC2"), ("Line2/Temp", "WC2")]
    anti = sorted(r["tag_path"] for r in prefix_join(paths, "tag_path", bridge, how="left_anti").collect())
    assert anti == ["AxB/x", "Line2", "Line20/Temp", "NoSlash"]


def test_prefix_join_plans_without_nested_loop(spark):
    paths = spark.range(100).select(F.concat(F.lit("Cell"), (F.col("id") % 7).cast("string"), F.lit("/v")).alias("tag_path"))
    bridge = spark.createDataFrame([("W1", "Cell1")], "wc_code string, tag_prefix string")
    plan = prefix_join(paths, "tag_path", bridge)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "BroadcastHashJoin" in plan


def test_range_join_inclusive_and_brute_force(spark):
    rnd = random.Random(7)
    base = dt.datetime(2001, 7, 1)
    wins = []
    for i in range(60):
        s = base + dt.timedelta(hours=rnd.randint(0, 500))
        wins.append((f"J{i}", f"P{rnd.randint(0, 3)}", s, s + dt.timedelta(hours=rnd.randint(0, 120))))
    evs = [(f"H{j}", f"P{rnd.randint(0, 3)}", base + dt.timedelta(hours=rnd.randint(0, 650))) for j in range(300)]
    # Exact boundary hits.
    evs.append(("HS", wins[0][1], wins[0][2]))
    evs.append(("HE", wins[0][1], wins[0][3]))
    w = spark.createDataFrame(wins, "job string, pattern_code string, lo timestamp_ntz, hi timestamp_ntz")
    e = spark.createDataFrame(evs, "heat string, pattern_code string, t timestamp_ntz")
    got = sorted((r["job"], r["heat"]) for r in range_join(w, e, key="pattern_code", lo="lo", hi="hi", t="t").collect())
    expect = sorted((a, h) for (a, p, lo, hi) in wins for (h, q, t) in evs if p == q and lo <= t <= hi)
    assert got == expect
    assert ("J0", "HS") in got and ("J0", "HE") in got
