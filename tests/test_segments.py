import datetime as dt
import random

from pyspark.sql import functions as F

from castwork.operators import segments

BASE = dt.datetime(2001, 7, 1)


def test_windows_equal_the_samples_they_hold(spark):
    """Ends inside a second, on a second, at midnight, one instant, the wrong way round, years long."""
    rng = random.Random(5)
    instants = [BASE + dt.timedelta(microseconds=rng.choice([0, 1, 999_999, 500_000]), seconds=rng.randrange(0, 5_000_000)) for _ in range(400)]
    instants += [BASE + dt.timedelta(seconds=i / 4) for i in range(40)]
    samples = [(rng.choice("pq"), t, None if i % 7 == 0 else rng.randrange(100) / 4) for i, t in enumerate(instants)]
    ends = [(t, t + dt.timedelta(microseconds=rng.choice([0, 1, 10**6, 4_321_000_001, 86_400_000_000 * 9]))) for t in rng.sample(instants, 60)]
    ends += [(BASE, BASE + dt.timedelta(days=d)) for d in (1, 8, 64, 900)] + [(BASE + dt.timedelta(seconds=1), BASE), (None, BASE), (BASE, None)]
    ends += [(BASE + dt.timedelta(seconds=0.25), BASE + dt.timedelta(seconds=0.75)), (BASE + dt.timedelta(seconds=0.25), BASE + dt.timedelta(seconds=1.25))]
    windows = [(i, "pq"[i % 2], a, b) for i, (a, b) in enumerate(ends)]
    s = spark.createDataFrame(samples, "k string, t timestamp_ntz, v double")
    w = spark.createDataFrame(windows, "id int, k string, lo timestamp_ntz, hi timestamp_ntz")
    met = segments.within(w, segments.rolled_up(s, "t", ["k"], "v"), "k", "lo", "hi")
    got = {r["id"]: tuple(r)[1:] for r in met.groupBy("id").agg(F.sum("n"), F.sum("n_values"), F.sum("total"), F.min("least"), F.max("most")).collect()}
    for i, k, a, b in windows:
        inside = [v for kk, t, v in samples if kk == k and a is not None and b is not None and a <= t <= b]
        values = [v for v in inside if v is not None]
        want = (len(inside), len(values), sum(values) if values else None, min(values, default=None), max(values, default=None))
        assert got.get(i, (0, 0, None, None, None)) == want, (i, a, b)


def test_a_cover_grows_with_the_logarithm(spark):
    w = spark.createDataFrame([(d, BASE + dt.timedelta(seconds=1, microseconds=5), BASE + dt.timedelta(days=d)) for d in (2, 20, 200, 2000)],
                              "d int, lo timestamp_ntz, hi timestamp_ntz")
    sizes = {r["d"]: r["count"] for r in segments.covered(w, "lo", "hi").groupBy("d").count().collect()}
    assert max(sizes.values()) <= 100
    midnight = spark.createDataFrame([(BASE, BASE + dt.timedelta(days=30))], "lo timestamp_ntz, hi timestamp_ntz")
    assert segments.covered(midnight, "lo", "hi").count() <= 20  # days and longer, and the one last instant


def test_no_join_of_machine_signal_sees_raw_samples(bound):
    from castwork.operators import cross

    ranged = cross.machine_signal(bound, day_bytes=0)
    assert sorted(ranged.collect()) == sorted(cross.machine_signal(bound).collect())
    plan = ranged._jdf.queryExecution().optimizedPlan()

    def leaves_under_joins(p, joined):
        """Names of the scans that some join reads without an aggregate in between."""
        name = p.nodeName()
        if name == "Aggregate":
            joined = False
        if p.children().size() == 0:
            return [p.toString()] if joined else []
        inner = name == "Join" and "LeftSemi" not in p.toString().splitlines()[0]
        return [x for i in range(p.children().size()) for x in leaves_under_joins(p.children().apply(i), joined or inner)]

    assert not [x for x in leaves_under_joins(plan, False) if "event_type" in x or "value_float" in x]
