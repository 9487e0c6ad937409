"""The streamed admission rule against the batch operator: replay in many batches, blocked requests included, a batch
that is run again, a query that is started again, and late requests."""
import dataclasses
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from castwork.operators import metering
from castwork.streaming.admission import admit_batch, chat_admission_stream

COLS = [*metering.DECISION]
CAPS = {"daily_cap": 3, "monthly_cap": 6000}


def _cut(bound, n):
    """The request events in n parts by time; equal instants may fall into two parts, by event_id."""
    ev = bound.request_event.toPandas().sort_values(["ts", "event_id"], kind="mergesort")
    at = [round(i * len(ev) / n) for i in range(n + 1)]
    return [bound.request_event.sparkSession.createDataFrame(ev.iloc[a:b], bound.request_event.schema) for a, b in zip(at, at[1:])]


def _land(parts, folder, first=0):
    for i, p in enumerate(parts, first):
        p.coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            path = os.path.join(folder, f)
            if f.endswith(".parquet") and os.path.getmtime(path) > 10**9 + 10**6:
                os.utime(path, (10**9 + i, 10**9 + i))


def _rows(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


def _start(spark, bound, root, **kw):
    src = os.path.join(root, "src")
    stream = spark.readStream.schema(bound.request_event.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (chat_admission_stream(stream, out=f"{root}/out", state=f"{root}/state", **kw)
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()


def test_replay_in_batches_equals_the_batch_operator(spark, bound):
    root = tempfile.mkdtemp(prefix="castwork-admission-")
    parts = _cut(bound, 6)
    _land(parts[:4], f"{root}/src")
    _start(spark, bound, root, **CAPS)
    _land(parts[4:], f"{root}/src", 4)
    _start(spark, bound, root, **CAPS)  # goes on from the stored counters
    got = spark.read.parquet(f"{root}/out")
    want = metering.chat_admission(bound, **CAPS)
    assert got.select("batch").distinct().count() == 6
    assert not got.where("late").count()
    assert _rows(got) == _rows(want)
    kinds = {(r.blocked, r.allowed) for r in want.collect()}
    assert kinds == {(False, True), (False, False), (True, False)}  # allowed, over the day's cap, over the budget
    assert sorted(os.listdir(f"{root}/state/daily")) == ["batch=4", "batch=5"]


def test_a_batch_run_again_counts_once(spark, bound):
    root = tempfile.mkdtemp(prefix="castwork-admission-")
    where = {"out": f"{root}/out", "state": f"{root}/state", **CAPS}
    a, b = _cut(bound, 2)
    for part, i in ((a, 0), (b, 1), (b, 1)):
        admit_batch(part, i, **where)
    assert _rows(spark.read.parquet(f"{root}/out")) == _rows(metering.chat_admission(bound, **CAPS))
    admit_batch(b.limit(0), 2, **where)  # an empty batch carries the counters over
    for kind in ("daily", "monthly"):
        one, two = (sorted(map(tuple, spark.read.parquet(f"{root}/state/{kind}/batch={i}").collect())) for i in (1, 2))
        assert one == two and one


def test_late_requests_are_refused(spark, bound):
    root = tempfile.mkdtemp(prefix="castwork-admission-")
    where = {"out": f"{root}/out", "state": f"{root}/state", "lateness_days": 1}
    schema = bound.request_event.schema
    kind = dict(channel="chat", x_forwarded_for="10.0.0.1", x_real_ip=None, input_tokens=1, output_tokens=1)

    def batch(*rows):
        full = [{"event_id": i, "ts": ts, **kind} for i, ts in rows]
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in full], schema)

    day = dt.datetime(2001, 7, 10, 12)
    admit_batch(batch((1, day), (2, day)), 0, **where)
    admit_batch(batch((3, day - dt.timedelta(days=2)), (4, day - dt.timedelta(days=1)), (5, day), (6, dt.datetime(2001, 7, 10))), 1, **where)
    got = {r.event_id: (r.n, r.allowed, r.late) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {1: (1, True, False), 2: (2, True, False), 3: (None, False, True), 4: (1, True, False),
                   6: (3, True, False), 5: (4, True, False)}
    months = spark.read.parquet(f"{root}/state/monthly/batch=1").collect()
    assert [tuple(r) for r in months] == [("2001-07", 10)]


def test_hot_visitor_in_batches(spark, bound):
    """A visitor with a third of all requests, most of them in one minute."""
    ev = bound.request_event.where("channel = 'chat'")
    hot = ev.withColumn("x_forwarded_for", F.when(F.col("event_id") % 3 == 0, "10.9.9.9").otherwise(F.col("x_forwarded_for")))
    hot = hot.withColumn("ts", F.when(F.col("x_forwarded_for") == "10.9.9.9", F.date_trunc("day", "ts")).otherwise(F.col("ts")).cast("timestamp_ntz"))
    t = dataclasses.replace(bound, request_event=hot)
    root = tempfile.mkdtemp(prefix="castwork-admission-")
    for i, part in enumerate(_cut(t, 3)):
        admit_batch(part, i, out=f"{root}/out", state=f"{root}/state", **CAPS)
    assert _rows(spark.read.parquet(f"{root}/out")) == _rows(metering.chat_admission(t, **CAPS))
