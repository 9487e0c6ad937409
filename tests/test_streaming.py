"""Streaming extensions replayed from Parquet with availableNow, compared
with the batch operators on the same rows."""
import os
import tempfile

from pyspark.sql import functions as F

from castwork.operators import metering
from castwork.streaming.jobs import daily_admission_stream, weekly_scrap_stream


def _replay(spark, df, name):
    root = tempfile.mkdtemp(prefix=f"castwork-stream-{name}-")
    src = os.path.join(root, "src")
    df.write.parquet(src)
    return root, spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)


def _run(stream_df, root, mode):
    q = (stream_df.writeStream.format("memory").queryName(os.path.basename(root).replace("-", "_"))
         .outputMode(mode).option("checkpointLocation", os.path.join(root, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q.name


def test_weekly_scrap_stream_equals_batch(spark, bound):
    scrap = bound.scrap_dtl.select("job_num", "oper_seq", "scrap_qty", "reason_code", "logged_at")
    root, stream = _replay(spark, scrap, "scrap")
    name = _run(weekly_scrap_stream(stream), root, "update")
    got = {(r["week"], r["reason_code"]): r["qty"] for r in spark.sql(f"SELECT * FROM {name}").collect()}
    batch = (bound.scrap_dtl.groupBy(F.date_trunc("week", "logged_at").cast("date").alias("week"), "reason_code")
             .agg(F.sum("scrap_qty").alias("qty")).collect())
    assert got == {(r["week"], r["reason_code"]): r["qty"] for r in batch}


def test_daily_admission_stream_equals_batch(spark, bound):
    ev = bound.request_event
    root, stream = _replay(spark, ev, "adm")
    name = _run(daily_admission_stream(stream, channel="mcp", cap=metering.MCP_DAILY_CAP), root, "append")
    got = {r["event_id"]: (r["n"], r["allowed"]) for r in spark.sql(f"SELECT * FROM {name}").collect()}
    batch = {r["event_id"]: (r["n"], r["allowed"]) for r in metering.channel_admission(bound).collect()}
    assert got == batch
