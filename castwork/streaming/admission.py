"""Chat admission (M02 with the M04 budget) over a stream of requests.

The daily counter belongs to a visitor, the token budget to a whole month: a
state function keyed by month would take every request of the month in one
group. Here a micro-batch is decided by the same distributed prefix sums as
the batch operator, and what earlier batches counted enters as *carry rows*:
one for each (day, visitor) with its count and one for each month with its
tokens, placed at the start of their day or month. Nothing is joined to the
requests, so a hot visitor or month stays split over its minutes.

Each batch N writes, in folders named by N,

* ``out/batch=N``: the decisions;
* ``state/daily/batch=N`` and ``state/monthly/batch=N``: the counters after
  the batch - those of batch N-1 plus the batch's own, from the written
  decisions. Counters of days that lie more than ``lateness_days`` before the
  newest day seen are let go; months are kept (one row each).

A batch that is run again after a failure starts from the counters of batch
N-1 and overwrites its own folders, so every request counts once. Folders of
batch N-2 are removed when batch N has been written. ``out`` and ``state`` are
folders that the driver and all executors share; both belong to one
``checkpointLocation`` and start empty with it.

Requests are counted batch by batch, within a batch by (ts, event_id): where
they arrive in time order the decisions are those of ``chat_admission``. A
request of a day whose counters were let go is ``late``: it is refused and
counts nowhere.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from castwork.functions.exprs import lit_date, visitor_hash
from castwork.operators.metering import DAILY_CAP, DECISION, DEFAULT_SALT, MONTHLY_TOKEN_CAP, admit

DAILY_SCHEMA = "day date, visitor string, n bigint"
MONTHLY_SCHEMA = "month string, tokens bigint"
# Carry rows come before every request of the same instant.
FIRST = -(2**63)
# The visitor of a month's carry row: no hash is empty, and the prefix sums join on it.
NOBODY = ""


def _counters(spark: SparkSession, state: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Daily and monthly counters after a batch; empty before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], DAILY_SCHEMA), spark.createDataFrame([], MONTHLY_SCHEMA)
    return (spark.read.schema(DAILY_SCHEMA).parquet(f"{state}/daily/batch={batch_id}"),
            spark.read.schema(MONTHLY_SCHEMA).parquet(f"{state}/monthly/batch={batch_id}"))


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def decide(requests: DataFrame, daily: DataFrame, monthly: DataFrame, *, daily_cap: int, monthly_cap: int,
           horizon: dt.date | None) -> DataFrame:
    """Decisions on one batch of chat requests (event_id, ts, visitor,
    input_tokens, output_tokens), given the counters so far. Requests of days
    before ``horizon`` are late."""
    v = requests.withColumn("day", F.col("ts").cast("date")).withColumn("month", F.date_format("ts", "yyyy-MM"))
    late = F.lit(False) if horizon is None else F.col("day") < lit_date(horizon)
    live = v.where(~late).withColumns({"step": F.lit(1).cast("bigint"), "held": F.col("input_tokens") + F.col("output_tokens")})

    def carried(df: DataFrame, day: F.Column, month: F.Column, visitor: F.Column, step: F.Column, held: F.Column) -> DataFrame:
        made = {"event_id": F.lit(FIRST), "ts": day, "day": day, "month": month, "visitor": visitor,
                "input_tokens": F.lit(0), "output_tokens": F.lit(0), "step": step, "held": held}
        return df.select(*(made[c].cast(live.schema[c].dataType).alias(c) for c in live.columns))

    zero, day = F.lit(0), F.col("day")
    first = F.to_date(F.concat("month", F.lit("-01")))
    rows = (live.unionByName(carried(daily, day, F.date_format("day", "yyyy-MM"), F.col("visitor"), F.col("n"), zero))
            .unionByName(carried(monthly, first, F.col("month"), F.lit(NOBODY), zero, F.col("tokens"))))
    done = (admit(rows, daily_cap=daily_cap, monthly_cap=monthly_cap, step=F.col("step"), tokens=F.col("held"))
            .where(F.col("event_id") != FIRST).select(*DECISION, F.lit(False).alias("late")))
    if horizon is None:
        return done
    refused = v.where(late).select(
        *(F.col(c) for c in DECISION[:7]), F.lit(None).cast("bigint").alias("n"), F.lit(False).alias("blocked"),
        F.lit(False).alias("allowed"), F.lit(0).cast("bigint").alias("remaining"), F.lit(True).alias("late"))
    return done.unionByName(refused)


def admit_batch(batch: DataFrame, batch_id: int, *, out: str, state: str, channel: str = "chat", daily_cap: int = DAILY_CAP,
                monthly_cap: int = MONTHLY_TOKEN_CAP, salt: str = DEFAULT_SALT, lateness_days: int = 2) -> None:
    """Decide one micro-batch of request events and write its decisions and counters."""
    spark = batch.sparkSession
    daily, monthly = _counters(spark, state, batch_id - 1)
    newest = daily.agg(F.max("day")).first()[0]
    requests = batch.where(F.col("channel") == channel).select(
        "event_id", "ts", visitor_hash(F.col("x_forwarded_for"), F.col("x_real_ip"), salt).alias("visitor"),
        "input_tokens", "output_tokens")
    decided = decide(requests, daily, monthly, daily_cap=daily_cap, monthly_cap=monthly_cap,
                     horizon=None if newest is None else newest - dt.timedelta(days=lateness_days))
    here = f"{out}/batch={batch_id}"
    decided.write.mode("overwrite").parquet(here)
    # A blocked request leaves both counters as they are; the month stays over its budget.
    counted = spark.read.schema(decided.schema).parquet(here).where(~F.col("late") & ~F.col("blocked"))
    ends = [d for d in (newest, counted.agg(F.max("day")).first()[0]) if d is not None]
    days = (daily.unionByName(counted.groupBy("day", "visitor").agg(F.count(F.lit(1)).alias("n")))
            .groupBy("day", "visitor").agg(F.sum("n").alias("n")))
    if ends:
        days = days.where(F.col("day") >= lit_date(max(ends) - dt.timedelta(days=lateness_days)))
    spent = counted.where("allowed").groupBy("month").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("bigint").alias("tokens"))
    days.write.mode("overwrite").parquet(f"{state}/daily/batch={batch_id}")
    (monthly.unionByName(spent).groupBy("month").agg(F.sum("tokens").alias("tokens")).coalesce(1)
     .write.mode("overwrite").parquet(f"{state}/monthly/batch={batch_id}"))
    if batch_id > 1:
        for kind in ("daily", "monthly"):
            _remove(spark, f"{state}/{kind}/batch={batch_id - 2}")


def chat_admission_stream(events: DataFrame, *, out: str, state: str, **params) -> DataStreamWriter:
    """A writer that decides each micro-batch of request events; the caller
    sets ``checkpointLocation`` and the trigger and starts it. Bound a batch
    at the source (``maxFilesPerTrigger``)."""
    return events.writeStream.foreachBatch(lambda df, i: admit_batch(df, i, out=out, state=state, **params))
