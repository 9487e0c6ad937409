"""Structured Streaming forms of two batch operators (extensions E1, E3).

E1 ``weekly_scrap_stream``: scrap records arriving over time, summed per
(Monday-aligned week, reason) with a watermark, so late records inside the
watermark still land in their week and closed weeks are final. Once every
week is closed it equals the batch weekly scrap.

E3 ``daily_admission_stream``: the per-(day, visitor) request counter with
its state kept by Spark between micro-batches (``applyInPandasWithState``);
a day's state is dropped when the event-time watermark passes the end of the
day. Within a micro-batch requests are counted in (ts, event_id) order.

Event-time windows and watermarks work on instants, so the naive model
timestamps are read as UTC: run these in a UTC session (as
``castwork.session.REQUIRED_CONF`` sets) or the Monday alignment shifts.

Both read any streaming DataFrame with the model's columns (in tests: a
Parquet folder replayed with ``trigger(availableNow=True)``) and write to a
checkpointed sink chosen by the caller.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from castwork.functions.exprs import visitor_hash
from castwork.operators.metering import DAILY_CAP, DEFAULT_SALT

# 1970-01-01 was a Thursday; windows offset by four days start on Mondays.
MONDAY_OFFSET = "4 days"


def weekly_scrap_stream(scrap: DataFrame, *, watermark: str = "14 days") -> DataFrame:
    """(week, reason_code, qty) per Monday-aligned week."""
    w = F.window(F.col("logged_at").cast("timestamp"), "7 days", "7 days", MONDAY_OFFSET)
    return (scrap.withColumn("logged_at", F.col("logged_at").cast("timestamp"))
            .withWatermark("logged_at", watermark)
            .groupBy(w.alias("w"), "reason_code")
            .agg(F.sum("scrap_qty").cast("bigint").alias("qty"))
            .select(F.to_date(F.col("w.start")).alias("week"), "reason_code", "qty"))


ADMISSION_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("day", T.DateType()),
    T.StructField("visitor", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("allowed", T.BooleanType()),
    T.StructField("remaining", T.LongType()),
])


def _counter(cap: int):
    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, visitor = key
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="mergesort")
        n = seen + pd.Series(range(1, len(pdf) + 1), index=pdf.index, dtype="int64")
        state.update((int(n.iloc[-1]) if len(pdf) else seen,))
        end_of_day = dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1)
        state.setTimeoutTimestamp(int(end_of_day.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
        yield pd.DataFrame({"event_id": pdf["event_id"].astype("int64"), "day": day, "visitor": visitor,
                            "n": n.astype("int64"), "allowed": n <= cap,
                            "remaining": (cap - n).clip(lower=0).astype("int64")})
    return fn


def daily_admission_stream(events: DataFrame, *, channel: str = "chat", cap: int = DAILY_CAP,
                           salt: str = DEFAULT_SALT, watermark: str = "1 hour") -> DataFrame:
    """Per request, its position in the (day, visitor) counter and the
    admission decision of a channel without a token budget (``streaming.admission`` has both)."""
    v = (events.where(F.col("channel") == channel)
         .withColumn("ts", F.col("ts").cast("timestamp"))
         .withColumn("visitor", visitor_hash(F.col("x_forwarded_for"), F.col("x_real_ip"), salt))
         .withColumn("day", F.to_date("ts"))
         .withWatermark("ts", watermark)
         .select("event_id", "ts", "day", "visitor"))
    return v.groupBy("day", "visitor").applyInPandasWithState(
        _counter(cap), ADMISSION_SCHEMA, "count long", "append", GroupStateTimeout.EventTimeTimeout)
