"""Usage metering (M01-M05) over an append-only request-event table.

The reference keeps upserted counters; here every request is an event and
the counters are window aggregates, so the same answers come out of a
replay at any scale. Running counts use the bucketed prefix sums of
``windows`` (minute buckets), so a hot visitor or a busy month never lands
in a single sort.

Semantics. Chat requests: the monthly token budget is checked first - once
the tokens of earlier completed requests in the month reach the cap, the
request is blocked and does not touch the daily counter. Otherwise the
daily counter of (day, visitor) is incremented and the request is allowed
while the count is within the daily cap; an allowed request completes and
records its tokens. A denied request still counts. MCP requests have their
own counter (key prefix ``mcp:``) with a larger cap and no token budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwork.functions.exprs import visitor_hash
from castwork.operators.windows import prefix_count, prefix_sum
from castwork.sources.tables import Tables

# Fixed values (caps and salt default).
DAILY_CAP = 20
MCP_DAILY_CAP = 400
MONTHLY_TOKEN_CAP = 2_000_000
DEFAULT_SALT = "castwork-demo"


def visitors(t: Tables, *, salt: str = DEFAULT_SALT) -> DataFrame:
    """Salted visitor hash per request."""
    e = t.request_event
    return e.select("event_id", "ts", "channel", "input_tokens", "output_tokens",
                    visitor_hash(F.col("x_forwarded_for"), F.col("x_real_ip"), salt).alias("visitor"))


def _minute(c: str = "ts") -> F.Column:
    return F.date_trunc("minute", F.col(c))


def chat_requests(t: Tables, *, salt: str = DEFAULT_SALT) -> DataFrame:
    """Chat requests with their visitor, day and month."""
    return (visitors(t, salt=salt).where(F.col("channel") == "chat")
            .withColumn("day", F.col("ts").cast("date")).withColumn("month", F.date_format("ts", "yyyy-MM")))


def admit(v: DataFrame, *, daily_cap: int, monthly_cap: int, step: F.Column | None = None,
          tokens: F.Column | None = None) -> DataFrame:
    """The admission rule over rows (event_id, ts, day, month, visitor,
    input_tokens, output_tokens): adds n, blocked, allowed, remaining and
    month_used_before. ``step`` is what a row adds to its visitor's day (1)
    and ``tokens`` what it adds to its month while the day's count is within
    the cap; rows that carry counters over from an earlier batch set both."""
    step = F.lit(1) if step is None else step
    tokens = F.col("input_tokens") + F.col("output_tokens") if tokens is None else tokens
    v = prefix_sum(v, step.cast("bigint"), partition=["day", "visitor"], bucket=_minute(), order=["ts", "event_id"], out="n_all")
    spent = F.when(F.col("n_all") <= daily_cap, tokens).otherwise(F.lit(0))
    v = prefix_sum(v, spent.cast("bigint"), partition=["month"], bucket=_minute(), order=["ts", "event_id"],
                   out="month_used_before", inclusive=False)
    blocked = F.col("month_used_before") >= monthly_cap
    n_all = F.col("n_all")
    return (v.withColumn("n", F.when(blocked, F.lit(None)).otherwise(n_all).cast("bigint"))
            .withColumn("blocked", blocked)
            .withColumn("allowed", (~blocked) & (n_all <= daily_cap))
            .withColumn("remaining", F.when(blocked, F.lit(0)).otherwise(F.greatest(F.lit(0), F.lit(daily_cap) - n_all)).cast("bigint")))


DECISION = ("event_id", "ts", "day", "month", "visitor", "input_tokens", "output_tokens", "n", "blocked", "allowed", "remaining")


def chat_admission(t: Tables, *, salt: str = DEFAULT_SALT, daily_cap: int = DAILY_CAP,
                   monthly_cap: int = MONTHLY_TOKEN_CAP) -> DataFrame:
    """M02 with the M04 budget check: per chat request its day, visitor,
    position in the day's counter, whether the month was already over
    budget, whether it was allowed, and the questions left."""
    v = admit(chat_requests(t, salt=salt), daily_cap=daily_cap, monthly_cap=monthly_cap)
    return v.select(*DECISION, "month_used_before")


def daily_admission(t: Tables, **kw) -> DataFrame:
    """(event, day, visitor, n, allowed, remaining) for chat requests."""
    return chat_admission(t, **kw).select("event_id", "day", "visitor", "n", "allowed", "remaining", "blocked")


def channel_admission(t: Tables, *, salt: str = DEFAULT_SALT, cap: int = MCP_DAILY_CAP) -> DataFrame:
    """The MCP counter, keyed ``mcp:<visitor>``, cap 400, no budget."""
    v = visitors(t, salt=salt).where(F.col("channel") == "mcp").withColumn("day", F.col("ts").cast("date")) \
        .withColumn("visitor", F.concat(F.lit("mcp:"), F.col("visitor")))
    v = prefix_count(v, partition=["day", "visitor"], bucket=_minute(), order=["ts", "event_id"], out="n")
    return v.select("event_id", "day", "visitor", "n", (F.col("n") <= cap).alias("allowed"),
                    F.greatest(F.lit(0), F.lit(cap) - F.col("n")).cast("bigint").alias("remaining"))


def monthly_budget(t: Tables, **kw) -> DataFrame:
    """Per month, tokens and queries of completed (allowed) chat
    requests, and how many requests the budget blocked."""
    a = chat_admission(t, **kw)
    ok = F.col("allowed")
    return a.groupBy("month").agg(
        F.sum(F.when(ok, F.col("input_tokens")).otherwise(0)).cast("bigint").alias("input_tokens"),
        F.sum(F.when(ok, F.col("output_tokens")).otherwise(0)).cast("bigint").alias("output_tokens"),
        F.count_if(ok).alias("queries"),
        F.count_if(F.col("blocked")).alias("blocked"))


def remaining_quota(t: Tables, *, daily_cap: int = DAILY_CAP, **kw) -> DataFrame:
    """Per (day, visitor), questions used (requests that reached the
    daily counter) and left. The read-only peek for one day is a filter."""
    a = chat_admission(t, daily_cap=daily_cap, **kw)
    g = a.groupBy("day", "visitor").agg(F.count_if(~F.col("blocked")).alias("used"))
    return g.withColumn("remaining", F.greatest(F.lit(0), F.lit(daily_cap) - F.col("used")).cast("bigint"))
