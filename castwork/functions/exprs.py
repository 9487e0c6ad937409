"""Column expressions shared by every operator.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen and push down where Catalyst can push them. No Python UDFs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
# Canonical job reference: the first run of exactly six digits, bounded by
# non-digits or the ends of the (upper-cased, trimmed) text.
JOB_REF_PATTERN = r"(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)"
JOB_REF_PREFIX = "J-"
# Downtime whose reason matches this (case-insensitive substring) is planned.
PLANNED_DOWNTIME_PATTERN = "(pm|preventive|scheduled|die change|tooling)"
# Nominal labour rate per hour by department, and the default for others.
LABOR_RATE_PER_HR = {"MELT": 38, "MOLD": 34, "CORE": 32, "CLEAN": 29, "HEAT_TREAT": 31, "MACHINE": 45}
DEFAULT_LABOR_RATE = 34
# Nominal metal cost, dollars per pound.
ALUMINUM_COST_PER_LB = 1.42
# Working days assumed in a 21-calendar-day look-back.
WORKING_DAYS_IN_21 = 15
# Downtime discount cap on capacity.
MAX_DOWNTIME_DISCOUNT = 0.6


def lit_date(d: dt.date | str) -> Column:
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


def ts_ntz(value: dt.date | dt.datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal (never session-time-zone dependent)."""
    if isinstance(value, dt.datetime):
        text = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = value.isoformat() + " 00:00:00"
    else:
        text = value if " " in value else value + " 00:00:00"
    return F.lit(text).cast("timestamp_ntz")


def midnight_minus_days(as_of: dt.date, days: int) -> Column:
    """``as_of::date - n days`` as a naive timestamp at midnight."""
    return ts_ntz(as_of - dt.timedelta(days=days))


def normalize_ref(raw: Column, most_digits: int = 6) -> Column:
    """Recover ``J-######`` from free text, NULL when none can be found.

    Plants with more jobs than six digits can number state the longest job
    number in ``most_digits``; the rule is otherwise the same."""
    cleaned = F.upper(F.trim(raw))
    pattern = JOB_REF_PATTERN.replace("{6}", f"{{6,{most_digits}}}") if most_digits > 6 else JOB_REF_PATTERN
    digits = F.nullif(F.regexp_extract(cleaned, pattern, 1), F.lit(""))
    return (F.when(raw.isNull() | (F.trim(raw) == ""), F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit(JOB_REF_PREFIX), digits)))


def resolve_job_num(raw: Column) -> Column:
    """The normalised reference, or the raw text when none is found."""
    return F.coalesce(normalize_ref(raw), raw)


def round_half_up(x: Column, n: int = 2) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n`` on doubles (ties toward +inf)."""
    f = float(10 ** n)
    return (F.floor(x.cast("double") * F.lit(f) + F.lit(0.5)) / F.lit(f)).cast("double")


def pct(numerator: Column, denominator: Column, n: int = 1) -> Column:
    """Null-safe percentage, NULL for a zero denominator, n decimals."""
    a, b = numerator.cast("double"), denominator.cast("double")
    return F.when(b.isNotNull() & (b != 0), round_half_up(a / b * F.lit(100.0), n))


def round_dec(x: Column, n: int) -> Column:
    """SQL ROUND on an exact decimal (half away from zero), returned as double."""
    return F.round(x, n).cast("double")


def is_unplanned(reason: Column) -> Column:
    """Reason does not match the planned-work pattern. NULL reason -> NULL (dropped)."""
    return ~reason.rlike("(?i)" + PLANNED_DOWNTIME_PATTERN)


def hours_between(start: Column, end: Column) -> Column:
    """Fractional hours between two naive timestamps (microsecond exact)."""
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / F.lit(3.6e9)


def week_start(c: Column) -> Column:
    """Monday of the week, as a DATE."""
    return F.date_trunc("week", c).cast("date")


def days_between(start: Column, end: Column) -> Column:
    """``end - start`` in whole days, as INT."""
    return F.datediff(end, start).cast("int")


def weekdays_inclusive(start: Column, end: Column) -> Column:
    """Monday-Friday days in [start, end], both ends included (0 when end < start).

    Closed form: whole weeks give five each, and the remaining 0-6 days are
    checked one by one from start's weekday (``weekday``: Monday = 0).
    """
    n = F.datediff(end, start) + 1
    full = F.floor(n / 7).cast("int")
    rem = (n - full * 7).cast("int")
    w = F.weekday(start)
    tail = F.aggregate(
        F.sequence(F.lit(0), F.greatest(rem - 1, F.lit(0))),
        F.lit(0),
        lambda acc, k: acc + F.when((k < rem) & (((w + k) % 7) < 5), 1).otherwise(0),
    )
    return F.when(n <= 0, F.lit(0)).otherwise(full * 5 + tail).cast("int")


def quote_literal(x: Column) -> Column:
    """SQL quote_literal: wrap in single quotes, doubling embedded ones. With
    a backslash in the text it is an escape string: backslashes doubled, and
    an E before the opening quote."""
    doubled = F.replace(F.replace(x, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.when(F.contains(x, F.lit("\\")), F.lit("E'")).otherwise(F.lit("'")), doubled, F.lit("'"))


def labor_rate(dept: Column) -> Column:
    """Nominal labour rate for a department column (CASE, no join)."""
    expr = None
    for d, rate in LABOR_RATE_PER_HR.items():
        expr = (F.when(dept == d, F.lit(rate)) if expr is None else expr.when(dept == d, F.lit(rate)))
    return expr.otherwise(F.lit(DEFAULT_LABOR_RATE))


def visitor_hash(forwarded_for: Column, real_ip: Column, salt: str) -> Column:
    """First address of X-Forwarded-For, else X-Real-IP, else 'unknown';
    sha256 of ``salt:ip``, first 32 hex characters."""
    first = F.trim(F.split(F.coalesce(forwarded_for, F.lit("")), ",", 2).getItem(0))
    ip = (F.when(first != "", first)
          .when(real_ip.isNotNull() & (real_ip != ""), real_ip)
          .otherwise(F.lit("unknown")))
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), ip), 256), 1, 32)


def round_mean(x: Column, n: int = 2) -> Column:
    """Half-up rounding for a mean of doubles whose summation order is not
    fixed: a nudge of 1e-6 of the last kept unit puts an exact tie on the same
    side whatever the order of the additions (which moves the sum by ~1e-15)."""
    f = float(10 ** n)
    return (F.floor(x.cast("double") * F.lit(f) + F.lit(0.5 + 1e-6)) / F.lit(f)).cast("double")


# Largest estimated side we hint as a broadcast. Above it the join is left to
# the planner (sort-merge) and to AQE, which re-plans with measured sizes.
BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024


def small(df):
    """``broadcast(df)`` only when Catalyst's size estimate of ``df`` is under
    ``BROADCAST_LIMIT_BYTES``; otherwise ``df`` unchanged. The estimate comes
    from the optimized plan's statistics (no job is run), so a side that grows
    with the data - or whose size cannot be bounded before running - is never
    forced into every task's memory. Frames bounded by construction (a
    ``limit``, the weeks of a window, a one-row aggregate) are broadcast
    explicitly at their call sites instead."""
    from pyspark.sql import functions as _F
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # a Java number or, by newer Py4J, an int
    except Exception:  # noqa: BLE001 - no estimate: do not hint
        return df
    return _F.broadcast(df) if size <= BROADCAST_LIMIT_BYTES else df
