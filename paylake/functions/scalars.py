"""Scalar column functions (P1-P22).  All are native Spark expressions.

Spark 4 runs with ANSI mode on, so every conversion of raw input uses a
``try_`` form: a bad value becomes NULL and the caller decides whether that
row is quarantined, instead of the whole job failing.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from paylake.schemas import AMOUNT_DECIMAL, UNKNOWN_STATUS, VALID_STATUSES

ColumnOrName = Column | str

_DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(value) -> Column:
    """A literal DATE from a ``date`` / ``'YYYY-MM-DD'`` / Column."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, (_dt.date, _dt.datetime)):
        value = value.strftime("%Y-%m-%d")
    return F.lit(value).cast("date")


def as_timestamp(value) -> Column:
    """A literal TIMESTAMP_NTZ (UTC wall clock) from a datetime / text / Column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def parse_date_strict(c: ColumnOrName) -> Column:
    """P1/P5 ``toDate(str)``: exactly ``YYYY-MM-DD`` and a real calendar day, else NULL.

    ``try_cast`` alone accepts trailing text such as ``'2026-01-15 xx'``; the
    shape check rejects it.
    """
    c = _col(c)
    return F.when(c.rlike(_DATE_SHAPE), c.try_cast("date"))


def parse_timestamp_ms(c: ColumnOrName) -> Column:
    """P2/P6/P7 best-effort ISO-8601 / RFC3339 parse, truncated to milliseconds.

    Accepts up to nine fraction digits and a ``Z`` / offset suffix.  Returns a
    TIMESTAMP_NTZ holding UTC wall-clock time (the session zone is UTC).
    """
    c = _col(c)
    return F.date_trunc("millisecond", c.try_cast("timestamp")).cast("timestamp_ntz")


def ingest_time() -> Column:
    """P3/P8 ``now64(3)``: arrival time in ms, constant within one query/micro-batch."""
    return F.date_trunc("millisecond", F.current_timestamp()).cast("timestamp_ntz")


def to_amount_decimal(c: ColumnOrName) -> Column:
    """P4 ``CAST(amount AS DECIMAL(12,2))``: HALF_UP rounding, NULL on overflow."""
    return _col(c).try_cast(AMOUNT_DECIMAL)


def normalize_status(c: ColumnOrName) -> Column:
    """``lower(trim(status))`` if it is a valid status, else ``'unknown'``.

    ``trim`` removes spaces only (a tab is kept and the value becomes unknown);
    NULL and the empty string become unknown.
    """
    cleaned = F.lower(F.trim(_col(c)))
    return F.when(cleaned.isin(*VALID_STATUSES), cleaned).otherwise(F.lit(UNKNOWN_STATUS))


def payment_month(c: ColumnOrName) -> Column:
    """P12 ``toYYYYMM(date)`` as an INT partition key."""
    c = _col(c)
    return (F.year(c) * 100 + F.month(c)).cast("int")


def minute_of(c: ColumnOrName) -> Column:
    """P13 ``toStartOfMinute(ts)`` keeping TIMESTAMP_NTZ."""
    return F.date_trunc("minute", _col(c)).cast("timestamp_ntz")


def week_start(c: ColumnOrName) -> Column:
    """P14 ``DATE_TRUNC('week', date)``: the Monday of the week, as DATE."""
    return F.to_date(F.date_trunc("week", _col(c)))


def days_before(as_of, days: int) -> Column:
    """P15 ``as_of - INTERVAL days DAY``."""
    return F.date_sub(as_date(as_of), days)


def minutes_before(now, minutes: int) -> Column:
    """P15 ``now - INTERVAL minutes MINUTE`` on TIMESTAMP_NTZ."""
    return as_timestamp(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def guarded_ratio(numerator: ColumnOrName, denominator: ColumnOrName,
                  default: float = 0.0) -> Column:
    """P20: ``numerator / denominator`` if the denominator is > 0, else ``default``."""
    num, den = _col(numerator), _col(denominator)
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(default))


def percent(part: ColumnOrName, whole: ColumnOrName, digits: int = 2) -> Column:
    """P19/P21 ``round(part / whole * 100, digits)``; NULL when ``whole`` is 0."""
    return F.round(F.try_divide(_col(part).cast("double"), _col(whole)) * 100, digits)


#: Amounts are added at this scale: 16 whole digits and 12 decimals, so that a
#: sum of up to 10^10 of them still fits DECIMAL(38,12).
_WIDE_MONEY = "decimal(28,12)"


def money_sum(c: ColumnOrName) -> Column:
    """Sum of a DOUBLE money column, returned as DOUBLE.

    Floating-point sums depend on the order rows are added in, which changes
    with partitioning.  Amounts below 10^16 are added exactly at twelve decimals
    (no rounding to cents); larger ones, which pass the gate, are added as
    doubles to that total, so one of them doesn't change how the others add up.
    """
    c = _col(c)
    exact = c.try_cast(_WIDE_MONEY)
    rest = F.sum(F.when(c.isNotNull() & exact.isNull(), c))
    small = F.sum(exact).cast("double")
    return F.when(rest.isNull(), small).otherwise(F.coalesce(small, F.lit(0.0)) + rest)


def money_avg(c: ColumnOrName) -> Column:
    """Average of a DOUBLE money column: ``money_sum / count`` (NULL if no rows)."""
    return F.try_divide(money_sum(c), F.count(_col(c)))
