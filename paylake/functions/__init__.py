"""Scalar column functions shared by every layer."""

from paylake.functions.scalars import (  # noqa: F401
    as_date,
    as_timestamp,
    days_before,
    guarded_ratio,
    ingest_time,
    minute_of,
    minutes_before,
    money_avg,
    money_sum,
    normalize_status,
    parse_date_strict,
    parse_timestamp_ms,
    payment_month,
    percent,
    to_amount_decimal,
    week_start,
)
