"""Literal cases of FIXTURES.md sections 2.1, 2.2 and 2.5."""
import datetime as dt
from decimal import Decimal


from paylake.functions import (
    normalize_status, parse_date_strict, parse_timestamp_ms, payment_month, to_amount_decimal,
    week_start,
)
from paylake.operators.silver import reject_reason, valid_payments


def test_status_normalisation(spark):
    cases = [("paid", "paid"), ("PAID", "paid"), ("Paid ", "paid"), (None, "unknown"),
             ("", "unknown"), ("invalid_xyz", "unknown"), ("invalid_status", "unknown"),
             ("unknown", "unknown"), ("\tpaid", "unknown"), (" Pending", "pending"),
             ("REFUNDED", "refunded"), ("cancelled", "cancelled"), ("failed", "failed")]
    df = spark.createDataFrame(cases, "raw string, expected string")
    got = df.select(normalize_status("raw").alias("n"), "expected").collect()
    assert all(r.n == r.expected for r in got), got


def test_row_validity(spark):
    rows = [("a", 1, None, dt.date(2024, 1, 1), False),
            ("a", 1, -100.0, dt.date(2024, 1, 1), False),
            ("a", 1, 0.0, dt.date(2024, 1, 1), False),
            ("a", 1, 99.99, dt.date(2024, 1, 1), True),
            (None, 1, 5.0, dt.date(2024, 1, 1), False),
            ("", 1, 5.0, dt.date(2024, 1, 1), False),
            (" ", 1, 5.0, dt.date(2024, 1, 1), True),
            ("a", None, 5.0, dt.date(2024, 1, 1), False),
            ("a", 0, 5.0, dt.date(2024, 1, 1), False),
            ("a", 1, 5.0, None, False)]
    df = spark.createDataFrame(rows, "event_id string, user_id bigint, amount double, "
                                     "payment_date date, keep boolean")
    kept = {tuple(r[:4]) for r in valid_payments(df).collect()}
    for r in rows:
        assert (tuple(r[:4]) in kept) == r[4], r
    reasons = df.select(reject_reason().alias("r"), "keep").collect()
    assert all((x.r is None) == x.keep for x in reasons)


def test_timestamps_dates_amounts(spark):
    df = spark.createDataFrame([("2026-01-15T10:30:00.123456789Z", "2026-01-15", 2.675),
                                ("2026-01-15T10:30:00Z", "2026-13-15", 1e12),
                                ("garbage", "2026-01-15 xx", 99.99)],
                               "ts string, d string, amount double")
    out = df.select(parse_timestamp_ms("ts").alias("ts"), parse_date_strict("d").alias("d"),
                    to_amount_decimal("amount").alias("a")).collect()
    assert out[0].ts == dt.datetime(2026, 1, 15, 10, 30, 0, 123000)
    assert out[1].ts == dt.datetime(2026, 1, 15, 10, 30, 0)
    assert out[2].ts is None
    assert out[0].d == dt.date(2026, 1, 15) and out[1].d is None and out[2].d is None
    assert out[0].a == Decimal("2.68") and out[1].a is None and out[2].a == Decimal("99.99")


def test_month_and_week(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 1, 7),)], "d date")
    out = df.select(payment_month("d").alias("m"), week_start("d").alias("w")).collect()
    assert [r.m for r in out] == [202401, 202401]
    assert [r.w for r in out] == [dt.date(2024, 1, 1), dt.date(2024, 1, 1)]
