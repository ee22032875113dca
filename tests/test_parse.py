"""Bronze lanes: defaults, quarantine reasons, decimal casts."""
import datetime as dt
from decimal import Decimal

from paylake.operators.parse import bronze_lane_a, bronze_lane_b, enforce_broken_budget

import pytest


def _msgs(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


FULL = ('{"event_id":"e1","user_id":7,"amount":12.5,"status":"PAID",'
        '"payment_date":"2024-01-15","updated_at":"2024-01-15T10:30:00.123456789Z"}')


def test_lane_a_defaults_and_quarantine(spark):
    msgs = _msgs(spark, [
        FULL,
        '{"event_id":"e2","payment_date":"2024-01-15","updated_at":"2024-01-15T00:00:00Z"}',
        '{"user_id":18446744073709551615,"payment_date":"2024-01-15","updated_at":"2024-01-15T00:00:00Z"}',
        '{"event_id":"e3","payment_date":"2026-01-15 xx","updated_at":"2024-01-15T00:00:00Z"}',
        '{"event_id":"e4","payment_date":"2026-13-15","updated_at":"2024-01-15T00:00:00Z"}',
        '{"event_id":"e5","payment_date":"2024-01-15"}',
        "null",
    ])
    good, bad = bronze_lane_a(msgs)
    rows = {r.event_id: r for r in good.collect()}
    assert set(rows) == {"e1", "e2"}
    assert rows["e1"].updated_at == dt.datetime(2024, 1, 15, 10, 30, 0, 123000)
    assert rows["e1"].status == "PAID" and rows["e1"].payment_month == 202401
    assert (rows["e2"].user_id, rows["e2"].amount, rows["e2"].status) == (0, 0.0, "")
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["bad_payment_date", "bad_payment_date", "bad_updated_at",
                       "undecodable", "user_id_out_of_range"]


def test_lane_b_lenient_decimal(spark):
    msgs = _msgs(spark, [
        FULL,
        '{"event_id":"e2","user_id":1,"amount":2.675,"payment_date":"2024-01-15","updated_at":"x"}',
        '{"event_id":"e3","user_id":1,"amount":1e12,"payment_date":"2024-01-15"}',
        '{"event_id":"e4","amount":5,"payment_date":"2024-01-15"}',     # no user_id: F2
        '{"event_id":"e5","user_id":1,"payment_date":"2024-02-30"}',    # not a day
    ])
    good, bad = bronze_lane_b(msgs)
    rows = {r.event_id: r for r in good.collect()}
    assert set(rows) == {"e1", "e2"}
    assert rows["e1"].amount == Decimal("12.50") and rows["e1"].status == "PAID"
    assert rows["e2"].amount == Decimal("2.68") and rows["e2"].updated_at is None
    assert sorted(r.reason for r in bad.collect()) == ["amount_out_of_range", "bad_payment_date"]


def test_broken_budget():
    enforce_broken_budget(1000, 1000)
    with pytest.raises(RuntimeError):
        enforce_broken_budget(1001, 1000)
