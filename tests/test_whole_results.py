"""Rows that earlier versions lost or kept wrongly: writes, sums, retention, stream starts."""
import datetime as dt
import os

from pyspark.sql import functions as F

from paylake.functions import money_sum
from paylake.sources import generations
from paylake.operators import lifecycle, merge, quality
from paylake.operators.gate import to_keyed
from paylake.sources.streams import first_start

DAY = dt.date(2024, 1, 2)


def row(event, amount, hour, status="paid"):
    return (event, "u", amount, status, DAY, dt.datetime(2024, 1, 2, hour))


SCHEMA = "event_id string, user_id string, amount double, status string, payment_date date, updated_at timestamp_ntz"


def test_the_later_write_wins_even_with_an_earlier_time(spark):
    old = spark.createDataFrame([row("a", 1.0, 12), row("b", 2.0, 12)], SCHEMA)
    new = spark.createDataFrame([row("a", 9.0, 11, "refunded"), row("b", 3.0, 12)], SCHEMA)
    got = {r.event_id: (r.amount, r.status) for r in
           merge.upsert_frame(old, new, ["event_id", "payment_date"], ["updated_at"]).collect()}
    assert got == {"a": (9.0, "refunded"), "b": (3.0, "paid")}


def test_rows_that_the_warehouse_cannot_hold_are_named(spark):
    df = spark.createDataFrame([row("a", 1.0, 1), row("b", 1e11, 1), row("c", None, 1), row(None, 1.0, 1)], SCHEMA)
    kept = merge.to_warehouse_silver(df).count()
    bad = {(r.event_id, r.reason) for r in merge.sync_misfits(df).collect()}
    assert kept == 1 and bad == {("b", "amount_overflow"), ("c", "null_amount"), (None, "null_event_id")}


def test_sums_keep_parts_of_cents_and_large_amounts(spark):
    df = spark.range(1000).select(F.lit(0.004).alias("amount"))
    assert df.agg(money_sum("amount").alias("s")).first().s == 4.0
    both = df.unionByName(spark.createDataFrame([(1e40,)], "amount double"))
    assert both.agg(money_sum("amount").alias("s")).first().s == 1e40 + 4.0


def test_every_failing_check_is_named(spark):
    summary = spark.createDataFrame([("c", f"col{i}", 1, "fail") for i in range(25)], "check_name string, column_name string, failures int, status string")
    try:
        quality.raise_on_failure(summary)
        raise AssertionError("no failure raised")
    except RuntimeError as e:
        assert all(f"col{i}=" in str(e) for i in range(25))


def test_retention_removes_expired_batches_of_the_boundary_month(spark, tmp_dir):
    rows = [(1, dt.date(2024, 1, 2), 202401, 0), (2, dt.date(2024, 1, 20), 202401, 1), (3, dt.date(2024, 2, 1), 202402, 2),
            (4, dt.date(2024, 1, 3), 202401, 1)]
    path = f"{tmp_dir}/bronze"
    spark.createDataFrame(rows, "x int, payment_date date, payment_month int, batch_id int") \
        .write.partitionBy("payment_month", "batch_id").parquet(path)
    lifecycle.apply_retention(spark, path, "2024-04-10", days=90)               # cutoff 2024-01-11
    assert sorted(r.x for r in generations.read(spark, path).collect()) == [2, 3]
    assert not any("batch_id=0" in d for d in generations.leaves(spark, path))


def test_retention_keeps_null_and_escaped_levels(spark, tmp_dir):
    """Directories are known by their own names: live rows under a null level or one with ':' stay."""
    rows = [(1, dt.date(2024, 1, 2), 202401, "a:b"), (2, dt.date(2024, 1, 20), 202401, "a:b"), (3, dt.date(2024, 1, 21), 202401, None),
            (4, dt.date(2024, 1, 22), 202401, "x"), (5, dt.date(2024, 1, 3), 202401, "gone"), (6, None, None, "x")]
    path = f"{tmp_dir}/levels"
    spark.createDataFrame(rows, "x int, payment_date date, payment_month int, level string") \
        .write.partitionBy("payment_month", "level").parquet(path)
    lifecycle.apply_retention(spark, path, "2024-04-10", days=90)
    assert sorted((r.x, r.level) for r in generations.read(spark, path).collect() if r.level) == [(2, "a:b"), (4, "x"), (6, "x")]
    assert [r.x for r in generations.read(spark, path).filter("level is null").collect()] == [3]


def test_key_of_a_message(spark):
    df = spark.createDataFrame([("{}",), ('{"event_id":"a","EVENT_ID":null}',), ('{"event_id":"a","event_id":"b"}',)], "value string")
    assert [r.key for r in to_keyed(df).collect()] == ["", "a", "b"]


def test_the_first_start_is_kept(spark, tmp_dir):
    at = first_start(spark, f"{tmp_dir}/position")
    assert first_start(spark, f"{tmp_dir}/position") == at
