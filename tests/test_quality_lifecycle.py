"""Checks, lane comparisons without joins, retention and partition windows."""
import datetime as dt

from pyspark.sql import functions as F

from paylake.operators import quality as Q
from paylake.sources import generations
from paylake.operators.lifecycle import (
    apply_partition_window, apply_retention, drop_old_versions, list_partitions, retained,
    write_partitioned,
)

SCHEMA = "event_id string, user_id bigint, amount double, status string, payment_date date, updated_at timestamp_ntz"


def _df(spark, days):
    return spark.createDataFrame(
        [(f"e{i}", 1, 1.0, "paid", d, dt.datetime.combine(d, dt.time())) for i, d in enumerate(days)], SCHEMA)


def test_drop_rate_zero_bronze(spark):
    empty = _df(spark, [])
    row = Q.drop_rate(empty, empty, "2024-01-30").first()
    assert (row.total_bronze, row.total_silver, row.dropped, row.drop_pct) == (0, 0, 0, None)


def test_lane_lag_by_day_one_sided(spark):
    a = _df(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    b = _df(spark, [dt.date(2024, 1, 2), dt.date(2024, 1, 3)])
    got = {r.payment_date.day: (r.lane_a_rows, r.lane_b_rows, r.lag_rows)
           for r in Q.lane_lag_by_day(a, b).collect()}
    assert got == {1: (1, 0, 1), 2: (1, 1, 0), 3: (0, 1, -1)}
    plan = Q.lane_lag_by_day(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_checks(spark):
    df = spark.createDataFrame([("a", "paid"), (None, "weird"), ("c", None)], "event_id string, status string")
    nn = {r.column_name: (r.failures, r.status) for r in Q.check_not_null(df, ["event_id", "status"]).collect()}
    assert nn == {"event_id": (1, "fail"), "status": (1, "fail")}
    acc = Q.check_accepted(df, "status", ["paid"]).first()
    assert (acc.failures, acc.status) == (1, "fail")
    assert Q.check_unique(df.union(df), ["event_id"]).count() == 3
    import pytest
    with pytest.raises(RuntimeError):
        Q.raise_on_failure(Q.check_not_null(df, ["event_id"]))


def test_freshness_and_gates(spark):
    df = _df(spark, [dt.date(2024, 1, 1)])
    now = "2024-01-01 03:00:00"
    assert Q.check_freshness(df, "updated_at", now, 2, 6).first().status == "warn"
    assert Q.check_freshness(df, "updated_at", "2024-01-01 01:00:00").first().status == "pass"
    assert Q.check_freshness(df, "updated_at", "2024-01-01 07:00:00").first().status == "error"
    assert Q.has_new_data(df, "2024-01-01 00:05:00", 6, "updated_at")
    assert not Q.has_new_data(df, "2024-01-01 00:06:00", 6, "updated_at")   # strict >
    import pytest
    with pytest.raises(RuntimeError):
        Q.require_recent(df, "2024-01-01 02:00:00", 2)


def test_retention_read_filter(spark):
    df = _df(spark, [dt.date(2024, 1, 15), dt.date(2024, 1, 16), dt.date(2024, 1, 17)])
    # rows live while payment_date + 90 days > as_of; 2024-01-16 + 90 = 2024-04-15
    assert sorted(r.payment_date.day for r in retained(df, "2024-04-15").collect()) == [17]


def test_apply_retention_on_disk(spark, tmp_dir):
    days = [dt.date(2023, 12, 5), dt.date(2024, 1, 10), dt.date(2024, 1, 20), dt.date(2024, 2, 1)]
    df = _df(spark, days).withColumn("payment_month", F.year("payment_date") * 100 + F.month("payment_date"))
    path = f"{tmp_dir}/bronze"
    write_partitioned(df, path, ["payment_month"])
    out = apply_retention(spark, path, "2024-04-15", 90)
    assert out["dropped_partitions"] == 1
    left = sorted(r.payment_date for r in generations.read(spark, path).collect())
    assert left == [dt.date(2024, 1, 20), dt.date(2024, 2, 1)]


def test_partition_window_and_versions(spark, tmp_dir):
    days = [dt.date(2023, 6, 30), dt.date(2023, 7, 1), dt.date(2024, 1, 5)]
    path = f"{tmp_dir}/silver_b"
    write_partitioned(_df(spark, days), path, ["payment_date"])
    assert apply_partition_window(spark, path, "2024-01-20", 6) == 1
    assert len(list_partitions(spark, path, "payment_date")) == 2
    vpath = f"{tmp_dir}/gold"
    for v in (1, 2, 3):
        spark.createDataFrame([(v,)], "x int").withColumn("version", F.lit(v)) \
            .write.mode("append").partitionBy("version").parquet(vpath)
    assert drop_old_versions(spark, vpath, keep=2) == 1


def test_compact_and_file_size_cap(spark, tmp_dir):
    import glob
    from paylake.operators.lifecycle import compact
    path = f"{tmp_dir}/b"
    days = [dt.date(2024, 1, 1 + (i % 3)) for i in range(300)]
    df = _df(spark, days).repartition(20)
    df.write.partitionBy("payment_date").parquet(path)            # many small files
    before = len(glob.glob(f"{path}/payment_date=2024-01-01/*.parquet"))
    assert compact(spark, path, "payment_date", ["2024-01-01"]) == 1
    fresh = [d for d in generations.leaves(spark, path) if "2024-01-01" in d]
    assert len(fresh) == 1 and len(glob.glob(f"{path}/{fresh[0]}/*.parquet")) < before
    assert generations.read(spark, path).count() == 300
    capped = f"{tmp_dir}/c"
    write_partitioned(df, capped, ["payment_date"], max_records_per_file=40)
    files = glob.glob(f"{capped}/payment_date=*/*.parquet")
    assert len(files) >= 300 // 40
    assert all(pq_rows <= 40 for pq_rows in
               (spark.read.parquet(f).count() for f in files))


def test_quarantine_bad_dates(spark):
    from paylake.operators.parse import quarantine_bad_dates
    raw = spark.createDataFrame([("a", "2024-01-15", "2024-01-15T10:00:00Z"),
                                 ("b", "2024-13-01", "2024-01-15T10:00:00Z"),
                                 ("c", "2024-01-15", "yesterday")],
                                "event_id string, payment_date string, updated_at string")
    good, bad = quarantine_bad_dates(raw)
    assert [r.event_id for r in good.collect()] == ["a"]
    assert sorted((r.event_id, r.reason) for r in bad.collect()) == [
        ("b", "bad_payment_date"), ("c", "bad_updated_at")]


def test_medallion_stops_on_failed_gate(spark):
    import pytest
    from paylake.functions import payment_month
    from paylake.plans.chains import run_medallion, scratch_lake
    lake = scratch_lake(spark, "t_stop")
    _df(spark, [dt.date(2024, 1, 1)]).withColumn("ingested_at", F.col("updated_at")) \
        .withColumn("payment_month", payment_month("payment_date")) \
        .write.partitionBy("payment_month").parquet(lake.path("bronze_a"))
    with pytest.raises(RuntimeError):
        run_medallion(spark, lake, now="2024-01-02 12:00:00")      # nothing in the last 2 h
    assert not lake.exists(spark, "silver_events")               # later steps never ran
    out = run_medallion(spark, lake, now="2024-01-01 01:00:00")
    assert out["silver_appended"] == 1 and lake.read(spark, "gold_revenue").count() == 1


def test_rebalance_splits_hot_partition(spark, tmp_dir):
    """A partition value holding most rows is written by several tasks (AQE
    splits the skewed REBALANCE partition), not funnelled through one."""
    import glob
    rows = [dt.date(2024, 1, 1)] * 9000 + [dt.date(2024, 1, 2 + i % 5) for i in range(1000)]
    df = _df(spark, rows).repartition(8)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        write_partitioned(df, f"{tmp_dir}/hot", ["payment_date"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    hot_files = glob.glob(f"{tmp_dir}/hot/payment_date=2024-01-01/*.parquet")
    assert len(hot_files) > 1
    assert spark.read.parquet(f"{tmp_dir}/hot").count() == 10000


def test_apply_retention_day_partitions(spark, tmp_dir):
    days = [dt.date(2024, 1, 15), dt.date(2024, 1, 16), dt.date(2024, 1, 17)]
    path = f"{tmp_dir}/bronze_b"
    write_partitioned(_df(spark, days), path, ["payment_date"])
    out = apply_retention(spark, path, "2024-04-15", 90, partition_col="payment_date")
    assert out["dropped_partitions"] == 2
    assert [r.payment_date.day for r in generations.read(spark, path).collect()] == [17]


def test_cli_runs_chains(spark, tmp_dir):
    from paylake.__main__ import main
    from paylake.functions import payment_month
    from paylake.sources.tables import Lakehouse
    lake = Lakehouse(f"{tmp_dir}/lake")
    _df(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]).withColumn("ingested_at", F.col("updated_at")) \
        .withColumn("payment_month", payment_month("payment_date")) \
        .write.partitionBy("payment_month").parquet(lake.path("bronze_a"))
    assert main(["medallion", "--root", lake.root, "--now", "2024-01-02 00:30:00"]) == 0
    assert lake.read(spark, "gold_revenue").count() == 2
    assert main(["medallion", "--root", lake.root, "--now", "2024-02-01 00:00:00"]) == 1
    assert main(["realtime", "--root", lake.root, "--now", "2024-01-02 00:03:00"]) == 0
    assert main(["merge", "--root", lake.root]) == 0
    assert main(["retention", "--root", lake.root, "--as-of", "2024-03-31"]) == 0
    assert lake.read(spark, "bronze_a").count() == 1


def test_a_layers_checks_in_one_pass(spark):
    df = spark.createDataFrame([("a", 1, "paid"), (None, 2, "odd"), (None, None, None)], "event_id string, user_id int, status string")
    both = Q.check_not_null(df, ["event_id", "user_id"]).unionByName(Q.check_accepted(df, "status", ["paid"]))
    one = Q.check_columns(df, ["event_id", "user_id"], {"status": ["paid"]})
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r[c] for c in one.columns) for r in both.collect())
    assert {r.status for r in Q.check_columns(df.limit(0), ["event_id"]).collect()} == {"pass"}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
