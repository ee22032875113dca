"""Incremental watermark (FIXTURES.md 2.3), dedup, upsert, versions, schema policy."""
import datetime as dt
import os

from pyspark.sql import types as T

from paylake.operators.merge import (
    align_schema, latest_by_key, overwrite_table, upsert, upsert_frame, user_dim,
)
from paylake.operators.silver import silver_current, silver_incremental
from paylake.sources import generations
from paylake.sources.tables import read_latest_version

SCHEMA = "event_id string, user_id bigint, amount double, status string, payment_date date, updated_at timestamp_ntz"


def _row(eid, day, amount=10.0, status="paid", user=1, hour=0):
    d = dt.date(2024, 1, day)
    return (eid, user, amount, status, d, dt.datetime(2024, 1, day, hour))


def test_incremental_watermark(spark):
    bronze = spark.createDataFrame([_row("a", 18), _row("b", 19), _row("c", 20), _row("d", 21)], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    assert silver_incremental(bronze, empty).count() == 4           # empty target: all
    assert silver_incremental(bronze, None).count() == 4            # first run
    target = spark.createDataFrame([_row("x", 20)], SCHEMA)          # max = 2024-01-20
    got = sorted(r.event_id for r in silver_incremental(bronze, target).collect())
    assert got == ["b", "c", "d"]                                    # 18th is late and lost


def test_silver_current_last_batch_wins(spark):
    rows = [_row("a", 19, 10.0) + (0,), _row("a", 19, 12.0) + (1,), _row("b", 20) + (0,)]
    df = spark.createDataFrame(rows, SCHEMA + ", batch_id int")
    cur = {r.event_id: r.amount for r in silver_current(df).collect()}
    assert cur == {"a": 12.0, "b": 10.0}


def test_latest_by_key_hot_key(spark):
    # one key holds most rows: result is still one row, the greatest by order
    rows = [("hot", i, float(i)) for i in range(2000)] + [("cold", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, v int, x double").repartition(8)
    got = {r.k: r.v for r in latest_by_key(df, ["k"], ["v"]).collect()}
    assert got == {"hot": 1999, "cold": 1}
    plan = latest_by_key(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_upsert_frame_and_user_dim(spark):
    cur = spark.createDataFrame([_row("a", 1, 10.0), _row("b", 1, 20.0)], SCHEMA)
    upd = spark.createDataFrame([_row("a", 1, 11.0, hour=5), _row("c", 2, 5.0)], SCHEMA)
    out = {r.event_id: r.amount for r in
           upsert_frame(cur, upd, ["event_id", "payment_date"], ["updated_at"]).collect()}
    assert out == {"a": 11.0, "b": 20.0, "c": 5.0}
    dim = user_dim(cur.unionByName(upd)).collect()
    assert len(dim) == 1 and dim[0].last_event_id == "c" and dim[0].last_amount == 5.0


def test_upsert_on_disk_is_idempotent_and_local(spark, tmp_dir):
    path = f"{tmp_dir}/silver_payments"
    first = spark.createDataFrame([_row("a", 1), _row("b", 2), _row("c", 3)], SCHEMA)
    keys, order = ["event_id", "payment_date"], ["updated_at", "amount"]
    upsert(spark, path, first, keys, order, "payment_date")
    upd = spark.createDataFrame([_row("b", 2, 99.0, hour=3), _row("d", 2)], SCHEMA)
    upsert(spark, path, upd, keys, order, "payment_date")
    upsert(spark, path, upd, keys, order, "payment_date")           # replay: no duplicates
    got = {r.event_id: r.amount for r in generations.read(spark, path).collect()}
    assert got == {"a": 10.0, "b": 99.0, "c": 10.0, "d": 10.0}


def test_overwrite_table_versions(spark, tmp_dir):
    path = f"{tmp_dir}/gold"
    overwrite_table(spark.createDataFrame([(1,)], "x int"), path, version=1)
    overwrite_table(spark.createDataFrame([(2,), (3,)], "x int"), path, version=2)
    assert sorted(r.x for r in read_latest_version(spark, path).collect()) == [2, 3]


def test_align_schema(spark):
    target = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([(1, "n")], "a int, c string")
    assert align_schema(df, target, "ignore").columns == ["a", "b"]
    assert align_schema(df, target, "append_new_columns").columns == ["a", "b", "c"]
    import pytest
    with pytest.raises(ValueError):
        align_schema(df, target, "fail")


def test_touched_partitions_prune_statically(spark, tmp_dir):
    from paylake.operators.merge import touched_partitions
    path = f"{tmp_dir}/t"
    spark.createDataFrame([_row("a", 1), _row("b", 2), _row("c", 3)], SCHEMA) \
        .write.partitionBy("payment_date").parquet(path)
    upd = spark.createDataFrame([_row("b", 2, 99.0)], SCHEMA)
    pruned = touched_partitions(spark.read.parquet(path), upd, "payment_date")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(payment_date" in plan and "2024-01-02" in plan
    assert "Join" not in plan
    assert [r.event_id for r in pruned.collect()] == ["b"]


def test_chain_over_years_matches_batch(spark):
    from paylake.operators.silver import silver_rows
    from paylake.plans.chains import current_silver, run_realtime, scratch_lake
    from paylake.plans import inputs as I
    from paylake.functions import ingest_time, payment_month
    lake = scratch_lake(spark, "t_chain")
    bronze = I.lineitem_bronze(spark, "/root/testdata/sf0.001")
    (bronze.withColumn("ingested_at", ingest_time())
           .withColumn("payment_month", payment_month("payment_date"))
           .write.partitionBy("payment_month").parquet(lake.path("bronze_a")))
    assert run_realtime(spark, lake).startswith("appended")
    second = run_realtime(spark, lake)
    assert second.startswith("appended") and int(second.split()[1]) > 0   # overlap re-appended
    got = current_silver(spark, lake).drop("payment_month")
    want = latest_by_key(silver_rows(bronze), ["payment_date", "user_id", "event_id"],
                         ["updated_at", "amount", "status"])
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_incremental_gold_equals_full_rebuild(spark):
    from paylake.operators.gold import gold_revenue
    from paylake.plans import inputs as I
    from paylake.plans.catalog import _land_bronze
    from paylake.plans.chains import run_medallion, scratch_lake
    sf = "/root/testdata/sf0.001"
    lake = scratch_lake(spark, "t_gold_inc")
    _land_bronze(spark, sf, lake)
    now = I.now_of(spark, sf)
    first = run_medallion(spark, lake, now=now, incremental_gold=True)
    second = run_medallion(spark, lake, now=now, incremental_gold=True)
    assert len(second["gold_days"]) < len(first["gold_days"])      # only the overlap days
    inc = lake.read(spark, "gold_revenue_daily").drop("dbt_updated_at")
    full = gold_revenue(lake.read(spark, "silver_payments"), with_build_time=False)
    cols = sorted(full.columns)
    assert inc.count() == full.count()
    assert inc.select(cols).exceptAll(full.select(cols)).count() == 0


def test_half_written_version_is_not_read(spark, tmp_dir):
    path = f"{tmp_dir}/half"
    overwrite_table(spark.createDataFrame([(1,)], "x int"), path, version=1)
    overwrite_table(spark.createDataFrame([(9,)], "x int"), path, version=2)
    os.remove(f"{path}/version=2/_SUCCESS")
    assert [r.x for r in read_latest_version(spark, path).collect()] == [1]


def test_incremental_medallion_stops_on_a_null_payment_date(spark):
    import pytest
    from pyspark.sql import functions as F

    from paylake.plans import inputs as I
    from paylake.plans.catalog import _land_bronze
    from paylake.plans.chains import run_medallion, scratch_lake
    sf = "/root/testdata/sf0.001"
    lake = scratch_lake(spark, "t_null_date")
    _land_bronze(spark, sf, lake)
    now = I.now_of(spark, sf)
    run_medallion(spark, lake, now=now, incremental_gold=True)
    bronze = lake.read(spark, "bronze_a")
    undated = bronze.limit(1).withColumn("payment_date", F.lit(None).cast("date")).withColumn("payment_month", F.lit(None).cast("int"))
    undated.write.mode("append").partitionBy("payment_month").parquet(lake.path("bronze_a"))
    with pytest.raises(RuntimeError, match="not_null:payment_date=1"):
        run_medallion(spark, lake, now=now, incremental_gold=True)
