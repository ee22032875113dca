"""Run log, incremental user tables, lane B, bucketed merge, external table, bounded reads, state-store dedup."""
import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from paylake.functions import payment_month
from paylake.operators.lifecycle import bucketed_write
from paylake.operators.merge import merge_bucketed, user_dim
from paylake.operators.sessions import session_rollup
from paylake.plans.chains import (
    build_user_tables, current_silver, last_batch, merge_silver, months_since, run_realtime, run_warehouse, runs, scratch_lake,
    silver_run, sync_new_batches, unsynced_batches,
)
from paylake.sources import generations
from paylake.sources.streams import read_validated
from paylake.sources.tables import external_table
from paylake.streaming.ingest import dedup_state_stream, dedup_table_stream, run_to_end, write_validated

SCHEMA = "event_id string, user_id bigint, amount double, status string, payment_date date, updated_at timestamp_ntz"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


def events(days, user=lambda i: i % 4, n=8, start=0):
    """Rows of (month, day) pairs, ``n`` a day, seven minutes apart."""
    out = []
    for m, d in days:
        at = dt.datetime(2024, m, d, 9)
        out += [(f"e{m}-{d}-{start + i}", user(i) + 1, 10.0 + i, ["paid", "failed"][i % 2], at.date(), at + dt.timedelta(minutes=7 * i)) for i in range(n)]
    return out


def land(spark, lake, rows):
    (spark.createDataFrame(rows, SCHEMA).withColumn("ingested_at", F.current_timestamp().cast("timestamp_ntz"))
     .withColumn("payment_month", payment_month("payment_date")).write.mode("append").partitionBy("payment_month").parquet(lake.path("bronze_a")))


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_three_incremental_builds_equal_a_full_one(spark):
    lake = scratch_lake(spark, "t_users")
    land(spark, lake, events([(1, 5), (1, 31), (2, 1)]))
    silver_run(spark, lake)
    assert build_user_tables(spark, lake) == [202401, 202402]
    land(spark, lake, events([(2, 1)], user=lambda i: i % 3, start=100) + events([(3, 1), (3, 2)]))
    silver_run(spark, lake, overlap_days=0)
    assert build_user_tables(spark, lake) == [202402, 202403]
    land(spark, lake, events([(3, 2)], n=20, start=200))
    silver_run(spark, lake, overlap_days=0)
    assert build_user_tables(spark, lake) == [202403]
    assert build_user_tables(spark, lake) == []
    silver = current_silver(spark, lake)
    assert rows_of(lake.read(spark, "silver_sessions")) == rows_of(session_rollup(silver))
    assert rows_of(lake.read(spark, "silver_users")) == rows_of(user_dim(silver))


def test_runs_read_only_the_months_that_were_written(spark):
    lake = scratch_lake(spark, "t_log")
    land(spark, lake, events([(1, 5), (2, 10), (3, 10)]))
    silver_run(spark, lake)
    assert sync_new_batches(spark, lake)
    land(spark, lake, events([(3, 11)]))
    silver_run(spark, lake)
    assert months_since(spark, lake, "sync") == [202403]
    fresh = unsynced_batches(spark, lake)
    filters = plan(fresh).split("PartitionFilters: ")[1].split("]")[0]
    assert "payment_month" in filters and "202403" in filters and "202401" not in filters
    assert {r.payment_month for r in fresh.collect()} == {202403}
    days = sync_new_batches(spark, lake)
    assert sorted(days) == [dt.date(2024, 3, 10), dt.date(2024, 3, 11)]
    assert sync_new_batches(spark, lake) == []
    assert [r.batch_id for r in runs(spark, lake).filter("kind = 'run'").orderBy("batch_id").collect()] == [0, 1]


def test_old_months_that_a_run_wrote_are_merged(spark):
    lake = scratch_lake(spark, "t_old")
    land(spark, lake, events([(1, 5), (2, 10), (3, 10), (3, 11)]))
    for _ in range(2):
        silver_run(spark, lake, overlap_days=90)             # everything is appended twice
    assert lake.read(spark, "silver_events").count() == 64
    assert merge_silver(spark, lake) == 32
    assert lake.read(spark, "silver_events").count() == 32
    before = set(generations.leaves(spark, lake.path("silver_events")))
    silver_run(spark, lake, overlap_days=1)                  # March alone
    assert months_since(spark, lake, "merge") == [202403]
    merge_silver(spark, lake)
    after = set(generations.leaves(spark, lake.path("silver_events")))
    assert {d for d in before if "202403" not in d} <= after and lake.read(spark, "silver_events").count() == 32


def test_a_run_that_dies_before_its_commit_is_done_again(spark, monkeypatch):
    lake = scratch_lake(spark, "t_dies")
    land(spark, lake, events([(1, 5)]))
    real = generations.commit

    def die(session, path, state):
        if path.endswith("silver_events"):
            raise KeyboardInterrupt
        real(session, path, state)

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(generations, "commit", die)
        silver_run(spark, lake)
    assert generations.leaves(spark, lake.path("silver_events")) == [] and last_batch(spark, lake, "run") == 0
    assert silver_run(spark, lake) == 8
    assert sync_new_batches(spark, lake) == [dt.date(2024, 1, 5)]
    assert lake.read(spark, "silver_payments").count() == 8


def test_new_bronze_columns_are_ignored_by_silver(spark):
    lake = scratch_lake(spark, "t_cols")
    land(spark, lake, events([(1, 5)]))
    run_realtime(spark, lake)
    columns = lake.read(spark, "silver_events").columns
    (spark.createDataFrame(events([(1, 6)]), SCHEMA).withColumn("channel", F.lit("web")).withColumn("ingested_at", F.current_timestamp().cast("timestamp_ntz"))
     .withColumn("payment_month", payment_month("payment_date")).write.mode("append").partitionBy("payment_month").parquet(lake.path("bronze_a")))
    run_realtime(spark, lake)
    assert lake.read(spark, "silver_events").columns == columns and current_silver(spark, lake).count() == 16


def test_the_run_log_stays_small(spark, monkeypatch):
    from paylake.plans import chains
    monkeypatch.setattr(chains, "LOG_DIRS", 4)
    lake = scratch_lake(spark, "t_small")
    for b in range(9):
        chains.log_run(spark, lake, "run", b, [202401], b)
    assert last_batch(spark, lake, "run") == 8 and runs(spark, lake).count() == 9
    assert len(generations.leaves(spark, lake.path("run_log"))) <= 5


def test_lane_b_takes_only_new_batches(spark):
    lake = scratch_lake(spark, "t_lane_b")

    def batch(b, rows):
        (spark.createDataFrame(rows, SCHEMA).withColumn("amount", F.col("amount").cast("decimal(12,2)")).withColumn("batch_id", F.lit(b))
         .write.mode("append").partitionBy("payment_date", "batch_id").parquet(lake.path("bronze_b")))

    batch(0, events([(1, 5), (1, 6)]))
    assert sorted(run_warehouse(spark, lake)["days"]) == [dt.date(2024, 1, 5), dt.date(2024, 1, 6)]
    assert run_warehouse(spark, lake) == {"days": []}
    batch(1, [("e1-6-0", 9, 99.0, "paid", dt.date(2024, 1, 6), dt.datetime(2024, 1, 7))])
    assert run_warehouse(spark, lake)["days"] == [dt.date(2024, 1, 6)]
    silver = lake.read(spark, "silver_payments")
    assert silver.count() == 16 and silver.filter("event_id = 'e1-6-0'").first().user_id == 9
    assert lake.read(spark, "gold_revenue_daily").count() == 2


def test_bucketed_merge_moves_no_row(spark, tmp_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cur = spark.range(1000).selectExpr("concat('e', id) as event_id", "date'2024-01-01' + cast(id % 3 as int) as payment_date", "id as v")
        upd = spark.range(0, 1200, 3).selectExpr("concat('e', id) as event_id", "date'2024-01-01' + cast(id % 3 as int) as payment_date", "-id as v") \
            .unionByName(spark.sql("select 'e1' as event_id, date'2030-01-01' as payment_date, 7L as v"))
        bucketed_write(cur, "t_merge_current", path=f"{tmp_dir}/c")
        bucketed_write(upd, "t_merge_updates", path=f"{tmp_dir}/u")
        out = merge_bucketed(spark, "t_merge_current", "t_merge_updates", ["event_id", "payment_date"])
        assert "Exchange" not in plan(out)
        got = {(r.event_id, str(r.payment_date)): r.v for r in out.collect()}
        want = {(f"e{i}", f"2024-01-0{1 + i % 3}"): i for i in range(1000)}
        want |= {(f"e{i}", f"2024-01-0{1 + i % 3}"): -i for i in range(0, 1200, 3)} | {("e1", "2030-01-01"): 7}
        assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_external_table_prunes_partitions(spark, tmp_dir):
    path = f"{tmp_dir}/ext"
    spark.createDataFrame(events([(1, 5), (1, 6)]), SCHEMA).withColumn("batch_id", F.lit(0)).write.partitionBy("payment_date", "batch_id").parquet(path)
    external_table(spark, "t_external", path)
    out = spark.sql("SELECT count(*) AS n FROM t_external WHERE payment_date = DATE '2024-01-06'")
    text = plan(out)
    assert "payment_date" in text.split("PartitionFilters")[1] and out.first().n == 8
    spark.createDataFrame(events([(1, 7)]), SCHEMA).withColumn("batch_id", F.lit(1)).write.mode("append").partitionBy("payment_date", "batch_id").parquet(path)
    external_table(spark, "t_external", path)
    assert spark.table("t_external").count() == 24


def test_a_backlog_runs_in_bounded_batches(spark, tmp_dir, monkeypatch):
    """Files on landing end after a block, and a batch takes one file a consumer."""
    from paylake.streaming import ingest
    monkeypatch.setattr(ingest, "BLOCK_ROWS", 100)
    keyed = spark.range(0, 1000, 1, 1).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("value"))
    write_validated(keyed, f"{tmp_dir}/topic", 0)
    assert len(glob.glob(f"{tmp_dir}/topic/batch_id=0/*.txt")) == 10
    sizes = []

    def count(batch, batch_id):
        sizes.append(batch.count())
        batch.write.mode("append").parquet(f"{tmp_dir}/out")

    for stream, name, most in ((read_validated(spark, f"{tmp_dir}/topic"), "a", 400), (read_validated(spark, f"{tmp_dir}/topic", max_bytes=900), "b", 400)):
        sizes.clear()
        run_to_end(stream.writeStream.option("checkpointLocation", f"{tmp_dir}/{name}").trigger(availableNow=True).foreachBatch(count).start())
        assert sum(sizes) == 1000 and len(sizes) >= 3 and max(sizes) <= most
    assert spark.read.parquet(f"{tmp_dir}/out").groupBy("value").count().filter("count <> 2").count() == 0


def test_state_dedup_reads_no_stored_row(spark, tmp_dir):
    """Twenty batches: each looks up its own keys, none reads the table; a replay changes nothing."""
    schema = "event_id string, payment_date date, v int"
    for b in range(20):
        rows = [(f"e{i}", dt.date(2024, 1, 1 + i % 3), b) for i in range(b * 5, b * 5 + 10)]      # half of them come again
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in")
        return run_to_end(dedup_state_stream(stream, ["event_id", "payment_date"], f"{tmp_dir}/out", f"{tmp_dir}/ck", state_partitions=2))

    q = run()
    progress = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(progress) == 20 and all(p["numInputRows"] == 10 for p in progress)
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in progress] == [10] + [5] * 19
    assert "RocksDB" in spark.read.text(f"{tmp_dir}/ck/offsets/0").agg(F.concat_ws("", F.collect_list("value"))).first()[0]
    out = spark.read.parquet(f"{tmp_dir}/out")
    assert out.count() == 105 == out.select("event_id").distinct().count()
    run()
    assert spark.read.parquet(f"{tmp_dir}/out").count() == 105


def test_table_dedup_reads_folded_tables(spark, tmp_dir):
    from paylake.operators.lifecycle import fold_batches
    schema = "event_id string, payment_date date, v int"
    out, ck = f"{tmp_dir}/out", f"{tmp_dir}/ck"

    def deliver(ids):
        spark.createDataFrame([(f"e{i}", dt.date(2024, 1, 1 + i % 2) if i else None, i) for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
        run_to_end(dedup_table_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in"),
                                      ["event_id", "payment_date"], out, ck))

    deliver(range(6))
    deliver(range(3, 9))
    assert fold_batches(spark, out, ck)["folded"] > 0
    deliver(range(12))
    assert sorted(r.v for r in generations.read(spark, out).collect()) == list(range(12))
