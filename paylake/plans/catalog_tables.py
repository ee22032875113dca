"""Registered queries over stored tables: folding, replays, late starts, merges,
retention, schema growth, external and bucketed tables (imported by the catalog).
"""

from __future__ import annotations

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from paylake.operators import gold as G
from paylake.operators import quality as Q
from paylake.operators import reports as R
from paylake.operators.gate import split_valid, to_keyed, validate_events
from paylake.operators.lifecycle import apply_retention, bucketed_write, fold_batches, last_committed
from paylake.operators.merge import latest_by_key, merge_bucketed, to_warehouse_silver
from paylake.operators.silver import silver_incremental, silver_rows
from paylake.plans import inputs as I
from paylake.plans import oracle as O
from paylake.plans.catalog import _GATED_BRONZE, _GATED_BRONZE_MS, _land_bronze, _late_events, _stream_dirs, register
from paylake.plans.chains import merge_silver, run_realtime, run_warehouse, scratch_lake
from paylake.schemas import BRONZE_TTL_DAYS, EVENT_ID_MAX_LEN, SILVER_COLUMNS, SILVER_B_KEY, STATUS_MAX_LEN
from paylake.sources import generations
from paylake.sources.driver_tables import CORRUPT_EVERY, dirty_payloads, duplicate_payloads, payments_from_events, redelivered
from paylake.sources.streams import read_validated
from paylake.sources.tables import external_table
from paylake.streaming.ingest import (
    bronze_a_stream,
    bronze_b_stream,
    dedup_state_stream,
    minute_counts,
    minute_counts_stream,
    run_to_end,
)

_BRONZE_A = O.with_layers("bronze") + f"""
SELECT event_id, user_id, COALESCE(amount, 0.0) AS amount, COALESCE(status, '') AS status,
       payment_date, date_trunc('millisecond', updated_at) AS updated_at
FROM bronze WHERE src_id % {CORRUPT_EVERY} <> 0"""

# ---------------------------------------------------------------------------
# Gate (V1, V3)


@register("gate_duplicates", """
SELECT event_id AS offset, CASE WHEN event_id % 6 IN (1, 2, 4) THEN 'bad_field_type' END AS reason,
       CASE event_id % 6 WHEN 0 THEN concat('evt-', event_id) WHEN 3 THEN concat('alt-', event_id)
                         WHEN 5 THEN concat('evt-', event_id) END AS key FROM events""")
def q_gate_duplicates(spark, sf_dir):
    """V1/V3 messages with keys given twice: every value is checked, the last id that isn't null is the key."""
    checked = validate_events(duplicate_payloads(I.events(spark, sf_dir)))
    good, bad = split_valid(checked)
    keyed = to_keyed(good).select("offset", F.lit(None).cast("string").alias("reason"), "key")
    return keyed.unionByName(bad.select("offset", "reason", F.lit(None).cast("string").alias("key")))


# ---------------------------------------------------------------------------
# Streams (S2, S3, K2, K4, T1-T3, T5, V5)

def _topic(spark, sf_dir, lake, parts=4):
    """The validated topic as ``parts`` files that a stream takes in several batches."""
    good, _ = split_valid(validate_events(I.messages(spark, sf_dir)))
    topic = f"{lake.root}/topic"
    good.withColumn("part", F.col("offset") % parts).repartition(parts, "part").select("value").write.text(topic)
    return topic


def _forget_last_commit(spark, checkpoint):
    """As after a crash between a batch's output and its commit."""
    fs, path = generations._fs(spark, f"{checkpoint}/commits/{last_committed(spark, checkpoint)}")
    fs.delete(path, False)


@register("stream_replayed", _BRONZE_A)
def q_stream_replayed(spark, sf_dir):
    """V5/T3 lane-A bronze of a stream whose last batch is done a second time."""
    lake, ckpt = _stream_dirs(spark, "stream_replayed")
    topic = _topic(spark, sf_dir, lake)

    def run():
        run_to_end(bronze_a_stream(read_validated(spark, topic, max_files=1), lake.path("bronze_a"),
                                   lake.path("quarantine"), f"{ckpt}/bronze_a"))

    run()
    _forget_last_commit(spark, f"{ckpt}/bronze_a")
    run()
    return lake.read(spark, "bronze_a").select(*SILVER_COLUMNS)


@register("stream_compacted", _BRONZE_A)
def q_stream_compacted(spark, sf_dir):
    """K4/K2/S2 lane-A bronze written in several bounded batches, its closed batches
    folded, the open one replayed, then folded too: equal rows, one directory a month."""
    lake, ckpt = _stream_dirs(spark, "stream_compacted")
    topic, path = _topic(spark, sf_dir, lake, parts=6), lake.path("bronze_a")

    def run():
        run_to_end(bronze_a_stream(read_validated(spark, topic, max_files=2), path, lake.path("quarantine"), f"{ckpt}/bronze_a"))

    run()
    _forget_last_commit(spark, f"{ckpt}/bronze_a")
    fold_batches(spark, path, f"{ckpt}/bronze_a")
    run()
    fold_batches(spark, path, f"{ckpt}/bronze_a")
    months = [generations.level(d, "payment_month") for d in generations.leaves(spark, path)]
    if len(months) != len(set(months)):
        raise RuntimeError(f"months left in several directories: {months}")
    return lake.read(spark, "bronze_a").select(*SILVER_COLUMNS)


@register("stream_minutes_folded", O.with_layers("bronze") + """
SELECT date_trunc('minute', updated_at) AS minute, COUNT(*) AS rows FROM bronze GROUP BY 1""")
def q_stream_minutes_folded(spark, sf_dir):
    """T5 the minute counts of all closed batches added up on disk, one row a minute."""
    lake, ckpt = _stream_dirs(spark, "stream_minutes_folded")
    out = f"{lake.root}/minute_counts"
    run_to_end(minute_counts_stream(payments_from_events(_late_events(spark, sf_dir, lake, again=None)), "updated_at", out, f"{ckpt}/m"))
    fold_batches(spark, out, f"{ckpt}/m", lambda df: minute_counts(df).withColumn("day", F.to_date("minute")))
    return minute_counts(generations.read(spark, out))


@register("stream_dedup_state", O.with_layers("bronze") + """
SELECT event_id, user_id, amount, status, payment_date, updated_at FROM bronze""")
def q_stream_dedup_state(spark, sf_dir):
    """T2 redeliveries in later batches, found in the stream's state on disk: no stored row is read."""
    lake, ckpt = _stream_dirs(spark, "stream_dedup_state")
    rows = payments_from_events(_late_events(spark, sf_dir, lake, again=10))
    out = f"{lake.root}/deduped"
    run_to_end(dedup_state_stream(rows, ["event_id", "payment_date", "updated_at"], out, f"{ckpt}/dedup"))
    return spark.read.parquet(out).select(*SILVER_COLUMNS)


@register("stream_bronze_latest", O.with_layers("bronze") + f"""
SELECT event_id, user_id, CAST(amount AS DECIMAL(12,2)) AS amount, status,
       payment_date, date_trunc('millisecond', updated_at) AS updated_at
FROM bronze WHERE src_id % {CORRUPT_EVERY} <> 0 AND src_id % 4 <> 0""")
def q_stream_bronze_latest(spark, sf_dir):
    """S3 lane-B bronze that starts at latest: messages from before its first start
    stay out; those that come while it runs or is down are read after the restart."""
    lake, ckpt = _stream_dirs(spark, "stream_latest")
    topic = f"{lake.root}/topic"
    good, _ = split_valid(validate_events(I.messages(spark, sf_dir)))
    good = good.persist()

    def publish(*parts):
        good.filter((F.col("offset") % 4).isin(list(parts))).select("value").write.mode("append").text(topic)
        time.sleep(0.05)                 # files are told apart by their times

    def run():
        stream = read_validated(spark, topic, starting="latest", position=f"{ckpt}/position")
        run_to_end(bronze_b_stream(stream, lake.path("bronze_b"), lake.path("quarantine"), f"{ckpt}/bronze_b"))

    publish(0)                           # before the first start
    run()
    publish(1)
    run()
    publish(2)                           # while it is down
    publish(3)
    run()
    good.unpersist()
    return lake.read(spark, "bronze_b").select(*SILVER_COLUMNS)


@register("broken_budget", O.with_layers("bronze") + """
, flawed AS (SELECT COUNT(*) FILTER (WHERE src_id % 7 IN (1, 2, 3, 5, 6)) AS broken FROM bronze)
SELECT budget, broken > budget AS stopped FROM flawed, (VALUES (0::BIGINT), (1000000000::BIGINT)) AS b(budget)""")
def q_broken_budget(spark, sf_dir):
    """V7 a lane-A stream over flawed messages stops beyond its budget of broken ones, and runs within it."""
    lake, ckpt = _stream_dirs(spark, "budget")
    topic = f"{lake.root}/topic"
    dirty_payloads(I.events(spark, sf_dir)).select("value").write.text(topic)
    rows = []
    for budget in (0, 1_000_000_000):
        try:
            run_to_end(bronze_a_stream(read_validated(spark, topic), f"{lake.root}/bronze/t{budget}", f"{lake.root}/quarantine{budget}",
                                       f"{ckpt}/{budget}", max_broken=budget))
            rows.append((budget, False))
        except (RuntimeError, StreamingQueryException) as error:
            if "broken messages" not in str(error):
                raise
            rows.append((budget, True))
    return spark.createDataFrame(rows, "budget bigint, stopped boolean")


@register("storage_order", O.with_layers("bronze", bronze=_GATED_BRONZE) + """
SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS out_of_order FROM bronze""")
def q_storage_order(spark, sf_dir):
    """O3 the files of stored bronze are in the order of the storage key: no row stands before its predecessor."""
    lake = scratch_lake(spark, "order")
    _land_bronze(spark, sf_dir, lake)
    rows = spark.read.parquet(lake.path("bronze_a")).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
        F.struct("payment_date", "event_id").alias("key"))
    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    return (rows.withColumn("before", before)
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("key") < F.col("before")).alias("out_of_order")))


# ---------------------------------------------------------------------------
# Lane B by itself, run log, merge

_LANE_B_SILVER = O.with_layers("bronze", bronze=_GATED_BRONZE) + f"""
, lane_b AS (SELECT * REPLACE (CAST(amount AS DECIMAL(12,2)) AS amount) FROM bronze)
, silver_b AS (SELECT event_id, user_id, amount, {O.STATUS_SQL} AS status, payment_date FROM lane_b WHERE {O.VALID_SQL})"""


@register("warehouse_chain", _LANE_B_SILVER + """
SELECT payment_date, COUNT(*) AS payments, COUNT(*) FILTER (WHERE status = 'paid') AS total_paid_orders,
       CAST(SUM(CASE WHEN status = 'paid' THEN amount ELSE 0 END) AS DECIMAL(22,2)) AS total_revenue,
       COUNT(DISTINCT user_id) AS unique_users
FROM silver_b GROUP BY payment_date""")
def q_warehouse_chain(spark, sf_dir):
    """Lane-B bronze stream -> warehouse silver -> gold, in two runs of which the
    second takes only the batches that came after the first."""
    lake, ckpt = _stream_dirs(spark, "warehouse")
    topic = f"{lake.root}/topic"
    good, _ = split_valid(validate_events(I.messages(spark, sf_dir)))
    for late in (True, False):
        (good.filter((F.col("offset") % 3 == 0) == F.lit(late)).select("value").write.mode("append").text(topic))
        run_to_end(bronze_b_stream(read_validated(spark, topic), lake.path("bronze_b"), lake.path("quarantine"), f"{ckpt}/b"))
        run_warehouse(spark, lake)
    silver = lake.read(spark, "silver_payments").groupBy("payment_date").agg(F.count(F.lit(1)).alias("payments"))
    gold = lake.read(spark, "gold_revenue_daily")
    return gold.join(silver, "payment_date").select("payment_date", "payments", "total_paid_orders", "total_revenue", "unique_users")


@register("merged_silver_table", O.with_layers("silver", bronze=_GATED_BRONZE_MS) + """
SELECT event_id, user_id, amount, status, payment_date, updated_at FROM silver""")
def q_merged_silver_table(spark, sf_dir):
    """M1/M7 two silver runs that overlap by 60 days, merged in the stored table:
    the months come from the run log, old ones too, and no duplicate is left."""
    lake = scratch_lake(spark, "merged")
    _land_bronze(spark, sf_dir, lake)
    for _ in range(2):
        run_realtime(spark, lake, overlap_days=60)
    merge_silver(spark, lake)
    return lake.read(spark, "silver_events").select(*SILVER_COLUMNS)


@register("silver_from_empty_target", O.with_layers("silver") + "\nSELECT * FROM silver")
def q_silver_from_empty_target(spark, sf_dir):
    """P18/F3 an empty target's bound is 1970-01-01: every valid row is appended."""
    return silver_incremental(I.bronze(spark, sf_dir), I.silver(spark, sf_dir).filter("payment_date < DATE '1970-01-01'"))


# ---------------------------------------------------------------------------
# Lifecycle, schema growth, external and bucketed tables

@register("retention_on_disk", O.with_layers("bronze", bronze=_GATED_BRONZE_MS) + f"""
SELECT event_id, user_id, COALESCE(amount, 0.0) AS amount, COALESCE(status, '') AS status, payment_date, updated_at
FROM bronze WHERE payment_date + INTERVAL {BRONZE_TTL_DAYS} DAY > DATE '{I.EXPIRY_AS_OF}'""")
def q_retention_on_disk(spark, sf_dir):
    """F7/L2 the stored bronze after expiry: whole months left out, the boundary month written anew."""
    lake = scratch_lake(spark, "retention")
    _land_bronze(spark, sf_dir, lake)
    apply_retention(spark, lake.path("bronze_a"), I.EXPIRY_AS_OF, BRONZE_TTL_DAYS)
    generations.vacuum(spark, lake.path("bronze_a"), keep=1)
    return lake.read(spark, "bronze_a").select(*SILVER_COLUMNS)


@register("gold_new_column", O.with_layers("gold") + f"""
SELECT payment_date, total_revenue, total_paid_orders,
       CASE WHEN payment_date > DATE '{I.TARGET_UNTIL}' THEN total_revenue / 2 END AS half_revenue FROM gold""")
def q_gold_new_column(spark, sf_dir):
    """M6 gold gains a column after days were built: later days have it, earlier ones are null."""
    lake = scratch_lake(spark, "gold_grows")
    gold = G.gold_revenue(I.silver_b(spark, sf_dir), with_build_time=False)
    path = lake.path("gold_revenue_daily")
    G.replace_gold_days(spark, gold, path, None)
    later = gold.filter(F.col("payment_date") > F.lit(I.TARGET_UNTIL).cast("date"))
    days = [r[0] for r in later.select("payment_date").distinct().collect()]
    G.replace_gold_days(spark, later.withColumn("half_revenue", F.col("total_revenue").cast("double") / 2), path, days)
    return lake.read(spark, "gold_revenue_daily").select("payment_date", "total_revenue", "total_paid_orders", "half_revenue")


@register("external_bronze_sql", O.with_layers("bronze") + f"""
SELECT status, COUNT(*) AS payments, SUM(CAST(amount AS DECIMAL(12,2))) AS total FROM bronze
WHERE src_id % {CORRUPT_EVERY} <> 0 AND event_id IS NOT NULL AND user_id IS NOT NULL AND payment_date = DATE '{I.AS_OF}'
GROUP BY status""")
def q_external_bronze_sql(spark, sf_dir):
    """S4 lane-B bronze queried where it stands, as a catalog table whose partitions are discovered and pruned."""
    lake, ckpt = _stream_dirs(spark, "external")
    run_to_end(bronze_b_stream(read_validated(spark, _topic(spark, sf_dir, lake)), lake.path("bronze_b"),
                               lake.path("quarantine"), f"{ckpt}/b"))
    name = f"bronze_payments_{lake.root.rsplit('-', 1)[1]}"
    external_table(spark, name, lake.path("bronze_b"))
    return spark.sql(f"SELECT status, count(*) AS payments, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM {name} "
                     f"WHERE payment_date = DATE '{I.AS_OF}' GROUP BY status")


@register("bucketed_upsert", O.with_layers("silver_b") + """
, redo AS (SELECT event_id, user_id, amount, status, payment_date,
                  updated_at + INTERVAL 1 HOUR AS updated_at FROM bronze WHERE src_id % 10 = 0)""" + f"""
, redo_b AS (SELECT event_id, user_id, CAST(amount AS DECIMAL(12,2)) AS amount, {O.STATUS_SQL} AS status,
                    payment_date, updated_at FROM redo WHERE {O.VALID_SQL})
, merged AS (SELECT *, 0 AS src FROM silver_b UNION ALL SELECT *, 1 AS src FROM redo_b)
SELECT event_id, user_id, amount, status, payment_date, updated_at FROM merged
QUALIFY row_number() OVER (PARTITION BY event_id, payment_date ORDER BY src DESC, updated_at DESC) = 1""")
def q_bucketed_upsert(spark, sf_dir):
    """L4/M3 warehouse silver and its updates in 8 buckets of event_id: the merge moves no row between tasks."""
    lake = scratch_lake(spark, "bucketed")
    tag = lake.root.rsplit("-", 1)[1]
    redo = redelivered(I.bronze_with_ids(spark, sf_dir)).drop("src_id", "batch_id")
    updates = latest_by_key(to_warehouse_silver(silver_rows(redo)), list(SILVER_B_KEY), ["updated_at"])
    bucketed_write(I.silver_b(spark, sf_dir), f"silver_payments_{tag}", path=f"{lake.root}/payments")
    bucketed_write(updates, f"silver_updates_{tag}", path=f"{lake.root}/updates")
    return merge_bucketed(spark, f"silver_payments_{tag}", f"silver_updates_{tag}", SILVER_B_KEY)


# ---------------------------------------------------------------------------
# Checks that can fail

@register("lane_lag_behind", O.with_layers("bronze") + f"""
SELECT payment_date, COUNT(*) AS lane_a_rows, COUNT(*) FILTER (WHERE src_id % 7 <> 0) AS lane_b_rows,
       COUNT(*) FILTER (WHERE src_id % 7 = 0) AS lag_rows
FROM bronze WHERE src_id % {CORRUPT_EVERY} <> 0 GROUP BY payment_date""")
def q_lane_lag_behind(spark, sf_dir):
    """J3 lane B has not committed every 7th message yet."""
    topic = I.validated_topic(spark, sf_dir)
    a, _ = I.bronze_a_parsed(spark, sf_dir, topic)
    b, _ = I.bronze_b_parsed(spark, sf_dir, topic.filter(F.col("offset") % 7 != 0))
    return Q.lane_lag_by_day(a, b)


@register("check_length_long", O.with_layers("bronze") + f"""
, long AS (SELECT CASE WHEN src_id % 11 = 0 THEN repeat(event_id, 20) ELSE event_id END AS event_id,
                  CASE WHEN src_id % 17 = 0 THEN concat(status, '{'x' * STATUS_MAX_LEN}') ELSE status END AS status FROM bronze)
SELECT 'max_length' AS check_name, 'event_id' AS column_name, COUNT(*) FILTER (WHERE length(event_id) > {EVENT_ID_MAX_LEN}) AS failures,
       CASE WHEN COUNT(*) FILTER (WHERE length(event_id) > {EVENT_ID_MAX_LEN}) = 0 THEN 'pass' ELSE 'fail' END AS status FROM long
UNION ALL
SELECT 'max_length', 'status', COUNT(*) FILTER (WHERE length(status) > {STATUS_MAX_LEN}),
       CASE WHEN COUNT(*) FILTER (WHERE length(status) > {STATUS_MAX_LEN}) = 0 THEN 'pass' ELSE 'fail' END FROM long""")
def q_check_length_long(spark, sf_dir):
    """Q10 with ids and statuses of which some are too long."""
    rows = I.bronze_with_ids(spark, sf_dir)
    long = rows.select(F.when(F.col("src_id") % 11 == 0, F.repeat("event_id", 20)).otherwise(F.col("event_id")).alias("event_id"),
                       F.when(F.col("src_id") % 17 == 0, F.concat("status", F.lit("x" * STATUS_MAX_LEN))).otherwise(F.col("status")).alias("status"))
    return Q.check_length(long, {"event_id": EVENT_ID_MAX_LEN, "status": STATUS_MAX_LEN})


@register("ingestion_rate_b", O.with_layers("bronze") + f"""
SELECT date_trunc('minute', updated_at) AS minute, COUNT(*) AS rows_ingested FROM bronze
WHERE src_id % {CORRUPT_EVERY} <> 0 AND updated_at > {O.NOW_SQL} - INTERVAL 30 MINUTE GROUP BY 1""")
def q_ingestion_rate_b(spark, sf_dir):
    """G6 lane-B rows a minute by arrival (the event time stands in for it)."""
    b, _ = I.bronze_b_parsed(spark, sf_dir)
    arrived = b.withColumn("ingested_at", F.col("updated_at"))
    return R.ingestion_rate(arrived, I.now_of(spark, sf_dir), 30, "ingested_at")
