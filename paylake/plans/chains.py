"""Layer chains (T7, T8): the scheduled runs of the reference as plain
sequences of Spark jobs with checks between them.  There is no scheduler
here; a caller (cron, an orchestrator, a streaming trigger) calls these.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylake.operators import quality as Q
from paylake.operators.gold import gold_revenue, refresh_gold_days
from paylake.operators.lifecycle import compact, list_partitions
from paylake.operators.merge import (
    align_schema,
    checkpointed,
    latest_by_key,
    merge_partitions,
    overwrite_table,
    sync_silver,
    touched_leaves,
    user_dim,
)
from paylake.operators.sessions import fragments, stitched
from paylake.operators.silver import incremental_since, silver_current, silver_incremental, silver_rows
from paylake.schemas import ACCEPTED_STATUSES, NEW_DATA_MINUTES, RECENT_HOURS
from paylake.session import shared_dir
from paylake.sources import generations
from paylake.sources.tables import Lakehouse


def scratch_lake(spark: SparkSession, name: str) -> Lakehouse:
    """A fresh lakehouse root inside the session's shared checkpoint folder."""
    return Lakehouse(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")


def _wall_clock(spark: SparkSession):
    return spark.range(1).select(F.current_timestamp().cast("timestamp_ntz")).first()[0]


#: One row a silver run, merge or sync: what it wrote, for the runs after it.
RUN_LOG = "kind string, batch_id bigint, months array<int>, rows bigint, ran_at timestamp_ntz"
#: Directories of the run log beyond which they are compacted to one a kind.
LOG_DIRS = 64


def log_run(spark: SparkSession, lake: Lakehouse, kind: str, batch: int, months: list[int], rows: int | None) -> None:
    """Append a row to the run log."""
    path = lake.path("run_log")
    at = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    row = spark.createDataFrame([(kind, batch, sorted(months), rows, at)], RUN_LOG)
    generations.replace(spark, path, row, ["kind"])
    if len(generations.leaves(spark, path)) > LOG_DIRS:
        compact(spark, path, "kind", ["run", "merge", "sync", "sync_b", "users"])
        generations.vacuum(spark, path, keep=LOG_DIRS)


def runs(spark: SparkSession, lake: Lakehouse) -> DataFrame:
    """The run log (empty before the first run)."""
    if generations.pointer(spark, lake.path("run_log")) is None:
        return spark.createDataFrame([], RUN_LOG)
    return lake.read(spark, "run_log").select(*[c.split()[0] for c in RUN_LOG.split(", ")])


def last_batch(spark: SparkSession, lake: Lakehouse, kind: str) -> int | None:
    return runs(spark, lake).filter(F.col("kind") == kind).agg(F.max("batch_id")).first()[0]


def months_since(spark: SparkSession, lake: Lakehouse, kind: str) -> list[int]:
    """The months that silver runs have written since the last run of ``kind``;
    all months of a table whose runs were not logged.  A list of months, so its
    length is bounded by the table's layout."""
    log = runs(spark, lake)
    ran, last = log.agg(F.max(F.when(F.col("kind") == "run", F.col("batch_id"))),
                        F.max(F.when(F.col("kind") == kind, F.col("batch_id")))).first()
    if ran is None:
        return [int(m) for m in list_partitions(spark, lake.path("silver_events"), "payment_month")]
    fresh = log.filter((F.col("kind") == "run") & (F.col("batch_id") > F.lit(-1 if last is None else last)))
    return sorted(r[0] for r in fresh.select(F.explode("months")).distinct().collect())


def recent_target(spark: SparkSession, lake: Lakehouse) -> DataFrame | None:
    """The part of lane-A silver that holds its newest day: the newest month."""
    months = [int(m) for m in list_partitions(spark, lake.path("silver_events"), "payment_month")]
    if not months:
        return None
    return lake.read(spark, "silver_events").filter(F.col("payment_month") == max(months))


def next_batch(spark: SparkSession, lake: Lakehouse) -> int:
    """One more than the newest silver batch, by the run log; a table whose runs
    were not logged is asked itself."""
    last = last_batch(spark, lake, "run")
    if last is None and generations.leaves(spark, lake.path("silver_events")):
        last = lake.read(spark, "silver_events").agg(F.max("batch_id")).first()[0]
    return 0 if last is None else int(last) + 1


def silver_run(spark: SparkSession, lake: Lakehouse, overlap_days: int = 1) -> int:
    """M4: append one incremental run of bronze -> silver; returns rows appended.

    The run's ``batch_id`` is one more than the newest one logged, so the merge
    (M1) can tell later inserts from earlier ones.  The rows are a fresh folder;
    the run log gets the months in it before the commit, so a run that dies leaves
    at most a log row without rows, never rows without a log row.  Columns that
    bronze gains are ignored once silver has its schema (M6)."""
    path = lake.path("silver_events")
    batch = next_batch(spark, lake)
    rows = silver_incremental(lake.read(spark, "bronze_a"), recent_target(spark, lake), overlap_days)
    rows = (rows.withColumn("batch_id", F.lit(batch))
                .withColumn("payment_month", (F.year("payment_date") * 100 + F.month("payment_date")).cast("int")))
    stored = generations.pointer(spark, path)
    if stored:
        rows = align_schema(rows, T.StructType.fromJson(stored["schema"]), "ignore")
    obs = Observation(f"silver_{batch}")

    def log(fresh: list[str]) -> None:
        log_run(spark, lake, "run", batch, [int(generations.level(d, "payment_month")) for d in fresh], int(obs.get["rows"]))

    generations.replace(spark, path, rows.observe(obs, F.count(F.lit(1)).alias("rows")), ["payment_month"],
                        sort_cols=["payment_date", "user_id", "event_id"], before_commit=log)
    return int(obs.get["rows"])


def new_bronze_data(spark: SparkSession, lake: Lakehouse, now, minutes: int) -> bool:
    """Q4 on the lakehouse: from the bronze stream's ingestion log when there is
    one (one row per micro-batch), else from bronze's arrival-time column."""
    if lake.exists(spark, "ingest_log"):
        return Q.has_new_data(lake.read(spark, "ingest_log"), now, minutes, "ingested_at")
    return Q.has_new_data(lake.read(spark, "bronze_a"), now, minutes, "ingested_at")


def run_realtime(spark: SparkSession, lake: Lakehouse, now=None,
                 minutes: int = NEW_DATA_MINUTES, overlap_days: int = 1) -> str:
    """New-data gate on bronze arrival time, then (or skip) a silver run."""
    now = now if now is not None else _wall_clock(spark)
    if not new_bronze_data(spark, lake, now, minutes):
        return "skipped"
    return f"appended {silver_run(spark, lake, overlap_days)}"


def merge_silver(spark: SparkSession, lake: Lakehouse, months: list[int] | None = None) -> int:
    """Background merge of lane-A silver: deduplicate the given months (default:
    every month that a run has written since the last merge)."""
    batch = last_batch(spark, lake, "run")
    if months is None:
        months = months_since(spark, lake, "merge")
    order = ["batch_id", "updated_at", "amount", "status"]
    kept = merge_partitions(spark, lake.path("silver_events"), "payment_month", months,
                            ["payment_date", "user_id", "event_id"], order)
    if batch is not None:
        log_run(spark, lake, "merge", batch, months, kept)
    return kept


def unsynced_batches(spark: SparkSession, lake: Lakehouse) -> DataFrame:
    """Silver rows of the batches appended since the last sync: the run log names
    the months that hold them, so only those are read."""
    last = last_batch(spark, lake, "sync")
    months = months_since(spark, lake, "sync")
    return (lake.read(spark, "silver_events").filter(F.col("payment_month").isin(months))
                .filter(F.col("batch_id") > F.lit(-1 if last is None else last)))


def changed_rows(spark: SparkSession, lake: Lakehouse) -> DataFrame:
    """The current rows that the batches since the last sync have changed, computed
    once: rows of a newer batch win the merge for their keys, so these are the
    unsynced batches merged among themselves."""
    return checkpointed(silver_current(unsynced_batches(spark, lake)))


def sync_new_batches(spark: SparkSession, lake: Lakehouse, changed: DataFrame | None = None) -> list:
    """M7 incrementally: sync only silver batches appended since the last sync
    (``changed``: their rows, if the caller has them).

    The synced batch goes to the run log *after* the upsert: a crash in between
    re-syncs the batch (the upsert is idempotent) instead of losing it.  Rows that
    the warehouse silver can't hold go to the table ``sync_quarantine``, under the
    newest batch of the sync.  Returns the days rewritten."""
    newest, last = next_batch(spark, lake) - 1, last_batch(spark, lake, "sync")
    if newest < 0 or newest == last:
        return []
    months = months_since(spark, lake, "sync")
    days = sync_silver(spark, changed if changed is not None else changed_rows(spark, lake), lake.path("silver_payments"),
                       lake.path("sync_quarantine"), newest, stable=True)
    log_run(spark, lake, "sync", newest, months, None)
    return days


def current_silver(spark: SparkSession, lake: Lakehouse) -> DataFrame:
    """Merged view of the append-only lane-A silver table (what reports read)."""
    return silver_current(lake.read(spark, "silver_events"))


def new_lane_b_rows(spark: SparkSession, lake: Lakehouse) -> tuple[DataFrame | None, int]:
    """Lane-B bronze rows of the batches that the warehouse silver hasn't taken
    yet, and the newest of those batches: found by the directories' names."""
    path, last = lake.path("bronze_b"), last_batch(spark, lake, "sync_b")
    dirs = [d for d in generations.leaves(spark, path)
            if int(generations.level(d, "batch_id")) > (-1 if last is None else last)]
    if not dirs:
        return None, -1 if last is None else last
    return generations.read_some(spark, path, dirs), max(int(generations.level(d, "batch_id")) for d in dirs)


def run_warehouse(spark: SparkSession, lake: Lakehouse) -> dict:
    """Lane B by itself: new bronze batches -> valid rows with normalised status ->
    upsert into warehouse silver -> the rewritten days of gold.  Rows that the
    warehouse silver can't hold go to the quarantine.  The batch is logged after
    the upsert, so a run that dies is done again with the same result."""
    rows, newest = new_lane_b_rows(spark, lake)
    if rows is None:
        return {"days": []}
    Q.raise_on_failure(Q.check_not_null(rows, ["event_id", "user_id", "payment_date"]))
    silver = silver_rows(rows)
    days = sync_silver(spark, silver, lake.path("silver_payments"), lake.path("sync_quarantine_b"), newest)
    log_run(spark, lake, "sync_b", newest, [], None)
    refresh_gold_days(spark, lake.read(spark, "silver_payments"), lake.path("gold_revenue_daily"), days)
    return {"days": days}


def build_user_tables(spark: SparkSession, lake: Lakehouse) -> list[int]:
    """M2 / M8 as tables: ``silver_users`` and ``silver_sessions``, each a new version.

    Both come from stored parts by month -- the latest row of each user, the
    session fragments of each user and chunk -- of which only the months that a
    silver run has written since the last build are computed anew, so a build
    reads those months of silver and the parts, which are far fewer.  Returns the
    months read."""
    months = months_since(spark, lake, "users")
    batch = last_batch(spark, lake, "run")
    if months:
        fresh = silver_current(lake.read(spark, "silver_events").filter(F.col("payment_month").isin(months)))
        users = latest_by_key(fresh, ["user_id", "payment_month"], ["updated_at", "event_id", "payment_date"])
        for layer, parts in (("user_parts", users), ("session_parts", fragments(fresh, extra=["payment_month"]))):
            path = lake.path(layer)
            generations.replace(spark, path, parts, ["payment_month"], touched_leaves(spark, path, "payment_month", months))
    overwrite_table(user_dim(lake.read(spark, "user_parts")), lake.path("silver_users"))
    overwrite_table(stitched(lake.read(spark, "session_parts")), lake.path("silver_sessions"))
    if batch is not None:
        log_run(spark, lake, "users", batch, months, None)
    return months


def run_medallion(spark: SparkSession, lake: Lakehouse, now=None,
                  hours: int = RECENT_HOURS, incremental_gold: bool = False) -> dict:
    """Recency gate -> bronze tests -> silver run -> silver tests -> sync ->
    warehouse silver tests -> gold -> gold tests.  A failing gate or test raises
    and stops what follows.

    ``incremental_gold`` refreshes only the days the sync rewrote in a
    day-partitioned gold table instead of rebuilding gold as a new version
    from all of warehouse silver (the reference's full refresh).  The tests of
    bronze and warehouse silver read the whole tables, or in incremental mode
    the days that the run can append and the days that the sync rewrote.  Bronze
    rows without a payment date belong to no day and are tested in both modes."""
    now = now if now is not None else _wall_clock(spark)
    Q.require_recent(lake.read(spark, "bronze_a"), now, hours, "updated_at")
    bronze = lake.read(spark, "bronze_a")
    target = recent_target(spark, lake) if incremental_gold else None
    if target is not None:
        # no day is on or after the bound for a null date: the rows of the null month are tested with the newer days
        undated = bronze.filter(F.col("payment_date").isNull())
        if "payment_month" in bronze.columns:
            undated = undated.filter(F.col("payment_month").isNull())
        bronze = incremental_since(bronze, target).unionByName(undated)
    Q.raise_on_failure(Q.check_not_null(bronze, ["event_id", "user_id", "payment_date"]))
    appended = silver_run(spark, lake)
    # data tests: all of silver (as a full test run does), or in incremental
    # mode only the rows this run will sync
    changed = changed_rows(spark, lake)
    silver = changed if incremental_gold else current_silver(spark, lake)
    Q.raise_on_failure(Q.check_columns(silver, ["event_id", "payment_date", "amount"], {"status": ACCEPTED_STATUSES}))
    days = sync_new_batches(spark, lake, changed)
    silver_b = lake.read(spark, "silver_payments")
    synced = silver_b.filter(F.col("payment_date").isin(days)) if incremental_gold else silver_b
    Q.raise_on_failure(Q.check_columns(synced, ["event_id", "user_id", "amount", "payment_date"], {"status": ACCEPTED_STATUSES}))
    if incremental_gold:
        refresh_gold_days(spark, silver_b, lake.path("gold_revenue_daily"), days)
        gold, result = lake.read(spark, "gold_revenue_daily"), {"gold_days": days}
    else:
        version = overwrite_table(gold_revenue(silver_b), lake.path("gold_revenue"))
        gold, result = lake.read(spark, "gold_revenue"), {"gold_version": version}
    Q.raise_on_failure(Q.check_not_null(gold, ["payment_date", "total_revenue", "unique_users"]))
    return {"silver_appended": appended, **result}


def realtime_stream(spark: SparkSession, lake: Lakehouse, checkpoint: str,
                    trigger: dict | None = None, overlap_days: int = 1):
    """T6/T7 without a scheduler: a stream over the bronze ingestion log whose
    micro-batches run the silver step (``processingTime='1 minute'`` in
    production).  A streaming query never overlaps itself, so at most one
    silver run is active; a trigger with no new log rows does nothing."""
    log_schema = "rows bigint, ingested_at timestamp_ntz, batch_id bigint"
    log = (spark.readStream.schema(log_schema).option("basePath", lake.path("ingest_log"))
           .parquet(lake.path("ingest_log")))

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(1).count():
            silver_run(spark, lake, overlap_days)

    return (log.writeStream.queryName("realtime_silver").option("checkpointLocation", checkpoint)
               .trigger(**(trigger or {"availableNow": True})).foreachBatch(handle).start())
