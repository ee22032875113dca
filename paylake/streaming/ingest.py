"""Streaming jobs.

Every query has its own checkpoint (its own source position, T1).  Writes
that produce more than one output (rows + quarantine) go through
``foreachBatch`` and are idempotent per micro-batch: each batch overwrites
only its own ``batch_id`` partitions (dynamic partition overwrite), so a
batch replayed after a failure replaces, never duplicates, its output.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from paylake.functions import minute_of
from paylake.operators.gate import gate_counter_columns, to_keyed, validate_events
from paylake.operators.merge import partition_values, touched_leaves
from paylake.operators.parse import enforce_broken_budget, split_staged, stage_lane_a, stage_lane_b
from paylake.session import spread
from paylake.sources import generations
from paylake.sources.streams import BLOCK_ROWS

_LOG = logging.getLogger("paylake.streaming")


def _write_batch(df: DataFrame, path: str, batch_id: int, partition_cols: Sequence[str] = (),
                 fmt: str = "parquet", max_records_per_file: int = 0) -> None:
    """Idempotent micro-batch write: overwrite this batch's partitions only.

    Inside ``foreachBatch`` this is a batch job with AQE, so the REBALANCE on
    the partition columns (K4) turns a batch that is mostly one day into
    ~64 MB files instead of one small file per input task and day."""
    out = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    if partition_cols:
        out = out.hint("rebalance", *partition_cols)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*partition_cols, "batch_id").format(fmt).save(path))


def write_validated(keyed: DataFrame, sink: str, batch_id: int) -> None:
    """K1: publish validated messages.  ``kafka://host:port/topic`` gets
    ``(key, value)`` records keyed by event_id (the producer partitions by the
    key); a directory gets the original text as one line per message, in files of
    one block (``BLOCK_ROWS``) at most, so its readers can take bounded batches."""
    if sink.startswith("kafka://"):
        servers, _, topic = sink[len("kafka://"):].partition("/")
        (keyed.select("key", "value").write.format("kafka")
              .option("kafka.bootstrap.servers", servers).option("topic", topic).save())
    else:
        _write_batch(keyed.select("value"), sink, batch_id, fmt="text", max_records_per_file=BLOCK_ROWS)


#: Keeps a query's state on the executors' disks and its changes in the checkpoint,
#: so state is bounded by disks, not by heaps.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_with_state_partitions(writer, spark, state_partitions: int | None, on_disk: bool = False) -> StreamingQuery:
    """Start a stream.  A stateful query fixes its number of state partitions
    (``spark.sql.shuffle.partitions``) and its state store at its first start
    (both are then kept in the checkpoint); ``state_partitions`` and ``on_disk``
    set them for this start only."""
    wanted = {"spark.sql.shuffle.partitions": str(state_partitions) if state_partitions else None,
              "spark.sql.streaming.stateStore.providerClass": ROCKSDB if on_disk else None}
    previous = {k: spark.conf.get(k) for k, v in wanted.items() if v}
    for key in previous:
        spark.conf.set(key, wanted[key])
    try:
        return writer.start()
    finally:
        for key, value in previous.items():
            spark.conf.set(key, value)


def _start(stream: DataFrame, name: str, checkpoint: str, handler: Callable | None = None,
           trigger: dict | None = None, output_mode: str = "append",
           state_partitions: int | None = None, on_disk: bool = False) -> StreamingQuery:
    writer = (stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
              .outputMode(output_mode).trigger(**(trigger or {"availableNow": True})))
    if handler is not None:
        writer = writer.foreachBatch(handler)
    return start_with_state_partitions(writer, stream.sparkSession, state_partitions, on_disk)


def gate_stream(messages: DataFrame, validated_path: str, quarantine_path: str,
                checkpoint: str, trigger: dict | None = None,
                on_counters: Callable[[int, dict], None] | None = None,
                min_partitions: int | None = None) -> StreamingQuery:
    """S1 -> V1..V5 -> K1: forward messages that pass the gate (original text)
    and quarantine the rest; the source position advances whether or not
    messages were dropped (V2).

    Counters (V4) are observed on the stream as ``gate`` -- every progress
    event carries them in ``observedMetrics`` (see :class:`CounterLog`) -- and
    also handed to ``on_counters(batch_id, {...})`` synchronously per batch.
    ``min_partitions`` spreads micro-batches that arrive in fewer splits over
    that many tasks before validating (file sources; Kafka sources split with
    their own ``minPartitions`` option)."""
    stream = messages.select("value")
    if min_partitions:
        stream = stream.repartition(min_partitions)
    checked = validate_events(stream).observe("gate", *gate_counter_columns())

    def handle(batch: DataFrame, batch_id: int) -> None:
        staged = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            from pyspark.sql import Observation
            obs = Observation(f"gate_{batch_id}")
            good = staged.observe(obs, *gate_counter_columns()).filter(F.col("ok"))
            write_validated(to_keyed(good), validated_path, batch_id)
            _write_batch(staged.filter(~F.col("ok")).select("value", "reason"),
                         quarantine_path, batch_id)
            if on_counters is not None:
                on_counters(batch_id, obs.get)
        finally:
            staged.unpersist()

    return _start(checked, "gate", checkpoint, handle, trigger)


class CounterLog(StreamingQueryListener):
    """V4 reporting: logs a stream's observed counters at every progress event
    (every trigger, e.g. ``processingTime='10 seconds'``) and the totals when
    the query ends.  Register with ``spark.streams.addListener(CounterLog())``."""

    def __init__(self, name: str = "gate", sink: Callable[[dict], None] | None = None):
        self.name = name
        self.totals: dict[str, int] = {}
        self.sink = sink or (lambda record: _LOG.info("%s", record))

    def onQueryStarted(self, event) -> None:  # noqa: N802 (listener API)
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics is None:
            return
        values = metrics.asDict()
        for key, value in values.items():
            self.totals[key] = self.totals.get(key, 0) + (value or 0)
        self.sink({"batch": event.progress.batchId, **values})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.sink({"final": dict(self.totals)})


def ingest_log_path(table_path: str) -> str:
    """Where a bronze stream logs its micro-batches: ``<dir>/_ingest_log/<table>``."""
    parent, table = table_path.rstrip("/").rsplit("/", 1)
    return f"{parent}/_ingest_log/{table}"


def _bronze_stream(lane: Callable, messages: DataFrame, table_path: str, quarantine_path: str,
                   checkpoint: str, partition_col: str, trigger: dict | None,
                   max_broken: int | None, name: str,
                   min_partitions: int | None = None) -> StreamingQuery:
    """Shared lane driver.  Besides rows and quarantine, each micro-batch logs
    one row ``(batch_id, rows, ingested_at)`` -- the arrival time is constant
    within a batch -- so arrival-time questions (new-data gate, ingestion rate)
    read the small log instead of scanning bronze."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        if min_partitions:
            batch = spread(batch, min_partitions)
        staged = lane(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = split_staged(staged)
            if max_broken is not None:
                enforce_broken_budget(bad.count(), max_broken)
            from pyspark.sql import Observation
            obs = Observation(f"{name}_{batch_id}")
            observed = good.observe(obs, F.count(F.lit(1)).alias("rows"),
                                    F.max("ingested_at").alias("ingested_at"))
            _write_batch(observed, table_path, batch_id, [partition_col])
            _write_batch(bad, quarantine_path, batch_id)
            stats = obs.get
            if stats["rows"]:
                log = batch.sparkSession.createDataFrame(
                    [(int(stats["rows"]), stats["ingested_at"])],
                    "rows bigint, ingested_at timestamp_ntz")
                _write_batch(log, ingest_log_path(table_path), batch_id)
        finally:
            staged.unpersist()

    return _start(messages.select("value"), name, checkpoint, handle, trigger)


def bronze_a_stream(messages: DataFrame, table_path: str, quarantine_path: str,
                    checkpoint: str, trigger: dict | None = None,
                    max_broken: int | None = None,
                    min_partitions: int | None = None) -> StreamingQuery:
    """K2: each consumed block is parsed strictly (V6-V10) and appended to the
    month-partitioned lane-A bronze; failures go to quarantine.  The broken-
    message budget (V7) is off by default, as in the engine's error-stream mode."""
    return _bronze_stream(stage_lane_a, messages, table_path, quarantine_path, checkpoint,
                          "payment_month", trigger, max_broken, "bronze_a", min_partitions)


def bronze_b_stream(messages: DataFrame, table_path: str, quarantine_path: str,
                    checkpoint: str, trigger: dict | None = None,
                    min_partitions: int | None = None) -> StreamingQuery:
    """K3: lenient parse (V8, F2, P4) into the day-partitioned lane-B bronze.
    Production trigger: ``{"processingTime": "60 seconds"}`` (commit interval);
    a replayed batch replaces its own output at job commit, so rows are never
    duplicated (effectively exactly once)."""
    return _bronze_stream(stage_lane_b, messages, table_path, quarantine_path, checkpoint,
                          "payment_date", trigger or {"availableNow": True}, None, "bronze_b",
                          min_partitions)


def event_time(col: str) -> Column:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): UTC wall clock -> instant."""
    return F.col(col).cast("timestamp")


def minute_counts_stream(rows: DataFrame, ts_col: str, out_path: str, checkpoint: str,
                         trigger: dict | None = None) -> StreamingQuery:
    """T5: one-minute counts, whatever the order of arrival: every micro-batch
    writes its own counts under its ``batch_id`` and :func:`minute_counts` adds
    them up.  There is no state and no watermark, so no late row is lost."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch.groupBy(minute_of(F.col(ts_col)).alias("minute")).agg(F.count(F.lit(1)).alias("rows"))
                     .withColumn("day", F.to_date("minute")), out_path, batch_id, ["day"])

    return _start(rows, "minute_counts", checkpoint, handle, trigger)


def minute_counts(counts: DataFrame) -> DataFrame:
    """T5 read side: the counts of all batches by minute."""
    return counts.groupBy("minute").agg(F.sum("rows").cast("bigint").alias("rows"))


def dedup_table_stream(rows: DataFrame, keys: Sequence[str], out_path: str, checkpoint: str,
                       partition_col: str = "payment_date", trigger: dict | None = None) -> StreamingQuery:
    """T2 without a time limit: append the rows whose ``keys`` the table doesn't
    hold yet.  Copies in a micro-batch are combined before the shuffle; copies
    of stored rows are found by an anti join with the partitions that the batch
    touches only (``partition_col`` is one of the keys, so copies share it).
    Rows may come as late as they like; a replayed batch replaces itself."""
    if partition_col not in keys:
        raise ValueError(f"{partition_col} must be one of the keys")
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        dirs = [d for d in touched_leaves(spark, out_path, partition_col, partition_values(batch, partition_col))
                if generations.level(d, "batch_id") != str(batch_id)]
        if dirs:
            stored = generations.read_leaves(spark, out_path, dirs, stored_schema).select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            new = new.join(stored, same, "left_anti")
        _write_batch(new, out_path, batch_id, [partition_col])

    stored_schema = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.LongType())])
    return _start(rows, "dedup_table", checkpoint, handle, trigger)


def dedup_state_stream(rows: DataFrame, keys: Sequence[str], out_path: str, checkpoint: str,
                       partition_col: str = "payment_date", trigger: dict | None = None,
                       state_partitions: int | None = None) -> StreamingQuery:
    """T2 without a time limit and at a cost per batch that doesn't grow with the
    table: the keys ever stored are the query's state, on disk, and a batch looks
    up its own keys only.  No stored row is read; rows may come as late as they
    like, and a replayed batch replaces itself.  The state holds every key; a
    stream of 90 days at 500 a second has about 4 billion."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, out_path, batch_id, [partition_col])

    return _start(rows.dropDuplicates(list(keys)), "dedup_state", checkpoint, handle, trigger,
                  state_partitions=state_partitions, on_disk=True)


def dedup_stream(rows: DataFrame, keys: Sequence[str], ts_col: str, delay: str = "1 hour") -> DataFrame:
    """T2 with bounded state: drop redelivered copies that arrive within ``delay``
    of each other.  Rows later than ``delay`` are dropped by the watermark; where
    that can happen use :func:`dedup_table_stream`."""
    return (rows.withColumn("_et", event_time(ts_col)).withWatermark("_et", delay)
                .dropDuplicatesWithinWatermark(list(keys)).drop("_et"))


def dedup_stream_combined(rows: DataFrame, key: str, ts_col: str,
                          delay: str = "1 hour") -> DataFrame:
    """T2 for keys with very many copies: deduplicate by ``(key, event time)``
    as a watermarked streaming aggregation.  Copies are combined map-side
    (``partial_max`` before the shuffle), so a key with a third of all rows
    does not land on one task.  Trade-off: in append mode a key is emitted
    once the watermark has passed its event time (``delay`` after newer data
    arrives), not immediately; the survivor is the greatest copy (a total
    order over the remaining columns)."""
    timed = rows.withColumn("_et", event_time(ts_col)).withWatermark("_et", delay)
    rest = [c for c in rows.columns if c != key]
    return (timed.groupBy(key, "_et").agg(F.max(F.struct(*rest)).alias("_row"))
                 .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]))


def append_stream(rows: DataFrame, path: str, checkpoint: str, partition_cols: Sequence[str] = (),
                  trigger: dict | None = None, max_records_per_file: int | None = None,
                  state_partitions: int | None = None) -> StreamingQuery:
    """Plain exactly-once file sink (the file sink's commit log)."""
    writer = (rows.writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append")
              .trigger(**(trigger or {"availableNow": True})))
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    return start_with_state_partitions(writer, rows.sparkSession, state_partitions)


def run_to_end(query: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for an ``availableNow`` query to finish; re-raise its failure."""
    query.awaitTermination(timeout_s)
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return query
