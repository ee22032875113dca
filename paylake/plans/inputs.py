"""Shared inputs of the registered queries: driver tables -> stand-in payment
layers, all built lazily with the library's own operators.

Anchors are never the wall clock: ``AS_OF`` is a fixed day and ``now`` is the
newest event time in the data (a scalar subquery, so it scales with the data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.operators.gate import validate_events, split_valid
from paylake.operators.merge import sync_frame
from paylake.operators.parse import bronze_lane_a, bronze_lane_b
from paylake.operators.silver import silver_current, silver_rows
from paylake.session import configure, shared_dir, spread
from paylake.sources.driver_tables import (
    driver_table,
    payments_from_events,
    payments_from_lineitem,
    raw_payloads,
)

# Fixed report anchors for the driver's January-2024 event tables.
AS_OF = "2024-01-30"
# Day up to which the incremental target is pre-built.
TARGET_UNTIL = "2024-01-20"
# An as-of far enough ahead that retention / partition windows expire data.
EXPIRY_AS_OF = "2024-04-15"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every query relies on (UTC, variant duplicate keys, AQE)."""
    return configure(spark)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "events")


def now_of(spark: SparkSession, sf_dir: str) -> Column:
    """``now`` = newest event time (scalar subquery, TIMESTAMP_NTZ)."""
    return events(spark, sf_dir).select(F.max("ts").cast("timestamp_ntz")).scalar()


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bronze rows planted with every bad-data class (from ``events``)."""
    return payments_from_events(events(spark, sf_dir))


def bronze_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments_from_events(events(spark, sf_dir), keep_source_id=True)


def lineitem_bronze(spark: SparkSession, sf_dir: str, keep_source_id: bool = False) -> DataFrame:
    """A larger bronze with a non-unique key (from ``lineitem``), spread over
    the cores (the driver file is a single row group)."""
    return payments_from_lineitem(spread(driver_table(spark, sf_dir, "lineitem")), keep_source_id)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane-A silver: one full run over bronze."""
    return silver_rows(bronze(spark, sf_dir))


def silver_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current (merged) lane-A silver that the reports read."""
    return silver_current(silver(spark, sf_dir).withColumn("batch_id", F.lit(0)))


def silver_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse silver: current lane-A silver synced with DECIMAL amounts."""
    return sync_frame(silver_now(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON messages ``(offset, value)`` built from ``events`` and
    materialised like a produced topic: spread over at least one partition per
    core and written once to the shared checkpoint folder.

    Materialising matters: a repartition alone is no barrier for Catalyst, which
    would push the gate's filter below it, back into the single-split scan."""
    shared_dir(spark)
    return raw_payloads(spread(events(spark, sf_dir))).checkpoint(eager=True)


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that pass the gate."""
    good, _ = split_valid(validate_events(messages(spark, sf_dir)))
    return good


def validated_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's output written once (reliable checkpoint in the shared
    folder), as the validated topic both lanes consume."""
    shared_dir(spark)
    return gated(spark, sf_dir).checkpoint(eager=True)


def bronze_a_parsed(spark: SparkSession, sf_dir: str,
                    topic: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return bronze_lane_a(topic if topic is not None else gated(spark, sf_dir))


def bronze_b_parsed(spark: SparkSession, sf_dir: str,
                    topic: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return bronze_lane_b(topic if topic is not None else gated(spark, sf_dir))


def silver_b_from_messages(spark: SparkSession, sf_dir: str,
                           topic: DataFrame | None = None) -> DataFrame:
    """Warehouse silver fed from the message path: gate -> lane-A bronze ->
    silver -> sync."""
    bronze_a, _ = bronze_a_parsed(spark, sf_dir, topic)
    return sync_frame(silver_current(silver_rows(bronze_a).withColumn("batch_id", F.lit(0))))
