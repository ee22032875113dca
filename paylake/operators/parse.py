"""Bronze parsing for both lanes.

Lane A (low latency) parses strictly: a message that does not decode, or
whose date / timestamp text cannot be converted, goes to quarantine with a
reason; absent fields take type defaults (``''`` / ``0``).  Lane B (warehouse)
parses leniently: a bad field becomes NULL, rows without the key fields are
filtered and the amount becomes DECIMAL(12,2).

Each ``bronze_*`` function returns ``(bronze_rows, quarantine_rows)``; both are
lazy frames over the same input, so a stream writes them from one
``foreachBatch`` (see :mod:`paylake.streaming.ingest`).  All parsing is
``from_json`` plus native casts: row-local, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylake.functions import (
    ingest_time,
    parse_date_strict,
    parse_timestamp_ms,
    payment_month,
    to_amount_decimal,
)
from paylake.schemas import LONG_MAX, MAX_BROKEN_MESSAGES, RAW_PAYMENT_SCHEMA
from paylake.session import computed

_CORRUPT = "_corrupt"
_STRICT_SCHEMA = T.StructType(RAW_PAYMENT_SCHEMA.fields + [T.StructField(_CORRUPT, T.StringType())])


def _long_range(user_id: Column) -> Column:
    return user_id <= F.lit(str(LONG_MAX)).cast("decimal(20,0)")


def parse_strict(df: DataFrame, value_col: str = "value") -> DataFrame:
    """V6: decode each message; ``_error`` is ``''`` for a clean decode.

    ``from_json`` runs in PERMISSIVE mode with a corrupt-record column, so a
    message that is not a JSON object of the declared types gets an error
    instead of failing the batch (the engine's error-stream mode).
    """
    parsed = F.from_json(F.col(value_col), _STRICT_SCHEMA,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    out = computed(df.withColumn("_p", parsed))
    error = (F.when(F.col("_p").isNull() | F.col(f"_p.{_CORRUPT}").isNotNull(),
                    F.lit("undecodable"))
             .otherwise(F.lit("")))
    return out.select("*", *[F.col(f"_p.{f}").alias(f) for f in RAW_PAYMENT_SCHEMA.fieldNames()],
                      error.alias("_error")).drop("_p")


def fill_lane_a_defaults(parsed: DataFrame) -> DataFrame:
    """V9: absent / null fields take their column default, as in a non-nullable
    column store: strings ``''``, numbers ``0``."""
    return parsed.select(
        *[c for c in parsed.columns if c not in ("event_id", "user_id", "amount", "status",
                                                 "payment_date", "updated_at")],
        F.coalesce("event_id", F.lit("")).alias("event_id"),
        F.coalesce("user_id", F.lit(0).cast("decimal(20,0)")).alias("user_id"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("payment_date", F.lit("")).alias("payment_date"),
        F.coalesce("updated_at", F.lit("")).alias("updated_at"),
    )


def conversion_reason(user_id: Column, date_text: Column, ts_text: Column | None,
                      date_value: Column, ts_value: Column | None) -> Column:
    """Why a decoded row cannot be stored (NULL when it can)."""
    reason = (F.when(user_id.isNotNull() & ~_long_range(user_id), F.lit("user_id_out_of_range"))
              .when(date_text.isNotNull() & date_value.isNull(), F.lit("bad_payment_date")))
    if ts_text is not None:
        reason = reason.when(ts_text.isNotNull() & ts_value.isNull(), F.lit("bad_updated_at"))
    return reason


def stage_lane_a(messages: DataFrame, value_col: str = "value",
                 ingested_at: Column | None = None) -> DataFrame:
    """Lane-A parse of every message into bronze columns plus ``_value`` (the
    original text) and ``_reason`` (NULL when the row can be stored).

    Split with :func:`split_staged`; persist the staged frame first when both
    sides are written, so each message is parsed once."""
    parsed = fill_lane_a_defaults(parse_strict(messages, value_col)).withColumns(
        {"_date": parse_date_strict(F.col("payment_date")), "_ts": parse_timestamp_ms(F.col("updated_at"))})
    date_value, ts_value = F.col("_date"), F.col("_ts")
    reason = (F.when(F.col("_error") != "", F.col("_error"))
              .otherwise(conversion_reason(F.col("user_id"), F.col("payment_date"),
                                           F.col("updated_at"), date_value, ts_value)))
    return computed(parsed.select(
        F.col(value_col).alias("_value"), reason.alias("_reason"),
        F.col("event_id"), F.col("user_id").try_cast("bigint").alias("user_id"),
        F.col("amount"), F.col("status"),
        date_value.alias("payment_date"), ts_value.alias("updated_at"),
        (ingested_at if ingested_at is not None else ingest_time()).alias("ingested_at"),
    )).withColumn("payment_month", payment_month("payment_date"))


def split_staged(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(storable rows without the staging columns, quarantine ``(value, reason)``)."""
    good = staged.filter(F.col("_reason").isNull()).drop("_value", "_reason")
    bad = staged.filter(F.col("_reason").isNotNull()).select(
        F.col("_value").alias("value"), F.col("_reason").alias("reason"))
    return good, bad


def bronze_lane_a(messages: DataFrame, value_col: str = "value",
                  ingested_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """K2 transform: messages -> lane-A bronze rows and quarantined messages.

    Output columns: event_id, user_id (BIGINT), amount (DOUBLE), status,
    payment_date (DATE), updated_at / ingested_at (TIMESTAMP_NTZ, ms),
    payment_month (INT partition key).
    """
    return split_staged(stage_lane_a(messages, value_col, ingested_at))


def parse_lenient(df: DataFrame, value_col: str = "value") -> DataFrame:
    """V8: decode with bad fields as NULL; a message that is not a JSON object
    at all (no struct) is skipped."""
    parsed = F.from_json(F.col(value_col), RAW_PAYMENT_SCHEMA, {"mode": "PERMISSIVE"})
    return (computed(df.withColumn("_p", parsed)).filter(F.col("_p").isNotNull())
              .select("*", *[F.col(f"_p.{f}").alias(f) for f in RAW_PAYMENT_SCHEMA.fieldNames()])
              .drop("_p"))


def bronze_b_filter(parsed: DataFrame) -> DataFrame:
    """the key fields must be present (raw text tested before any cast)."""
    return parsed.filter(F.col("event_id").isNotNull() & F.col("user_id").isNotNull()
                         & F.col("payment_date").isNotNull())


def stage_lane_b(messages: DataFrame, value_col: str = "value",
                 ingested_at: Column | None = None) -> DataFrame:
    """Lane-B parse into bronze columns plus ``_value`` / ``_reason`` (see
    :func:`stage_lane_a`)."""
    parsed = bronze_b_filter(parse_lenient(messages, value_col))
    date_value = parse_date_strict(F.col("payment_date"))
    amount = to_amount_decimal(F.col("amount"))
    reason = (conversion_reason(F.col("user_id"), F.col("payment_date"), None, date_value, None)
              .when(F.col("amount").isNotNull() & amount.isNull(), F.lit("amount_out_of_range")))
    return computed(parsed.select(
        F.col(value_col).alias("_value"), reason.alias("_reason"),
        "event_id", F.col("user_id").try_cast("bigint").alias("user_id"),
        amount.alias("amount"), "status", date_value.alias("payment_date"),
        parse_timestamp_ms(F.col("updated_at")).alias("updated_at"),
        (ingested_at if ingested_at is not None else ingest_time()).alias("ingested_at")))


def bronze_lane_b(messages: DataFrame, value_col: str = "value",
                  ingested_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """K3 transform: messages -> lane-B bronze rows and quarantined messages.

    amount is DECIMAL(12,2) (HALF_UP; an amount that overflows is quarantined),
    a payment_date that is not a real ``YYYY-MM-DD`` day is quarantined, an
    unparseable updated_at becomes NULL.
    """
    return split_staged(stage_lane_b(messages, value_col, ingested_at))


def quarantine_bad_dates(bronze_raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V10 on already-decoded rows with text dates: (convertible rows, the rest).

    Convertible rows get DATE / TIMESTAMP_NTZ columns; the rest keep their text
    and carry a ``reason``.
    """
    date_value = parse_date_strict(F.col("payment_date"))
    ts_value = parse_timestamp_ms(F.col("updated_at"))
    reason = (F.when(date_value.isNull(), F.lit("bad_payment_date"))
              .when(F.col("updated_at").isNotNull() & ts_value.isNull(), F.lit("bad_updated_at")))
    staged = bronze_raw.withColumn("reason", reason)
    good = (staged.filter(F.col("reason").isNull()).drop("reason")
                  .withColumn("payment_date", date_value).withColumn("updated_at", ts_value))
    return good, staged.filter(F.col("reason").isNotNull())


def enforce_broken_budget(broken_count: int, max_broken: int = MAX_BROKEN_MESSAGES) -> None:
    """V7: stop the stream when a micro-batch holds more broken messages than allowed."""
    if max_broken is not None and broken_count > max_broken:
        raise RuntimeError(
            f"{broken_count} broken messages in one batch exceeds the budget of {max_broken}")
