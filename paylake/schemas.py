"""Table schemas and the fixed value sets of the payment data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
# Valid normalised statuses, then the catch-all.
VALID_STATUSES = ("paid", "pending", "failed", "refunded", "cancelled")
UNKNOWN_STATUS = "unknown"
ACCEPTED_STATUSES = VALID_STATUSES + (UNKNOWN_STATUS,)
# Lane-B column widths: VARCHAR(64) event_id, VARCHAR(20) status.
EVENT_ID_MAX_LEN = 64
STATUS_MAX_LEN = 20
# Lane-B amount type.
AMOUNT_DECIMAL = T.DecimalType(12, 2)
# Largest unsigned 64-bit user id a JSON decoder accepts.
UINT64_MAX = 18446744073709551615
LONG_MAX = 9223372036854775807
# Defaults: bronze TTL, warehouse partition window, freshness thresholds.
BRONZE_TTL_DAYS = 90
PARTITION_WINDOW_MONTHS = 6
FRESHNESS_WARN_HOURS = 2
FRESHNESS_ERROR_HOURS = 6
NEW_DATA_MINUTES = 6
RECENT_HOURS = 2
MAX_BROKEN_MESSAGES = 1000
# ---------------------------------------------------------------------------

# The six payment fields as they travel in JSON (dates still text).
RAW_FIELDS = ("event_id", "user_id", "amount", "status", "payment_date", "updated_at")

# Lane A reads user_id as unsigned 64-bit: parse wide, range-check, then narrow.
RAW_PAYMENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.DecimalType(20, 0)),
    T.StructField("amount", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("payment_date", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

BRONZE_A_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("payment_date", T.DateType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
    T.StructField("ingested_at", T.TimestampNTZType(), False),
])

BRONZE_B_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("amount", AMOUNT_DECIMAL),
    T.StructField("status", T.StringType()),
    T.StructField("payment_date", T.DateType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("ingested_at", T.TimestampNTZType()),
])

SILVER_COLUMNS = ("event_id", "user_id", "amount", "status", "payment_date", "updated_at")

# Lane-A silver sort/dedup key and lane-B primary key.
SILVER_A_KEY = ("payment_date", "user_id", "event_id")
SILVER_B_KEY = ("event_id", "payment_date")

QUARANTINE_SCHEMA = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("reason", T.StringType()),
])
