"""Stand-in payment inputs derived from the driver's test tables.

These builders only shape rows into the schemas the jobs expect (raw bronze
rows, JSON payloads, redelivered duplicates); they do none of the jobs' work.
The bad-data classes are planted by fixed modulus rules on the source id so
that every class occurs at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Payloads the gate must reject, in the order they are cycled
# through when a payload is corrupted (one per 50 source rows), each with the
# class it falls in: not valid JSON text of exactly one value
# (malformed_json), valid JSON but not an object (not_an_object), or an object
# with a field of the wrong JSON kind (bad_field_type).
REJECT_CASES = (
    ("", "malformed_json"),
    ("{}] [{}", "malformed_json"),
    ("{}, 1", "malformed_json"),
    ("{}],[{}", "malformed_json"),
    ("[1]", "not_an_object"),
    ('[{"event_id":"a"}]', "not_an_object"),
    ('{"event_id":"a"', "malformed_json"),
    ('{"event_id":"a"} x', "malformed_json"),
    ('{"event_id":"a"}{"b":1}', "malformed_json"),
    ('{}, "b":{}', "malformed_json"),
    ('{} , "z":1', "malformed_json"),
    ('{"q":1},"a":{}', "malformed_json"),
    ("{'event_id':'a'}", "malformed_json"),
    ('{"amount":NaN}', "malformed_json"),
    ('{"event_id":"a",}', "malformed_json"),
    ('{"user_id":-5}', "bad_field_type"),
    ('{"user_id":1.5}', "bad_field_type"),
    ('{"user_id":1.0}', "bad_field_type"),
    ('{"user_id":1e3}', "bad_field_type"),
    ('{"user_id":"12"}', "bad_field_type"),
    ('{"user_id":012}', "malformed_json"),
    ('{"user_id":18446744073709551616}', "bad_field_type"),
    ('{"USER_ID":"x"}', "bad_field_type"),
    ('{"event_id":5}', "bad_field_type"),
    ('{"amount":"1.5"}', "bad_field_type"),
    ('{"amount":true}', "bad_field_type"),
    ('{"amount":1e400}', "bad_field_type"),
    ("5", "not_an_object"),
    ('"s"', "not_an_object"),
    ("true", "not_an_object"),
    ('{"status":["a"]}', "bad_field_type"),
    ('{"payment_date":{"a":1}}', "bad_field_type"),
    ('{"event_id":"a" /* note */}', "malformed_json"),
    ('{event_id:"a"}', "malformed_json"),
    ('{"event_id":"a\tb"}', "malformed_json"),
    ('{"user_id":"x","user_id":5}', "bad_field_type"),
    ('{"event_id":5,"event_id":"a"}', "bad_field_type"),
    ('{"amount":"1","amount":1}', "bad_field_type"),
)
REJECT_PAYLOADS = tuple(payload for payload, _ in REJECT_CASES)
# Payloads the gate must accept.
ACCEPT_PAYLOADS = (
    '{"event_id":"e1","user_id":7,"amount":12.5,"status":"paid",'
    '"payment_date":"2024-01-15","updated_at":"2024-01-15T10:30:00.123456789Z"}',
    "{}",
    "null",
    '{"event_id":"a","zz":1}',
    '{"event_id":"a","event_id":"b"}',
    '{"EVENT_ID":"a"}',
    '{"event_id":null,"user_id":null,"amount":null}',
    '{"user_id":18446744073709551615}',
    '{"user_id":0}',
    '{"amount":1e3}',
    '{"amount":-0}',
    '{"amount":12345678901234567890123456789012345678901234567890}',
    '  {"event_id":"a"}\n',
    '{"event_id":"a","extra":{"x":[1,{"y":null}],"s":"t"}}',
)
# Every CORRUPT_EVERY-th source row becomes a reject payload.
CORRUPT_EVERY = 50
# ---------------------------------------------------------------------------


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, e.g. ``driver_table(spark, '/root/testdata/sf0.01', 'events')``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _planted(src_id: Column, user_id: Column, value: Column, ts: Column) -> list[Column]:
    """The six raw payment columns with every bad-data class planted by ``src_id``."""
    event_id = (F.when(src_id % 97 == 0, F.lit(""))
                .otherwise(F.concat(F.lit("evt-"), src_id.cast("string"))))
    user = F.when(src_id % 89 == 0, F.lit(0).cast("bigint")).otherwise(user_id.cast("bigint"))
    amount = (F.when(src_id % 20 == 0, -value)
              .when(src_id % 20 == 1, F.lit(0.0))
              .when(src_id % 101 == 0, F.lit(None).cast("double"))
              .otherwise(value))
    status = (F.when(src_id % 103 == 0, F.lit(None).cast("string"))
              .when(src_id % 107 == 0, F.lit(""))
              .when(src_id % 109 == 0, F.lit(" Paid "))
              .when(src_id % 13 < 6, F.lit("paid"))
              .when(src_id % 13 < 8, F.lit("pending"))
              .when(src_id % 13 == 8, F.lit("failed"))
              .when(src_id % 13 == 9, F.lit("refunded"))
              .when(src_id % 13 == 10, F.lit("cancelled"))
              .when(src_id % 13 == 11, F.lit("PAID"))
              .otherwise(F.lit("invalid_status")))
    return [event_id.alias("event_id"), user.alias("user_id"), amount.alias("amount"),
            status.alias("status"), ts.cast("date").alias("payment_date"),
            ts.cast("timestamp_ntz").alias("updated_at")]


def payments_from_events(events: DataFrame, keep_source_id: bool = False) -> DataFrame:
    """Raw bronze payment rows from ``events`` (event_id, user_id, value, ts)."""
    src = F.col("event_id")
    cols = _planted(src, F.col("user_id"), F.col("value"), F.col("ts"))
    if keep_source_id:
        cols.append(src.alias("src_id"))
    return events.select(*cols)


def payments_from_lineitem(lineitem: DataFrame, keep_source_id: bool = False) -> DataFrame:
    """Raw bronze payment rows from ``lineitem``: suppliers as users, extended
    price as amount, ship date as time, ``l_orderkey * 8 + l_linenumber`` as the
    id number.  That id is not unique, which makes this a dedup/upsert input."""
    src = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    cols = _planted(src, F.col("l_suppkey"), F.col("l_extendedprice"), F.col("l_shipdate"))
    if keep_source_id:
        cols.append(src.alias("src_id"))
    return lineitem.select(*cols)


def raw_payloads(events: DataFrame) -> DataFrame:
    """JSON text messages ``(offset, value)`` as a producer would publish them.

    Each event becomes one JSON object (NULL fields omitted, dates as
    ``YYYY-MM-DD``, times as RFC3339 with ``Z``); every 50th message is
    replaced by the next payload of :data:`REJECT_PAYLOADS`.
    """
    rows = payments_from_events(events, keep_source_id=True)
    body = F.to_json(F.struct(
        "event_id", "user_id", "amount", "status",
        F.date_format("payment_date", "yyyy-MM-dd").alias("payment_date"),
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("updated_at"),
    ))
    rejects = F.array(*[F.lit(p) for p in REJECT_PAYLOADS])
    pick = (F.col("src_id") / CORRUPT_EVERY).cast("bigint") % len(REJECT_PAYLOADS)
    value = F.when(F.col("src_id") % CORRUPT_EVERY == 0,
                   F.element_at(rejects, (pick + 1).cast("int"))).otherwise(body)
    return rows.select(F.col("src_id").alias("offset"), value.alias("value"))


def dirty_payloads(events: DataFrame) -> DataFrame:
    """JSON messages ``(offset, value)`` of which six of seven have a flaw that the
    gate lets pass: a date that doesn't exist, a time that is none, a user id
    beyond 2^63, an amount beyond DECIMAL(12,2), ``null`` and ``{}``."""
    rows = payments_from_events(events, keep_source_id=True)
    kind = F.col("src_id") % 7
    body = F.to_json(F.struct(
        "event_id",
        F.when(kind == 3, F.lit("9223372036854775808").cast("decimal(20,0)")).otherwise(F.col("user_id").cast("decimal(20,0)")).alias("user_id"),
        F.when(kind == 4, F.lit(1e10)).otherwise(F.col("amount")).alias("amount"), "status",
        F.when(kind == 1, F.lit("2024-02-30")).otherwise(F.date_format("payment_date", "yyyy-MM-dd")).alias("payment_date"),
        F.when(kind == 2, F.lit("yesterday")).otherwise(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("updated_at")))
    value = F.when(kind == 5, F.lit("null")).when(kind == 6, F.lit("{}")).otherwise(body)
    return rows.select(F.col("src_id").alias("offset"), value.alias("value"))


def duplicate_payloads(events: DataFrame) -> DataFrame:
    """JSON messages ``(offset, value)`` with a key given twice, in six kinds by id:
    a null after the id, a user id first as text, an id first as number, an id of
    another letter case last, an amount last as text, an id of another case first."""
    n = F.col("event_id").cast("string")
    kinds = ('{"event_id":"evt-%","event_id":null}', '{"user_id":"%","user_id":%}', '{"event_id":%,"event_id":"evt-%"}',
             '{"event_id":"evt-%","amount":1.5,"EVENT_ID":"alt-%"}', '{"amount":%,"status":"paid","amount":"%"}',
             '{"EVENT_ID":"alt-%","user_id":1,"user_id":2,"event_id":"evt-%"}')
    value = F.element_at(F.array(*[F.replace(F.lit(k), F.lit("%"), n) for k in kinds]), (F.col("event_id") % 6 + 1).cast("int"))
    return events.select(F.col("event_id").alias("offset"), value.alias("value"))


def misfit_payments(events: DataFrame) -> DataFrame:
    """Raw bronze payments of which every 9th amount is beyond DECIMAL(12,2) and
    every 11th row has no ``updated_at``."""
    rows = payments_from_events(events, keep_source_id=True)
    return (rows.withColumn("amount", F.when(F.col("src_id") % 9 == 0, F.lit(1e10)).otherwise(F.col("amount")))
                .withColumn("updated_at", F.when(F.col("src_id") % 11 != 0, F.col("updated_at"))).drop("src_id"))


def redelivered(rows: DataFrame, src_col: str = "src_id", every: int = 10,
                batch_id: int = 1) -> DataFrame:
    """Second delivery of every ``every``-th row: ``updated_at + 1 hour`` and a
    later ``batch_id``; input for the merge/upsert jobs."""
    again = rows.filter(F.col(src_col) % every == 0)
    return again.withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 HOUR")) \
                .withColumn("batch_id", F.lit(batch_id).cast("int"))
