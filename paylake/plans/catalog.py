"""Registered queries: name -> (Spark job, DuckDB oracle SQL or None).

Every job reads the driver tables (or layers Spark derives from them) at
full size and runs through the library's operators.  The oracle SQL is an
independent formulation checked by the driver at sf0.01; column names match
the Spark output exactly.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.operators import gold as G
from paylake.operators import quality as Q
from paylake.operators import reports as R
from paylake.operators.gate import gate_counters, split_valid, to_keyed, validate_events
from paylake.operators.lifecycle import in_partition_window, retained, write_partitioned
from paylake.operators.parse import bronze_lane_a, bronze_lane_b, split_staged, stage_lane_a
from paylake.operators.merge import (
    latest_by_key,
    sync_frame,
    sync_misfits,
    to_warehouse_silver,
    upsert_frame,
    user_dim,
)
from paylake.operators.sessions import session_rollup
from paylake.operators.silver import silver_current, silver_incremental, silver_rows
from paylake.plans import inputs as I
from paylake.plans import oracle as O
from paylake.schemas import (
    ACCEPTED_STATUSES,
    BRONZE_TTL_DAYS,
    PARTITION_WINDOW_MONTHS,
    SILVER_COLUMNS,
    EVENT_ID_MAX_LEN,
    FRESHNESS_ERROR_HOURS,
    FRESHNESS_WARN_HOURS,
    NEW_DATA_MINUTES,
    RECENT_HOURS,
    SILVER_B_KEY,
    STATUS_MAX_LEN,
)
from paylake.plans.sql_reports import run_report
from paylake.plans.chains import (
    build_user_tables,
    current_silver,
    realtime_stream,
    run_medallion,
    run_realtime,
    scratch_lake,
)
from paylake.sources.driver_tables import (
    CORRUPT_EVERY,
    REJECT_CASES,
    REJECT_PAYLOADS,
    payments_from_events,
    raw_payloads,
    redelivered,
    dirty_payloads,
    misfit_payments,
)
from paylake.sources.streams import read_table_stream, read_validated
from paylake.streaming.ingest import (
    bronze_a_stream,
    bronze_b_stream,
    dedup_table_stream,
    gate_stream,
    minute_counts,
    minute_counts_stream,
    run_to_end,
)

Job = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[Job, str | None]] = {}


def register(name: str, sql: str | None):
    """Decorator: register a job under ``name`` with its oracle SQL."""
    def wrap(fn: Job) -> Job:
        def job(spark: SparkSession, sf_dir: str) -> DataFrame:
            I.prepare(spark)
            return fn(spark, sf_dir)
        job.__name__ = fn.__name__
        job.__doc__ = fn.__doc__
        _REGISTRY[name] = (job, sql)
        return job
    return wrap


def queries() -> dict[str, Job]:
    return {name: job for name, (job, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql is not None}


# ---------------------------------------------------------------------------
# Gold (G1, G10, G11)

@register("gold_revenue", O.with_layers("gold") + "\nSELECT * FROM gold")
def q_gold_revenue(spark, sf_dir):
    """G1 daily revenue from warehouse silver (build-time column left out)."""
    return G.gold_revenue(I.silver_b(spark, sf_dir), with_build_time=False)


@register("weekly_revenue", O.with_layers("gold") + """
SELECT CAST(date_trunc('week', payment_date) AS DATE) AS week,
       CAST(SUM(total_revenue) AS DECIMAL(22,2)) AS weekly_revenue,
       CAST(SUM(total_paid_orders) AS BIGINT) AS weekly_orders,
       CAST(SUM(unique_users) AS BIGINT) AS total_users
FROM gold GROUP BY 1""")
def q_weekly_revenue(spark, sf_dir):
    """G10 weekly roll-up of gold (sum of daily distinct users)."""
    return G.weekly_revenue(G.gold_revenue(I.silver_b(spark, sf_dir), with_build_time=False))


@register("weekly_unique_users", O.with_layers("silver_now") + """
SELECT CAST(date_trunc('week', payment_date) AS DATE) AS week, COUNT(DISTINCT user_id) AS unique_users
FROM silver_now GROUP BY 1""")
def q_weekly_unique_users(spark, sf_dir):
    """G10 exact weekly distinct users from silver."""
    return G.weekly_unique_users(I.silver_now(spark, sf_dir))


@register("recent_revenue", O.with_layers("gold") + f"""
SELECT payment_date, total_revenue, total_paid_orders, avg_order_value, unique_users FROM gold
WHERE payment_date >= DATE '{I.AS_OF}' - INTERVAL 30 DAY AND payment_date <= DATE '{I.AS_OF}'""")
def q_recent_revenue(spark, sf_dir):
    """G11 last 30 days of gold."""
    gold = G.gold_revenue(I.silver_b(spark, sf_dir), with_build_time=False)
    return G.recent_revenue(gold, I.AS_OF, 30)


# ---------------------------------------------------------------------------
# Silver (F1, P9-P11, Q8)

@register("silver_full", O.with_layers("silver") + "\nSELECT * FROM silver")
def q_silver_full(spark, sf_dir):
    """F1 + P11 over all of bronze."""
    return I.silver(spark, sf_dir)


@register("reject_profile", O.with_layers("bronze") + """
SELECT reason, COUNT(*) AS rows FROM (
  SELECT CASE WHEN event_id IS NULL OR event_id = '' THEN 'blank_event_id'
              WHEN user_id IS NULL OR user_id <= 0 THEN 'bad_user_id'
              WHEN amount IS NULL OR amount <= 0 THEN 'bad_amount'
              WHEN payment_date IS NULL THEN 'no_payment_date' END AS reason
  FROM bronze) WHERE reason IS NOT NULL GROUP BY reason""")
def q_reject_profile(spark, sf_dir):
    """Q8 rows rejected by each silver rule."""
    return Q.reject_profile(I.bronze(spark, sf_dir))


@register("status_normalised_counts", O.with_layers("silver") + """
SELECT status, COUNT(*) AS rows FROM silver GROUP BY status""")
def q_status_normalised_counts(spark, sf_dir):
    """P11 normalised status distribution of silver."""
    return I.silver(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------------------
# Reports (G2-G9, G12, G13)

@register("status_breakdown", O.with_layers("silver_now") + f"""
SELECT payment_date, COUNT(*) FILTER (WHERE status = 'paid') AS paid,
       COUNT(*) FILTER (WHERE status = 'pending') AS pending,
       COUNT(*) FILTER (WHERE status = 'failed') AS failed,
       COUNT(*) FILTER (WHERE status = 'unknown') AS unknown, COUNT(*) AS total
FROM silver_now WHERE payment_date >= DATE '{I.AS_OF}' - INTERVAL 7 DAY GROUP BY payment_date""")
def q_status_breakdown(spark, sf_dir):
    """G2 status counts per day, last 7 days."""
    return R.status_breakdown(I.silver_now(spark, sf_dir), I.AS_OF, 7)


@register("day_summary", O.with_layers("silver_now") + f"""
SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE status = 'paid') AS paid_count,
       {O.money_sum_sql()} AS total_amount,
       {O.money_sum_sql()} / COUNT(amount) AS avg_amount,
       COUNT(DISTINCT user_id) AS unique_users
FROM silver_now WHERE payment_date = DATE '{I.AS_OF}'""")
def q_day_summary(spark, sf_dir):
    """G3 one-day summary over all statuses."""
    return R.day_summary(I.silver_now(spark, sf_dir), I.AS_OF)


@register("top_users", O.with_layers("silver_now") + f"""
SELECT user_id, COUNT(*) AS num_transactions, {O.money_sum_sql()} AS total_amount
FROM silver_now WHERE payment_date = DATE '{I.AS_OF}' AND status = 'paid'
GROUP BY user_id ORDER BY num_transactions DESC, user_id ASC LIMIT 10""")
def q_top_users(spark, sf_dir):
    """G4 top-10 users by paid transactions on one day."""
    return R.top_users(I.silver_now(spark, sf_dir), I.AS_OF, 10)


@register("ingestion_rate", O.with_layers("bronze") + f"""
SELECT date_trunc('minute', updated_at) AS minute, COUNT(*) AS rows_ingested
FROM bronze WHERE updated_at >= {O.NOW_SQL} - INTERVAL 10 MINUTE GROUP BY 1""")
def q_ingestion_rate(spark, sf_dir):
    """G5/G6 rows per minute over the last 10 minutes (updated_at stands in
    for the arrival time, ``now`` = newest event)."""
    return R.ingestion_rate(I.bronze(spark, sf_dir), I.now_of(spark, sf_dir), 10, "updated_at")


@register("bad_data_profile", O.with_layers("bronze") + f"""
SELECT status, COUNT(*) AS count, COUNT(*) FILTER (WHERE amount <= 0) AS bad_amount,
       MIN(amount) AS min_amount, MAX(amount) AS max_amount
FROM bronze WHERE payment_date = DATE '{I.AS_OF}' GROUP BY status""")
def q_bad_data_profile(spark, sf_dir):
    """G7 bad-data distribution by raw status."""
    return R.bad_data_profile(I.bronze(spark, sf_dir), I.AS_OF)


@register("bronze_overview", O.with_layers("bronze") + """
SELECT COUNT(*) AS rows, MIN(payment_date) AS min_payment_date, MAX(payment_date) AS max_payment_date
FROM bronze""")
def q_bronze_overview(spark, sf_dir):
    """G8 bronze row count and date range."""
    return R.bronze_overview(I.bronze(spark, sf_dir))


@register("bronze_status_counts", O.with_layers("bronze") + f"""
SELECT status, COUNT(*) AS cnt FROM bronze WHERE payment_date = DATE '{I.AS_OF}' GROUP BY status""")
def q_bronze_status_counts(spark, sf_dir):
    """G9 raw status distribution for one day."""
    return R.bronze_status_counts(I.bronze(spark, sf_dir), I.AS_OF)


@register("layer_row_counts", O.with_layers("silver") + """
SELECT 'bronze' AS layer, COUNT(*) AS rows FROM bronze
UNION ALL SELECT 'silver' AS layer, COUNT(*) AS rows FROM silver""")
def q_layer_row_counts(spark, sf_dir):
    """G12 row counts of bronze and silver."""
    return R.layer_row_counts({"bronze": I.bronze(spark, sf_dir), "silver": I.silver(spark, sf_dir)})


@register("approx_users", None)
def q_approx_users(spark, sf_dir):
    """G13 approximate distinct users per day (no exact oracle by design)."""
    return R.approx_users(I.silver_now(spark, sf_dir))


@register("approx_users_close", O.with_layers("silver_now") + """
SELECT payment_date, COUNT(DISTINCT user_id) AS unique_users, TRUE AS within_3pct FROM silver_now GROUP BY 1""")
def q_approx_users_close(spark, sf_dir):
    """G13 against G14: whether each day's approximate count is within 3 % of the exact one."""
    s = I.silver_now(spark, sf_dir)
    close = F.abs(F.col("approx_users") - F.col("unique_users")) <= F.col("unique_users") * 0.03
    return R.approx_users(s).join(R.unique_users(s), "payment_date").select(
        "payment_date", "unique_users", close.alias("within_3pct"))


# ---------------------------------------------------------------------------
# Lane comparisons

_GATED = " WHERE src_id % 50 <> 0"


@register("drop_rate", O.with_layers("silver_now") + f"""
, counts AS (
  SELECT (SELECT COUNT(*) FROM bronze WHERE payment_date = DATE '{I.AS_OF}') AS total_bronze,
         (SELECT COUNT(*) FROM silver_now WHERE payment_date = DATE '{I.AS_OF}') AS total_silver)
SELECT total_bronze, total_silver, total_bronze - total_silver AS dropped,
       round(100.0 * (total_bronze - total_silver) / NULLIF(total_bronze, 0), 2) AS drop_pct
FROM counts""")
def q_drop_rate(spark, sf_dir):
    """J1 bronze vs silver drop rate on one day."""
    return Q.drop_rate(I.bronze(spark, sf_dir), I.silver_now(spark, sf_dir), I.AS_OF)


@register("drop_rate_b", O.with_layers("bronze") + f"""
, gated AS (SELECT * FROM bronze{_GATED} AND payment_date = DATE '{I.AS_OF}')
SELECT COUNT(*) AS bronze_count, COUNT(*) FILTER (WHERE {O.VALID_SQL}) AS silver_count,
       COUNT(*) FILTER (WHERE NOT ({O.VALID_SQL})) AS dropped
FROM gated""")
def q_drop_rate_b(spark, sf_dir):
    """J2 lane-B bronze (parsed from gated messages) vs warehouse silver."""
    topic = I.validated_topic(spark, sf_dir)
    bronze_b, _ = I.bronze_b_parsed(spark, sf_dir, topic)
    return Q.drop_count(bronze_b, I.silver_b_from_messages(spark, sf_dir, topic), I.AS_OF)


@register("lane_lag", O.with_layers("bronze") + f"""
, lanes AS (SELECT COUNT(*) AS lane_a_rows,
                   COUNT(*) FILTER (WHERE event_id IS NOT NULL AND user_id IS NOT NULL) AS lane_b_rows
            FROM bronze WHERE src_id % {CORRUPT_EVERY} <> 0 AND payment_date = DATE '{I.AS_OF}')
SELECT lane_a_rows, lane_b_rows, lane_a_rows - lane_b_rows AS lag_rows FROM lanes""")
def q_lane_lag(spark, sf_dir):
    """J3 lane A vs lane B bronze rows on one day (both lanes fed by the gate)."""
    topic = I.validated_topic(spark, sf_dir)
    a, _ = I.bronze_a_parsed(spark, sf_dir, topic)
    b, _ = I.bronze_b_parsed(spark, sf_dir, topic)
    return Q.lane_lag(a, b, I.AS_OF)


@register("lane_lag_by_day", O.with_layers("bronze") + f"""
, lanes AS (SELECT payment_date, COUNT(*) AS lane_a_rows,
                   COUNT(*) FILTER (WHERE event_id IS NOT NULL AND user_id IS NOT NULL) AS lane_b_rows
            FROM bronze WHERE src_id % {CORRUPT_EVERY} <> 0 GROUP BY payment_date)
SELECT *, lane_a_rows - lane_b_rows AS lag_rows FROM lanes""")
def q_lane_lag_by_day(spark, sf_dir):
    """J3 per day, without a join."""
    topic = I.validated_topic(spark, sf_dir)
    a, _ = I.bronze_a_parsed(spark, sf_dir, topic)
    b, _ = I.bronze_b_parsed(spark, sf_dir, topic)
    return Q.lane_lag_by_day(a, b)


# ---------------------------------------------------------------------------
# Quality checks (Q1-Q5, Q9, Q10)

def _not_null_sql(table: str, cols: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT 'not_null' AS check_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) "
        f"AS failures, CASE WHEN COUNT(*) FILTER (WHERE {c} IS NULL) = 0 THEN 'pass' ELSE 'fail' END "
        f"AS status FROM {table}" for c in cols)


_BRONZE_COLS = ["event_id", "user_id", "amount", "status", "payment_date", "updated_at"]


@register("check_not_null", O.with_layers("bronze") + "\n" + _not_null_sql("bronze", _BRONZE_COLS))
def q_check_not_null(spark, sf_dir):
    """Q1 NULL counts of every bronze column."""
    return Q.check_not_null(I.bronze(spark, sf_dir), _BRONZE_COLS)


@register("check_accepted", O.with_layers("silver_now") + """
SELECT 'accepted_values' AS check_name, 'status' AS column_name,
       COUNT(*) FILTER (WHERE status IS NOT NULL AND status NOT IN
         ('paid','pending','failed','refunded','cancelled','unknown')) AS failures,
       CASE WHEN COUNT(*) FILTER (WHERE status IS NOT NULL AND status NOT IN
         ('paid','pending','failed','refunded','cancelled','unknown')) = 0 THEN 'pass' ELSE 'fail' END AS status
FROM silver_now""")
def q_check_accepted(spark, sf_dir):
    """Q2 accepted_values on silver status."""
    return Q.check_accepted(I.silver_now(spark, sf_dir), "status", ACCEPTED_STATUSES)


@register("accepted_violations", O.with_layers("bronze") + """
SELECT status AS value, COUNT(*) AS failures FROM bronze
WHERE status IS NOT NULL AND status NOT IN ('paid','pending','failed','refunded','cancelled','unknown')
GROUP BY status""")
def q_accepted_violations(spark, sf_dir):
    """Q2 detail: raw bronze statuses outside the accepted set."""
    return Q.accepted_violations(I.bronze(spark, sf_dir), "status", ACCEPTED_STATUSES)


@register("check_length", O.with_layers("bronze") + """
SELECT 'max_length' AS check_name, 'event_id' AS column_name,
       COUNT(*) FILTER (WHERE length(event_id) > 64) AS failures,
       CASE WHEN COUNT(*) FILTER (WHERE length(event_id) > 64) = 0 THEN 'pass' ELSE 'fail' END AS status
FROM bronze
UNION ALL
SELECT 'max_length', 'status', COUNT(*) FILTER (WHERE length(status) > 20),
       CASE WHEN COUNT(*) FILTER (WHERE length(status) > 20) = 0 THEN 'pass' ELSE 'fail' END
FROM bronze""")
def q_check_length(spark, sf_dir):
    """Q10 VARCHAR(64) event_id / VARCHAR(20) status limits on bronze."""
    return Q.check_length(I.bronze(spark, sf_dir),
                          {"event_id": EVENT_ID_MAX_LEN, "status": STATUS_MAX_LEN})


@register("check_unique", O.with_layers("silver", bronze=O.LINEITEM_BRONZE_SELECT) + """
SELECT event_id, payment_date, COUNT(*) AS occurrences FROM silver
GROUP BY event_id, payment_date HAVING COUNT(*) > 1""")
def q_check_unique(spark, sf_dir):
    """Q9 duplicated (event_id, payment_date) keys in silver built from lineitem."""
    return Q.check_unique(silver_rows(I.lineitem_bronze(spark, sf_dir)), list(SILVER_B_KEY))


@register("check_freshness", O.with_layers("silver_now") + f"""
SELECT 'updated_at' AS column_name, MAX(updated_at) AS newest,
       epoch_ms({O.NOW_SQL}) - epoch_ms(MAX(updated_at)) AS age_ms,
       CASE WHEN epoch_ms({O.NOW_SQL}) - epoch_ms(MAX(updated_at)) > 6 * 3600000 THEN 'error'
            WHEN epoch_ms({O.NOW_SQL}) - epoch_ms(MAX(updated_at)) > 2 * 3600000 THEN 'warn'
            ELSE 'pass' END AS status
FROM silver_now""")
def q_check_freshness(spark, sf_dir):
    """Q3 freshness of silver updated_at against ``now``."""
    return Q.check_freshness(I.silver_now(spark, sf_dir), "updated_at", I.now_of(spark, sf_dir),
                             FRESHNESS_WARN_HOURS, FRESHNESS_ERROR_HOURS)


@register("check_freshness_late", O.with_layers("silver_now") + """
SELECT late_hours, CASE WHEN late_hours > 6 THEN 'error' WHEN late_hours > 2 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT MAX(updated_at) AS newest FROM silver_now), (VALUES (1), (3), (7)) AS h(late_hours)""")
def q_check_freshness_late(spark, sf_dir):
    """Q3 one, three and seven hours after silver's newest row: pass, warn, error."""
    s = I.silver_now(spark, sf_dir)
    newest = s.agg(F.max("updated_at")).scalar()
    out = None
    for h in (1, 3, 7):
        one = Q.check_freshness(s, "updated_at", newest + F.expr(f"INTERVAL {h} HOURS"),
                                FRESHNESS_WARN_HOURS, FRESHNESS_ERROR_HOURS).select(F.lit(h).alias("late_hours"), "status")
        out = one if out is None else out.unionByName(one)
    return out


@register("gates_closed", O.with_layers("bronze") + f"""
SELECT gate, EXISTS (SELECT 1 FROM bronze WHERE updated_at > {O.NOW_SQL} + INTERVAL 3 HOUR - INTERVAL 1 MINUTE * minutes) AS passed
FROM (VALUES ('new_data', 6), ('recent', 120)) AS g(gate, minutes)""")
def q_gates_closed(spark, sf_dir):
    """Q4/Q5 three hours after the newest event: both gates are closed."""
    b, now = I.bronze(spark, sf_dir), I.now_of(spark, sf_dir) + F.expr("INTERVAL 3 HOURS")
    new = Q.gate_frame(spark, "new_data", Q.exists_since(b, "updated_at", NEW_DATA_MINUTES, now))
    return new.unionByName(Q.gate_frame(spark, "recent", Q.exists_since(b, "updated_at", RECENT_HOURS * 60, now)))


@register("new_data_gate", O.with_layers("bronze") + f"""
SELECT 'new_data' AS gate,
       EXISTS (SELECT 1 FROM bronze WHERE updated_at > {O.NOW_SQL} - INTERVAL 6 MINUTE) AS passed""")
def q_new_data_gate(spark, sf_dir):
    """Q4 any bronze row in the last 6 minutes (updated_at stands in for arrival)."""
    b = I.bronze(spark, sf_dir)
    return Q.gate_frame(spark, "new_data",
                        Q.exists_since(b, "updated_at", NEW_DATA_MINUTES, I.now_of(spark, sf_dir)))


@register("recent_gate", O.with_layers("bronze") + f"""
SELECT 'recent' AS gate,
       EXISTS (SELECT 1 FROM bronze WHERE updated_at > {O.NOW_SQL} - INTERVAL 2 HOUR) AS passed""")
def q_recent_gate(spark, sf_dir):
    """Q5 any bronze row updated in the last 2 hours."""
    b = I.bronze(spark, sf_dir)
    return Q.gate_frame(spark, "recent",
                        Q.exists_since(b, "updated_at", RECENT_HOURS * 60, I.now_of(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Gate and bronze

def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_KEY_SQL = "CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('evt-', cast(event_id as varchar(32))) END"


@register("gate_accepted", f"""
SELECT event_id AS offset, {_KEY_SQL} AS key FROM events WHERE event_id % {CORRUPT_EVERY} <> 0""")
def q_gate_accepted(spark, sf_dir):
    """V1-V3 messages forwarded by the gate, re-keyed by event_id."""
    return to_keyed(I.gated(spark, sf_dir)).select("offset", "key")


@register("gate_rejected", f"""
SELECT event_id AS offset,
       {_sql_list(REJECT_PAYLOADS)}[(event_id // {CORRUPT_EVERY}) % {len(REJECT_PAYLOADS)} + 1] AS value,
       {_sql_list([r for _, r in REJECT_CASES])}[(event_id // {CORRUPT_EVERY}) % {len(REJECT_PAYLOADS)} + 1]
         AS reason
FROM events WHERE event_id % {CORRUPT_EVERY} = 0""")
def q_gate_rejected(spark, sf_dir):
    """V1/V2 messages the gate drops: original text and the reason class."""
    _, bad = split_valid(validate_events(I.messages(spark, sf_dir)))
    return bad.select("offset", "value", "reason")


@register("gate_counters", f"""
SELECT COUNT(*) AS consumed, COUNT(*) FILTER (WHERE event_id % {CORRUPT_EVERY} <> 0) AS forwarded,
       COUNT(*) FILTER (WHERE event_id % {CORRUPT_EVERY} = 0) AS parse_err FROM events""")
def q_gate_counters(spark, sf_dir):
    """V4 consumed / forwarded / parse_err counters."""
    return gate_counters(validate_events(I.messages(spark, sf_dir)))


@register("bronze_lane_a", O.with_layers("bronze") + f"""
SELECT event_id, user_id, COALESCE(amount, 0.0) AS amount, COALESCE(status, '') AS status,
       payment_date, date_trunc('millisecond', updated_at) AS updated_at
FROM bronze WHERE src_id % {CORRUPT_EVERY} <> 0""")
def q_bronze_lane_a(spark, sf_dir):
    """V6/V9/V10 strict parse of gated messages with defaults (arrival time left out)."""
    good, _ = I.bronze_a_parsed(spark, sf_dir)
    return good.select(*SILVER_COLUMNS)


@register("bronze_lane_b", O.with_layers("bronze") + f"""
SELECT event_id, user_id, CAST(amount AS DECIMAL(12,2)) AS amount, status,
       payment_date, date_trunc('millisecond', updated_at) AS updated_at
FROM bronze WHERE src_id % {CORRUPT_EVERY} <> 0
  AND event_id IS NOT NULL AND user_id IS NOT NULL AND payment_date IS NOT NULL""")
def q_bronze_lane_b(spark, sf_dir):
    """V8/F2/P4 lenient parse with DECIMAL(12,2) amounts (arrival time left out)."""
    good, _ = I.bronze_b_parsed(spark, sf_dir)
    return good.select(*SILVER_COLUMNS)


_FLAWED_SQL = O.with_layers("bronze") + """
, flawed AS (SELECT CASE WHEN src_id % 7 < 5 THEN event_id END AS event_id, CASE {} END AS reason FROM bronze)
SELECT event_id, reason FROM flawed WHERE reason IS NOT NULL"""


def _reasons(quarantine):
    return quarantine.select(F.get_json_object("value", "$.event_id").alias("event_id"), "reason")


@register("bronze_a_quarantine", _FLAWED_SQL.format("""src_id % 7
    WHEN 1 THEN 'bad_payment_date' WHEN 2 THEN 'bad_updated_at' WHEN 3 THEN 'user_id_out_of_range'
    WHEN 5 THEN 'undecodable' WHEN 6 THEN 'bad_payment_date'"""))
def q_bronze_a_quarantine(spark, sf_dir):
    """V6/V10 messages that pass the gate and that lane A can't store, with the reason."""
    _, bad = bronze_lane_a(dirty_payloads(I.events(spark, sf_dir)))
    return _reasons(bad)


@register("bronze_b_quarantine", _FLAWED_SQL.format("""src_id % 7
    WHEN 1 THEN 'bad_payment_date' WHEN 3 THEN 'user_id_out_of_range' WHEN 4 THEN 'amount_out_of_range'"""))
def q_bronze_b_quarantine(spark, sf_dir):
    """V8/V10/F2 messages that lane B can't store (those without a key are skipped)."""
    _, bad = bronze_lane_b(dirty_payloads(I.events(spark, sf_dir)))
    return _reasons(bad)


@register("sync_quarantine", O.with_layers("bronze") + f"""
, amounts AS (SELECT * REPLACE (CASE WHEN src_id % 9 = 0 THEN 1e10 ELSE amount END AS amount) FROM bronze)
SELECT event_id, payment_date, CASE WHEN src_id % 11 = 0 THEN 'null_updated_at' ELSE 'amount_overflow' END AS reason
FROM amounts WHERE {O.VALID_SQL} AND (src_id % 11 = 0 OR src_id % 9 = 0)""")
def q_sync_quarantine(spark, sf_dir):
    """M7 silver rows that the warehouse silver can't hold, with the reason."""
    return sync_misfits(silver_rows(misfit_payments(I.events(spark, sf_dir)))).select("event_id", "payment_date", "reason")


# ---------------------------------------------------------------------------
# Incremental silver, merge, upsert, sync

_TARGET_BOUND_SQL = f"""(SELECT CASE WHEN COUNT(*) > 0 THEN MAX(payment_date) - 1 ELSE DATE '1970-01-01' END
                      FROM silver WHERE payment_date <= DATE '{I.TARGET_UNTIL}')"""


def _target(spark, sf_dir):
    return I.silver(spark, sf_dir).filter(F.col("payment_date") <= F.lit(I.TARGET_UNTIL).cast("date"))


@register("silver_incremental", O.with_layers("silver") + f"""
SELECT * FROM silver WHERE payment_date >= {_TARGET_BOUND_SQL}""")
def q_silver_incremental(spark, sf_dir):
    """F3/M4 rows one incremental run appends to a target built up to 2024-01-20."""
    return silver_incremental(I.bronze(spark, sf_dir), _target(spark, sf_dir), overlap_days=1)


@register("silver_current_after_two_runs", O.with_layers("silver_now") + "\nSELECT * FROM silver_now")
def q_silver_current_after_two_runs(spark, sf_dir):
    """M4 then M1: target (batch 0) + overlapping incremental run (batch 1), merged."""
    target = _target(spark, sf_dir)
    appended = silver_incremental(I.bronze(spark, sf_dir), target, overlap_days=1)
    both = (target.withColumn("batch_id", F.lit(0))
            .unionByName(appended.withColumn("batch_id", F.lit(1))))
    return silver_current(both)


_REDO_SQL = f"""
, redo AS (SELECT event_id, user_id, amount, status, payment_date,
                  updated_at + INTERVAL 1 HOUR AS updated_at FROM bronze WHERE src_id % 10 = 0)
, redo_b AS (SELECT event_id, user_id, CAST(amount AS DECIMAL(12,2)) AS amount, {O.STATUS_SQL} AS status,
                    payment_date, updated_at FROM redo WHERE {O.VALID_SQL})
, merged AS (SELECT *, 0 AS src FROM silver_b UNION ALL SELECT *, 1 AS src FROM redo_b)
SELECT event_id, user_id, amount, status, payment_date, updated_at FROM merged
QUALIFY row_number() OVER (PARTITION BY event_id, payment_date
                           ORDER BY updated_at DESC, user_id DESC, amount DESC, status DESC, src DESC) = 1"""


@register("silver_upsert", O.with_layers("silver_b") + _REDO_SQL)
def q_silver_upsert(spark, sf_dir):
    """M3 upsert on (event_id, payment_date): every 10th event redelivered an hour later."""
    redo = redelivered(I.bronze_with_ids(spark, sf_dir)).drop("src_id", "batch_id")
    updates = to_warehouse_silver(silver_rows(redo))
    return upsert_frame(I.silver_b(spark, sf_dir), updates, list(SILVER_B_KEY),
                        ["updated_at", "user_id", "amount", "status"])


@register("silver_upsert_lineitem", O.with_layers("silver_b", bronze=O.LINEITEM_BRONZE_SELECT)
          + _REDO_SQL)
def q_silver_upsert_lineitem(spark, sf_dir):
    """M3 upsert at larger volume: warehouse silver built from lineitem (key not
    unique, several years of days), every 10th id redelivered an hour later."""
    li = I.lineitem_bronze(spark, sf_dir, keep_source_id=True)
    redo = redelivered(li).drop("src_id", "batch_id")
    current = sync_frame(silver_current(silver_rows(li.drop("src_id")).withColumn("batch_id", F.lit(0))))
    return upsert_frame(current, to_warehouse_silver(silver_rows(redo)), list(SILVER_B_KEY),
                        ["updated_at", "user_id", "amount", "status"])


@register("gold_revenue_lineitem", O.with_layers("gold", bronze=O.LINEITEM_BRONZE_SELECT)
          + "\nSELECT * FROM gold")
def q_gold_revenue_lineitem(spark, sf_dir):
    """G1 over the lineitem-derived layers (thousands of days)."""
    li = I.lineitem_bronze(spark, sf_dir)
    silver_b = sync_frame(silver_current(silver_rows(li).withColumn("batch_id", F.lit(0))))
    return G.gold_revenue(silver_b, with_build_time=False)


@register("sync_silver", O.with_layers("silver_b") + "\nSELECT * FROM silver_b")
def q_sync_silver(spark, sf_dir):
    """M7 lane-A silver after two overlapping runs (with duplicates) synced into
    a warehouse silver that already holds the first run."""
    target = _target(spark, sf_dir)
    appended = silver_incremental(I.bronze(spark, sf_dir), target, overlap_days=1)
    return sync_frame(target.unionByName(appended), to_warehouse_silver(target))


@register("latest_by_key", O.with_layers("bronze", bronze=O.LINEITEM_BRONZE_SELECT) + """
SELECT event_id, user_id, amount, status, payment_date, updated_at FROM bronze
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY payment_date DESC NULLS LAST,
          updated_at DESC NULLS LAST, user_id DESC NULLS LAST, amount DESC NULLS LAST,
          status DESC NULLS LAST) = 1""")
def q_latest_by_key(spark, sf_dir):
    """M1 on the non-unique lineitem-derived key: newest row per event_id."""
    return latest_by_key(I.lineitem_bronze(spark, sf_dir), ["event_id"],
                         ["payment_date", "updated_at", "user_id", "amount", "status"])


_USERS_SQL = """
SELECT user_id, event_id AS last_event_id, status AS last_status, amount AS last_amount,
       payment_date AS last_payment_date, updated_at AS last_updated_at FROM silver_now
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, event_id DESC,
                                                         payment_date DESC) = 1"""


@register("user_dim", O.with_layers("silver_now") + _USERS_SQL)
def q_user_dim(spark, sf_dir):
    """M2 latest silver row per user."""
    return user_dim(I.silver_now(spark, sf_dir))


_SESSIONS_SQL = """
, flagged AS (
  SELECT user_id, updated_at, status, amount,
         CASE WHEN lag(updated_at) OVER w IS NULL OR updated_at - lag(updated_at) OVER w > INTERVAL 30 MINUTE
              THEN 1 ELSE 0 END AS new_session
  FROM silver_now WINDOW w AS (PARTITION BY user_id ORDER BY updated_at))
, numbered AS (
  SELECT *, SUM(new_session) OVER (PARTITION BY user_id ORDER BY updated_at
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
  FROM flagged)
SELECT md5(concat_ws('|', user_id, CAST(epoch_us(MIN(updated_at)) AS VARCHAR))) AS session_id,
       user_id, MIN(updated_at) AS session_start, MAX(updated_at) AS session_end,
       CAST(MIN(updated_at) AS DATE) AS session_date, COUNT(*) AS events,
       COUNT(*) FILTER (WHERE status = 'paid') AS paid_events,
       CAST(SUM(CASE WHEN status = 'paid' THEN CAST(amount AS DECIMAL(38,2)) ELSE 0 END) AS DOUBLE)
         AS paid_amount
FROM numbered GROUP BY user_id, sid"""


@register("session_rollup", O.with_layers("silver_now") + _SESSIONS_SQL)
def q_session_rollup(spark, sf_dir):
    """M8 30-minute-gap sessions per user over silver."""
    return session_rollup(I.silver_now(spark, sf_dir), gap_minutes=30, chunk_minutes=5)


# ---------------------------------------------------------------------------
# Lifecycle

@register("retention_90d", O.with_layers("bronze") + f"""
SELECT event_id, user_id, amount, status, payment_date, updated_at FROM bronze
WHERE payment_date + INTERVAL 90 DAY > DATE '{I.EXPIRY_AS_OF}'""")
def q_retention_90d(spark, sf_dir):
    """F7 bronze rows still alive under a 90-day TTL at a later as-of."""
    return retained(I.bronze(spark, sf_dir), I.EXPIRY_AS_OF, BRONZE_TTL_DAYS)


@register("partition_window", O.with_layers("silver", bronze=O.LINEITEM_BRONZE_SELECT) + """
SELECT * FROM silver
WHERE payment_date >= date_trunc('month', (SELECT MAX(l_shipdate) FROM lineitem)) - INTERVAL 6 MONTH""")
def q_partition_window(spark, sf_dir):
    """L3 rows inside the 6-month rolling partition window of the newest month
    (silver built from lineitem, which spans several years)."""
    li = I.lineitem_bronze(spark, sf_dir)
    newest = li.select(F.max("payment_date")).scalar()
    return in_partition_window(silver_rows(li), newest, PARTITION_WINDOW_MONTHS)


# ---------------------------------------------------------------------------
# Streaming (S1-S3, K1-K4, T1-T6): availableNow runs over the driver tables

def _stream_dirs(spark, name):
    lake = scratch_lake(spark, name)
    return lake, f"{lake.root}/_checkpoints"


def _late_events(spark, sf_dir, lake, again=None):
    """A stream of ``events`` in files that arrive one a batch: the second half of
    the month first, then the first half, then every ``again``-th event once more."""
    events, folder = I.events(spark, sf_dir), f"{lake.root}/events_in"
    late = F.day("ts") > 15
    parts = [events.filter(late), events.filter(~late | late.isNull())]
    if again:
        parts.append(events.filter(F.col("event_id") % again == 0))
    for part in parts:
        part.write.mode("append").parquet(folder)
    return (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder))


@register("stream_bronze", O.with_layers("bronze") + f"""
SELECT event_id, user_id, COALESCE(amount, 0.0) AS amount, COALESCE(status, '') AS status,
       payment_date, date_trunc('millisecond', updated_at) AS updated_at
FROM bronze WHERE src_id % {CORRUPT_EVERY} <> 0""")
def q_stream_bronze(spark, sf_dir):
    """S1 -> gate stream (K1) -> validated text topic -> S2 -> lane-A bronze
    stream (K2); the written bronze table is read back."""
    lake, ckpt = _stream_dirs(spark, "stream_bronze")
    topic, dropped = f"{lake.root}/topic/validated", f"{lake.root}/topic/dropped"
    raw = raw_payloads(read_table_stream(spark, sf_dir, "events"))
    cores = spark.sparkContext.defaultParallelism
    run_to_end(gate_stream(raw, topic, dropped, f"{ckpt}/gate", min_partitions=cores))
    validated = read_validated(spark, topic)
    run_to_end(bronze_a_stream(validated, lake.path("bronze_a"), lake.path("quarantine"),
                               f"{ckpt}/bronze_a", min_partitions=cores))
    return lake.read(spark, "bronze_a").select(*SILVER_COLUMNS)


@register("stream_bronze_b", O.with_layers("bronze") + f"""
SELECT event_id, user_id, CAST(amount AS DECIMAL(12,2)) AS amount, status,
       payment_date, date_trunc('millisecond', updated_at) AS updated_at
FROM bronze WHERE src_id % {CORRUPT_EVERY} <> 0""")
def q_stream_bronze_b(spark, sf_dir):
    """S1 -> gate stream -> validated topic -> S3 -> lane-B bronze stream (K3,
    day-partitioned, replaced per batch on replay); read back."""
    lake, ckpt = _stream_dirs(spark, "stream_bronze_b")
    topic, dropped = f"{lake.root}/topic/validated", f"{lake.root}/topic/dropped"
    raw = raw_payloads(read_table_stream(spark, sf_dir, "events"))
    cores = spark.sparkContext.defaultParallelism
    run_to_end(gate_stream(raw, topic, dropped, f"{ckpt}/gate", min_partitions=cores))
    run_to_end(bronze_b_stream(read_validated(spark, topic), lake.path("bronze_b"),
                               lake.path("quarantine"), f"{ckpt}/bronze_b", min_partitions=cores))
    return lake.read(spark, "bronze_b").select(*SILVER_COLUMNS)


@register("stream_minute_counts", O.with_layers("bronze") + """
SELECT date_trunc('minute', updated_at) AS minute, COUNT(*) AS rows FROM bronze GROUP BY 1""")
def q_stream_minute_counts(spark, sf_dir):
    """T5 streaming one-minute counts over files that arrive one a batch, the newest days first."""
    lake, ckpt = _stream_dirs(spark, "stream_minutes")
    rows = payments_from_events(_late_events(spark, sf_dir, lake))
    out = f"{lake.root}/minute_counts"
    run_to_end(minute_counts_stream(rows, "updated_at", out, f"{ckpt}/minutes"))
    return minute_counts(spark.read.parquet(out))


@register("stream_dedup", O.with_layers("bronze") + """
SELECT event_id, user_id, amount, status, payment_date, updated_at FROM bronze""")
def q_stream_dedup(spark, sf_dir):
    """T2 at-least-once delivery (every 10th event delivered again, in a later
    batch) over files that arrive one a batch, the newest days first: each
    (event_id, payment_date, updated_at) is kept once."""
    lake, ckpt = _stream_dirs(spark, "stream_dedup")
    rows = payments_from_events(_late_events(spark, sf_dir, lake, again=10))
    out = f"{lake.root}/deduped"
    run_to_end(dedup_table_stream(rows, ["event_id", "payment_date", "updated_at"], out, f"{ckpt}/dedup"))
    return spark.read.parquet(out).select(*SILVER_COLUMNS)


# ---------------------------------------------------------------------------
# Chains (T7, T8): layers written as tables, then read back

def _land_bronze(spark, sf_dir, lake):
    """Batch landing of lane-A bronze from the gated messages (what the bronze
    stream does per micro-batch): parse once, write rows and quarantine."""
    staged = stage_lane_a(I.gated(spark, sf_dir))
    staged = staged.withColumn("_value", F.when(F.col("_reason").isNotNull(), F.col("_value")))     # only the quarantine keeps texts
    staged = staged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        bronze_a, quarantine = split_staged(staged)
        write_partitioned(bronze_a, lake.path("bronze_a"), ["payment_month"],
                          sort_cols=["payment_date", "event_id"])
        write_partitioned(quarantine.withColumn("batch_id", F.lit(0)), lake.path("quarantine"),
                          ["batch_id"])
    finally:
        staged.unpersist()


_GATED_BRONZE = f"SELECT * FROM ({O.BRONZE_SELECT}) WHERE src_id % {CORRUPT_EVERY} <> 0"


@register("realtime_chain", O.with_layers("silver", bronze=_GATED_BRONZE) + """
SELECT event_id, user_id, amount, status, payment_date,
       date_trunc('millisecond', updated_at) AS updated_at FROM silver""")
def q_realtime_chain(spark, sf_dir):
    """T7 twice: bronze landed, gate passes, first silver run, second run
    re-appends the 1-day overlap; the merged silver is read back."""
    lake = scratch_lake(spark, "realtime")
    _land_bronze(spark, sf_dir, lake)
    for _ in range(2):
        if run_realtime(spark, lake) == "skipped":
            raise RuntimeError("new-data gate skipped a run on freshly landed bronze")
    return current_silver(spark, lake).select(*SILVER_COLUMNS)


@register("realtime_stream_chain", O.with_layers("silver", bronze=_GATED_BRONZE) + """
SELECT event_id, user_id, amount, status, payment_date,
       date_trunc('millisecond', updated_at) AS updated_at FROM silver""")
def q_realtime_stream_chain(spark, sf_dir):
    """T6/T7 fully streamed: events -> gate stream -> validated topic -> lane-A
    bronze stream (with ingestion log) -> log-triggered silver runs; the merged
    silver is read back."""
    lake, ckpt = _stream_dirs(spark, "realtime_stream")
    topic, dropped = f"{lake.root}/topic/validated", f"{lake.root}/topic/dropped"
    cores = spark.sparkContext.defaultParallelism
    run_to_end(gate_stream(raw_payloads(read_table_stream(spark, sf_dir, "events")), topic, dropped,
                           f"{ckpt}/gate", min_partitions=cores))
    run_to_end(bronze_a_stream(read_validated(spark, topic), lake.path("bronze_a"),
                               lake.path("quarantine"), f"{ckpt}/bronze_a", min_partitions=cores))
    run_to_end(realtime_stream(spark, lake, f"{ckpt}/silver"))
    return current_silver(spark, lake).select(*SILVER_COLUMNS)


@register("medallion_chain", O.with_layers("gold", bronze=_GATED_BRONZE) + "\nSELECT * FROM gold")
def q_medallion_chain(spark, sf_dir):
    """T8 end to end: recency gate (``now`` = newest event), silver run and
    tests, sync into warehouse silver (upsert), gold full refresh and tests;
    the newest gold version is read back (build time left out)."""
    lake = scratch_lake(spark, "medallion")
    _land_bronze(spark, sf_dir, lake)
    run_medallion(spark, lake, now=I.now_of(spark, sf_dir))
    return lake.read(spark, "gold_revenue").drop("dbt_updated_at")



@register("medallion_chain_incremental", O.with_layers("gold", bronze=_GATED_BRONZE)
          + "\nSELECT * FROM gold")
def q_medallion_chain_incremental(spark, sf_dir):
    """T8 run twice with incremental gold: the second run syncs only the new
    silver batch and recomputes only the days it rewrote; the day-partitioned
    gold must equal a full build."""
    lake = scratch_lake(spark, "medallion_inc")
    _land_bronze(spark, sf_dir, lake)
    now = I.now_of(spark, sf_dir)
    run_medallion(spark, lake, now=now, incremental_gold=True)
    run_medallion(spark, lake, now=now, incremental_gold=True)
    return lake.read(spark, "gold_revenue_daily").drop("dbt_updated_at")


_GATED_BRONZE_MS = f"SELECT * REPLACE (date_trunc('millisecond', updated_at) AS updated_at) FROM ({_GATED_BRONZE})"


def _user_tables(spark, sf_dir):
    lake = scratch_lake(spark, "users")
    _land_bronze(spark, sf_dir, lake)
    for _ in range(2):
        run_realtime(spark, lake)
        build_user_tables(spark, lake)
    return lake


@register("silver_users_table", O.with_layers("silver_now", bronze=_GATED_BRONZE_MS) + _USERS_SQL)
def q_silver_users_table(spark, sf_dir):
    """M2 as a table: written after each of two silver runs, the newest version read back."""
    return _user_tables(spark, sf_dir).read(spark, "silver_users")


@register("silver_sessions_table", O.with_layers("silver_now", bronze=_GATED_BRONZE_MS) + _SESSIONS_SQL)
def q_silver_sessions_table(spark, sf_dir):
    """M8 as a table: written after each of two silver runs, the newest version read back."""
    return _user_tables(spark, sf_dir).read(spark, "silver_sessions")


# ---------------------------------------------------------------------------
# The same reports through Spark SQL (S6): parameterised statements over views

def _sql_views(spark, sf_dir):
    return {"payments_bronze": I.bronze(spark, sf_dir), "silver_events": I.silver_now(spark, sf_dir),
            "silver_payments": I.silver_b(spark, sf_dir)}


def _register_sql(name: str) -> None:
    _, sql = _REGISTRY[name]

    def job(spark, sf_dir):
        """The report as a Spark SQL statement over temp views."""
        return run_report(spark, name, _sql_views(spark, sf_dir),
                          as_of=datetime.date.fromisoformat(I.AS_OF))

    register(f"sql_{name}", sql)(job)


for _name in ("status_breakdown", "day_summary", "top_users", "bad_data_profile", "drop_rate",
              "gold_revenue"):
    _register_sql(_name)


from paylake.plans import catalog_tables  # noqa: E402,F401  (registers its queries)
