"""DuckDB SQL building blocks for the oracle side of the registered queries.

The oracle recomputes every result with plain SQL on the driver's tables,
independently of the Spark code.  ``bronze`` is the stand-in input rule
written in SQL; every later step (cleaning, dedup, aggregation) is an
independent SQL formulation of the operator's meaning.
"""

from __future__ import annotations

BRONZE_SELECT = """
SELECT CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('evt-', cast(event_id as varchar(32))) END AS event_id,
       CASE WHEN event_id % 89 = 0 THEN cast(0 as bigint) ELSE user_id END AS user_id,
       CASE WHEN event_id % 20 = 0 THEN -value
            WHEN event_id % 20 = 1 THEN cast(0 as double)
            WHEN event_id % 101 = 0 THEN NULL ELSE value END AS amount,
       CASE WHEN event_id % 103 = 0 THEN NULL
            WHEN event_id % 107 = 0 THEN ''
            WHEN event_id % 109 = 0 THEN ' Paid '
            WHEN event_id % 13 < 6 THEN 'paid'
            WHEN event_id % 13 < 8 THEN 'pending'
            WHEN event_id % 13 = 8 THEN 'failed'
            WHEN event_id % 13 = 9 THEN 'refunded'
            WHEN event_id % 13 = 10 THEN 'cancelled'
            WHEN event_id % 13 = 11 THEN 'PAID'
            ELSE 'invalid_status' END AS status,
       CAST(ts AS DATE) AS payment_date,
       ts AS updated_at,
       event_id AS src_id
FROM events
"""

LINEITEM_BRONZE_SELECT = BRONZE_SELECT.replace("event_id %", "(l_orderkey * 8 + l_linenumber) %") \
    .replace("cast(event_id as varchar(32))", "cast(l_orderkey * 8 + l_linenumber as varchar(32))") \
    .replace("ELSE user_id END", "ELSE l_suppkey END") \
    .replace("-value", "-l_extendedprice").replace("ELSE value END", "ELSE l_extendedprice END") \
    .replace("CAST(ts AS DATE)", "CAST(l_shipdate AS DATE)").replace("ts AS updated_at", "l_shipdate AS updated_at") \
    .replace("event_id AS src_id", "l_orderkey * 8 + l_linenumber AS src_id") \
    .replace("FROM events", "FROM lineitem")

STATUS_SQL = ("CASE WHEN lower(trim(status)) IN ('paid','pending','failed','refunded','cancelled') "
              "THEN lower(trim(status)) ELSE 'unknown' END")

VALID_SQL = ("event_id IS NOT NULL AND event_id <> '' AND user_id IS NOT NULL AND user_id > 0 "
             "AND amount IS NOT NULL AND amount > 0 AND payment_date IS NOT NULL")

SILVER_SELECT = f"""
SELECT event_id, user_id, amount, {STATUS_SQL} AS status, payment_date, updated_at
FROM bronze WHERE {VALID_SQL}
"""

# Current lane-A silver: one row per (payment_date, user_id, event_id).
SILVER_NOW_SELECT = """
SELECT event_id, user_id, amount, status, payment_date, updated_at FROM silver
QUALIFY row_number() OVER (PARTITION BY payment_date, user_id, event_id
                           ORDER BY updated_at DESC NULLS LAST, amount DESC NULLS LAST,
                                    status DESC NULLS LAST) = 1
"""

# Warehouse silver: DECIMAL amount, one row per (event_id, payment_date).
SILVER_B_SELECT = """
SELECT event_id, user_id, CAST(amount AS DECIMAL(12,2)) AS amount, status, payment_date, updated_at
FROM silver_now
WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND TRY_CAST(amount AS DECIMAL(12,2)) IS NOT NULL
  AND status IS NOT NULL AND payment_date IS NOT NULL AND updated_at IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY event_id, payment_date
                           ORDER BY updated_at DESC NULLS LAST, user_id DESC NULLS LAST,
                                    CAST(amount AS DECIMAL(12,2)) DESC NULLS LAST,
                                    status DESC NULLS LAST) = 1
"""

GOLD_SELECT = """
SELECT payment_date,
       CAST(COALESCE(SUM(amount) FILTER (WHERE status = 'paid'), 0) AS DECIMAL(22,2)) AS total_revenue,
       COUNT(*) FILTER (WHERE status = 'paid') AS total_paid_orders,
       COUNT(*) FILTER (WHERE status = 'pending') AS pending_orders,
       COUNT(*) FILTER (WHERE status = 'failed') AS failed_orders,
       COUNT(*) FILTER (WHERE status = 'refunded') AS refunded_orders,
       COUNT(*) FILTER (WHERE status = 'cancelled') AS cancelled_orders,
       COUNT(*) FILTER (WHERE status = 'unknown') AS unknown_orders,
       COUNT(DISTINCT user_id) AS unique_users,
       COALESCE(CAST(SUM(amount) FILTER (WHERE status = 'paid') AS DOUBLE)
                / NULLIF(COUNT(*) FILTER (WHERE status = 'paid'), 0), 0) AS avg_order_value
FROM silver_b GROUP BY payment_date
"""


def with_layers(*layers: str, bronze: str = BRONZE_SELECT) -> str:
    """``WITH`` clause defining the requested layers and everything they need."""
    order = ["bronze", "silver", "silver_now", "silver_b", "gold"]
    bodies = {"bronze": bronze, "silver": SILVER_SELECT, "silver_now": SILVER_NOW_SELECT,
              "silver_b": SILVER_B_SELECT, "gold": GOLD_SELECT}
    last = max(order.index(layer) for layer in layers)
    return "WITH " + ",\n".join(f"{name} AS ({bodies[name]})" for name in order[:last + 1])


# Exact money sum of a DOUBLE amount column, as DOUBLE (cent arithmetic).
def money_sum_sql(col: str = "amount") -> str:
    return f"CAST(SUM(CAST({col} AS DECIMAL(38,2))) AS DOUBLE)"


NOW_SQL = "(SELECT CAST(max(ts) AS TIMESTAMP) FROM events)"
