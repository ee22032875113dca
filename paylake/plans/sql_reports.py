"""The reporting queries as Spark SQL (S6): parameterised statements over
temp views, for users who query the layers in SQL.

Views: ``payments_bronze`` (raw bronze), ``silver_events`` (current silver),
``silver_payments`` (warehouse silver).  Parameters are bound with Spark's
named-parameter markers (``:as_of``), never spliced into the text.  The
two-table comparison uses scalar subqueries instead of a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paylake.sources.tables import register_views

# The sum of amounts as money_sum() adds them: exactly where they fit, larger ones as doubles.
_EXACT = "TRY_CAST(amount AS DECIMAL(28,12))"
_MONEY = f"""CASE WHEN count_if(amount IS NOT NULL AND {_EXACT} IS NULL) = 0 THEN CAST(sum({_EXACT}) AS DOUBLE)
                    ELSE coalesce(CAST(sum({_EXACT}) AS DOUBLE), 0D)
                         + sum(CASE WHEN {_EXACT} IS NULL THEN amount END) END"""

STATEMENTS = {
    "status_breakdown": """
        SELECT payment_date,
               count_if(status = 'paid') AS paid, count_if(status = 'pending') AS pending,
               count_if(status = 'failed') AS failed, count_if(status = 'unknown') AS unknown,
               count(*) AS total
        FROM silver_events
        WHERE payment_date >= date_sub(:as_of, 7)
        GROUP BY payment_date ORDER BY payment_date DESC""",
    "day_summary": f"""
        SELECT count(*) AS total_transactions, count_if(status = 'paid') AS paid_count,
               {_MONEY} AS total_amount,
               try_divide({_MONEY}, count(amount)) AS avg_amount,
               count(DISTINCT user_id) AS unique_users
        FROM silver_events WHERE payment_date = :as_of""",
    "top_users": f"""
        SELECT user_id, count(*) AS num_transactions,
               {_MONEY} AS total_amount
        FROM silver_events WHERE payment_date = :as_of AND status = 'paid'
        GROUP BY user_id ORDER BY num_transactions DESC, user_id ASC LIMIT 10""",
    "bad_data_profile": """
        SELECT status, count(*) AS count, count_if(amount <= 0) AS bad_amount,
               min(amount) AS min_amount, max(amount) AS max_amount
        FROM payments_bronze WHERE payment_date = :as_of
        GROUP BY status ORDER BY count DESC""",
    "drop_rate": """
        SELECT total_bronze, total_silver, total_bronze - total_silver AS dropped,
               round(try_divide(total_bronze - total_silver, total_bronze) * 100, 2) AS drop_pct
        FROM (SELECT (SELECT count(*) FROM payments_bronze WHERE payment_date = :as_of) AS total_bronze,
                     (SELECT count(*) FROM silver_events WHERE payment_date = :as_of) AS total_silver)""",
    "gold_revenue": """
        SELECT payment_date,
               CAST(coalesce(sum(amount) FILTER (WHERE status = 'paid'), 0) AS DECIMAL(22,2))
                 AS total_revenue,
               count_if(status = 'paid') AS total_paid_orders,
               count_if(status = 'pending') AS pending_orders,
               count_if(status = 'failed') AS failed_orders,
               count_if(status = 'refunded') AS refunded_orders,
               count_if(status = 'cancelled') AS cancelled_orders,
               count_if(status = 'unknown') AS unknown_orders,
               count(DISTINCT user_id) AS unique_users,
               coalesce(try_divide(CAST(sum(amount) FILTER (WHERE status = 'paid') AS DOUBLE),
                                   count_if(status = 'paid')), 0D) AS avg_order_value
        FROM silver_payments GROUP BY payment_date""",
}


def run_report(spark: SparkSession, name: str, views: dict[str, DataFrame], **params) -> DataFrame:
    """Register ``views`` and run the named statement with bound parameters."""
    register_views(spark, views)
    return spark.sql(STATEMENTS[name], args=params or None)
