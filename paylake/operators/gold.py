"""Gold layer (G1, G10, G11): daily revenue and its roll-ups.

``gold_revenue`` is one grouped aggregation over silver.  The exact
``count_distinct(user_id)`` is planned as a two-level aggregation: rows are
first combined map-side and shuffled on ``(payment_date, user_id)``, then the
per-day counts are merged, so a day holding a large share of the rows is
spread over many tasks in the first exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylake.functions import as_date, days_before, week_start
from paylake.operators.merge import touched_leaves
from paylake.schemas import AMOUNT_DECIMAL
from paylake.sources import generations

_COUNTED = ("pending", "failed", "refunded", "cancelled", "unknown")
REVENUE_TYPE = "decimal(22,2)"


def gold_revenue(silver_b: DataFrame, with_build_time: bool = True) -> DataFrame:
    """G1: one row per payment_date.

    total_revenue is the exact DECIMAL sum of paid amounts; avg_order_value is
    revenue / paid orders, 0 when there are none.  ``dbt_updated_at`` is the
    build time (wall clock).  The build is not sorted (a table write keeps no
    row order); readers sort, see :func:`gold_listing`."""
    paid = F.col("status") == "paid"
    amount = F.col("amount").cast(AMOUNT_DECIMAL)
    revenue = F.sum(F.when(paid, amount).otherwise(F.lit(0).cast(AMOUNT_DECIMAL)))
    paid_orders = F.count_if(paid)
    gold = silver_b.groupBy("payment_date").agg(
        revenue.cast(REVENUE_TYPE).alias("total_revenue"),
        paid_orders.alias("total_paid_orders"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_orders") for s in _COUNTED],
        F.count_distinct("user_id").alias("unique_users"),
        F.when(paid_orders > 0, revenue.cast("double") / paid_orders)
         .otherwise(F.lit(0.0)).alias("avg_order_value"),
    )
    if with_build_time:
        gold = gold.withColumn("dbt_updated_at", F.current_timestamp().cast("timestamp_ntz"))
    return gold


def gold_listing(gold: DataFrame) -> DataFrame:
    """O1: gold newest day first (the model's ``ORDER BY payment_date DESC``)."""
    return gold.orderBy(F.col("payment_date").desc())


def weekly_revenue(gold: DataFrame) -> DataFrame:
    """Per ISO week (Monday start): revenue, paid orders and the *sum of the
    daily* distinct users (this over-counts users active on several days; see
    :func:`weekly_unique_users` for the exact figure)."""
    return (gold.groupBy(week_start("payment_date").alias("week"))
                .agg(F.sum("total_revenue").cast(REVENUE_TYPE).alias("weekly_revenue"),
                     F.sum("total_paid_orders").cast("bigint").alias("weekly_orders"),
                     F.sum("unique_users").cast("bigint").alias("total_users"))
                .orderBy(F.col("week").desc()))


def weekly_unique_users(silver: DataFrame) -> DataFrame:
    """G10 exact twin: distinct users per week, computed from silver."""
    return (silver.groupBy(week_start("payment_date").alias("week"))
                  .agg(F.count_distinct("user_id").alias("unique_users"))
                  .orderBy(F.col("week").desc()))


def recent_revenue(gold: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The last ``days`` days of gold up to ``as_of``, newest first."""
    return (gold.filter((F.col("payment_date") >= days_before(as_of, days))
                        & (F.col("payment_date") <= as_date(as_of)))
                .select("payment_date", "total_revenue", "total_paid_orders",
                        "avg_order_value", "unique_users")
                .orderBy(F.col("payment_date").desc()))


def refresh_gold_days(spark, silver_b: DataFrame, gold_path: str, days: list | None) -> None:
    """G1 incrementally: recompute only the given days and replace exactly
    those days of a day-partitioned gold table, by one committed pointer.

    A gold row for day D depends only on silver rows of day D, so this equals
    a full rebuild while reading only the touched silver partitions
    (``days=None`` rebuilds every day).  Columns that gold gains are appended to
    the table's; days built before have null there (M6)."""
    rows = silver_b if days is None else silver_b.filter(F.col("payment_date").isin(days))
    replace_gold_days(spark, gold_revenue(rows), gold_path, days)


def replace_gold_days(spark, gold: DataFrame, gold_path: str, days: list | None) -> None:
    """The rows ``gold`` in place of the table's rows of ``days`` (None: of all days)."""
    old = generations.leaves(spark, gold_path) if days is None \
        else touched_leaves(spark, gold_path, "payment_date", days)
    generations.replace(spark, gold_path, gold, ["payment_date"], old)
