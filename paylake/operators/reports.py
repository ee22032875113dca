"""Reporting queries over bronze and silver.

All are single-scan grouped or global aggregations: partial aggregation
runs map-side, so only one row per group per task is shuffled.  Every report
takes an explicit ``as_of`` day / ``now`` time instead of the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylake.functions import (
    as_date,
    days_before,
    minute_of,
    minutes_before,
    money_avg,
    money_sum,
    payment_month,
)


def _with_month(df: DataFrame, cond: Column, month_cond: Column) -> DataFrame:
    """Add the equivalent ``payment_month`` predicate when the table is stored
    by month, so whole month directories are pruned (not only row groups)."""
    if "payment_month" in df.columns:
        cond = cond & month_cond
    return df.filter(cond)


def in_last_days(df: DataFrame, days: int, as_of, col: str = "payment_date") -> DataFrame:
    """``col >= as_of - days`` (the reference's open-ended 'last N days')."""
    lo = days_before(as_of, days)
    return _with_month(df, F.col(col) >= lo, F.col("payment_month") >= payment_month(lo))


def on_day(df: DataFrame, as_of, col: str = "payment_date") -> DataFrame:
    """``col = as_of`` ('today')."""
    day = as_date(as_of)
    return _with_month(df, F.col(col) == day, F.col("payment_month") == payment_month(day))


def in_last_minutes(df: DataFrame, col: str, minutes: int, now, strict: bool = False) -> DataFrame:
    """``col >= now - minutes`` (``>`` when ``strict``)."""
    bound = minutes_before(now, minutes)
    return df.filter(F.col(col) > bound if strict else F.col(col) >= bound)


def with_status(df: DataFrame, status: str) -> DataFrame:
    """``status = <status>``."""
    return df.filter(F.col("status") == status)


def _count_status(status: str) -> Column:
    return F.count_if(F.col("status") == status).alias(status)


def status_breakdown(silver: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per day of the last ``days`` days: paid / pending / failed / unknown / total."""
    return (in_last_days(silver, days, as_of)
            .groupBy("payment_date")
            .agg(*[_count_status(s) for s in ("paid", "pending", "failed", "unknown")],
                 F.count(F.lit(1)).alias("total"))
            .orderBy(F.col("payment_date").desc()))


def day_summary(silver: DataFrame, as_of) -> DataFrame:
    """One row for ``as_of``: transactions, paid count, amount sum / average
    over all statuses and the exact distinct users."""
    return on_day(silver, as_of).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("status") == "paid").alias("paid_count"),
        money_sum("amount").alias("total_amount"),
        money_avg("amount").alias("avg_amount"),
        F.count_distinct("user_id").alias("unique_users"))


def approx_users(silver: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Approximate distinct users per day (HyperLogLog++, mergeable partials)."""
    return (silver.groupBy("payment_date")
                  .agg(F.approx_count_distinct("user_id", rsd).alias("approx_users"))
                  .orderBy(F.col("payment_date").desc()))


def unique_users(silver: DataFrame) -> DataFrame:
    """Exact distinct users per day."""
    return silver.groupBy("payment_date").agg(F.count_distinct("user_id").alias("unique_users"))


def top_users(silver: DataFrame, as_of, k: int = 10) -> DataFrame:
    """The ``k`` users with most paid transactions on ``as_of`` (ties by
    user_id).  ``orderBy + limit`` plans as TakeOrderedAndProject: each task
    keeps its own top k, no global sort."""
    return (with_status(on_day(silver, as_of), "paid")
            .groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("num_transactions"),
                 money_sum("amount").alias("total_amount"))
            .orderBy(F.col("num_transactions").desc(), F.col("user_id").asc())
            .limit(k))


def ingestion_rate(bronze: DataFrame, now, minutes: int = 10, col: str = "ingested_at") -> DataFrame:
    """Rows per minute of ``col`` over the last ``minutes`` minutes, newest first."""
    return (in_last_minutes(bronze, col, minutes, now)
            .groupBy(minute_of(col).alias("minute"))
            .agg(F.count(F.lit(1)).alias("rows_ingested"))
            .orderBy(F.col("minute").desc()))


def ingestion_rate_from_log(log: DataFrame, now, minutes: int = 10) -> DataFrame:
    """G5/G6 from a bronze stream's ingestion log (rows per micro-batch)."""
    return (in_last_minutes(log, "ingested_at", minutes, now)
            .groupBy(minute_of("ingested_at").alias("minute"))
            .agg(F.sum("rows").cast("bigint").alias("rows_ingested"))
            .orderBy(F.col("minute").desc()))


def bad_data_profile(bronze: DataFrame, as_of) -> DataFrame:
    """Per raw status on ``as_of``: rows, rows with amount <= 0, min / max amount.
    A NULL status forms its own group."""
    return (on_day(bronze, as_of).groupBy("status")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.count_if(F.col("amount") <= 0).alias("bad_amount"),
                 F.min("amount").alias("min_amount"),
                 F.max("amount").alias("max_amount"))
            .orderBy(F.col("count").desc()))


def bronze_overview(bronze: DataFrame) -> DataFrame:
    """Row count and date range of bronze."""
    return bronze.agg(F.count(F.lit(1)).alias("rows"),
                      F.min("payment_date").alias("min_payment_date"),
                      F.max("payment_date").alias("max_payment_date"))


def bronze_status_counts(bronze: DataFrame, as_of) -> DataFrame:
    """Raw status distribution on ``as_of``, most frequent first."""
    return (on_day(bronze, as_of).groupBy("status")
            .agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc()))


def layer_row_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """``(layer, rows)`` for several tables in one job (union of per-layer
    global counts; each count is computed map-side)."""
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("layer"), "rows")
              for name, df in layers.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
