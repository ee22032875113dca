"""Silver layer.

``silver_rows`` is the cleaning step: keep valid payments, normalise the
status.  ``silver_incremental`` adds the incremental watermark: only rows on
or after the target's newest day minus an overlap are appended, so a re-run
re-inserts the overlap (duplicates until :func:`silver_current` merges them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylake.functions import normalize_status, payment_month
from paylake.operators.merge import latest_by_key
from paylake.schemas import SILVER_A_KEY, SILVER_COLUMNS

EPOCH = "1970-01-01"

# Rejection reasons, in the order the rules are tested.
REJECT_REASONS = ("blank_event_id", "bad_user_id", "bad_amount", "no_payment_date")


def valid_payment(event_id: str = "event_id", user_id: str = "user_id",
                  amount: str = "amount", payment_date: str = "payment_date") -> Column:
    """F1 predicate: event_id non-blank, user_id > 0, amount > 0, date present.

    Written as plain comparisons so Parquet filter push-down can use them.
    """
    return (F.col(event_id).isNotNull() & (F.col(event_id) != "")
            & F.col(user_id).isNotNull() & (F.col(user_id) > 0)
            & F.col(amount).isNotNull() & (F.col(amount) > 0)
            & F.col(payment_date).isNotNull())


def valid_payments(df: DataFrame) -> DataFrame:
    """F1 filter."""
    return df.filter(valid_payment())


def reject_reason() -> Column:
    """Q8: the first F1 rule a row breaks (NULL for a valid row)."""
    return (F.when(F.col("event_id").isNull() | (F.col("event_id") == ""), F.lit(REJECT_REASONS[0]))
            .when(F.col("user_id").isNull() | (F.col("user_id") <= 0), F.lit(REJECT_REASONS[1]))
            .when(F.col("amount").isNull() | (F.col("amount") <= 0), F.lit(REJECT_REASONS[2]))
            .when(F.col("payment_date").isNull(), F.lit(REJECT_REASONS[3])))


def silver_rows(bronze: DataFrame) -> DataFrame:
    """F1 + P11: valid bronze rows with a normalised status, silver columns only."""
    return valid_payments(bronze).select(
        "event_id", "user_id", "amount", normalize_status("status").alias("status"),
        "payment_date", "updated_at")


def incremental_bound(target: DataFrame, overlap_days: int = 1) -> Column:
    """``max(payment_date) - overlap`` of the target, or 1970-01-01 when empty.

    Returned as an uncorrelated scalar subquery; when the source is partitioned
    by date the comparison becomes a runtime partition filter.
    """
    bound = target.agg(
        F.when(F.count(F.lit(1)) > 0, F.date_sub(F.max("payment_date"), overlap_days))
         .otherwise(F.lit(EPOCH).cast("date")).alias("bound"))
    return bound.scalar()


def incremental_since(new: DataFrame, target: DataFrame, overlap_days: int = 1) -> DataFrame:
    """F3 filter: rows of ``new`` at or after the target's watermark.

    When ``new`` is stored by month (``payment_month``), the same bound is also
    applied to the month column so whole month directories are pruned."""
    bound = incremental_bound(target, overlap_days)
    cond = F.col("payment_date") >= bound
    if "payment_month" in new.columns:
        cond = cond & (F.col("payment_month") >= payment_month(bound))
    return new.filter(cond)


def silver_incremental(bronze: DataFrame, target: DataFrame | None,
                       overlap_days: int = 1) -> DataFrame:
    """M4: the rows one incremental run appends (all valid rows on the first run).

    The watermark filter is applied to bronze before cleaning so that it
    reaches the bronze scan as a partition / row-group filter."""
    if target is None:
        return silver_rows(bronze)
    return silver_rows(incremental_since(bronze, target, overlap_days))


def silver_current(appended: DataFrame, order: tuple[str, ...] = ("batch_id", "updated_at")
                   ) -> DataFrame:
    """M1 read of an append-only silver table: one row per sort key, the row of
    the latest batch (ties by ``updated_at``, then the remaining columns).

    A stored table's ``payment_month`` partition column is kept and added to
    the key (it is a function of payment_date, so the result is the same):
    filters on key columns are pushed below the dedup window by Catalyst, so
    a report's day / month predicate still prunes directories and row groups."""
    part = ("payment_month",) if "payment_month" in appended.columns else ()
    keys = SILVER_A_KEY + part
    order = tuple(c for c in order if c in appended.columns)
    rest = tuple(c for c in appended.columns if c not in keys + order)
    return latest_by_key(appended, keys, order + rest).select(*SILVER_COLUMNS, *part)
