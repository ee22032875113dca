"""Session roll-up per user (M8) with mergeable partial aggregates.

A session is a run of one user's events where consecutive events are at most
``gap`` apart.  A plain ``lag`` window over ``partitionBy(user)`` would send
all of a very active user's rows to one task, so the work is split in two:

1. Time is cut into chunks of ``chunk_minutes``, no longer than the gap, so the
   rows of a ``(user, chunk)`` are one session *fragment*: a plain aggregation,
   combined map-side (first/last time, counts, sums).
   Fragments can be added up: a chunk's fragment is that of all parts of its rows,
   so a stored table of fragments by month is kept up to date by computing the
   months anew that a run has touched (:func:`paylake.plans.chains.build_user_tables`).
2. Fragments of one user are stitched in time order: a fragment starts a new
   session when it begins more than ``gap`` after the previous one ends.
   A user has at most about ``span / chunk + span / gap`` fragments, however
   many events they have, so this second window is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: As in money_sum: exact up to 10^16, larger amounts are added as doubles.
_EXACT = "decimal(28,12)"


def fragments(silver: DataFrame, chunk_minutes: int = 5, ts: str = "updated_at", extra: Sequence[str] = ()) -> DataFrame:
    """Session fragments by user and chunk (and the columns ``extra``): first and
    last time, rows, paid rows, and their amounts in two sums."""
    chunk_us = int(chunk_minutes) * 60 * 1_000_000
    paid = F.col("status") == "paid"
    exact = F.col("_exact")                                # one cast a row for both sums
    return (silver.withColumn("chunk", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / chunk_us))
                  .withColumn("_exact", F.when(paid, F.col("amount").try_cast(_EXACT)))
                  .groupBy("user_id", "chunk", *extra)
                  .agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"),
                       F.count(F.lit(1)).alias("events"), F.count_if(paid).alias("paid_events"),
                       F.sum(exact).alias("exact_amount"),
                       F.sum(F.when(paid & exact.isNull(), F.col("amount"))).alias("rest_amount")))


def stitched(parts: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions from fragments; fragments of one user and chunk are added up first."""
    gap = F.expr(f"INTERVAL {int(gap_minutes)} MINUTES")
    sums = [F.sum(c).alias(c) for c in ("events", "paid_events", "exact_amount", "rest_amount")]
    whole = parts.groupBy("user_id", "chunk").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), *sums)
    per_user = Window.partitionBy("user_id").orderBy("first_at", "last_at")
    new = F.coalesce(F.col("first_at") - F.lag("last_at").over(per_user) > gap, F.lit(True))
    numbered = (whole.withColumn("_new", new.cast("int"))
                     .withColumn("_sid", F.sum("_new").over(
                         per_user.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return (numbered.groupBy("user_id", "_sid")
                    .agg(F.min("first_at").alias("session_start"), F.max("last_at").alias("session_end"),
                         F.sum("events").cast("bigint").alias("events"),
                         F.sum("paid_events").cast("bigint").alias("paid_events"),
                         (F.coalesce(F.sum("exact_amount").cast("double"), F.lit(0.0))
                          + F.coalesce(F.sum("rest_amount"), F.lit(0.0))).alias("paid_amount"))
                    .select(F.md5(F.concat_ws("|", "user_id", F.unix_micros(F.col("session_start").cast("timestamp")).cast("string")))
                            .alias("session_id"),
                            "user_id", "session_start", "session_end",
                            F.to_date("session_start").alias("session_date"),
                            "events", "paid_events", "paid_amount"))


def session_rollup(silver: DataFrame, gap_minutes: int = 30, chunk_minutes: int = 5,
                   ts: str = "updated_at") -> DataFrame:
    """Sessions ``(session_id, user_id, session_start, session_end, session_date,
    events, paid_events, paid_amount)``; ``session_date`` is the day the session
    starts and ``session_id`` the MD5 of user and start, the same in every run."""
    if chunk_minutes > gap_minutes:
        raise ValueError("a chunk must not be longer than the gap: it could hold two sessions")
    return stitched(fragments(silver, chunk_minutes, ts), gap_minutes)
