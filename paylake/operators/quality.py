"""Data-quality checks and lane comparisons.

Checks return small result frames ``(check_name, column_name, failures,
status)`` computed in one pass; nothing is collected to the driver unless a
caller asks for a pass/fail decision (:func:`raise_on_failure`).

The bronze-vs-silver comparisons need counts from two tables.  Instead of a
cross join of two one-row aggregates they tag the rows of both inputs,
``unionByName`` them and aggregate once -- no join, no broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.operators.reports import on_day
from paylake.functions import as_date, as_timestamp, minutes_before, percent
from paylake.operators.silver import reject_reason

_SUMMARY = ("check_name", "column_name", "failures", "status")


def _summary(df: DataFrame, check: str, failures: dict[str, Column]) -> DataFrame:
    """One aggregation pass, then one row per column: failures and pass/fail."""
    wide = df.agg(*[c.alias(name) for name, c in failures.items()])
    long = wide.unpivot([], list(failures), "column_name", "failures")
    return long.select(F.lit(check).alias("check_name"), "column_name",
                       F.col("failures").cast("bigint").alias("failures"),
                       F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"))


def check_not_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Q1: NULL count per column."""
    return _summary(df, "not_null", {c: F.count_if(F.col(c).isNull()) for c in cols})


def check_accepted(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Q2: rows whose ``col`` is outside ``values`` (NULL is not tested)."""
    bad = F.col(col).isNotNull() & ~F.col(col).isin(*values)
    return _summary(df, "accepted_values", {col: F.count_if(bad)})


def check_columns(df: DataFrame, not_null: Sequence[str] = (), accepted: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Q1 and Q2 of a layer in one pass over it: the rows of :func:`check_not_null`
    and of :func:`check_accepted` for each column of ``accepted``."""
    accepted = accepted or {}
    counts = {("not_null", c): F.count_if(F.col(c).isNull()) for c in not_null}
    counts |= {("accepted_values", c): F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in accepted.items()}
    wide = df.agg(F.array(*[F.struct(F.lit(check).alias("check_name"), F.lit(col).alias("column_name"),
                                     n.cast("bigint").alias("failures")) for (check, col), n in counts.items()]).alias("c"))
    return (wide.select(F.explode("c").alias("c")).select("c.check_name", "c.column_name", "c.failures")
                .withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("fail")))


def accepted_violations(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Q2 detail: each unexpected value and how often it occurs."""
    return (df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*values))
              .groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("failures")))


def check_length(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Q10: values longer than the column's VARCHAR(n) limit."""
    return _summary(df, "max_length", {c: F.count_if(F.length(c) > n) for c, n in limits.items()})


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q9: keys that occur more than once, with their multiplicity.

    A grouped count with map-side partial aggregation: a hot key collapses to
    one row per task before the shuffle."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
              .filter(F.col("occurrences") > 1))


def check_unique_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q9 summary: number of duplicated keys and of surplus rows."""
    dups = check_unique(df, keys)
    return dups.agg(F.lit("unique").alias("check_name"),
                    F.lit(",".join(keys)).alias("column_name"),
                    F.count(F.lit(1)).alias("duplicate_keys"),
                    F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).cast("bigint")
                     .alias("surplus_rows"))


def check_freshness(df: DataFrame, col: str, now, warn_hours: float = 2,
                    error_hours: float = 6) -> DataFrame:
    """Q3: newest ``col`` against ``now``: pass / warn / error by age."""
    newest = F.max(col)
    age_ms = (F.unix_millis(as_timestamp(now).cast("timestamp"))
              - F.unix_millis(newest.cast("timestamp")))
    return df.agg(F.lit(col).alias("column_name"), newest.alias("newest"),
                  age_ms.alias("age_ms")).select(
        "column_name", "newest", "age_ms",
        F.when(F.col("age_ms").isNull() | (F.col("age_ms") > error_hours * 3_600_000), "error")
         .when(F.col("age_ms") > warn_hours * 3_600_000, "warn").otherwise("pass")
         .alias("status"))


def exists_since(df: DataFrame, col: str, minutes: int, now) -> Column:
    """Existence test ``EXISTS(rows with col > now - minutes)`` as a column.

    Spark rewrites an uncorrelated EXISTS to a LIMIT 1 scalar subquery, so the
    scan stops at the first matching row."""
    return df.filter(F.col(col) > minutes_before(now, minutes)).select(F.lit(1)).exists()


def gate_frame(spark: SparkSession, name: str, passed: Column) -> DataFrame:
    """One row ``(gate, passed)`` for a gate condition given as a column."""
    return spark.range(1).select(F.lit(name).alias("gate"), passed.alias("passed"))


def has_new_data(bronze: DataFrame, now, minutes: int = 6, col: str = "ingested_at") -> bool:
    """Q4: True when bronze got rows in the last ``minutes``; else the run is skipped."""
    return bool(gate_frame(bronze.sparkSession, "new_data",
                           exists_since(bronze, col, minutes, now)).first()["passed"])


def require_recent(bronze: DataFrame, now, hours: int = 2, col: str = "updated_at") -> None:
    """Q5: raise unless some row was updated in the last ``hours``."""
    ok = gate_frame(bronze.sparkSession, "recent",
                    exists_since(bronze, col, hours * 60, now)).first()["passed"]
    if not ok:
        raise RuntimeError(f"no {col} newer than {hours} h before {now}")


def reject_profile(bronze: DataFrame) -> DataFrame:
    """Q8: how many bronze rows each silver rule rejects (first failing rule)."""
    return (bronze.select(reject_reason().alias("reason")).filter(F.col("reason").isNotNull())
                  .groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))


def _tagged_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables in one aggregation over a tagged union."""
    tagged = None
    for tag in frames:
        part = frames[tag].select(F.lit(tag).alias("_tag"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.agg(*[F.count_if(F.col("_tag") == tag).alias(tag) for tag in frames])


def drop_rate(bronze: DataFrame, silver: DataFrame, as_of) -> DataFrame:
    """Bronze vs silver rows on ``as_of``, dropped rows and drop %."""
    counts = _tagged_counts({"total_bronze": on_day(bronze, as_of),
                             "total_silver": on_day(silver, as_of)})
    return counts.select("total_bronze", "total_silver",
                         (F.col("total_bronze") - F.col("total_silver")).alias("dropped"),
                         percent(F.col("total_bronze") - F.col("total_silver"),
                                 F.col("total_bronze")).alias("drop_pct"))


def drop_count(bronze: DataFrame, silver: DataFrame, as_of) -> DataFrame:
    """Lane-B variant without the percentage."""
    counts = _tagged_counts({"bronze_count": on_day(bronze, as_of),
                             "silver_count": on_day(silver, as_of)})
    return counts.select("bronze_count", "silver_count",
                         (F.col("bronze_count") - F.col("silver_count")).alias("dropped"))


def lane_lag(bronze_a: DataFrame, bronze_b: DataFrame, as_of) -> DataFrame:
    """Rows in lane A vs lane B bronze on ``as_of``; the difference is what
    lane B has not committed yet."""
    counts = _tagged_counts({"lane_a_rows": on_day(bronze_a, as_of),
                             "lane_b_rows": on_day(bronze_b, as_of)})
    return counts.select("lane_a_rows", "lane_b_rows",
                         (F.col("lane_a_rows") - F.col("lane_b_rows")).alias("lag_rows"))


def lane_lag_by_day(bronze_a: DataFrame, bronze_b: DataFrame) -> DataFrame:
    """J3 per day: counts of both lanes for every day present in either lane
    (what a full outer join of two daily counts gives, without the join)."""
    tagged = (bronze_a.select("payment_date", F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(bronze_b.select("payment_date", F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    return (tagged.groupBy("payment_date")
                  .agg(F.sum("_a").cast("bigint").alias("lane_a_rows"),
                       F.sum("_b").cast("bigint").alias("lane_b_rows"))
                  .withColumn("lag_rows", F.col("lane_a_rows") - F.col("lane_b_rows"))
                  .orderBy(F.col("payment_date").desc()))


def raise_on_failure(summary: DataFrame) -> None:
    """Stop a chain when a check summary has failing rows (T8 'tests')."""
    failed = summary.filter(F.col("status") != "pass").collect()      # one row per check
    if failed:
        raise RuntimeError("data checks failed: " + "; ".join(
            f"{r['check_name']}:{r['column_name']}={r['failures']}" for r in failed))
