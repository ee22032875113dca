"""Keyed merge, dedup and table materialisation (M1-M7).

``latest_by_key`` is the core: ``row_number() = 1`` per key.  Spark plans it
with a *partial* WindowGroupLimit before the shuffle, so every map task keeps
only its best row per key; a key that holds a third of all rows still sends
one row per map task across the network.

Tables are Parquet directories (no table format is on the classpath), so:

* M3 ``upsert`` reads only the partitions the update touches, merges, writes the
  result to a fresh folder and commits a pointer that names it in their place
  (:mod:`paylake.sources.generations`): a run killed at any moment leaves the old
  table whole.
* M5 ``overwrite_table`` appends a new ``version=N`` partition and readers take
  the newest one, so a failed build never leaves a half-written table.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylake.functions import to_amount_decimal
from paylake.schemas import SILVER_B_KEY, SILVER_COLUMNS
from paylake.session import shared_dir
from paylake.sources import generations


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """M1: keep, per ``keys``, the row that is greatest by ``order`` (descending,
    NULLs last).  Give ``order`` a total order for a deterministic survivor."""
    spec = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") == 1).drop("_rn")


def user_dim(silver: DataFrame) -> DataFrame:
    """M2: latest silver row per user (versioned by ``updated_at``, ties by event_id)."""
    return latest_by_key(silver, ["user_id"], ["updated_at", "event_id", "payment_date"]).select(
        "user_id", F.col("event_id").alias("last_event_id"),
        F.col("status").alias("last_status"), F.col("amount").alias("last_amount"),
        F.col("payment_date").alias("last_payment_date"), F.col("updated_at").alias("last_updated_at"))


def upsert_frame(current: DataFrame, updates: DataFrame, keys: Sequence[str],
                 order: Sequence[str]) -> DataFrame:
    """M3 merge semantics of a primary-key table: the later write wins.

    A key's row comes from ``updates`` if it is there, whatever its
    ``updated_at``; ``order`` decides between rows of the same write."""
    cols = current.columns
    both = (current.select(*cols, F.lit(0).alias("_src"))
            .unionByName(updates.select(*cols, F.lit(1).alias("_src"))))
    return latest_by_key(both, keys, ["_src", *order]).drop("_src")


def partition_values(updates: DataFrame, partition_col: str) -> list:
    """Distinct partition values of ``updates``: at most one per partition
    directory, so their number is bounded by the table layout."""
    return [r[0] for r in updates.select(partition_col).distinct().collect()]


def touched_partitions(current: DataFrame, updates: DataFrame, partition_col: str,
                       values: list | None = None) -> DataFrame:
    """Rows of ``current`` in the partitions that ``updates`` touches.

    The distinct partition values of the update are applied as a literal
    IN-list, which Spark turns into static partition pruning of the
    ``current`` scan -- no join, no shuffle of the current table."""
    if values is None:
        values = partition_values(updates, partition_col)
    return current.filter(F.col(partition_col).isin(values))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives executor loss)
    and cut its lineage, so the source path may then be overwritten."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def upsert(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str],
           order: Sequence[str], partition_col: str, stable: bool = False) -> list:
    """M3: primary-key upsert into a partitioned Parquet table at ``path``;
    returns the partition values it rewrote.

    The update is checkpointed once (it is read twice -- for the touched partition
    values and for the merge -- and must not change between the two under task
    retries), unless the caller says that it is ``stable``.  Only the directories of the touched values are read; the merged
    rows are written to a fresh folder and take their place with the commit."""
    updates = updates if stable else checkpointed(updates)
    values = partition_values(updates, partition_col)
    old = touched_leaves(spark, path, partition_col, values)
    if old:
        current = generations.read_some(spark, path, old)
        merged = upsert_frame(current, updates.select(*[c for c in current.columns if c in updates.columns]), keys, order)
    else:
        merged = latest_by_key(updates, keys, order)
    generations.replace(spark, path, merged, [partition_col], old)
    return values


def touched_leaves(spark: SparkSession, path: str, partition_col: str, values: Sequence) -> list[str]:
    """The table's directories that hold the given partition values.  The values
    are compared after Spark has read the directories' names, one row each, so
    escaped and null values match."""
    dirs = generations.leaves(spark, path)
    if not dirs or not values:
        return []
    kind = generations.read_some(spark, path, dirs[:1]).schema[partition_col].dataType
    names = spark.createDataFrame([(d, generations.level(d, partition_col)) for d in dirs], "leaf string, name string")
    value = F.when(F.col("name") != generations.NULL_NAME, F.expr("url_decode(replace(name, '+', '%2B'))")).cast(kind)
    wanted = set(values)
    return [r["leaf"] for r in names.select("leaf", value.alias("value")).collect() if r["value"] in wanted]


def overwrite_table(df: DataFrame, path: str, version: int | None = None) -> int:
    """M5 full refresh: write ``df`` as a new ``version=N`` of the table at ``path``.

    The new version appears only when the write job commits; readers use
    :func:`paylake.sources.tables.read_latest_version`.  Old versions are
    removed by :func:`paylake.operators.lifecycle.drop_old_versions`."""
    version = version if version is not None else time.time_ns() // 1_000_000
    df.write.parquet(f"{path}/version={version}")
    return version


def align_schema(df: DataFrame, target: T.StructType, policy: str = "ignore") -> DataFrame:
    """M6 schema-change policy for writes into an existing table.

    ``ignore``: keep the target's columns (missing ones NULL, new ones dropped);
    ``append_new_columns``: target columns first, then the new ones;
    ``fail``: raise if the column sets differ."""
    names = set(df.columns)
    target_cols = [F.col(f.name).cast(f.dataType) if f.name in names
                   else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields]
    extra = [c for c in df.columns if c not in set(target.fieldNames())]
    if policy == "ignore":
        return df.select(*target_cols)
    if policy == "append_new_columns":
        return df.select(*target_cols, *extra)
    if policy == "fail":
        if extra or names != set(target.fieldNames()):
            raise ValueError(f"schema differs from target: new={extra}")
        return df.select(*target_cols)
    raise ValueError(f"unknown schema policy {policy!r}")


def to_warehouse_silver(silver_a: DataFrame) -> DataFrame:
    """M7 column mapping: lane-A silver -> lane-B silver (DECIMAL amount, all
    columns NOT NULL).  Rows that don't fit are :func:`sync_misfits`."""
    return (silver_a.select("event_id", "user_id", to_amount_decimal("amount").alias("amount"),
                            "status", "payment_date", "updated_at")
                    .dropna(subset=list(SILVER_COLUMNS)))


def sync_misfits(silver_a: DataFrame) -> DataFrame:
    """The lane-A silver rows that :func:`to_warehouse_silver` can't hold, with
    the ``reason``: the first column that is NULL, or an amount beyond
    DECIMAL(12,2).  A sync writes them to the table ``sync_quarantine``."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"null_{c}")) for c in SILVER_COLUMNS],
                        F.when(to_amount_decimal("amount").isNull(), F.lit("amount_overflow")))
    return (silver_a.select(*SILVER_COLUMNS).withColumn("reason", reason)
                    .filter(F.col("reason").isNotNull()))


def sync_frame(silver_a: DataFrame, silver_b: DataFrame | None = None) -> DataFrame:
    """M7 as a frame: current lane-A silver merged into warehouse silver on
    ``(event_id, payment_date)``; the later write wins, within one write the
    latest ``updated_at``.  One keyed pass either way."""
    order = ["updated_at", "user_id", "amount", "status"]
    incoming = to_warehouse_silver(silver_a)
    if silver_b is None:
        return latest_by_key(incoming, SILVER_B_KEY, order)
    return upsert_frame(silver_b.select(*SILVER_COLUMNS), incoming, SILVER_B_KEY, order)


def sync_silver(spark: SparkSession, silver_a: DataFrame, path_b: str, quarantine_path: str | None = None,
                batch_id: int = 0, stable: bool = False) -> list:
    """M7: upsert current lane-A silver into the warehouse silver table;
    returns the days (partitions) it rewrote.  Rows that the warehouse silver
    can't hold replace the ``batch_id`` of the table at ``quarantine_path``.
    ``stable``: the rows are written already and can't change."""
    if quarantine_path:
        (sync_misfits(silver_a).withColumn("batch_id", F.lit(int(batch_id)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(quarantine_path))
    incoming = to_warehouse_silver(silver_a)
    return upsert(spark, path_b, incoming, SILVER_B_KEY,
                  ["updated_at", "user_id", "amount", "status"], "payment_date", stable)


def merge_bucketed(spark: SparkSession, current: str, updates: str, keys: Sequence[str]) -> DataFrame:
    """L4 + M3: the rows of the catalog table ``current`` with those of ``updates``
    in their place, both bucketed alike by the first of ``keys`` and unique by all.

    Buckets are joined on their own key (the other keys are left to the condition,
    as a join on all of them would ask for other buckets), so neither table is
    shuffled; the later write's row stands."""
    a, b = spark.table(current).alias("a"), spark.table(updates).alias("b")
    same = F.col(f"a.{keys[0]}") == F.col(f"b.{keys[0]}")
    rest = [F.coalesce(F.col(f"a.{k}") == F.col(f"b.{k}"), F.col(f"a.{k}").isNull() & F.col(f"b.{k}").isNull())
            for k in keys[1:]]
    kept = a.join(b, reduce(lambda x, y: x & y, rest, same), "left_anti")
    return kept.select("*").unionByName(b.select("*"))


def merge_partitions(spark: SparkSession, path: str, partition_col: str, values: Sequence,
                     keys: Sequence[str], order: Sequence[str]) -> int:
    """M1 applied at merge time: rewrite the given partitions keeping only the
    latest row per key (what a replacing merge tree does in the background).

    Only the directories of the listed values are read; the merged rows take
    their place with the commit of a fresh folder.  Returns the rows kept."""
    old = touched_leaves(spark, path, partition_col, values)
    if not old:
        return 0
    kept = Observation("merge_partitions")
    merged = latest_by_key(generations.read_some(spark, path, old), keys, order)
    generations.replace(spark, path, merged.observe(kept, F.count(F.lit(1)).alias("rows")),
                        generations.levels(old[0]), old)
    return int(kept.get["rows"])
