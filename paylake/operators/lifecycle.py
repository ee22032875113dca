"""Table layout and lifecycle.

Partitions are ``key=value`` directories, and nothing is rewritten in place:
expiry and compaction write fresh folders and commit a pointer that lists what is
the table from then on (:mod:`paylake.sources.generations`).  Partitions whose
every row is expired are left out without being read; only the boundary partition
is rewritten.  :func:`paylake.sources.generations.vacuum` frees the space.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paylake.functions import as_date
from paylake.schemas import BRONZE_TTL_DAYS, PARTITION_WINDOW_MONTHS
from paylake.sources import generations


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str],
                      sort_cols: Sequence[str] = (), max_records_per_file: int | None = None) -> None:
    """L1 + O3 + K4: hash-distribute by the partition columns (AQE REBALANCE,
    which splits a hot partition value into several tasks), sort rows inside
    each file by the storage sort key for min/max row-group skipping, append.

    A table with a committed pointer gets a further generation."""
    if generations.pointer(df.sparkSession, path) is not None:
        generations.replace(df.sparkSession, path, df, partition_cols, sort_cols=sort_cols,
                            max_records_per_file=max_records_per_file)
        return
    out = df.hint("rebalance", *partition_cols)
    if sort_cols:
        out = out.sortWithinPartitions(*partition_cols, *sort_cols)
    writer = out.write.mode("append").option("parquet.block.size", generations.ROW_GROUP).partitionBy(*partition_cols)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)


def bucketed_write(df: DataFrame, table: str, key: str = "event_id", buckets: int = 8,
                   partition_col: str | None = None, path: str | None = None) -> None:
    """L4: ``bucketBy(8, key)`` into a catalog table, so joins / aggregations on
    ``key`` with another table bucketed the same way need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if partition_col:
        writer = writer.partitionBy(partition_col)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def retained(df: DataFrame, as_of, days: int = BRONZE_TTL_DAYS, col: str = "payment_date") -> DataFrame:
    """F7/L2 read filter: a row lives while ``col + days > as_of``."""
    return df.filter(F.date_add(F.col(col), days) > as_date(as_of))


def window_start(as_of, back_months: int = PARTITION_WINDOW_MONTHS) -> Column:
    """First day of the oldest month kept by a ``back_months`` rolling window."""
    return F.add_months(F.trunc(as_date(as_of), "MM"), -back_months)


def in_partition_window(df: DataFrame, as_of, back_months: int = PARTITION_WINDOW_MONTHS,
                        col: str = "payment_date") -> DataFrame:
    """L3 read filter: rows in the current month or the ``back_months`` before it."""
    return df.filter(F.col(col) >= window_start(as_of, back_months))


# -- physical expiry ---------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def list_partitions(spark: SparkSession, path: str, partition_col: str) -> list[str]:
    """Directory values of ``partition_col`` in the table now (a listing)."""
    values = {generations.level(d, partition_col) for d in generations.leaves(spark, path)}
    return sorted(v for v in values if v is not None and v != generations.NULL_NAME)


def _month_end(yyyymm: int) -> _dt.date:
    year, month = divmod(int(yyyymm), 100)
    nxt = _dt.date(year + month // 12, month % 12 + 1, 1)
    return nxt - _dt.timedelta(days=1)


def apply_retention(spark: SparkSession, path: str, as_of: _dt.date | str,
                    days: int = BRONZE_TTL_DAYS, partition_col: str = "payment_month",
                    date_col: str = "payment_date") -> dict[str, int]:
    """Leave out the rows that are expired.

    Month-partitioned (``payment_month``): the directories of months ending on or
    before the cutoff go unread, and the one month that is partly expired is read
    and written anew.  Day-partitioned (``partition_col`` is the date column):
    expired days go, nothing is read.  Directories without a date (null) stay."""
    as_of = _dt.date.fromisoformat(str(as_of))
    cutoff = as_of - _dt.timedelta(days=days)          # rows with date <= cutoff expire
    leaves = [d for d in generations.leaves(spark, path)
              if generations.level(d, partition_col) not in (None, generations.NULL_NAME)]
    value = {d: generations.level(d, partition_col) for d in leaves}
    if partition_col == date_col:
        whole = [d for d in leaves if _dt.date.fromisoformat(value[d][:10]) <= cutoff]
        partial = []
    else:
        whole = [d for d in leaves if _month_end(int(value[d])) <= cutoff]
        partial = [d for d in leaves if d not in whole and int(value[d]) <= cutoff.year * 100 + cutoff.month]
    dropped = len({value[d] for d in whole})
    if not whole and not partial:
        return {"dropped_partitions": 0, "rewritten_rows": 0}
    if not partial:
        generations.replace(spark, path, None, generations.levels(whole[0]), whole)
        return {"dropped_partitions": dropped, "rewritten_rows": 0}
    rows = Observation("retention")
    keep = retained(generations.read_some(spark, path, partial), as_of, days, date_col)
    fresh = generations.replace(spark, path, keep.observe(rows, F.count(F.lit(1)).alias("rows")),
                                generations.levels(partial[0]), [*whole, *partial])
    gone = {_without_gen(d) for d in partial} - {_without_gen(d) for d in fresh}
    return {"dropped_partitions": dropped + len(gone), "rewritten_rows": int(rows.get["rows"])}


def _without_gen(leaf: str) -> str:
    return "/".join(p for p in leaf.split("/") if not p.startswith("gen="))


def apply_partition_window(spark: SparkSession, path: str, as_of: _dt.date | str,
                           back_months: int = PARTITION_WINDOW_MONTHS,
                           partition_col: str = "payment_date") -> int:
    """L3 on a day-partitioned table: drop partitions before the window start."""
    as_of = _dt.date.fromisoformat(str(as_of))
    month = as_of.year * 12 + as_of.month - 1 - back_months
    start = _dt.date(month // 12, month % 12 + 1, 1)
    value = {d: generations.level(d, partition_col) for d in generations.leaves(spark, path)}
    old = [d for d, v in value.items() if v not in (None, generations.NULL_NAME) and _dt.date.fromisoformat(v[:10]) < start]
    if old:
        generations.replace(spark, path, None, generations.levels(old[0]), old)
    return len({value[d] for d in old})


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions of a full-refresh table (M5)."""
    fs, hpath = _fs(spark, path)
    versions = sorted((int(st.getPath().getName().split("=", 1)[1]), st.getPath()) for st in fs.listStatus(hpath)
                      if st.isDirectory() and st.getPath().getName().startswith("version=")) if fs.exists(hpath) else []
    old = versions[:-keep] if keep else versions
    for _, directory in old:
        fs.delete(directory, True)
    return len(old)


def compact(spark: SparkSession, path: str, partition_col: str, values: Sequence[str]) -> int:
    """K4: rewrite the directories of the given partition values into files of the
    advisory size (64 MB), as a fresh generation; returns how many directories took
    part.  Batch directories of streams are folded by :func:`fold_batches`."""
    wanted = {str(v) for v in values}
    old = [d for d in generations.leaves(spark, path) if generations.level(d, partition_col) in wanted]
    if old:
        generations.replace(spark, path, generations.read_some(spark, path, old), generations.levels(old[0]), old)
    return len(old)


def last_committed(spark: SparkSession, checkpoint: str) -> int | None:
    """The newest micro-batch that a stream has committed: it starts after it, so
    it never writes this one's or an earlier one's output again."""
    fs, hpath = _fs(spark, f"{checkpoint}/commits")
    if not fs.exists(hpath):
        return None
    done = [int(st.getPath().getName()) for st in fs.listStatus(hpath) if st.getPath().getName().isdigit()]
    return max(done, default=None)


def fold_batches(spark: SparkSession, path: str, checkpoint: str,
                 combine: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """K4 for stream-written tables: merge closed batch directories.

    The checkpoint's last committed batch is the fence.  In every partition that
    has several directories up to the fence, their rows (after ``combine``, if
    given) are written to one, under the fence's ``batch_id``; a replayed batch is
    always above the fence and keeps its own directory.  Files come in the advisory
    size (64 MB), whatever the number of batches.  Running it again, or after a
    kill, gives the same rows."""
    fence = last_committed(spark, checkpoint)
    groups: dict[str, list[str]] = {}
    for d in generations.leaves(spark, path):
        batch = generations.level(d, "batch_id")
        if fence is not None and batch is not None and batch != generations.NULL_NAME and int(batch) <= fence:
            groups.setdefault("/".join(p for p in _without_gen(d).split("/") if not p.startswith("batch_id=")), []).append(d)
    old = [d for dirs in groups.values() if len(dirs) > 1 for d in dirs]
    if not old:
        return {"folded": 0, "into": 0}
    rows = generations.read_some(spark, path, old)
    if combine is not None:
        rows = combine(rows)
    fresh = generations.replace(spark, path, rows.withColumn("batch_id", F.lit(fence).cast("bigint")),
                                generations.levels(old[0]), old)
    return {"folded": len(old), "into": len(fresh)}
