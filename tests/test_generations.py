"""Committed tables: a writer that dies leaves the old table whole, folding keeps rows."""
import datetime as dt
import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paylake.operators.lifecycle import apply_retention, compact, fold_batches, last_committed, write_partitioned
from paylake.operators.merge import merge_partitions, touched_leaves, upsert
from paylake.sources import generations

SCHEMA = "event_id string, user_id bigint, amount double, status string, payment_date date, updated_at timestamp_ntz"
KEYS, ORDER = ["event_id", "payment_date"], ["updated_at", "amount"]


def _row(eid, day, amount=10.0, hour=0):
    d = dt.date(2024, 1, day) if day else None
    return (eid, 1, amount, "paid", d, dt.datetime(2024, 1, day or 1, hour))


def _rows(spark, path):
    return sorted((r.event_id, r.amount, str(r.payment_date)) for r in generations.read(spark, path).collect())


@pytest.mark.parametrize("dies_at", ["write", "commit"])
def test_a_killed_upsert_leaves_the_old_table_whole(spark, tmp_dir, monkeypatch, dies_at):
    path = f"{tmp_dir}/t"
    upsert(spark, path, spark.createDataFrame([_row("a", 1), _row("b", 2), _row("c", 2)], SCHEMA), KEYS, ORDER, "payment_date")
    before = _rows(spark, path)
    upd = spark.createDataFrame([_row("b", 2, 99.0, 3), _row("d", 3)], SCHEMA)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(generations, "commit" if dies_at == "commit" else "_leaf_dirs", die)
        upsert(spark, path, upd, KEYS, ORDER, "payment_date")
    assert _rows(spark, path) == before
    upsert(spark, path, upd, KEYS, ORDER, "payment_date")
    after = _rows(spark, path)
    assert after == [("a", 10.0, "2024-01-01"), ("b", 99.0, "2024-01-02"), ("c", 10.0, "2024-01-02"), ("d", 10.0, "2024-01-03")]
    # the old folders and what the dead writer left go; the table doesn't change
    assert generations.vacuum(spark, path, keep=1) > 0
    assert _rows(spark, path) == after
    live = {os.path.dirname(f) for f in glob.glob(f"{path}/gen=*/*/*.parquet")}
    assert live == {f"{path}/{d}" for d in generations.leaves(spark, path)}


def test_untouched_partitions_keep_their_files(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    upsert(spark, path, spark.createDataFrame([_row("a", 1), _row("b", 2), _row("n", None)], SCHEMA), KEYS, ORDER, "payment_date")
    first = {generations.level(d, "payment_date"): d for d in generations.leaves(spark, path)}
    upsert(spark, path, spark.createDataFrame([_row("b", 2, 5.0, 9), _row("n", None, 7.0)], SCHEMA), KEYS, ORDER, "payment_date")
    second = {generations.level(d, "payment_date"): d for d in generations.leaves(spark, path)}
    assert second["2024-01-01"] == first["2024-01-01"]
    assert second["2024-01-02"] != first["2024-01-02"] and second[generations.NULL_NAME] != first[generations.NULL_NAME]
    assert ("n", 7.0, "None") in _rows(spark, path) and len(_rows(spark, path)) == 3


def test_a_second_writer_of_a_generation_fails(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    generations.replace(spark, path, spark.createDataFrame([(1, "a")], "x int, p string"), ["p"])
    state = generations.pointer(spark, path)
    with pytest.raises(RuntimeError, match="another writer"):
        generations.commit(spark, path, state)


def test_touched_leaves_of_escaped_values(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    df = spark.createDataFrame([(1, "a:b"), (2, None), (3, "x y%"), (4, "a+b"), (5, "plain")], "x int, p string")
    generations.replace(spark, path, df, ["p"])
    for value, x in [("a:b", 1), (None, 2), ("x y%", 3), ("a+b", 4)]:
        dirs = touched_leaves(spark, path, "p", [value])
        assert [r.x for r in generations.read_some(spark, path, dirs).collect()] == [x]


def test_columns_grow_with_the_rows_written(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    generations.replace(spark, path, spark.createDataFrame([(1, "a")], "x int, p string"), ["p"])
    generations.replace(spark, path, spark.createDataFrame([(2, 5.0, "b")], "x int, y double, p string"), ["p"])
    assert generations.read(spark, path).columns == ["x", "y", "p"]
    assert sorted(tuple(r) for r in generations.read(spark, path).collect()) == [(1, None, "a"), (2, 5.0, "b")]
    generations.replace(spark, path, None, ["p"], generations.leaves(spark, path))
    assert generations.read(spark, path).columns == ["x", "y", "p"] and generations.read(spark, path).count() == 0


def _batches(spark, path, ids, rows=30):
    for b in ids:
        (spark.range(rows).select((F.col("id") + 1000 * b).alias("x"), F.lit(b).cast("bigint").alias("batch_id"),
                                  (F.lit(202401) + F.col("id") % 2).cast("int").alias("payment_month"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("payment_month", "batch_id").parquet(path))


def _committed(tmp_dir, n):
    os.makedirs(f"{tmp_dir}/ck/commits", exist_ok=True)
    for b in range(n):
        open(f"{tmp_dir}/ck/commits/{b}", "w").close()
    return f"{tmp_dir}/ck"


def test_folding_closed_batches_survives_a_replay(spark, tmp_dir, monkeypatch):
    path, ck = f"{tmp_dir}/bronze", _committed(tmp_dir, 9)
    _batches(spark, path, range(10))                       # batch 9 is written but not committed
    values = lambda: sorted(r.x for r in generations.read(spark, path).collect())
    before = values()
    assert last_committed(spark, ck) == 8
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(generations, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        fold_batches(spark, path, ck)
    assert values() == before
    assert fold_batches(spark, path, ck) == {"folded": 18, "into": 2}
    assert values() == before and len(generations.leaves(spark, path)) == 4
    _batches(spark, path, [9])                             # the stream replays the batch that was open
    assert values() == before
    assert fold_batches(spark, path, ck) == {"folded": 0, "into": 0}
    _committed(tmp_dir, 12)
    _batches(spark, path, [10, 11])
    assert fold_batches(spark, path, ck) == {"folded": 8, "into": 2}
    assert len(values()) == 12 * 30 and len(generations.leaves(spark, path)) == 2
    assert generations.vacuum(spark, path, keep=1) > 0
    assert len(values()) == 12 * 30
    assert {r.batch_id for r in generations.read(spark, path).select("batch_id").distinct().collect()} == {11}


def test_folding_with_sums(spark, tmp_dir):
    path, ck = f"{tmp_dir}/counts", _committed(tmp_dir, 4)
    for b in range(4):
        (spark.createDataFrame([("m1", 2, "d"), (f"m{b}", 1, "d")], "minute string, rows bigint, day string").withColumn("batch_id", F.lit(b))
         .write.mode("append").partitionBy("day", "batch_id").parquet(path))
    total = lambda: {r.minute: r.n for r in generations.read(spark, path).groupBy("minute").agg(F.sum("rows").alias("n")).collect()}
    before = total()
    fold_batches(spark, path, ck, lambda df: df.groupBy("minute", "day").agg(F.sum("rows").alias("rows")))
    assert total() == before and generations.read(spark, path).count() == len(before)


def test_merge_retention_and_compaction_in_one_table(spark, tmp_dir):
    path = f"{tmp_dir}/silver"
    rows = [(f"e{i}", i % 5, dt.date(2023, 12, 1) + dt.timedelta(days=i), b) for i in range(60) for b in (0, 1)]
    df = spark.createDataFrame(rows, "event_id string, user_id int, payment_date date, batch_id int") \
        .withColumn("payment_month", (F.year("payment_date") * 100 + F.month("payment_date")).cast("int"))
    generations.replace(spark, path, df.repartition(6), ["payment_month"])
    assert merge_partitions(spark, path, "payment_month", [202312, 202401], ["event_id"], ["batch_id"]) == 60
    assert apply_retention(spark, path, "2024-04-10", 90) == {"dropped_partitions": 1, "rewritten_rows": 18}
    compact(spark, path, "payment_month", [202401])
    left = generations.read(spark, path)
    assert left.count() == 18 and left.agg(F.min("payment_date")).first()[0] == dt.date(2024, 1, 12)


def test_a_file_has_row_groups_for_several_tasks(spark, tmp_dir, monkeypatch):
    """One file of one large row group is read by one task, however many are free."""
    monkeypatch.setattr(generations, "ROW_GROUP", 64 * 1024)
    rows = spark.range(50_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.lit(1).alias("p"))
    write_partitioned(rows, f"{tmp_dir}/plain", ["p"])
    generations.replace(spark, f"{tmp_dir}/gen", rows, ["p"])
    for name in ("plain", "gen"):
        groups = [pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{tmp_dir}/{name}/**/*.parquet", recursive=True)]
        assert len(groups) == 1 and groups[0] > 4, (name, groups)
        assert generations.read(spark, f"{tmp_dir}/{name}").distinct().count() == 50_000
