"""Python workers give memory back: they live on from one stage of the pipeline to the next."""
import os
import re

import pyarrow as pa
from pyspark.sql import functions as F

from paylake.llm import common
from paylake.llm import gumbel_pieces as G


def test_token_tasks_leave_little_behind(spark):
    """A task over 100,000 distinct words: what it took is given back when it ends."""
    def own_mb(batches):
        # the worker's pid and the MB that it holds of its own
        for _ in batches:
            with open("/proc/self/smaps_rollup") as f:
                mb = sum(map(int, re.findall(r"\nPrivate_Dirty:\s+(\d+)", f.read()))) / 1024
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([mb], pa.float64())], names=["pid", "mb"])

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.md5((F.col("id") * 100 + i).cast("string"))))
    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    sampled = G.sample(docs, decoded=True)
    assert sampled.filter(G.round_trip()).count() == 2000
    left = spark.range(0, 4, 1, 1).mapInArrow(own_mb, "pid long, mb double").collect()
    assert max(r.mb for r in left) < 150


def test_small_table(spark):
    schema = "name string, no long, part double"
    rows = [(None, 0, 0.5), ("a", 1, 2.0)]
    got = common.small_table(spark, rows, schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert got.schema.simpleString() == "struct<name:string,no:bigint,part:double>"
    assert common.small_table(spark, [(None, 0, 1.0)], schema).collect()[0].name is None
    assert common.small_table(spark, [], schema).count() == 0
