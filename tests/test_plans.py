"""Physical-plan shape: pushdown, pruning, map-side reduction, no joins."""
from paylake.operators import quality as Q
from paylake.operators.gate import split_valid, validate_events
from paylake.operators.gold import gold_revenue
from paylake.operators.merge import latest_by_key
from paylake.operators.parse import bronze_lane_a, bronze_lane_b
from paylake.operators.reports import top_users
from paylake.operators.silver import silver_rows
from paylake.plans import inputs as I

SF = "/root/testdata/sf0.01"


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_silver_filter_pushed_to_scan(spark, tmp_dir):
    path = f"{tmp_dir}/bronze"
    I.bronze(spark, SF).write.parquet(path)
    plan = _plan(silver_rows(spark.read.parquet(path)).select("event_id", "amount"))
    assert "GreaterThan(user_id,0)" in plan and "GreaterThan(amount,0.0)" in plan
    assert "IsNotNull(payment_date)" in plan
    assert "ReadSchema: struct<event_id:string,user_id:bigint,amount:double,payment_date:date>" in plan


def test_incremental_bound_prunes_partitions(spark, tmp_dir):
    from pyspark.sql import functions as F
    from paylake.operators.silver import incremental_since
    path = f"{tmp_dir}/bronze_m"
    (I.bronze(spark, SF).withColumn("payment_month", F.year("payment_date") * 100 + F.month("payment_date"))
     .write.partitionBy("payment_month").parquet(path))
    bronze = spark.read.parquet(path)
    plan = _plan(incremental_since(bronze, silver_rows(bronze)))
    assert "PartitionFilters: [isnotnull(payment_month" in plan and "Subquery" in plan


def test_gold_distinct_two_phase_no_expand(spark):
    plan = _plan(gold_revenue(I.silver_b(spark, SF)))
    assert "Expand" not in plan
    assert "partial_count(distinct user_id" in plan


def test_dedup_pre_limits_before_shuffle(spark):
    plan = _plan(latest_by_key(I.lineitem_bronze(spark, SF), ["event_id"], ["payment_date"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_users_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in _plan(top_users(I.silver_now(spark, SF), I.AS_OF))


def test_lane_comparisons_have_no_join(spark):
    plan = _plan(Q.drop_rate(I.bronze(spark, SF), I.silver_now(spark, SF), I.AS_OF))
    assert "Join" not in plan and "Cartesian" not in plan


def test_report_over_merged_silver_prunes_months(spark, tmp_dir):
    from pyspark.sql import functions as F
    from paylake.functions import payment_month
    from paylake.operators.silver import silver_current
    path = f"{tmp_dir}/silver"
    (silver_rows(I.bronze(spark, SF)).withColumn("batch_id", F.lit(0))
     .withColumn("payment_month", payment_month("payment_date"))
     .write.partitionBy("payment_month").parquet(path))
    plan = _plan(top_users(silver_current(spark.read.parquet(path)), I.AS_OF))
    assert "PartitionFilters: [isnotnull(payment_month" in plan
    assert "EqualTo(payment_date,2024-01-30)" in plan
    scan = plan.index("FileScan")
    assert plan.index("WindowGroupLimit") < scan      # filter sits below the dedup


def test_spread_only_for_under_partitioned_inputs(spark, tmp_dir):
    from paylake.session import spread
    many = f"{tmp_dir}/many"
    spark.range(0, 20000, numPartitions=12).write.parquet(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")   # one split per file
    try:
        wide = spark.read.parquet(many)
        assert wide.rdd.getNumPartitions() >= 4
        assert "Exchange" not in _plan(spread(wide, 4))           # already split: no shuffle
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = spark.read.parquet(f"{SF}/events.parquet")
    assert one.rdd.getNumPartitions() == 1
    assert "RoundRobinPartitioning(4)" in _plan(spread(one, 4))


def test_filters_read_values_of_parsed_messages(spark):
    """No filter parses a message again: the gate's and both lanes' filters stand above the computed columns."""
    messages = spark.createDataFrame([(0, '{"event_id":"a","user_id":1,"payment_date":"2024-01-02","updated_at":"2024-01-02T10:00:00Z"}')], "offset long, value string")
    good, _ = split_valid(validate_events(messages))
    for lane in (bronze_lane_a, bronze_lane_b):
        rows, _ = lane(good)
        late = rows.filter("updated_at > TIMESTAMP_NTZ '2024-01-01 00:00:00' or event_id = 'a'")
        plan = late._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter" in line]
        assert filters and not any(word in line for line in filters for word in ("from_json", "jsontostructs", "parse_json", "parseJson", "json_array_length", "variant"))
        assert [r.event_id for r in late.collect()] == ["a"]
