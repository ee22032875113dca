from decimal import Decimal

from pyspark.sql import functions as F

from paylake.operators.gold import gold_revenue
from paylake.operators.merge import sync_frame
from paylake.operators.silver import reject_reason, silver_current, silver_rows
from paylake.plans import inputs as I

SF = "/root/testdata/sf0.01"


def test_bronze_is_silver_plus_rejects(spark):
    bronze = I.bronze(spark, SF)
    silver = silver_rows(bronze)
    rejects = bronze.filter(reject_reason().isNotNull())
    assert bronze.count() == silver.count() + rejects.count()
    assert silver.count() == 8663                     # FIXTURES.md section 3


def test_status_counts_sum_to_total_and_gold_matches_silver(spark):
    silver_b = I.silver_b(spark, SF)
    gold = gold_revenue(silver_b, with_build_time=False)
    g = gold.agg(*[F.sum(c).alias(c) for c in ("total_paid_orders", "pending_orders", "failed_orders",
                                               "refunded_orders", "cancelled_orders", "unknown_orders",
                                               "total_revenue")]).first()
    total = sum(g[c] for c in g.asDict() if c.endswith("_orders"))
    assert total == silver_b.count()
    paid = silver_b.filter("status = 'paid'").agg(F.sum("amount")).first()[0]
    assert Decimal(g.total_revenue) == Decimal(paid)
    assert gold.count() == 30


def test_silver_rerun_idempotent_after_merge(spark):
    silver = I.silver(spark, SF)
    twice = silver.withColumn("batch_id", F.lit(0)).unionByName(silver.withColumn("batch_id", F.lit(1)))
    assert silver_current(twice).count() == silver.count()
    assert sync_frame(twice.drop("batch_id")).count() == silver.count()


def test_approx_users_within_error_bound(spark):
    from paylake.operators.reports import approx_users, unique_users
    s = I.silver_now(spark, SF)
    approx = {r[0]: r[1] for r in approx_users(s, rsd=0.01).collect()}
    exact = {r[0]: r[1] for r in unique_users(s).collect()}
    assert approx.keys() == exact.keys()
    assert all(abs(approx[d] - exact[d]) <= max(2, 0.03 * exact[d]) for d in exact)
