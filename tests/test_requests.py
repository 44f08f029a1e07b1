"""Batch authorization over whole tables."""

from pyspark.sql import functions as F

from corollary import auth
from corollary.plans import catalog


def test_batch_requests_do_not_come_from_the_answer(spark):
    """Every order and customer takes part, and the batch refuses as well as allows."""
    folder = "/root/testdata/sf0.001"
    asked = catalog.order_requests(spark, folder).cache()
    allowed = catalog.QUERIES["auth_can_requests"](spark, folder)
    assert asked.select("resource").distinct().count() == spark.read.parquet(f"{folder}/orders.parquet").count()
    assert asked.select("who").distinct().count() == spark.read.parquet(f"{folder}/customer.parquet").count()
    for action in ("read", "update", "ship"):
        of = lambda df: df.where(F.col("action") == action).count()  # noqa: B023, E731
        assert 0 < of(allowed) < of(asked)
    whole = auth.Authorizer(spark, catalog._whole_authorization(spark, folder)).authorized().toDF("who", "action", "resource")
    assert allowed.exceptAll(asked.join(whole, ["who", "action", "resource"], "left_semi")).count() == 0
