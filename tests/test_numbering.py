"""Distributed places in an order."""

import random

from pyspark.sql import functions as F

from terratess.operators.numbering import numbered


def test_places_follow_the_order(spark):
    r = random.Random(1)
    values = [r.randrange(10_000) for _ in range(3000)] + [None, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "row long, v long").repartition(5)
    order = [F.col("v").asc_nulls_last(), F.col("row").asc()]
    found = {x.row: x.place for x in numbered(rows, order, "place", first=1).collect()}
    expected = sorted(range(len(values)), key=lambda k: (values[k] is None, values[k] or 0, k))
    assert [found[k] for k in expected] == list(range(1, len(values) + 1))
    assert numbered(rows.limit(0), order, "place").count() == 0


def test_no_task_holds_all_rows(spark):
    rows = spark.range(20_000, numPartitions=8).select((F.col("id") * 7919 % 20_011).alias("v"))
    found = numbered(rows, [F.col("v").asc()], "place")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and found.where("place < 0").count() == 0 and found.agg(F.max("place")).first()[0] == 19_999
