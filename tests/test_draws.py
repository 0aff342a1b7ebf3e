"""Tables of draws are many times their units, whatever the plan's estimate: no join broadcasts them."""

import random

from pyspark.sql import functions as F

from quadrat.operators import agg as A
from quadrat.operators import resample as RS


def test_rarefy_broadcasts_no_draws(spark):
    draw = random.Random(2)
    counts = spark.createDataFrame([(p, f, draw.randint(1, 9)) for p in range(4) for f in range(30)], "profile int, feature int, n long")
    got = A.rarefy(counts, 20, seed=3)
    logical = got._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("strategy=merge") >= 2
    assert {r.n for r in got.groupBy("profile").agg(F.sum("n").alias("n")).collect()} == {20}


def test_permutations_broadcast_no_draws(spark):
    units = spark.createDataFrame([(i, i % 3) for i in range(30)], "u int, g int")
    got = RS.permutations(units, 40, "u", ["g"])
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == got.select("draw", "perm_unit").distinct().count() == 30 * 40


def test_bootstrap_draws_in_many_tasks(spark):
    units = spark.createDataFrame([(i,) for i in range(400)], "u int").coalesce(1)
    draws = RS._draws(units, 5)
    assert draws.groupBy(F.spark_partition_id().alias("p")).count().count() == 4
    got = RS.bootstrap(units, 7, "u").groupBy("draw").agg(F.sum("weight").alias("n"))
    assert {r.n for r in got.collect()} == {400}
    assert "BroadcastHashJoin" not in RS.bootstrap(units, 7, "u")._jdf.queryExecution().executedPlan().toString()
