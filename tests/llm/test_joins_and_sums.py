import random

from pyspark.sql import functions as F

from sonograin.llm.text import LEAST, running, spread_join


def test_heavy_keys_join_like_others(spark):
    r = random.Random(3)
    rows = [(0 if r.random() < 0.4 else r.randrange(1, 900), None if i % 50 == 0 else i) for i in range(3 * LEAST)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = spark.createDataFrame([(k, k * 7) for k in range(0, 900, 2)] + [(0, -1)], "k long, w long")
    counted = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = sorted(map(str, spread_join(left, right, ["k"], counted, ["v"], how).select("k", "v", "w").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("k", "v", "w").collect()))
    parts = spread_join(left, right, ["k"], counted, ["v"]).where("k = 0").select("v").distinct().count()
    assert parts > 0 and spread_join(left.limit(0), right, ["k"], counted.limit(0), ["v"]).count() == 0


def test_running_sums_over_sorted_parts(spark):
    r = random.Random(5)
    rows = sorted((r.randrange(40), i, r.randrange(9)) for i in range(700))
    got = running(spark.createDataFrame(rows, "a long, b long, c long").repartition(9), [F.col("a").desc(), F.col("b")], i="1", s="c").collect()
    order = sorted(rows, key=lambda x: (-x[0], x[1]))
    want = {x: (k, sum(y[2] for y in order[:k])) for k, x in enumerate(order)}
    assert {(x.a, x.b, x.c): (x.i, x.s) for x in got} == want
    assert running(spark.createDataFrame([], "a long"), [F.col("a")], i="1").count() == 0
