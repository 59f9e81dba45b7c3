import random

from sonograin.llm import neardup


def joins(df):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan().toString())


def prints(spark, n, near=False):
    r = random.Random(11)
    fps = [(1 << (i % 8)) | (1 << (8 + i // 8)) for i in range(n)] if near else [r.getrandbits(63) for _ in range(n)]
    return spark.createDataFrame([(x,) for x in fps], "fp long")


def test_exploded_lists_are_never_broadcast(spark):
    """Spark sizes the lists after the explode as one row a fingerprint, so that 40 times the threshold would go to the driver."""
    index = neardup._index(prints(spark, 3000)).withColumnRenamed("fp", "label").withColumn("fp", neardup.F.col("label"))
    plan = joins(neardup._mixed(index))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_values_around_crowded_entries_are_never_broadcast(spark):
    entries = prints(spark, 40, near=True).selectExpr("fp", "fp as label").distinct()
    plan = joins(neardup._dense_links(entries, 4))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
