"""Column helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators between words of letters, digits and everything outside ASCII.
ALNUM_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Separators between blank-delimited tokens.
BLANK_GAP = "[\\x20\\x09-\\x0D]+"


def valid_text(name: str = "text") -> Column:
    """A text column as UTF-8: each sequence of bytes that is none counts as U+FFFD."""
    return F.make_valid_utf8(name).alias(name)


def own_prefix(docs: DataFrame) -> str:
    """The beginning of names for helper columns: no column of docs begins like this, in any case."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character alone (``lower`` would change É)."""
    return F.translate(c, _UPPER, _UPPER.lower())


def pieces(c: Column, gap: str) -> Column:
    """The non-empty pieces between matches of ``gap``; a null text has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), gap), "")


def alnum_words(c: Column) -> Column:
    return pieces(ascii_lower(c), ALNUM_GAP)


def blank_tokens(c: Column) -> Column:
    return pieces(c, BLANK_GAP)


#: A key with LEAST rows that are more than a SHARE-th of all is heavy, so fewer than SHARE keys are; their rows are dealt to SALTS tasks.
LEAST, SHARE, SALTS = 1000, 1000, 64


def shared_dir(spark) -> str:
    """The folder that driver and executors share: the cluster's setting; a local one only where all tasks run in this process."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Compute once, store in the shared folder and forget the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def discard(spark, path: str) -> None:
    """Remove a folder of the shared file system that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], counted: DataFrame, by: list[str], how: str = "inner", sized: bool = True) -> DataFrame:
    """rows joined with side on ``keys``, without a task that holds a heavy key.

    counted has keys and n, how many of rows have each key; keys that it lacks count as light.  Heavy ones, of LEAST rows and
    over a SHARE-th of all, are fewer than SHARE; they are fetched and broadcast, their rows get a salt from a hash of
    ``by``, and their rows of side are repeated for each salt.  Spark takes what an explode makes of a row for one row, and a
    file's bytes for those of its rows; with ``sized`` False neither side is broadcast on such a guess.
    """
    met = (lambda a, b, on: a.join(b, on, how)) if sized else (lambda a, b, on: a.hint("merge").join(b, on, how))
    total = counted.agg(F.sum("n").alias("_total"))  # one row
    heavy = counted.where(F.col("n") >= LEAST).crossJoin(F.broadcast(total)).where(F.col("n") * SHARE > F.col("_total")).select(*keys).collect()
    if not heavy:
        return met(rows, side, keys)
    marked = F.broadcast(rows.sparkSession.createDataFrame(heavy, counted.select(*keys).schema).withColumn("_of", F.lit(SALTS)))
    of = F.coalesce("_of", F.lit(1))
    dealt = rows.join(marked, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), of).cast("int")).drop("_of")
    repeated = side.join(marked, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), of - 1))).drop("_of")
    return met(dealt, repeated, [*keys, "_salt"]).drop("_salt")


def running(rows: DataFrame, order: list, **sums: str) -> DataFrame:
    """rows with, for each name in ``sums``, the sum of that SQL expression over all rows that come before in ``order``.

    ``order`` must be total.  Rows are sorted over many tasks; only one total a task is added up in one place.
    """
    cast = [F.expr(e).alias(f"_{n}") for n, e in sums.items()]
    placed = cut(rows.select("*", *cast).orderBy(*order).withColumn("_part", F.spark_partition_id()))
    upto = lambda *by: Window.partitionBy(*by)
    totals = placed.groupBy("_part").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    before = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(upto().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b{n}") for n in sums))
    inside = upto("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *(F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)).alias(f"_i{n}") for n in sums)).join(F.broadcast(before), "_part")  # a row a task
    return out.select(*rows.columns, *((F.col(f"_i{n}") + F.col(f"_b{n}")).alias(n) for n in sums))
