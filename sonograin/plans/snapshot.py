"""Tables in buckets, each bucket in versions: a commit replaces some buckets and leaves the others' files alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshot:
    """Tables under ``path`` as they are before ``version``, and the buckets that ``version`` will replace.

    A bucket's files stand in path/<table>/version=<n>/bucket=<b>; path/commits tells which version holds a bucket.  What is written
    counts only once ``commit`` has written the list, so a version that failed is written again without harm, and
    readers of earlier versions keep their files.
    """

    def __init__(self, spark: SparkSession, path: str, version: int, buckets: int):
        self.spark, self.path, self.version, self.buckets, self.wrote = spark, path, version, buckets, []
        self.current: dict[str, dict[int, int]] = {}
        if self._exists(f"{path}/commits"):
            rows = spark.read.parquet(f"{path}/commits").where(F.col("version") < version).groupBy("name", "bucket").agg(F.max("version").alias("version"))
            for r in rows.collect():  # a row for each table and bucket
                self.current.setdefault(r["name"], {})[r["bucket"]] = r["version"]

    def _exists(self, where: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows, of all buckets or of some; other buckets' files are not opened."""
        known = self.current.get(name, {})
        paths = [p for b, v in sorted(known.items()) if buckets is None or b in buckets if self._exists(p := f"{self.path}/{name}/version={v}/bucket={b}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, key: str, buckets: list[int]) -> None:
        """``rows`` (all of these buckets' rows) become the buckets' content, by the bucket of ``key``."""
        placed = rows.withColumn("bucket", self.bucket(F.col(key)))
        placed.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{name}/version={self.version}")
        self.wrote += [(name, b) for b in buckets]

    def commit(self) -> None:
        rows = self.spark.createDataFrame([(n, b, self.version) for n, b in self.wrote], "name string, bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/at={self.version}")
