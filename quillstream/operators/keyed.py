"""A table by key, of which an upsert rewrites only what it touches.

Rows live in buckets by a hash of their key, one folder each. A batch of changes reads the buckets
that its keys fall in, merges by key, and replaces those folders (dynamic partition overwrite); all
others stay as they are, file by file. A manifest names the batches that are done, so a batch that is
run again after it ended changes nothing, and one that broke off before is simply run again: merging
the same rows twice gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..sources.session import discard, materialise, prepare, table_exists
from .sessions import upsert


class KeyedTable:
    """A table under ``path``; ``key`` names a row, ``schema`` its columns. Rows with a null key
    are refused, as nothing could name them."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = prepare(spark), path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self) -> DataFrame:
        if not table_exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").select(*self.schema.names)

    def done(self, batch: int) -> bool:
        return table_exists(self.spark, f"{self.path}/batches/batch={batch}/_SUCCESS")

    def upsert(self, rows: DataFrame, batch: int) -> int:
        """Merge a batch by key, the latest by its own columns that aren't null; returns how many buckets it
        rewrote, 0 if the batch was done before. Keys are unique within a batch."""
        if self.done(batch):
            return 0
        if rows.filter(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"a row has no {self.key}")
        new = materialise(rows, "upsert-rows")
        touched = sorted(r.bucket for r in new.select(self._bucket()).distinct().collect())  # at most all buckets
        if touched:
            wide = StructType([*self.schema.fields]).add("bucket", IntegerType())
            old = self.spark.createDataFrame([], self.schema)
            if table_exists(self.spark, f"{self.path}/rows"):
                known = self.spark.read.schema(wide).parquet(f"{self.path}/rows")
                old = known.filter(F.col("bucket").isin(touched)).drop("bucket")
            merged = materialise(upsert(old, new, self.key), "upsert-merged")
            dealt = merged.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", self.key)
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
            discard(merged)
        discard(new)
        mark = self.spark.range(1).select(F.lit(len(touched)).alias("buckets"))
        mark.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")
        return len(touched)
