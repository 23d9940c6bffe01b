"""A keyed table in buckets, of which each change writes anew only the buckets that it touches."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store


class KeyedTable:
    """Rows of ``schema`` below ``root``, one for each ``key``. A generation counts once its manifest is complete."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.root, self.key, self.schema, self.buckets = spark, root.rstrip("/"), key, schema, buckets

    def _bucket(self):
        return F.pmod(F.crc32(F.col(self.key).cast("string").cast("binary")), F.lit(self.buckets)).cast("int")

    def held(self) -> dict[int, str]:
        """The generation of each bucket, in the last one that is complete."""
        for name in reversed(store.children(self.spark, self.root)):
            if store.exists(self.spark, f"{self.root}/{name}/manifest/_SUCCESS"):
                rows = self.spark.read.schema("bucket int, generation string").parquet(f"{self.root}/{name}/manifest").collect()  # a row a bucket
                return {r["bucket"]: r["generation"] for r in rows}
        return {}

    def read(self, only: list[int] | None = None) -> DataFrame:
        of: dict[str, list[int]] = {}
        for bucket, name in self.held().items():
            if only is None or bucket in only:
                of.setdefault(name, []).append(bucket)
        columns = [c.split()[0] for c in self.schema.split(", ")]
        parts = [self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.root}/{n}/rows").where(F.col("bucket").isin(b)).select(columns) for n, b in of.items() if store.exists(self.spark, f"{self.root}/{n}/rows")]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Rows of keys that are new or have changed, and keys(key) without a row now."""
        rows = store.settle(rows.select([c.split()[0] for c in self.schema.split(", ")]), "rows")
        dropped = rows.select(self.key) if gone is None else rows.select(self.key).unionByName(gone.select(self.key))
        touched = sorted(r["b"] for r in dropped.select(self._bucket().alias("b")).distinct().collect())  # at most as many as buckets
        held = self.held()
        last = max(store.children(self.spark, self.root), default="0")
        name = f"{int(last.split('-')[0]) + 1:012d}-{uuid.uuid4().hex[:8]}"
        kept = self.read(touched).join(dropped, self.key, "left_anti")
        out = kept.unionByName(rows).withColumn("bucket", self._bucket())
        out.hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.root}/{name}/rows")
        held.update(dict.fromkeys(touched, name))
        self.spark.createDataFrame(list(held.items()), "bucket int, generation string").coalesce(1).write.parquet(f"{self.root}/{name}/manifest")
