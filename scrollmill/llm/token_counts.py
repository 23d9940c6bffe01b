"""Token counts from a cache of digests.

A text's key is the digest of its normalised content (null is the empty text; nothing else is changed, as any
other change could change the count) together with a digest of the tokenizer's file, library and settings.
Keys are joined to the stored counts; only one text for each missing key is encoded, and its count is
appended to the cache. The cache is a Parquet folder in shared storage, one subfolder a tokenizer version.
Appending twice does no harm: readers take one count a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import settle, small_batches, tidy
from ._tokenizers import encoder, fingerprint

SCHEMA = "digest binary, n_tokens long"
#: Missing keys up to this number are broadcast (16 bytes each) when the cache already holds others.
BROADCAST_KEYS = 500_000


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path):
        return None
    return spark.read.schema(SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs(doc_id, text, ...)``; ``cache`` is updated on the way.

    The result reads the cache when it is used: write it before the cache is given more, if both are to meet in one plan.

    Counts are of whole texts, without special tokens, truncation or padding. A null text counts as empty.
    Repeated rows and null doc_ids give a row each; other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)))
    path = f"{cache.rstrip('/')}/tokenizer={fingerprint(tokenizer)}"
    stored = _stored(spark, path)
    wanted = keyed
    if stored is not None:
        missing = settle(keyed.select("digest").distinct().join(stored, "digest", "left_anti"), "missing")
        few = missing.count() <= BROADCAST_KEYS
        wanted = keyed.join(F.broadcast(missing) if few else missing, "digest", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            n = [len(e.encode(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    # Copies meet in their own task first, so a text that fills the table is shuffled once a task.
    misses = wanted.groupBy("digest").agg(F.any_value("text").alias("text"))
    misses.mapInArrow(tidy(encode), SCHEMA).write.mode("append").parquet(path)
    counts = spark.read.schema(SCHEMA).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
