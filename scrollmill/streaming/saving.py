"""Conversations saved from a stream: what is delivered again changes nothing.

The archive is kept in buckets of Parquet by conversation, generation by generation. A batch writes only its buckets, into
a new folder, and then one manifest, which names for every bucket the generation that it stands in and for every stream the
batches that are in. A batch that dies before its manifest leaves the archive as it was; one that comes again finds itself
in the manifest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.archive import prefix_hashes
from ..sources import store

BUCKETS = 32
SCHEMAS = {"turns": "conv_id long, file string, turn long, role string, body string, bucket int", "files": "conv_id long, file string, sightings long, bucket int"}
_MANIFEST = "kind string, bucket int, generation string, stream string, batch long"


@dataclass(frozen=True)
class Generation:
    """name; held: bucket to the generation that it stands in; upto: of each stream, all batches before this are in; others: those that are in beyond that."""

    name: str
    held: dict[int, str]
    upto: dict[str, int]
    others: frozenset[tuple[str, int]]

    def has(self, stream: str, batch: int) -> bool:
        return batch < self.upto.get(stream, 0) or (stream, batch) in self.others


class SavedArchive:
    """Files of conversations below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def latest(self) -> Generation | None:
        for name in reversed(store.children(self.spark, self.root)):
            at = f"{self.root}/{name}/manifest"
            if store.exists(self.spark, f"{at}/_SUCCESS"):
                rows = self.spark.read.schema(_MANIFEST).parquet(at).collect()  # a row a bucket and a row a stream
                held = {r["bucket"]: r["generation"] for r in rows if r["kind"] == "bucket"}
                return Generation(name, held, {r["stream"]: r["batch"] for r in rows if r["kind"] == "upto"}, frozenset((r["stream"], r["batch"]) for r in rows if r["kind"] == "other"))
        return None

    def read(self, what: str = "turns", buckets: list[int] | None = None, at: Generation | None = None) -> DataFrame:
        """turns(conv_id, file, turn, role, body, bucket) or files(conv_id, file, sightings, bucket), sightings being deliveries that were in the file."""
        at = at or self.latest()
        held: dict[str, list[int]] = {}
        for bucket, name in sorted((at.held if at else {}).items()):
            if buckets is None or bucket in buckets:
                held.setdefault(name, []).append(bucket)
        parts = [self.spark.read.schema(SCHEMAS[what]).parquet(f"{self.root}/{name}/{what}").where(F.col("bucket").isin(of)) for name, of in held.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMAS[what])

    def save(self, batch: DataFrame, batch_id: int, stream: str = "") -> Generation | None:
        """Apply batch(conv_id, seq, turn, role, body), in which seq numbers the versions of a conversation; null if it is in already.

        Each version goes to a file of its conversation: one with the same turns stays (unchanged), one whose turns are the
        head of it grows (append), else there is a new file (write_new, or write_alongside under a free name). As an argument
        of ``foreachBatch`` it may be called again with the same batch at any time.
        """
        old = self.latest()
        if old is not None and old.has(stream, batch_id):
            return None
        rows = store.settle(batch.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("body", F.lit("")).alias("body"), F.dense_rank().over(Window.partitionBy("conv_id").orderBy("seq")).alias("version"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket")), "batch")
        told = rows.agg(F.max("version").alias("n"), F.array_sort(F.collect_set("bucket")).alias("buckets")).first()
        buckets = told["buckets"]
        name = f"{int(old.name.split('-')[0]) + 1 if old else 1:012d}-{uuid.uuid4().hex[:8]}"
        turns, files = (self.read(what, buckets, old) if buckets else self.spark.createDataFrame([], SCHEMAS[what]) for what in ("turns", "files"))
        for version in range(1, (told["n"] or 0) + 1):
            turns, files = self._step(turns, files, rows.where(F.col("version") == version).drop("version"))
        for what, df in (("turns", turns), ("files", files)):
            df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "conv_id", "file").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{what}")

        held = {**(old.held if old else {}), **{b: name for b in buckets}}
        upto, others = dict(old.upto) if old else {}, set(old.others if old else ()) | {(stream, batch_id)}
        while (stream, upto.get(stream, 0)) in others:
            others.remove((stream, upto.get(stream, 0)))
            upto[stream] = upto.get(stream, 0) + 1
        manifest = [("bucket", b, g, None, None) for b, g in held.items()] + [("upto", None, None, s, n) for s, n in upto.items()] + [("other", None, None, s, n) for s, n in others]
        self.spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.parquet(f"{self.root}/{name}/manifest")
        return Generation(name, held, upto, frozenset(others))

    def _step(self, turns: DataFrame, files: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One version of each conversation of ``new`` into its file."""
        last = prefix_hashes(turns, "file").groupBy("file").agg(F.max_by(F.struct("n", "hash"), "n").alias("e"))
        last = files.join(last, "file").select("conv_id", "file", "e.n", "e.hash")
        heads = prefix_hashes(new)
        size = heads.groupBy("conv_id").agg(F.max("n").alias("m"))
        # The file that holds most of it; of equals the first by name.
        best = heads.join(last, ["conv_id", "n", "hash"]).groupBy("conv_id").agg(F.min(F.struct((-F.col("n")).alias("minus"), "file")).alias("b"))
        held = files.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"))
        met = size.join(best, "conv_id", "left").join(held, "conv_id", "left")
        c, k = F.col("conv_id").cast("string"), F.coalesce("k", F.lit(0))
        free = F.when(k == 0, F.concat(c, F.lit(".md"))).otherwise(F.concat(c, F.lit(" ("), (k + 1).cast("string"), F.lit(").md")))
        aims = store.settle(met.select("conv_id", F.coalesce("b.file", free).alias("file"), (F.col("b.file").isNotNull() & (-F.col("b.minus") == F.col("m"))).alias("same")), "aims")
        written = new.join(aims.where("not same").select("conv_id", "file"), "conv_id")
        turns = turns.join(aims.where("not same").select("file"), "file", "left_anti").unionByName(written)
        seen = new.select("conv_id", "bucket").distinct().join(aims.select("conv_id", "file"), "conv_id").withColumn("sightings", F.lit(1).cast("long"))
        files = files.unionByName(seen).groupBy("conv_id", "file", "bucket").agg(F.sum("sightings").alias("sightings"))
        return store.settle(turns, "turns"), store.settle(files, "files")
