"""Passes over a folder of Markdown files that keep a search index up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import store
from ..sources.files import listing, read_files
from ..sources.generations import KeyedTable
from .archive import index_delta, pass_report
from .render import metadata, parse_frontmatter, split_turns, strip_frontmatter
from .stored_index import StoredIndex

_DOCUMENTS = "path string, mtime double, byte_size bigint, title string, platform string, model string, url string, fingerprint string, turn_count int, incomplete boolean, tags array<string>"


class FolderIndex:
    """What is known of the files below ``folder``, and an index of their turns, both below ``root``.

    A pass lists the folder and opens only files that are new or whose time or size is another. It writes the index first and
    what is known of the files last: a pass that dies in between is made up for by the next one, which finds them changed still.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.folder = spark, folder
        self.documents = KeyedTable(spark, f"{root.rstrip('/')}/documents", "path", _DOCUMENTS)
        self.index = StoredIndex(spark, f"{root.rstrip('/')}/index")

    def run(self, force: bool = False) -> DataFrame:
        """One row of counters: indexed, unchanged, removed, failed, total. With ``force`` every file is read.

        A missing folder changes nothing. A file whose bytes are not UTF-8 is counted as failed, and what was known of it stays
        until a later pass can read it. Only files of this folder are ever forgotten.
        """
        seen = listing(self.spark, self.folder)
        if seen is None:
            return self.spark.createDataFrame([(0, 0, 0, 0, 0)], "indexed long, unchanged long, removed long, failed long, total long")
        known = self.documents.read()
        delta = index_delta(known, seen)
        if force:
            delta = delta.withColumn("status", F.when(F.col("status") == "unchanged", "changed").otherwise(F.col("status")))
        delta = store.settle(delta, "delta")
        wanted = delta.where(F.col("status").isin("added", "changed")).select("path")
        files = store.settle(read_files(self.spark, self.folder, wanted), "files")
        good = files.where("not failed").withColumnRenamed("content", "document")
        turns = store.settle(split_turns(good, "path"), "turns")
        gone = delta.where("status = 'removed'").select("path")
        self.index.refresh(turns, gone.unionByName(good.select("path")).distinct())
        self.documents.replace(_documents(good, turns), gone)
        return pass_report(delta, files.where("failed").select("path"))


def _documents(documents: DataFrame, turns: DataFrame) -> DataFrame:
    told = documents.select("path", "mtime", "byte_size", F.coalesce(parse_frontmatter(F.col("document"))["fingerprint"], F.lit("")).alias("fingerprint"), T.body_tags(strip_frontmatter(F.col("document"))).alias("tags"))
    meta = metadata(documents).select("path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("platform", F.lit("")).alias("platform"), "model", "url", "incomplete")
    counted = turns.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("turn_count"))
    return told.join(meta, "path").join(counted, "path", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))
