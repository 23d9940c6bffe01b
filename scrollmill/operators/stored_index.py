"""An inverted index that is kept: postings in buckets of Parquet, generation by generation.

A generation is a folder of its own. It holds only the buckets that its pass has changed, and a manifest that says of every
bucket in which generation it stands, with the number of messages and words. A generation counts once its manifest is
complete, so a pass that dies leaves the last one as it was, and readers of an older generation are not disturbed.

Postings of one stem lie in one bucket, whatever their word, sorted by stem and word; a search reads the buckets of its
words and no others. Positions are delta-coded by Parquet's own encoding. A word in a third of all messages makes its
bucket large, not slow to write: large buckets are split over several tasks and small ones share one (rebalance).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache, reduce
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.porter import stem
from ..sources import store
from .search import WORD, fold, query_phrases, score_phrases

#: Buckets of postings and of documents.
BUCKETS, DOCUMENT_BUCKETS = 64, 16


@lru_cache(200_000)
def _stem(word: str) -> str:
    return stem(word)


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(_stem)


def _bucket(value: Column, n: int) -> Column:
    return F.pmod(F.crc32(value.cast("binary")), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Generation:
    """Where each bucket stands: (kind, bucket) to the name of a generation; and the messages and words in all."""

    name: str
    held: dict[tuple[str, int], str]
    messages: int
    words: int


class StoredIndex:
    """The index in folder ``root`` of messages(key, turn, body), where ``key`` names a document's column of type ``kind``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "path", kind: str = "string"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schemas = {
            "postings": f"stem string, term string, `{key}` {kind}, turn long, dl int, positions array<int>, bucket int",
            "terms": "stem string, term string, df long, bucket int",
            "documents": f"`{key}` {kind}, messages long, words long, buckets array<int>, bucket int",
        }

    # -- generations
    def latest(self) -> Generation | None:
        """The last generation whose manifest is complete."""
        for name in reversed(store.children(self.spark, self.root)):
            at = f"{self.root}/{name}/manifest"
            if store.exists(self.spark, f"{at}/_SUCCESS"):
                rows = self.spark.read.schema("kind string, bucket int, generation string, messages long, words long").parquet(at).collect()  # a row a bucket
                total = next(r for r in rows if r["kind"] == "total")
                return Generation(name, {(r["kind"], r["bucket"]): r["generation"] for r in rows if r["kind"] != "total"}, total["messages"], total["words"])
        return None

    def vacuum(self) -> list[str]:
        """Remove generations that the last one does not name, and those that were never completed; for when no search of them is under way."""
        now = self.latest()
        used = set() if now is None else {now.name, *now.held.values()}
        gone = [name for name in store.children(self.spark, self.root) if name not in used]
        for name in gone:
            store.remove(self.spark, f"{self.root}/{name}")
        return gone

    def read(self, what: str, buckets: list[int] | None = None, at: Generation | None = None) -> DataFrame:
        """Rows of postings, terms or documents, of the given buckets only; each bucket from the generation that it stands in."""
        at = at or self.latest()
        kind = "documents" if what == "documents" else "postings"
        held: dict[str, list[int]] = {}
        for (k, bucket), name in sorted((at.held if at else {}).items()):
            if k == kind and (buckets is None or bucket in buckets):
                held.setdefault(name, []).append(bucket)
        schema = self.schemas[what]
        # A generation that removed the last rows of all its buckets has no folder for them.
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{what}").where(F.col("bucket").isin(of)) for name, of in held.items() if store.exists(self.spark, f"{self.root}/{name}/{what}")]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    # -- writing
    def _postings(self, messages: DataFrame) -> DataFrame:
        body = F.coalesce("body", F.lit(""))
        words = messages.select(self.key, F.col("turn").cast("long").alias("turn"), F.size(F.regexp_extract_all(body, F.lit(WORD), 0)).alias("dl"), F.posexplode(F.regexp_extract_all(fold(body), F.lit(WORD), 0)).alias("pos", "term"))
        told = words.groupBy(self.key, "turn", "dl", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions")).withColumn("stem", _stems("term"))
        return told.select("stem", "term", self.key, "turn", "dl", "positions", _bucket(F.col("stem"), BUCKETS).alias("bucket"))

    def _write(self, rows: DataFrame, path: str, order: list[str]) -> None:
        dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
        dealt.write.partitionBy("bucket").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#positions.list.element", "false").parquet(path)

    def refresh(self, messages: DataFrame, gone: DataFrame | None = None) -> Generation:
        """The next generation: ``messages`` are all those of documents that are new or have changed, ``gone(key)`` documents without any now.

        Only buckets that hold words of these documents, before or after, are read and written anew; all others stay where they
        are. Null bodies are empty, and a document of empty messages counts among the messages. Applied twice, a refresh gives
        the same rows.
        """
        old = self.latest()
        name = f"{int(old.name.split('-')[0]) + 1 if old else 1:012d}-{uuid.uuid4().hex[:8]}"
        place = f"{self.root}/{name}"
        spark, key = self.spark, self.key
        body = F.coalesce("body", F.lit(""))
        counted = messages.groupBy(key).agg(F.count(F.lit(1)).alias("messages"), F.sum(F.size(F.regexp_extract_all(body, F.lit(WORD), 0))).cast("long").alias("words"))
        # Written before anything is replaced: the postings of what is new, and what the old index knows of it.
        self._postings(messages).write.parquet(f"{place}/new")
        new = spark.read.schema(self.schemas["postings"]).parquet(f"{place}/new")
        known = new.groupBy(key).agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))  # at most BUCKETS numbers each
        documents = counted.join(known, key, "left").select(key, "messages", "words", F.coalesce("buckets", F.array().cast("array<int>")).alias("buckets"), _bucket(F.col(key).cast("string"), DOCUMENT_BUCKETS).alias("bucket"))
        documents.write.parquet(f"{place}/seen")
        seen = spark.read.schema(self.schemas["documents"]).parquet(f"{place}/seen")
        dropped = seen.select(key) if gone is None else seen.select(key).unionByName(gone.select(key)).distinct()
        # Where the old rows stand, and how much goes and comes: one row each.
        before = self.read("documents", at=old).join(dropped, key, "left_semi")
        total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "words")]
        less, more = (d.agg(*total, F.collect_set("bucket").alias("of")).first() for d in (before, seen))
        touched = before.unionByName(seen).select(F.explode("buckets").alias("b")).distinct().collect()  # at most BUCKETS
        changed = {"postings": sorted(r["b"] for r in touched), "documents": sorted({*less["of"], *more["of"]})}

        kept = self.read("postings", changed["postings"], old).join(dropped, key, "left_anti")
        self._write(kept.unionByName(new), f"{place}/postings", ["stem", "term", key])
        written = spark.read.schema(self.schemas["postings"]).parquet(f"{place}/postings") if store.exists(spark, f"{place}/postings") else new.limit(0)
        self._write(written.groupBy("bucket", "stem", "term").agg(F.count(F.lit(1)).alias("df")), f"{place}/terms", ["stem", "term"])
        kept = self.read("documents", changed["documents"], old).join(dropped, key, "left_anti")
        self._write(kept.unionByName(seen), f"{place}/documents", [key])
        for what in ("new", "seen"):
            store.remove(spark, f"{place}/{what}")

        held = dict(old.held) if old else {}
        held.update({(kind, b): name for kind, buckets in changed.items() for b in buckets})
        now = Generation(name, held, (old.messages if old else 0) - less["messages"] + more["messages"], (old.words if old else 0) - less["words"] + more["words"])
        rows = [(kind, b, g, None, None) for (kind, b), g in held.items()] + [("total", None, name, now.messages, now.words)]
        spark.createDataFrame(rows, "kind string, bucket int, generation string, messages long, words long").coalesce(1).write.parquet(f"{place}/manifest")
        return now

    # -- searching
    def search(self, query: str, stemmed: bool = False, prefix: bool = False) -> DataFrame:
        """(key, turn, score) of messages that have every phrase, as ``search.bm25`` over the messages themselves."""
        at, keys = self.latest(), [self.key, "turn"]
        phrases = query_phrases(query)
        none = self.spark.createDataFrame([], ", ".join(self.schemas["postings"].split(", ")[2:4]) + ", score double")
        if at is None or not at.messages or not phrases:
            return none
        wanted = sorted({w for p in phrases for w in p})
        begun = sorted({p[-1] for p, piece in zip(phrases, [x for x in query.replace('"', " ").split() if query_phrases(x)], strict=True) if piece.endswith("*")}) if prefix else []
        buckets = {crc32(_stem(w).encode()) % BUCKETS for w in wanted}
        match = F.col("stem").isin([_stem(w) for w in wanted]) if stemmed else F.col("term").isin(wanted)
        if begun:  # the dictionary says where words that begin so stand
            starts = lambda: reduce(lambda a, b: a | b, (F.col("term").startswith(w) for w in begun))
            buckets |= {r["bucket"] for r in self.read("terms", at=at).where(starts()).select("bucket").distinct().collect()}
            match = match | starts()
        rows = self.read("postings", sorted(buckets), at).where(match)
        index = rows.select(*keys, "dl", F.col("stem" if stemmed else "term").alias("term"), "positions")
        size = self.spark.range(1).select(F.lit(at.messages).alias("n"), F.lit(at.words / at.messages).alias("avgdl"))
        return score_phrases(index, size, query, keys, stemmed, prefix)
