"""Cleaning of ``documents`` in five stages, each written as Parquet and read again by the next.

Toxic documents go; of each group of near duplicates the one with the least doc_id stays; repeated passages of 50
words or more are cut, all but their first occurrence; documents that hold benchmark text go; what is left is
encoded. Rows with a null doc_id belong to no group and stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm import bpe, decontaminate, ngram_join, suffix_dedup, toxicity
from scrollmill.llm._store import settle

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.withColumn("_all", F.struct(*docs.columns)), model, keep=["_all"])
    return scored.where(F.col("predicted") == 0).select("_all.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8. Rows that repeat a doc_id of a kept document stay with it."""
    found = ngram_join.ngram_components(docs, k=5, num=4, den=5)
    gone = found.where((F.col("doc_id") != F.col("component_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where(F.col("contaminated") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document that is left."""
    path = public_tokenizers.path(TOKENIZER)
    out = bpe.decode(bpe.encode(docs, path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A trained score is not SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
