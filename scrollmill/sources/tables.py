"""Archive tables from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, body); system and tool speak as the user."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    role = F.when(F.col("role").isin("system", "tool"), "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("body"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For costly rows in few input splits: at least one partition a core; tables with more splits stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
