"""Sinks and keyed tables on Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.upserts import latest_by_key


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def merge_table(spark: SparkSession, path: str, rows: DataFrame, key: str, by: str, target: str) -> DataFrame:
    """Insert or replace ``rows`` in the table at ``path`` by key, latest ``by`` first, written to ``target``."""
    merged = latest_by_key(spark.read.parquet(path).unionByName(rows, allowMissingColumns=True), key, by)
    write_table(merged, target)
    return spark.read.parquet(target)


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Summaries and their links to entities as two tables."""
    write_table(summaries.drop("entities"), f"{path}/summaries")
    write_table(summaries.select(F.col("id").alias("summary_id"), F.explode("entities").alias("entity_id")).distinct(), f"{path}/summary_entities")


def cached_embeddings(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Texts with their cached vectors by md5, and whether they were found; the rest must be generated."""
    keyed = texts.withColumn("cache_id", F.md5(text))
    return keyed.join(cache.select(F.col("id").alias("cache_id"), "embedding"), "cache_id", "left").withColumn("hit", F.col("embedding").isNotNull())


def accessed(cache: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The cache after the entries ``ids`` (id) were looked up: their access_count goes up by one and last_accessed is ``now``."""
    hit = F.col("_hit").isNotNull()
    seen = cache.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    count = (F.coalesce("access_count", F.lit(0)) + hit.cast("int")).cast(cache.schema["access_count"].dataType)
    return seen.withColumn("access_count", count).withColumn("last_accessed", F.when(hit, now).otherwise(F.col("last_accessed"))).select(*cache.columns)


BATCH = 32  # texts that an encoder gets at once


def embeddings_for(texts: DataFrame, cache: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """text, cache_id, embedding, hit of different texts: cached vectors, and for the rest those of the encoder, which gets batches of 32.

    Rows without ``hit`` are what the cache lacks.  Null texts have no row.
    """
    found = cached_embeddings(texts.select(text).filter(F.col(text).isNotNull()).distinct(), cache, text).select(text, "cache_id", "embedding", "hit")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            new: list = []
            for i in range(0, len(f), BATCH):
                new += encode(f[text].iloc[i : i + BATCH].tolist())
            yield f.assign(embedding=new)

    made = found.filter("NOT hit").mapInPandas(run, found.schema)
    return found.filter("hit").union(made)
