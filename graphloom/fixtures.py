"""Graph tables derived from the data folder's star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vector import similar_pairs
from graphloom.operators.graph import PropertyGraph
from graphloom.session import read_table

KINDS = (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))


def ident(kind: str, key: str):
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, key, name in KINDS:
        rows = read_table(spark, d, kind).select(ident(kind, key).alias("id"), F.lit(kind.upper()).alias("type"), F.col(name).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def supplied(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.count("*").alias("occurrence_count"))
    return e.select(ident("part", "l_partkey").alias("src"), ident("supplier", "l_suppkey").alias("dst"), F.lit("RELATED_TO").alias("label"), F.lit("supplied_by").alias("type"), "confidence", "occurrence_count")


def located(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, a, ka, b, kb, kind in (("customer", "customer", "c_custkey", "nation", "c_nationkey", "located_in"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "located_in"), ("nation", "nation", "n_nationkey", "region", "n_regionkey", "part_of")):
        rows = read_table(spark, d, table).select(ident(a, ka).alias("src"), ident(b, kb).alias("dst"), F.lit("RELATED_TO").alias("label"), F.lit(kind).alias("type"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("occurrence_count"))
        out = rows if out is None else out.unionByName(rows)
    return out


def relationships(spark: SparkSession, d: str) -> DataFrame:
    return supplied(spark, d).unionByName(located(spark, d))


def mention_calls(spark: SparkSession, d: str) -> DataFrame:
    """One call for each line of an order: the part is mentioned in the order's chunk."""
    rows = read_table(spark, d, "lineitem")
    return rows.select(ident("part", "l_partkey").alias("entity_id"), ident("order", "l_orderkey").alias("doc_id"), F.concat(F.lit("chunk_"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.col("l_linenumber").alias("seq"))


def graph(spark: SparkSession, d: str) -> PropertyGraph:
    from graphloom.operators.upserts import upsert_mentions

    return PropertyGraph(entities(spark, d), relationships(spark, d), upsert_mentions(mention_calls(spark, d)))


def similar(spark: SparkSession, d: str, least: float = 0.3) -> DataFrame:
    return similar_pairs(read_table(spark, d, "embeddings"), "vec_id", "embedding", least)


def sim_edges(spark: SparkSession, d: str) -> DataFrame:
    return similar(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def operations(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op_type"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("success"), "user_id")


ENT = "ent AS (" + " UNION ALL ".join(f"SELECT '{k}_' || {key} AS id, '{k.upper()}' AS type, {name} AS text FROM {k}" for k, key, name in KINDS) + ")"
PS = "ps AS (SELECT 'part_' || l_partkey AS src, 'supplier_' || l_suppkey AS dst, 'RELATED_TO' AS label, 'supplied_by' AS type, max(1 - l_discount) AS confidence, count(*) AS occurrence_count FROM lineitem GROUP BY ALL)"
GEO = """geo AS (SELECT 'customer_' || c_custkey AS src, 'nation_' || c_nationkey AS dst, 'RELATED_TO' AS label, 'located_in' AS type, 1.0::DOUBLE AS confidence, 1 AS occurrence_count FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'RELATED_TO', 'located_in', 1.0, 1 FROM supplier
  UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey, 'RELATED_TO', 'part_of', 1.0, 1 FROM nation)"""
REL = f"{PS}, {GEO}, rel AS (SELECT * FROM ps UNION ALL SELECT * FROM geo), ways AS (SELECT * FROM rel UNION ALL SELECT dst AS src, src AS dst, label, type, confidence, occurrence_count FROM rel)"
SIM = """sim AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE s >= 0.3),
  sw AS MATERIALIZED (SELECT a AS src, b AS dst FROM sim UNION ALL SELECT b, a FROM sim), sd AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM sw GROUP BY 1)"""
TRI = "tri AS (SELECT e.a AS x, e.b AS y, f.b AS z FROM sim e JOIN sim f ON e.b = f.a JOIN sim g ON g.a = e.a AND g.b = f.b)"
OPS = "ops AS (SELECT event_id, ts, event_type AS op_type, value AS duration, event_type <> 'error' AS success, user_id FROM events)"
