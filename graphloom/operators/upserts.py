"""Upserts as aggregations: a table and its changes are grouped by key, and the state of a key is a function of its group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 1000


def upsert_entities_by_id(changes: DataFrame) -> DataFrame:
    """id, properties, update_count, created_at, last_updated from changes id, properties (map), seq, ts.

    The last value of each property wins, and a last value of null takes the property away; update_count is null
    for an id that was only created.
    """
    each = changes.select("id", "seq", F.explode_outer("properties").alias("k", "v"))
    last = each.filter("k IS NOT NULL").groupBy("id", "k").agg(F.max_by(F.struct("v"), "seq").alias("s"))
    props = last.filter("s.v IS NOT NULL").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "s.v")))).alias("properties"))  # an entity's own properties
    state = changes.groupBy("id").agg(F.nullif(F.count("*") - 1, F.lit(0)).alias("update_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_updated"))
    return state.join(props, "id", "left")


def upsert_entities(mentions: DataFrame, ts: str = "ts") -> DataFrame:
    """type, text, id, occurrence_count, created_at, last_seen: one entity for each type and text, with a stable id."""
    made = mentions.groupBy("type", "text").agg(F.count("*").alias("occurrence_count"), F.min(ts).alias("created_at"), F.max(ts).alias("last_seen"))
    return made.withColumn("id", F.md5(F.concat_ws("#", "type", "text")))


def upsert_mentions(calls: DataFrame) -> DataFrame:
    """entity_id, doc_id, chunks, mention_count from calls entity_id, doc_id, chunk_id, seq.

    A call names an entity once; chunks are kept in the order of their first call.  Rows are hashed by entity and document
    once, which all three steps keep to.
    """
    calls = calls.select("entity_id", "doc_id", "chunk_id", "seq").repartition("entity_id", "doc_id")
    once = calls.groupBy("entity_id", "doc_id", "seq").agg(F.min("chunk_id").alias("chunk_id"))
    first = once.groupBy("entity_id", "doc_id", "chunk_id").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"])  # the chunks of one document
    return first.groupBy("entity_id", "doc_id").agg(chunks.alias("chunks"), F.sum("n").alias("mention_count"))


def upsert_relationships(rows: DataFrame) -> DataFrame:
    """src, dst, type, confidence (greatest), occurrence_count, created_at."""
    return rows.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), F.count("*").alias("occurrence_count"), F.min("ts").alias("created_at"))


def edges_by_text(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges from relationships that name their ends by text; entities of one text and several types give an edge each."""
    a, b = entities.select(F.col("text").alias("source"), F.col("id").alias("src")), entities.select(F.col("text").alias("target"), F.col("id").alias("dst"))
    return relationships.join(a, "source").join(b, "target")


def latest_by_key(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Insert-or-replace: the last row of each key, whole rows compared on ties."""
    w = Window.partitionBy(key).orderBy(F.desc(by), F.desc(F.xxhash64(*[c for c in rows.columns if rows.schema[c].dataType.typeName() != "map"])))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def create(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Add rows whose key isn't there yet."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Values of ``changes`` that aren't null replace those of the table; unknown keys are ignored."""
    fields = [c for c in changes.columns if c != key]
    joined = table.alias("t").join(changes.alias("c"), key, "left")
    kept = [F.coalesce(F.col(f"c.{c}"), F.col(f"t.{c}")).alias(c) if c in fields else F.col(f"t.{c}") for c in table.columns if c != key]
    return joined.select(key, *kept).select(*table.columns)


def delete(table: DataFrame, ids: DataFrame, relationships: DataFrame, cascade: bool = False, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Table and relationships without ``ids``.  Without ``cascade`` an entity that has edges stays."""
    ends = relationships.select(F.explode(F.array("src", "dst")).alias(key))
    if not cascade:
        return table.join(ids.select(key).join(ends, key, "left_anti"), key, "left_anti"), relationships
    gone = ids.select(key)
    left = relationships.join(gone.withColumnRenamed(key, "src"), "src", "left_anti").join(gone.withColumnRenamed(key, "dst"), "dst", "left_anti")
    return table.join(gone, key, "left_anti"), left.select(*relationships.columns)


def ingest_metrics(results: DataFrame) -> DataFrame:
    """entity_count, relationship_count, batch_count (batches of 1000 entities a result)."""
    n, r = F.coalesce(F.size("entities"), F.lit(0)), F.coalesce(F.size("relationships"), F.lit(0))
    n, r = F.greatest(n, F.lit(0)), F.greatest(r, F.lit(0))
    return results.agg(F.sum(n).alias("entity_count"), F.sum(r).alias("relationship_count"), F.sum(F.ceil(n / F.lit(BATCH))).alias("batch_count"))
