"""Summaries of nodes, communities and the whole graph.  The text generator is a hook; the default is the filled template."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import community_statistics, in_out_degree, induced, undirected
from graphloom.operators.upserts import latest_by_key

Generator = Callable[[Column], Column]


def as_is(prompt: Column) -> Column:
    return prompt


def node_contexts(entities: DataFrame, relationships: DataFrame, most: int = 10) -> DataFrame:
    """id, type, text, relations (sorted lines), neighbours (map id to text): the ``most`` strongest links of each node."""
    ways = undirected(relationships.select("src", "dst", "type", "confidence"))
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), "dst", "type")
    top = ways.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    named = top.join(entities.select(F.col("id").alias("dst"), F.col("text").alias("other")), "dst")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_k", F.format_string("- %s %s", F.col("type"), F.col("other")).alias("line")))), lambda x: x["line"])  # at most ten
    per = named.groupBy(F.col("src").alias("id")).agg(lines.alias("relations"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("dst", "other")))).alias("neighbours"))
    return entities.select("id", "type", "text").join(per, "id", "left")


def node_metadata(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """id, type, text, in_degree, out_degree."""
    return entities.select("id", "type", "text").join(in_out_degree(relationships), "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree")})


def node_summaries(entities: DataFrame, relationships: DataFrame, generate: Generator = as_is) -> DataFrame:
    """id, content: prompt of the node's text, type and relations, through the generator."""
    c = node_contexts(entities, relationships)
    prompt = F.concat(F.format_string("Entity: %s\nType: %s\nRelationships:\n", "text", "type"), F.coalesce(F.array_join("relations", "\n"), F.lit("")))
    return c.select("id", generate(prompt).alias("content"))


def internal_relations(entities: DataFrame, relationships: DataFrame, membership: DataFrame, most: int = 20) -> DataFrame:
    """community, relations: the strongest lines ``- source type target`` inside it."""
    inner = induced(relationships, membership)
    w = Window.partitionBy("community").orderBy(F.desc("confidence"), "src", "dst", "type")
    top = inner.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    a, b = entities.select(F.col("id").alias("src"), F.col("text").alias("s")), entities.select(F.col("id").alias("dst"), F.col("text").alias("t"))
    named = top.join(a, "src").join(b, "dst").withColumn("line", F.format_string("- %s %s %s", "s", "type", "t"))
    return named.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "line"))), lambda x: x["line"]), "\n").alias("relations"))  # at most ``most``


def community_summaries(entities: DataFrame, relationships: DataFrame, membership: DataFrame, least: int = 3, generate: Generator = as_is) -> DataFrame:
    """community, node_count, density, content for communities of at least ``least`` nodes."""
    stats = community_statistics(entities, relationships, membership).filter(F.col("node_count") >= least)
    names = ("person", "organization", "location", "event")
    counts = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{n}_count") > 0, F.format_string(f"{n}: %d", F.col(f"{n}_count"))) for n in names])), ", ")
    joined = stats.join(internal_relations(entities, relationships, membership), "community", "left")
    prompt = F.concat(F.format_string("Nodes: %d\nDensity: %.2f\nTypes: ", F.col("node_count"), F.bround("density", 2)), counts, F.lit("\nRelations:\n"), F.coalesce("relations", F.lit("")))
    return joined.select("community", "node_count", "density", generate(prompt).alias("content"))


def global_statistics(entities: DataFrame, relationships: DataFrame, membership: DataFrame) -> DataFrame:
    """total_nodes, total_edges, n_communities, avg_size, max_size."""
    n = entities.agg(F.count("*").alias("total_nodes"))
    m = relationships.agg(F.count("*").alias("total_edges"))
    c = membership.groupBy("community").agg(F.count("*").alias("s")).agg(F.count("*").alias("n_communities"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("avg_size"), F.coalesce(F.max("s"), F.lit(0)).alias("max_size"))
    return n.join(m, F.lit(True)).join(c, F.lit(True))  # one row each


def top_communities(membership: DataFrame, k: int = 10) -> DataFrame:
    return membership.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(k)


def global_summary(entities: DataFrame, relationships: DataFrame, membership: DataFrame, generate: Generator = as_is) -> DataFrame:
    """One row: content of the statistics and the ten largest communities, and the number of entities that they hold."""
    top = top_communities(membership)
    sizes = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("size", F.col("community").cast("string").alias("c"))), asc=False), lambda x: F.format_string("- %s: %d", x["c"], x["size"])), "\n").alias("lines"), F.sum("size").alias("covered"))
    one = global_statistics(entities, relationships, membership).join(sizes, F.lit(True))
    prompt = F.concat(F.format_string("Communities: %d\nAverage size: %.1f\nLargest:\n", F.col("n_communities"), F.bround("avg_size", 1)), F.coalesce("lines", F.lit("")))
    return one.select("n_communities", "covered", generate(prompt).alias("content"))


def with_entities(summaries: DataFrame, links: DataFrame) -> DataFrame:
    """Summaries with the sorted ids of their entities; empty where there are none."""
    ids = links.groupBy(F.col("summary_id").alias("id")).agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return summaries.join(ids, "id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def hierarchy(entities: DataFrame, relationships: DataFrame, membership: DataFrame, generate: Generator = as_is) -> DataFrame:
    """id, level, content: summaries of all member nodes, of communities, and of the whole graph."""
    nodes = node_summaries(entities, relationships, generate).join(membership.select("id").distinct(), "id", "left_semi").select("id", F.lit("node").alias("level"), "content")
    groups = community_summaries(entities, relationships, membership, generate=generate).select(F.concat(F.lit("comm_"), F.col("community").cast("string")).alias("id"), F.lit("community").alias("level"), "content")
    whole = global_summary(entities, relationships, membership, generate).select(F.lit("global").alias("id"), F.lit("global").alias("level"), "content")
    return nodes.union(groups).union(whole)


def current(summaries: DataFrame) -> DataFrame:
    """The last updated row of each summary, with its level in one spelling."""
    return latest_by_key(summaries.filter("id IS NOT NULL").withColumn("level", F.lower(F.trim("level"))), "id", "last_updated")


def by_id(summaries: DataFrame, id: str) -> DataFrame:
    return summaries.filter(F.col("id") == id)


def by_level(summaries: DataFrame, level: str) -> DataFrame:
    return summaries.filter(F.col("level") == level)


def level_counts(summaries: DataFrame) -> DataFrame:
    """level, n, latest of current summaries."""
    return summaries.groupBy("level").agg(F.count("*").alias("n"), F.max("last_updated").alias("latest"))
