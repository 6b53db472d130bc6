"""From documents to the graph in one composition: chunks, extraction, validation, upserts, links and a status for each document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import upserts as U
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.validation import Rule, Validator, required
from graphloom.session import cut

Extractor = Callable[[Column], Column]
EXTRACTED = (
    Rule("extracted_entity", "entity", "error", "missing_required", "type and text are required", lambda: (F.col("type") != "") & (F.col("text") != "")),
    Rule("extracted_relationship", "relationship", "error", "missing_required", "source, target and type are required", required("source", "target", "type")),
)


def extract(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """Chunks with entities, relationships and confidence of the extractor's response, a column of text as a language model gives it."""
    read = chunks.withColumn("response", extractor(F.col("chunk_text")))
    found = read.withColumns({"entities": T.parse_entities(F.col("response")), "relationships": T.parse_relationships(F.col("response"))})
    return found.withColumn("confidence", T.extraction_confidence(F.size("entities"), F.size("relationships")))


def ingest(documents: DataFrame, extractor: Extractor, chunk_size: int = 1000, overlap: int = 200, validator: Validator | None = None) -> dict[str, DataFrame]:
    """chunks, entities, mentions, relationships and status of documents (doc_id, content, error, and ``ts``, when they came in).

    Entities are identified by type and text, relationships name their ends by text and need both to be entities.  A
    document that couldn't be read, is blank, or whose id has other characters than letters, digits, _ and - is not taken in;
    its status says why.  ``status`` has doc_id, success, error, chunk_count, entity_count, relationship_count, confidence.
    Documents taken in several times count once, by their last ``ts``.
    """
    rules = validator or Validator(list(EXTRACTED))
    once = U.latest_by_key(documents.select("doc_id", "content", "error", "ts").filter("doc_id IS NOT NULL"), "doc_id", "ts")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(F.trim(F.regexp_replace("content", T.WHITE, " ")), F.lit("")) == "", F.lit("no content")).when(~F.col("doc_id").rlike(T.ID_FORMAT), F.lit("format_error"))
    checked = cut(once.withColumn("error", reason))
    chunks = T.chunks(checked.filter("error IS NULL"), chunk_size, overlap, text="content").join(checked.select("doc_id", "ts"), "doc_id")
    found = cut(extract(chunks, extractor))
    seq = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int")
    named = found.select("doc_id", "chunk_id", seq.alias("seq"), "ts", F.explode(F.array_distinct("entities")).alias("e")).select("doc_id", "chunk_id", "seq", "ts", "e.type", "e.text")
    named = rules.entities(named).filter("result.success").drop("result")
    entities = cut(U.upsert_entities(named))
    calls = named.withColumn("entity_id", F.md5(F.concat_ws("#", "type", "text")))
    mentions = U.upsert_mentions(calls)
    said = found.select("doc_id", "ts", F.explode("relationships").alias("r")).select("doc_id", "ts", "r.source", "r.target", F.col("r.relationship").alias("type"), "r.confidence")
    texts = entities.select(F.col("text").alias("id"))
    valid = rules.relationships(said, texts).filter("result.success AND source_exists AND target_exists").drop("result", "source_exists", "target_exists")
    relationships = U.upsert_relationships(U.edges_by_text(valid, entities.select("id", "text")))
    per = found.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(F.size("entities")).alias("entity_count"), F.sum(F.size("relationships")).alias("relationship_count"), F.avg("confidence").alias("confidence"))
    status = checked.select("doc_id", "error").join(per, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("chunk_count", "entity_count", "relationship_count", "confidence")}
    return {"chunks": found, "entities": entities, "mentions": mentions, "relationships": relationships, "status": status.withColumns(zero).select("doc_id", F.col("error").isNull().alias("success"), "error", *zero)}


def ingest_folder(spark: SparkSession, folder: str, extractor: Extractor, patterns: str = "*.pdf,*.docx,*.csv", **settings) -> dict[str, DataFrame]:
    """``ingest`` of the files of a folder."""
    from graphloom.sources.documents import read_directory

    return ingest(read_directory(spark, folder, patterns).withColumn("ts", F.current_timestamp()), extractor, **settings)


def graph_of(parts: dict[str, DataFrame]) -> PropertyGraph:
    """The property graph of what was taken in."""
    return PropertyGraph(parts["entities"].select("id", "type", "text"), parts["relationships"].withColumn("label", F.lit("RELATED_TO")), parts["mentions"])


def apply_operations(table: DataFrame, relationships: DataFrame, ops: DataFrame, cascade: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Table and relationships after a batch of operations (seq, operation, id, data map), and a result for each.

    The table has id and text columns.  Creates come first, then merges and updates, of which the last (by seq) wins for each
    field, then deletes, with the edges of what goes if ``cascade``.  ``results`` has seq, operation, success, error: unknown
    operations, missing ids, creates of an id that is there and updates of one that isn't fail.
    """
    fields = [c for c in table.columns if c != "id"]
    known = F.col("operation").isin("create", "merge", "update", "delete", "read")
    seen = ops.join(table.select("id", F.lit(True).alias("_there")), "id", "left")
    first = F.min(F.when(F.col("operation").isin("create", "merge"), F.col("seq"))).over(_by_id())
    there = F.coalesce(F.col("_there"), F.lit(False))
    error = (
        F.when(~known, "unknown_operation").when(F.col("id").isNull(), "missing_required")
        .when((F.col("operation") == "create") & (there | (first < F.col("seq"))), "duplicate")
        .when(F.col("operation").isin("update", "read", "delete") & ~there & (first.isNull() | (first > F.col("seq"))), "not_found")
    )
    judged = cut(seen.withColumn("error", error))
    good = judged.filter("error IS NULL AND operation IN ('create', 'merge', 'update')")
    each = good.select("id", "seq", F.explode("data").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    values = each.groupBy("id").agg(*[F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for c in fields])
    made = good.select("id").distinct().join(values, "id", "left")
    changed = U.create(U.update(table, made), made.select("id", *[F.col(c).cast(table.schema[c].dataType).alias(c) for c in fields]))
    left, edges = U.delete(changed, judged.filter("error IS NULL AND operation = 'delete'").select("id").distinct(), relationships, cascade)
    return left, edges, judged.select("seq", "operation", F.col("error").isNull().alias("success"), "error")


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("id")
