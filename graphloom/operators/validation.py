"""Validation by registered rules, the first that fails being the result; and checks of triples against an ontology."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import ID_FORMAT


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # entity, relationship or structure
    level: str
    error_code: str
    message: str
    holds: Callable[[], Column]


def required(*names: str) -> Callable[[], Column]:
    def holds() -> Column:
        out = F.lit(True)
        for n in names:
            out = out & F.col(n).isNotNull()
        return out

    return holds


DEFAULTS = (
    Rule("required_entity_fields", "entity", "error", "missing_required", "id and type are required", required("id", "type")),
    Rule("entity_id_format", "entity", "error", "format_error", "id has other characters than letters, digits, _ and -", lambda: F.coalesce(F.col("id").rlike(ID_FORMAT), F.lit(False))),
    Rule("required_relationship_fields", "relationship", "error", "missing_required", "source, target and type are required", required("source", "target", "type")),
    Rule("relationship_endpoints", "relationship", "error", "relationship_error", "an end does not exist", lambda: F.col("source_exists") & F.col("target_exists")),
    Rule("graph_connectivity", "structure", "warning", "structure_error", "less than 80 % of the nodes are connected", lambda: F.col("connectivity") >= 0.8),
)


@dataclass
class Validator:
    rules: list[Rule] = field(default_factory=lambda: list(DEFAULTS))

    def add(self, rule: Rule) -> None:
        if any(r.name == rule.name for r in self.rules):
            raise ValueError(f"rule {rule.name} exists")
        self.rules.append(rule)

    def result(self, kind: str) -> Column:
        """struct<success, level, error_code, message> of the first failing rule of a kind."""
        out = None
        for r in (r for r in self.rules if r.kind == kind):
            value = F.struct(F.lit(False).alias("success"), F.lit(r.level).alias("level"), F.lit(r.error_code).alias("error_code"), F.lit(r.message).alias("message"))
            out = F.when(~r.holds(), value) if out is None else out.when(~r.holds(), value)
        fine = F.struct(F.lit(True).alias("success"), F.lit("info").alias("level"), F.lit("").alias("error_code"), F.lit("").alias("message"))
        return fine if out is None else out.otherwise(fine)

    def entities(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("result", self.result("entity"))

    def relationships(self, rows: DataFrame, entities: DataFrame) -> DataFrame:
        """``relationship`` stands in for a missing ``type``; both ends are looked up."""
        if "type" not in rows.columns and "relationship" in rows.columns:
            rows = rows.withColumn("type", F.col("relationship"))
        ids = entities.select("id").distinct()
        a, b = ids.select(F.col("id").alias("source"), F.lit(True).alias("_a")), ids.select(F.col("id").alias("target"), F.lit(True).alias("_b"))
        seen = rows.join(a, "source", "left").join(b, "target", "left").withColumns({"source_exists": F.col("_a").isNotNull(), "target_exists": F.col("_b").isNotNull()})
        return seen.withColumn("result", self.result("relationship")).drop("_a", "_b")

    def structure(self, connectivity: DataFrame) -> DataFrame:
        return connectivity.withColumn("result", self.result("structure"))


def split_batch(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid rows of a validated batch."""
    return rows.filter("result.success"), rows.filter("NOT result.success")


# ---- Fixed values: required fields of each operation ----
OPERATION_FIELDS = {"create": ("type", "properties"), "read": ("id",), "update": ("id", "properties"), "delete": ("id",), "merge": ("id", "properties"), "index": ("label", "property"), "constraint": ("label", "property")}
# ---- End of fixed values ----


def operation_errors(ops: DataFrame) -> DataFrame:
    """Operations (operation, data map) with the required fields that are missing."""
    table = F.create_map(*[x for k, v in OPERATION_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    have = F.coalesce(F.map_keys("data"), F.array().cast("array<string>"))
    return ops.withColumn("known", F.col("operation").isin(*OPERATION_FIELDS)).withColumn("missing", F.array_except(F.coalesce(F.try_element_at(table, "operation"), F.array().cast("array<string>")), have))


def semantic_errors(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """Triples src, src_type, rel, dst, dst_type against ontology src_type, rel, dst_type, max_card: error is unknown_relation, cardinality or null."""
    known = triples.join(ontology, ["src_type", "rel", "dst_type"], "left")
    seen = known.withColumn("_n", F.row_number().over(Window.partitionBy("src", "rel").orderBy("dst")))
    return seen.withColumn("error", F.when(F.col("max_card").isNull(), "unknown_relation").when(F.col("_n") > F.col("max_card"), "cardinality")).drop("_n", "max_card")


def integrity(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, nulls: rows that lack each column, in one pass."""
    one = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("r")).select("r.column", "r.nulls")


def duplicates(table: DataFrame, key: str) -> DataFrame:
    """Keys that several rows hold: the uniqueness constraint as a query."""
    return table.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def document_id_errors(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, error of ids that are missing or have other characters than letters, digits, _ and - (format_error), or that several rows hold (duplicate)."""
    held = documents.groupBy(key).agg(F.count("*").alias("n"))
    error = F.when(~F.coalesce(F.col(key).cast("string").rlike(ID_FORMAT), F.lit(False)), "format_error").when(F.col("n") > 1, "duplicate")
    return held.select(key, error.alias("error")).filter("error IS NOT NULL")
