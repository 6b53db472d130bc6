"""Dictionary queries compiled to one DataFrame plan; the optimiser does what follows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph, condition, simple, undirected
from graphloom.operators.iterative import ego_distances, ego_edges
from graphloom.operators.paths import costed, simple_paths

LIMIT = 1000
AGGREGATES = {"count": lambda c: F.count("*"), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def query_kind(spec: dict[str, Any]) -> str:
    for name, kind in (("path", "path_finding"), ("pattern", "pattern_matching"), ("aggregation", "aggregation"), ("subgraph", "subgraph")):
        if name in spec:
            return kind
    return "entity_search"


def compile_spec(graph: PropertyGraph, spec: dict[str, Any], interactive: bool = False) -> DataFrame:
    """A DataFrame for a query of any of the five kinds.  ``filters``, ``sort`` and ``limit`` hold for all.

    An ``interactive`` query that names no limit gets that of ``with_limit``.
    """
    out = {"path_finding": _paths, "pattern_matching": _pattern, "aggregation": _aggregate, "subgraph": _subgraph, "entity_search": _entities}[query_kind(spec)](graph, spec)
    if spec.get("filters") and query_kind(spec) != "aggregation":
        out = out.filter(condition(spec["filters"]))
    if spec.get("sort"):
        out = out.orderBy(*[F.desc(s[1:]) if s.startswith("-") else F.asc(s) for s in ([spec["sort"]] if isinstance(spec["sort"], str) else spec["sort"])])
    return out.limit(spec["limit"]) if spec.get("limit") else with_limit(out) if interactive else out


def with_limit(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The limit that interactive queries get where they name none."""
    return df.limit(limit)


def _entities(graph: PropertyGraph, spec: dict[str, Any]) -> DataFrame:
    out = graph.entities.filter(condition(spec.get("criteria", {})))
    return out.select(*spec["fields"]) if spec.get("fields") else out


def _aggregate(graph: PropertyGraph, spec: dict[str, Any]) -> DataFrame:
    """aggregation: {function, field, on, grouping}."""
    a = spec["aggregation"]
    rows = getattr(graph, a.get("on", "entities")).filter(condition(spec.get("filters", {})))
    fields = a["field"] if isinstance(a.get("field"), list) else [a.get("field", "id")]
    made = [AGGREGATES[a["function"]](f).alias(f"{a['function']}_{f}") for f in fields]
    return rows.groupBy(*a["grouping"]).agg(*made) if a.get("grouping") else rows.agg(*made)


def _subgraph(graph: PropertyGraph, spec: dict[str, Any]) -> DataFrame:
    s = spec["subgraph"]
    depth = s.get("depth", 2)
    centers = graph.entities.filter(F.col("id").isin(*s["nodes"])).select("id")
    return ego_edges(graph.relationships, ego_distances(simple(graph.relationships), centers, depth), depth)


def _paths(graph: PropertyGraph, spec: dict[str, Any]) -> DataFrame:
    p = spec["path"]
    return simple_paths(costed(graph.relationships), p["start"], p["end"], p.get("max_length", 5))


def _pattern(graph: PropertyGraph, spec: dict[str, Any]) -> DataFrame:
    """pattern: node specs {name, type} with edge types between them, as a chain of joins; no edge is used twice."""
    nodes, edges = spec["pattern"]["nodes"], spec["pattern"]["edges"]
    ways = undirected(graph.relationships.select("src", "dst", "type").withColumn("e", F.xxhash64("src", "dst", "type")))

    def members(node: dict[str, Any]) -> DataFrame:
        rows = graph.entities
        if node.get("type"):
            rows = rows.filter(F.col("type") == node["type"])
        return rows.select(F.col("id").alias(node["name"]))

    out, used = members(nodes[0]), []
    for i, kind in enumerate(edges):
        step = ways.filter(F.col("type") == kind) if kind else ways
        a, b = nodes[i]["name"], nodes[i + 1]["name"]
        out = out.join(step.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("e").alias(f"_e{i}")), a).join(members(nodes[i + 1]), b)
        for u in used:
            out = out.filter(F.col(f"_e{i}") != F.col(u))
        used.append(f"_e{i}")
    return out.select(*[n["name"] for n in nodes]).distinct()


def execution_cost(groups: list[list[float]], cache: str = "none") -> float:
    """Sum over groups of steps that run side by side of the dearest, less what a cache saves."""
    return sum(max(g) for g in groups if g) * {"full": 0.2, "partial": 0.5, "stream": 0.8}.get(cache, 1.0)
