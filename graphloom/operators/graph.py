"""Property graphs as DataFrames, and the metrics that need no long iteration.

Edges are rows src, dst, label, type, confidence, ...; ``simple`` makes the undirected simple graph
that the metrics are defined on: parallel edges collapsed, self-loops and isolated nodes left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut


@dataclass(frozen=True)
class PropertyGraph:
    """entities(id, type, text), relationships(src, dst, label, type, confidence, occurrence_count), mentions(entity_id, doc_id, chunks, mention_count)."""

    entities: DataFrame
    relationships: DataFrame
    mentions: DataFrame


def simple(edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Undirected simple edges a < b, restricted to the ids of ``keep`` at both ends."""
    e = edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    if keep is not None:
        ids = keep.select("id").distinct()
        e = e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return e.select("a", "b")


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """src, dst of every edge in both orientations; one exploding pass instead of a union of two scans."""
    ends = F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))
    return edges.select(F.explode(ends).alias("_e")).select("_e.src", "_e.dst")


def undirected(relationships: DataFrame) -> DataFrame:
    """src, dst and the other columns in both orientations, as an undirected match sees them; parallel edges stay, self-loops once."""
    rest = [c for c in relationships.columns if c not in ("src", "dst")]
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = F.when(F.col("src") == F.col("dst"), F.slice(ways, 1, 1)).otherwise(ways)
    return relationships.withColumn("_w", F.explode(ways)).select("_w.src", "_w.dst", *rest)


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree of a simple graph."""
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """id, degree / (n - 1)."""
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n), F.lit(True)).select("id", F.coalesce(F.try_divide(F.col("degree").cast("double"), F.col("n") - 1), F.lit(1.0)).alias("degree_centrality"))  # one row


def triangles(edges: DataFrame) -> DataFrame:
    """x, y, z of every triangle once.  Edges point from lower to higher degree, so hubs open few wedges."""
    d = degrees(edges)
    deg = edges.join(d.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    up = F.struct(F.col("da").alias("d"), F.col("a").alias("i")) < F.struct(F.col("db").alias("d"), F.col("b").alias("i"))
    directed = deg.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    w1, w2 = directed.select("u", F.col("v").alias("v1")), directed.select("u", F.col("v").alias("v2"))
    wedges = w1.join(w2, "u").filter(F.col("v1") < F.col("v2")).select("u", F.col("v1").alias("a"), F.col("v2").alias("b"))
    closed = wedges.join(edges, ["a", "b"], "left_semi")
    ids = F.array_sort(F.array("u", "a", "b"))
    return closed.select(ids[0].alias("x"), ids[1].alias("y"), ids[2].alias("z"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, clustering: triangles over possible ones, 0 below two neighbours."""
    per = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    d = degrees(edges).join(per, "id", "left")
    return d.select("id", F.coalesce(F.try_divide(2.0 * F.col("t"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)).alias("clustering"))


def motifs(edges: DataFrame) -> DataFrame:
    """motif, n: pairs of neighbours that are linked (each triangle counts three times) or not; absent when 0."""
    wedges = degrees(edges).agg(F.coalesce(F.sum(F.col("degree") * (F.col("degree") - 1) / 2), F.lit(0)).cast("long").alias("w"))
    closed = triangles(edges).agg((F.count("*") * 3).alias("t"))
    rows = wedges.join(closed, F.lit(True)).select(F.explode(F.array(F.struct(F.lit("triangle").alias("motif"), F.col("t").alias("n")), F.struct(F.lit("v_shape").alias("motif"), (F.col("w") - F.col("t")).alias("n")))).alias("m"))
    return rows.select("m.motif", "m.n").filter("n > 0")


def density(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density = 2m / (n (n - 1))."""
    n = degrees(edges).agg(F.count("*").alias("n_nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("n_edges"))
    return n.withColumn("density", F.coalesce(F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)))


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at both ends, over both orientations."""
    d = degrees(edges)
    ends = both_ways(edges).join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    return ends.agg(F.corr("ds", "dd").alias("assortativity"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Sum over communities of L/m - (d / 2m)^2.  ``membership`` has id, community; a node without one is a community of its own."""
    d = degrees(edges).join(membership, "id", "left").withColumn("community", F.coalesce(F.col("community").cast("string"), F.concat(F.lit("_"), F.col("id").cast("string"))))
    tagged = edges.join(d.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(d.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inner = tagged.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("l"))
    total = d.groupBy("community").agg(F.sum("degree").alias("d"))
    m = edges.agg(F.count("*").alias("m"))
    rows = total.join(inner, "community", "left").join(F.broadcast(m), F.lit(True))  # one row
    return rows.agg(F.sum(F.try_divide(F.coalesce("l", F.lit(0)).cast("double"), "m") - F.pow(F.try_divide(F.col("d").cast("double"), 2 * F.col("m")), F.lit(2.0))).alias("modularity"))


def in_out_degree(relationships: DataFrame) -> DataFrame:
    """id, in_degree, out_degree in one pass over the edges."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return relationships.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def connectivity(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Share of entities that have an edge, and twice that share (the raw sum over both ends)."""
    linked = relationships.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_l", F.lit(1))
    share = F.coalesce(F.try_divide(F.count("_l").cast("double"), F.count("*")), F.lit(0.0))
    return entities.select("id").join(linked, "id", "left").agg(share.alias("connectivity"), (2 * share).alias("connectivity_raw"))


def isolated(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    return entities.join(relationships.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")


def stale_isolated(entities: DataFrame, relationships: DataFrame, reference: DataFrame, days: int = 90) -> DataFrame:
    """Entities without an edge whose last_accessed is more than ``days`` before the reference (one row with ``ref``)."""
    old = entities.join(F.broadcast(reference), F.lit(True)).filter(F.col("last_accessed") < F.col("ref") - F.expr(f"INTERVAL {days} DAYS")).drop("ref")  # one row
    return isolated(old, relationships)


def induced(relationships: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with both ends in the same community, with it."""
    a, b = membership.select(F.col("id").alias("src"), "community"), membership.select(F.col("id").alias("dst"), "community")
    return relationships.join(a, "src").join(b, ["dst", "community"])


def community_statistics(entities: DataFrame, relationships: DataFrame, membership: DataFrame, types: tuple[str, ...] = ("PERSON", "ORGANIZATION", "LOCATION", "EVENT")) -> DataFrame:
    """community, node_count, counts by type, internal_edges (directed), density, avg_degree."""
    counts = [F.count_if(F.col("type") == t).alias(f"{t.lower()}_count") for t in types]
    nodes = membership.join(entities.select("id", "type"), "id", "left").groupBy("community").agg(F.count("*").alias("node_count"), *counts)
    inner = induced(relationships, membership).groupBy("community").agg(F.count("*").alias("internal_edges"))
    out = nodes.join(inner, "community", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    n = F.col("node_count")
    return out.withColumn("density", F.coalesce(F.try_divide(F.col("internal_edges").cast("double"), n * (n - 1)), F.lit(0.0))).withColumn("avg_degree", F.try_divide(2.0 * F.col("internal_edges"), n))


def community_objects(entities: DataFrame, relationships: DataFrame, membership: DataFrame, least: int = 3) -> DataFrame:
    """comm_id, community, size, density, avg_degree, node_types, edge_types (maps of counts) of communities of at least ``least`` members.

    Ids are comm_0, comm_1, ... from the largest on, ties by community.
    """
    stats = community_statistics(entities, relationships, membership, ()).filter(F.col("node_count") >= least)
    types = lambda rows, name: rows.groupBy("community", "type").agg(F.count("*").alias("n")).groupBy("community").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias(name))  # noqa: E731  an entry a type
    nodes = types(membership.join(entities.select("id", "type"), "id").select("community", "type"), "node_types")
    edges = types(induced(relationships, membership).select("community", "type"), "edge_types")
    placed = stats.withColumn("comm_id", F.concat(F.lit("comm_"), (F.row_number().over(Window.orderBy(F.desc("node_count"), "community")) - 1).cast("string")))  # a row a community
    return placed.join(nodes, "community", "left").join(edges, "community", "left").select("comm_id", "community", F.col("node_count").alias("size"), "density", "avg_degree", "node_types", "edge_types")


def community_center(relationships: DataFrame, membership: DataFrame, k: int = 1) -> DataFrame:
    """community, id, degree of the nodes with the most links inside; ties to the smaller id."""
    ends = induced(relationships, membership).select("community", F.explode(F.array("src", "dst")).alias("id"))
    d = ends.groupBy("community", "id").agg(F.count("*").alias("degree"))
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def shared_neighbours(edges: DataFrame, least: float) -> DataFrame:
    """x, y, similarity: pairs of nodes by the Jaccard similarity of their neighbours, at least ``least`` (above 0).

    Prefix filter: neighbours are ranked from the rarest on, and two sets that are alike enough share one of the first
    d - ceil(least * d) + 1 of each.  So a hub links nodes only where it is among their rarest neighbours; then sizes are compared,
    and the pairs left are counted exactly.
    """
    e = both_ways(edges)
    d = degrees(edges)
    sized = e.join(d.select(F.col("id").alias("dst"), F.col("degree").alias("rare")), "dst").join(d.select(F.col("id").alias("src"), "degree"), "src")
    place = F.row_number().over(Window.partitionBy("src").orderBy("rare", "dst"))
    first = sized.withColumn("_at", place).filter(F.col("_at") <= F.col("degree") - F.ceil(F.round(F.col("degree") * least, 9)) + 1)
    x = first.select(F.col("src").alias("x"), F.col("degree").alias("dx"), "dst")
    y = first.select(F.col("src").alias("y"), F.col("degree").alias("dy"), "dst")
    pairs = x.join(y, "dst").filter((F.col("x") < F.col("y")) & (F.least("dx", "dy") >= F.greatest("dx", "dy") * least - 1e-9)).select("x", "y", "dx", "dy").distinct()
    common = pairs.join(e.select(F.col("src").alias("x"), "dst"), "x").join(e.select(F.col("src").alias("y"), "dst"), ["y", "dst"]).groupBy("x", "y", "dx", "dy").agg(F.count("*").alias("c"))
    return common.withColumn("similarity", F.col("c") / (F.col("dx") + F.col("dy") - F.col("c"))).filter(F.col("similarity") >= least).select("x", "y", "similarity")


def edge_similarity(edges: DataFrame) -> DataFrame:
    """a, b, jaccard: each edge with the Jaccard similarity of its ends' neighbours.

    Neighbours that both have close a triangle over the edge, so triangles are counted and no neighbourhood is collected.
    """
    sides = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("x", "y"), ("x", "z"), ("y", "z"))])
    shared = triangles(edges).select(F.explode(sides).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("c"))
    d = degrees(edges)
    j = edges.join(shared, ["a", "b"], "left").join(d.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    c = F.coalesce("c", F.lit(0))
    return j.select("a", "b", (c / (F.col("da") + F.col("db") - c)).alias("jaccard"))


def compress(relationships: DataFrame, level: float, components) -> tuple[DataFrame, DataFrame]:
    """Merge nodes with like neighbours and drop the weakest edges.

    Nodes whose neighbourhoods have a Jaccard similarity of at least 1 - level / 2 form groups; the smallest id
    stands for each.  Then the int(m * level) edges of least confidence go, ties by ids.  Gives the edges left and
    the map id, rep.
    """
    alike = shared_neighbours(simple(relationships), 1 - level / 2)
    groups = components(alike.select(F.col("x").alias("a"), F.col("y").alias("b"))).select("id", F.col("component").alias("rep"))
    moved = relationships.join(groups.select(F.col("id").alias("src"), F.col("rep").alias("rs")), "src", "left").join(groups.select(F.col("id").alias("dst"), F.col("rep").alias("rd")), "dst", "left")
    merged = moved.select(F.coalesce("rs", "src").alias("src"), F.coalesce("rd", "dst").alias("dst"), "type", "confidence").filter("src <> dst").groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))
    return drop_weakest(merged, level), groups


def kth_least(rows: DataFrame, value: str, k: int) -> float:
    """The k-th least of a finite double column without nulls: rows are counted by bins, then inside the bin that holds it."""
    low, high = (float(v) for v in rows.agg(F.min(value), F.max(value)).first())
    while True:
        # Bins of equal width between the bounds; the one with the wanted rank becomes the new bounds.
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            return low
        at = F.least(F.floor((F.col(value) - low) / width), F.lit(4095))
        inside = rows.filter((F.col(value) >= low) & (F.col(value) <= high))
        bins = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(at.alias("b")).agg(F.count("*"), F.min(value), F.max(value)).collect()}  # 4096 rows at most
        for b in sorted(bins):
            n, least, most = bins[b]
            if k <= n:
                low, high = least, most
                break
            k -= n
        if low == high:
            return low


def drop_weakest(edges: DataFrame, level: float) -> DataFrame:
    """All but the int(m * level) edges of least confidence, ties by ids: the k-th least is found by counting, not by a sort.

    Edges with the k-th confidence are ranked by their hash ranges, so that many ties aren't one task.
    """
    edges = cut(edges)  # read several times
    m = edges.count()
    k = int(m * level)
    if not k:
        return edges
    c = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    edges = edges.withColumn("_c", c)
    border = kth_least(edges.select("_c"), "_c", k)
    ties = edges.filter(F.col("_c") == border)
    more = k - edges.filter(F.col("_c") < border).count()
    # As many ties as are left go, by their ids: sorted in ranges, and counted before each range.
    ids = ties.select("src", "dst", "type").repartitionByRange("src", "dst", "type").withColumn("_p", F.spark_partition_id())
    ids = cut(ids)
    counts = sorted((r[0], r[1]) for r in ids.groupBy("_p").agg(F.count("*")).collect())  # a row a partition
    whole, split = [], None
    for p, n in counts:
        if n <= more:
            whole.append(p)
            more -= n
        else:
            split = p
            break
    gone = ids.filter(F.col("_p").isin(whole)) if whole else ids.limit(0)
    if split is not None and more:
        gone = gone.unionByName(ids.filter(F.col("_p") == split).orderBy("src", "dst", "type").limit(more))  # one range
    return edges.filter(F.col("_c") >= border).drop("_c").join(gone.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")


def rename_ids(edges: DataFrame, groups: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Edges with ids replaced by their representatives."""
    for end in ends:
        edges = edges.join(groups.select(F.col("id").alias(end), F.col("rep").alias("_r")), end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    return edges


def condition(spec: dict[str, object]) -> Column:
    """A filter dictionary {field: value} or {field: {op: value}} as a column; all parts must hold."""
    ops = {
        "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v,
        "in": lambda c, v: c.isin(*v), "contains": lambda c, v: F.contains(c, F.lit(v)), "exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    }
    out = F.lit(True)
    for name, want in spec.items():
        for op, value in (want if isinstance(want, dict) else {"eq": want}).items():
            if op not in ops:
                raise ValueError(f"unknown operator {op}")
            out = out & ops[op](F.col(name), value)
    return out
