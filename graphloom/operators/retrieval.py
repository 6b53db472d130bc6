"""Retrieval over the graph and its vectors: community choice, ego subgraphs, expansion, ranking and fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vector import cosine, literal, mean_vector
from graphloom.operators.graph import PropertyGraph, both_ways, community_center, simple, undirected
from graphloom.operators.iterative import ego_distances, ego_edges
from graphloom.session import cut


def top_similar(df: DataFrame, key: str, query: list[float], k: int, least: float = -2.0, embedding: str = "embedding") -> DataFrame:
    """key, similarity of the k rows most like the query, at ``least`` or more; ties to the smaller key."""
    scored = df.select(key, cosine(F.col(embedding), literal(query)).alias("similarity")).filter(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def communities_for(vectors: DataFrame, membership: DataFrame, query: list[float], k: int = 5, least: float = 0.3) -> DataFrame:
    """Communities by the similarity of their mean vector."""
    means = mean_vector(membership.join(vectors, "id"), ["community"])
    return top_similar(means, "community", query, k, least)


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, key: str, score: str = "score", c: int = 60) -> DataFrame:
    """key, fused: sum of 1 / (60 + rank) over both rankings.  Ranked lists come from top-k searches."""
    rank = lambda df, n: df.withColumn(n, F.row_number().over(Window.orderBy(F.desc(score), key))).select(key, n)
    both = rank(first, "_a").join(rank(second, "_b"), key, "full_outer")
    part = lambda n: F.coalesce(1.0 / (c + F.col(n)), F.lit(0.0))
    return both.select(key, (part("_a") + part("_b")).alias("fused"))


def subgraph_confidence(subgraphs: DataFrame) -> DataFrame:
    """Mean over subgraphs (n_nodes, n_edges) of (min(1, n / 100) + e / (n (n - 1))) / 2; one node has density 0."""
    n = F.col("n_nodes")
    return subgraphs.agg(F.avg((F.least(F.lit(1.0), n / 100) + F.coalesce(F.try_divide(F.col("n_edges").cast("double"), n * (n - 1)), F.lit(0.0))) / 2).alias("confidence"))


def connected_outside(relationships: DataFrame, seeds: DataFrame, k: int = 50) -> DataFrame:
    """id, connections: nodes outside of the seeds by their links to seeds, the k first."""
    links = undirected(relationships.select("src", "dst")).join(seeds.select(F.col("id").alias("src")), "src", "left_semi").join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti")
    return links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("connections")).orderBy(F.desc("connections"), "id").limit(k)


def expansion_edges(relationships: DataFrame, base: DataFrame, added: DataFrame) -> DataFrame:
    """Directed edges from base nodes to added ones."""
    return relationships.join(base.select(F.col("id").alias("src")), "src", "left_semi").join(added.select(F.col("id").alias("dst")), "dst", "left_semi")


def relevance(subgraph_nodes: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """subgraph, relevance: mean cosine of its nodes, 0 for nodes without a vector."""
    scored = subgraph_nodes.join(vectors, "id", "left").withColumn("s", F.coalesce(cosine(F.col("embedding"), literal(query)), F.lit(0.0)))
    return scored.groupBy("subgraph").agg(F.avg("s").alias("relevance"))


def ranked(subgraph_nodes: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """subgraph, score = 0.7 relevance + 0.3 diversity; diversity is one minus the mean overlap with the subgraphs before it.

    ``scores`` has subgraph, seq (the order of scoring) and relevance; an overlap is the share of the subgraph's own nodes.
    """
    nodes = subgraph_nodes.select("subgraph", "id").distinct()
    size = nodes.groupBy("subgraph").agg(F.count("*").alias("n"))
    a = nodes.join(scores.select("subgraph", "seq"), "subgraph")
    b = a.select(F.col("subgraph").alias("other"), "id", F.col("seq").alias("seq2"))
    shared = a.join(b, "id").filter("seq2 < seq").groupBy("subgraph").agg(F.count("*").alias("c"))
    rank = scores.join(size, "subgraph").join(shared, "subgraph", "left")
    before = F.col("seq") - 1
    overlap = F.coalesce(F.try_divide(F.coalesce("c", F.lit(0)).cast("double"), F.col("n") * before), F.lit(0.0))
    return rank.withColumn("score", 0.7 * F.col("relevance") + 0.3 * (1 - overlap)).select("subgraph", "score").orderBy(F.desc("score"), "subgraph").limit(k)


def best_first(relationships: DataFrame, vectors: DataFrame, centers: list, query: list[float], max_subgraphs: int = 5, depth: int = 3, branch: int = 5) -> tuple[list, DataFrame]:
    """Visit order and nodes (center, id, dist): the node most like the query is taken from the queue, its ego subgraph kept, its neighbours queued.

    Of each node taken, the ``branch`` best neighbours that weren't taken are queued, so the queue holds at most
    max_subgraphs * branch ids and the centres.  Neighbours are fetched for all queued nodes at once.
    """
    edges = cut(simple(relationships))
    scored = cut(vectors.select("id", cosine(F.col("embedding"), literal(query)).alias("s")))
    ways = both_ways(edges)
    best = Window.partitionBy("src").orderBy(F.desc("s"), "id")
    queue = {r["id"]: r["s"] for r in scored.filter(F.col("id").isin(*centers)).collect()}
    near: dict = {}
    done: list = []
    while queue and len(done) < max_subgraphs:
        node = min(queue, key=lambda i: (-queue[i], i))
        if node not in near:
            wanted = [i for i in queue if i not in near]
            # No more than max_subgraphs nodes are taken ever, so the branch best others are among these.
            rows = ways.filter(F.col("src").isin(*wanted)).select("src", F.col("dst").alias("id")).join(scored, "id").withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= branch + max_subgraphs)
            near.update({i: [] for i in wanted})
            for r in rows.orderBy("src", "_k").collect():
                near[r["src"]].append((r["id"], r["s"]))
        queue.pop(node)
        done.append(node)
        for i, s in [x for x in near[node] if x[0] not in done][:branch]:
            queue.setdefault(i, s)
    kind = relationships.schema["src"].dataType.simpleString()
    picked = relationships.sparkSession.createDataFrame([(d,) for d in done], f"id {kind}")
    return done, ego_distances(edges, picked, depth)


def expanded(nodes: DataFrame, context: DataFrame, relationships: DataFrame) -> DataFrame:
    """subgraph, id: nodes of subgraphs and, of the context nodes (id), those that have an edge with one of theirs."""
    ways = undirected(relationships.select("src", "dst"))
    more = nodes.join(ways.select(F.col("src").alias("id"), "dst"), "id").join(context.select(F.col("id").alias("dst")), "dst", "left_semi").select("subgraph", F.col("dst").alias("id"))
    return nodes.select("subgraph", "id").union(more).distinct()


def staged(
    relationships: DataFrame, vectors: DataFrame, membership: DataFrame, query: list[float], depth: int = 2, least: float = 0.7, k: int = 10, community_least: float = 0.3, max_subgraphs: int = 100
) -> dict[str, DataFrame]:
    """Five stages: communities, subgraphs, context, refinement and ranking, each as a table.

    Communities like the query are chosen; best-first subgraphs are taken among their nodes; the 50 nodes outside with most
    links to them are merged into the subgraphs that they touch; those with a mean similarity of ``least`` stay and are ranked.
    """
    chosen = cut(communities_for(vectors, membership, query, least=community_least))
    members = cut(membership.join(chosen, "community", "left_semi"))
    inside = relationships.join(members.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("dst")), "dst", "left_semi")
    own = vectors.join(members, "id", "left_semi")
    centers = community_center(inside, members).select("id")  # one for each of at most five communities
    order, egos = best_first(inside, own, [r["id"] for r in centers.collect()], query, max_subgraphs, depth)
    egos = cut(egos)
    context = cut(connected_outside(relationships, egos.select("id").distinct()))
    nodes = cut(expanded(egos.select(F.col("center").alias("subgraph"), "id"), context, relationships))
    rel = cut(relevance(nodes, vectors, query))
    kept = rel.filter(F.col("relevance") >= least)
    scores = kept.withColumn("seq", F.row_number().over(Window.orderBy(F.desc("relevance"), "subgraph")))  # at most max_subgraphs rows
    return {"communities": chosen, "subgraphs": egos, "nodes": nodes, "edges": ego_edges(relationships, egos, depth), "context": context, "relevance": rel, "ranked": ranked(nodes, scores, k)}


def query_graph(graph: PropertyGraph, vectors: DataFrame, membership: DataFrame, query: str, encode: Callable[[str], list[float]], cache: DataFrame | None = None, **stages) -> dict[str, object]:
    """A question answered by the graph: its vector from the cache (by md5) or the encoder, then ``staged``, then a confidence.

    Gives the stages' tables, ``hit`` (whether the vector was cached), ``cached`` (the row for the cache, where it wasn't)
    and ``confidence``, the mean of size and density of the subgraphs.
    """
    spark = vectors.sparkSession
    asked = spark.createDataFrame([(query,)], "text string").withColumn("id", F.md5("text"))
    held = asked.join(cache.select("id", "embedding"), "id").first() if cache is not None else None
    vector = [float(x) for x in (held["embedding"] if held else encode(query))]
    out: dict[str, object] = dict(staged(graph.relationships, vectors, membership, vector, **stages))
    size = out["nodes"].groupBy("subgraph").agg(F.count("*").alias("n_nodes"))
    a, b = (out["nodes"].select("subgraph", F.col("id").alias(c)) for c in ("src", "dst"))
    links = graph.relationships.select("src", "dst").join(a, "src").join(b, ["subgraph", "dst"]).groupBy("subgraph").agg(F.count("*").alias("n_edges"))
    sized = size.join(links, "subgraph", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0))).join(out["ranked"].select("subgraph"), "subgraph", "left_semi")
    out |= {"hit": held is not None, "confidence": subgraph_confidence(sized)}
    if held is None:
        out["cached"] = asked.select("id", F.lit(vector).cast("array<float>").alias("embedding"), F.current_timestamp().alias("created_at"))
    return out


def stage_rates(communities: Column, subgraphs: Column, expansion: Column, share: Column, final: Column) -> Column:
    """Success rates of the stages as a struct: limits over counts, capped at one."""
    one = lambda c: F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))
    return F.struct(one(F.try_divide(F.lit(5.0), communities)).alias("selection"), one(F.try_divide(F.lit(100.0), subgraphs)).alias("retrieval"), one(expansion / 1.5).alias("expansion"), one(share).alias("refinement"), one(final / 10.0).alias("ranking"))


def q_values(states: DataFrame, actions: DataFrame) -> DataFrame:
    """state, action, q: default scorer of a move, the cosine of both vectors; a trained model can stand in as a pandas UDF."""
    return states.join(actions, "state").select("state", "action", cosine(F.col("state_vector"), F.col("action_vector")).alias("q"))


def rewards(steps: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """state, next_state, reward: 1, plus 0.5 where the next node is linked to itself as the move's end, plus 0.3 where types differ; 0 if one is unknown."""
    loops = relationships.filter("src = dst").select(F.col("src").alias("next_state")).distinct().withColumn("loop", F.lit(True))
    linked = undirected(relationships.select("src", "dst")).select(F.col("src").alias("state"), F.col("dst").alias("next_state")).distinct().withColumn("near", F.lit(True))
    a, b = entities.select(F.col("id").alias("state"), F.col("type").alias("t1")), entities.select(F.col("id").alias("next_state"), F.col("type").alias("t2"))
    j = steps.join(a, "state", "left").join(b, "next_state", "left").join(linked, ["state", "next_state"], "left").join(loops, "next_state", "left")
    reward = 1.0 + F.when(F.col("near") & F.col("loop"), 0.5).otherwise(0.0) + F.when(F.col("t1") != F.col("t2"), 0.3).otherwise(0.0)
    return j.select("state", "next_state", F.when(F.col("t1").isNull() | F.col("t2").isNull(), 0.0).otherwise(reward).alias("reward"))
