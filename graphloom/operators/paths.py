"""Paths: bounded, simple, least-cost and diverse.  Frontiers grow by joins, one hop a round."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from graphloom.functions.text import jaccard
from graphloom.functions.vector import cosine, literal
from graphloom.session import cut

# ---- Fixed values: nodes of a path, paths, weight of the semantic cost, least distance of paths ----
MAX_NODES, MAX_PATHS, SEMANTIC, DIVERSE = 6, 5, 0.4, 0.3
# ---- End of fixed values ----
SMALL_ROWS = 500_000  # ids or short paths that go to every task at most; more are joined by a shuffle


def semantic_cost(query: Column, src: Column, dst: Column, rel: Column) -> Column:
    """1 minus the mean cosine of the query with both ends and the relation; missing vectors count as cosine 0."""
    parts = [F.coalesce(cosine(query, v), F.lit(0.0)) for v in (src, dst, rel)]
    return 1 - (parts[0] + parts[1] + parts[2]) / 3


def edge_cost(confidence: Column, semantic: Column | None = None) -> Column:
    c = 1 + (1 - SEMANTIC) * (1 - F.coalesce(confidence, F.lit(0.0)))
    return c if semantic is None else c + SEMANTIC * semantic


def path_cost(distance: Column, semantic: Column, confidence: Column) -> Column:
    """Cost record's total: hops, mean semantic cost, mean confidence."""
    return distance + SEMANTIC * semantic + (1 - SEMANTIC) * (1 - confidence)


def costed(relationships: DataFrame, vectors: DataFrame | None = None, query: list[float] | None = None) -> DataFrame:
    """src, dst, type, confidence, semantic, cost in both orientations, the cheapest of parallel edges; integer micro-units keep sums exact.

    With ``vectors`` (id, embedding) and a query's vector, edges cost more the less their ends are like the query; relations
    have no vector of their own.  Without them ``semantic`` is 0.
    """
    rows = relationships.select("src", "dst", "type", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    # A union, as conditions on its ends are passed on to the relationships' own tables.
    e = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence")).filter("src <> dst")
    if vectors is not None and query is not None:
        like = vectors.select("id", cosine(F.col("embedding"), literal(query)).alias("_s"))
        e = e.join(like.select(F.col("id").alias("src"), F.col("_s").alias("_a")), "src", "left").join(like.select(F.col("id").alias("dst"), F.col("_s").alias("_b")), "dst", "left")
        e = e.withColumn("semantic", 1 - (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 3)
        cost = F.round(edge_cost(F.col("confidence"), F.col("semantic")) * 1_000_000).cast("long")
    else:
        e = e.withColumn("semantic", F.lit(0.0))
        cost = F.round(edge_cost(F.col("confidence")) * 1_000_000).cast("long")
    best = F.min_by(F.struct("type", "confidence", "semantic"), F.struct(cost.alias("c"), "type"))
    return e.groupBy("src", "dst").agg(best.alias("e"), F.min(cost).alias("cost")).select("src", "dst", "e.type", "e.confidence", "e.semantic", "cost")


def path_records(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths (column ``nodes``) with their relationships (src, type, dst), distance in edges, mean semantic cost, mean confidence, and the record's total.

    ``edges`` comes from ``costed``.  Equal paths count once.
    """
    steps = paths.select("nodes").distinct().filter(F.size("nodes") > 1).select("nodes", F.posexplode(F.expr("transform(sequence(0, size(nodes) - 2), i -> struct(nodes[i] AS src, nodes[i + 1] AS dst))")).alias("_at", "_e"))
    each = steps.select("nodes", "_at", "_e.src", "_e.dst").join(edges, ["src", "dst"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "src", "type", "dst"))), lambda x: F.struct(x["src"].alias("src"), x["type"].alias("type"), x["dst"].alias("dst")))  # a path's own edges
    out = each.groupBy("nodes").agg(ordered.alias("relationships"), F.count("*").alias("distance"), F.avg("semantic").alias("semantic"), F.avg("confidence").alias("confidence"))
    return out.withColumn("total", path_cost(F.col("distance"), F.col("semantic"), F.col("confidence")))


def cheapest_paths(edges: DataFrame, starts: DataFrame, max_nodes: int = MAX_NODES, targets: DataFrame | None = None) -> DataFrame:
    """start, id, cost, hops, nodes: the cheapest path of at most ``max_nodes`` nodes from each start to each node, or to ``targets`` (ids).

    ``edges`` comes from ``costed``.  First only costs go out, a hop a round, and only where they are below those of fewer hops;
    then the nodes of the wanted paths are found backwards.  Ties go to fewer hops, then to the smaller node at each step
    back.  A start has no path to itself.
    """
    edges = cut(edges.select("src", "dst", "cost"))
    if targets is not None:
        # An edge is only of use while a target is within the hops that are left at its end.
        reach = hops_to(edges, targets, max_nodes - 2)
        edges = cut(edges.join(reach.select(F.col("id").alias("dst"), "togo"), "dst").select("src", "dst", "cost", "togo"))
    levels = [starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("cost"))]
    for hop in range(1, max_nodes):
        open_ = edges if targets is None else edges.filter(F.col("togo") < max_nodes - hop)
        step = levels[-1].join(open_.select(F.col("src").alias("id"), "dst", F.col("cost").alias("c")), "id")
        least = step.groupBy("start", F.col("dst").alias("id")).agg(F.min(F.col("cost") + F.col("c")).alias("cost")).filter("start <> id")
        if len(levels) > 1:
            known = levels[1]
            for x in levels[2:]:
                known = known.unionByName(x)
            known = known.groupBy("start", "id").agg(F.min("cost").alias("known"))
            least = least.join(known, ["start", "id"], "left").filter(F.col("known").isNull() | (F.col("cost") < F.col("known"))).drop("known")
        levels.append(cut(least))
    every = None
    for hops, x in enumerate(levels[1:], 1):
        if targets is not None:
            x = x.join(targets.select("id"), "id", "left_semi")
        rows = x.select("start", "id", "cost", F.lit(hops).alias("hops"))
        every = rows if every is None else every.unionByName(rows)
    best = every.groupBy("start", "id").agg(F.min(F.struct("cost", "hops")).alias("b")).select("start", "id", "b.cost", "b.hops")
    walk = cut(best.select("*", F.col("id").alias("at"), F.col("cost").alias("left"), F.array("id").alias("nodes")))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("before"), F.col("cost").alias("c"))
    done = walk.filter("false")
    for hops in range(max_nodes - 1, 0, -1):
        now, later = walk.filter(F.col("hops") == hops), walk.filter(F.col("hops") < hops)
        prior = levels[hops - 1].select("start", F.col("id").alias("before"), F.col("cost").alias("pc"))
        going = now.unionByName(done)
        step = going.join(back, "at").join(prior, ["start", "before"]).filter(F.col("left") - F.col("c") == F.col("pc"))
        one = step.groupBy("start", "id", "cost", "hops").agg(F.min(F.struct("before", "pc", "nodes")).alias("m"))
        done = cut(one.select("start", "id", "cost", "hops", F.col("m.before").alias("at"), F.col("m.pc").alias("left"), F.concat(F.array("m.before"), "m.nodes").alias("nodes")))
        walk = later
    return done.select("start", "id", "cost", "hops", "nodes")


def hops_to(edges: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """id, togo: nodes from which one of the targets is at most ``most`` edges away, with the least number of edges."""
    found = front = cut(targets.select("id").distinct().withColumn("togo", F.lit(0)))
    for d in range(1, most + 1):
        step = front.select(F.col("id").alias("dst")).join(edges, "dst").select(F.col("src").alias("id")).distinct()
        front = cut(step.join(found.select("id"), "id", "left_anti").withColumn("togo", F.lit(d)))
        found = found.unionByName(front)
    return found


def stepped(edges: DataFrame, front: DataFrame, rows: int, near: str = "src", far: str = "dst") -> DataFrame:
    """Rows of ``front`` (id and more; ``rows`` of them) with each edge at their id: its other end ``to``, its cost ``c``.

    Few rows go to the edges before parallel ones are put together, so that no others are shuffled.
    """
    step = edges.select(F.col(near).alias("id"), F.col(far).alias("to"), F.col("cost").alias("c"))
    if rows > SMALL_ROWS:
        return step.join(front, "id")
    return step.join(F.broadcast(front.select("id").distinct()), "id", "left_semi").join(F.broadcast(front), "id")


def simple_paths(edges: DataFrame, start: str, end: str, max_edges: int = 5) -> DataFrame:
    """nodes, cost, hops of every simple path between two nodes.

    Walks grow from both ends, always the fewer ones, and meet: ``edges`` are read a step at a time, and only those at the
    walks' ends are looked at.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    form = f"id {kind}, nodes array<{kind}>, cost bigint"
    ahead, back = spark.createDataFrame([(start, [start], 0)], form), spark.createDataFrame([(end, [end], 0)], form)
    if start == end or max_edges < 1:
        return ahead.select("nodes", "cost", F.lit(0).alias("hops")).limit(0)
    sizes, hops, done, backs = [1, 1], [0, 0], [], []
    for left in range(max_edges - 1, -1, -1):
        if not min(sizes):  # no walk goes on from one of the ends
            break
        forth = sizes[0] <= sizes[1]
        if forth:
            step = stepped(edges, ahead, sizes[0]).filter(~F.array_contains("nodes", F.col("to")))
            walk = step.select(F.col("to").alias("id"), F.concat("nodes", F.array("to")).alias("nodes"), (F.col("cost") + F.col("c")).alias("cost"))
        else:
            step = stepped(edges, back, sizes[1], "dst", "src").filter(~F.array_contains("nodes", F.col("to")) & (F.col("to") != start))
            walk = step.select(F.col("to").alias("id"), F.concat(F.array("to"), "nodes").alias("nodes"), (F.col("cost") + F.col("c")).alias("cost"))
        if left:  # the last step, mostly the largest, isn't kept
            walk = cut(walk)
        side = 0 if forth else 1
        hops[side] += 1
        if forth:
            done.append(walk.filter(F.col("id") == end).select("nodes", "cost", F.lit(hops[0]).alias("hops")))
            ahead = walk.filter(F.col("id") != end)
        else:
            back = walk
            backs.append(walk)
        if left:
            sizes[side] = (ahead if forth else back).count()
    # A longer path is a walk ahead of just so many edges and a walk back.
    for length, walk in enumerate(backs, 1):
        both = ahead.select("id", F.col("nodes").alias("_a"), F.col("cost").alias("_c")).join(walk.select("id", F.col("nodes").alias("_b"), F.col("cost").alias("_d")), "id")
        both = both.filter(F.size(F.array_intersect("_a", "_b")) == 1)
        done.append(both.select(F.concat("_a", F.slice("_b", 2, length)).alias("nodes"), (F.col("_c") + F.col("_d")).alias("cost"), F.lit(hops[0] + length).alias("hops")))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return every


def diverse_paths(paths: DataFrame, most: int = MAX_PATHS, least: float = DIVERSE) -> DataFrame:
    """place, nodes, cost, penalty: the cheapest path, then each time the one that is cheapest with its penalty among those far enough from all before.

    The distance of two paths is one minus the Jaccard similarity of their nodes; the penalty is (1 - distance) * least.
    """
    paths = paths.persist(StorageLevel.DISK_ONLY)  # in compressed columns; a shared file would hold each row as it is
    spark, chosen, rows = paths.sparkSession, [], []
    for place in range(1, most + 1):  # at most five rows reach the driver
        far = F.lit(1.0)
        for nodes in chosen:
            far = F.least(far, 1 - jaccard(F.col("nodes"), F.array(*map(F.lit, nodes))))
        ranked = paths.withColumn("_d", far).filter((F.col("_d") >= least) if chosen else F.lit(True)).withColumn("penalty", (1 - F.col("_d")) * least if chosen else F.lit(0.0))
        best = ranked.agg(F.min(F.struct((F.col("cost") + F.col("penalty") * 1_000_000).alias("t"), "hops", "nodes", "cost", "penalty")).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append(best["nodes"])
        rows.append((place, best["nodes"], best["cost"], best["penalty"]))
    paths.unpersist()
    kind = paths.schema["nodes"].dataType.simpleString()
    return spark.createDataFrame(rows, f"place int, nodes {kind}, cost bigint, penalty double")


def nearest_target(edges: DataFrame, start: str, targets: list[str], max_nodes: int = MAX_NODES) -> Row | None:
    """cost, hops, nodes, id of the cheapest path to any of the targets, as ``cheapest_paths`` has it; None where there is none.

    Least costs go out from the start (with the nodes so far, last first) and from the targets, always from the fewer nodes,
    until no longer path can be as cheap; no cost may be negative.  Where the best path meets the costs from the targets, it
    goes on to them along those nodes alone whose costs add up to the least.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    aheads = [spark.createDataFrame([(start, 0, [start])], f"id {kind}, cost bigint, back array<{kind}>")]
    backs = [spark.createDataFrame([(t, 0) for t in targets], f"id {kind}, togo bigint")]
    sizes, lows, best = [1, len(targets)], [0, 0], None

    def onward(front: DataFrame, rows: int) -> DataFrame:
        step = stepped(edges, front, rows).filter(F.col("to") != start)
        least = step.groupBy("to").agg(F.min(F.struct((F.col("cost") + F.col("c")).alias("cost"), "back")).alias("m"))
        return least.select(F.col("to").alias("id"), "m.cost", F.concat(F.array("to"), "m.back").alias("back"))

    def met(a: int, b: int) -> tuple[int, int] | None:
        low = aheads[a].join(backs[b], "id").agg(F.min(F.col("cost") + F.col("togo"))).first()[0]
        return None if low is None else (low, a + b)

    for _ in range(max_nodes - 1):
        if sizes[0] <= sizes[1]:
            x = cut(onward(aheads[-1], sizes[0]))
            aheads.append(x)
            side, cost = 0, "cost"
        else:
            step = stepped(edges, backs[-1], sizes[1], "dst", "src").filter(~F.col("to").isin(*targets))
            x = cut(step.groupBy(F.col("to").alias("id")).agg(F.min(F.col("togo") + F.col("c")).alias("togo")))
            backs.append(x)
            side, cost = 1, "togo"
        sizes[side], lows[side] = x.agg(F.count("*"), F.min(cost)).first()
        if not sizes[side]:
            break
        best = min((m for m in (best, met(len(aheads) - 1, len(backs) - 1)) if m), default=None)
        if best and best[0] <= sum(lows):
            break
    if best is None:
        return None
    total, hops = best
    at = min(hops, len(aheads) - 1)
    while hops - at >= len(backs):  # no costs came that far from the targets
        at += 1
    front = aheads[at].join(backs[hops - at], "id").filter(F.col("cost") + F.col("togo") == total).select("id", "cost", "back")
    for togo in range(hops - at - 1, -1, -1):
        front = cut(front)
        front = onward(front, front.count()).join(backs[togo], "id").filter(F.col("cost") + F.col("togo") == total).select("id", "cost", "back")
    return front.agg(F.min(F.struct("cost", F.lit(hops).alias("hops"), F.reverse("back").alias("nodes"), "id")).alias("b")).first()["b"]


def multi_target_paths(edges: DataFrame, start: str, targets: list[str], most: int = MAX_PATHS) -> DataFrame:
    """place, id, nodes, cost: repeatedly the cheapest remaining target from the same start, avoiding nodes used before."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    left, used, rows = [t for t in targets if t != start], set(), []
    while left and len(rows) < most:
        open_ = edges.filter(~F.col("src").isin(*used) & ~F.col("dst").isin(*used)) if used else edges
        best = nearest_target(open_, start, left)
        if best is None:
            break
        rows.append((len(rows) + 1, best["id"], best["nodes"], best["cost"]))
        used |= set(best["nodes"]) - {start}
        left = [t for t in left if t not in used]
    return spark.createDataFrame(rows, f"place int, id {kind}, nodes array<{kind}>, cost bigint")


def connecting_paths(edges: DataFrame, nodes: list[str], first: str) -> DataFrame:
    """place, start, id, nodes, cost: a stated set of nodes is connected, always by the cheapest path from it to a node not yet reached."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    ids = spark.createDataFrame([(n,) for n in nodes], f"id {kind}")
    links = {(r["start"], r["id"]): r for r in cheapest_paths(edges, ids, targets=ids).collect()}  # pairs of the stated nodes
    reached, rows = {first}, []
    while True:
        open_ = [r for (a, b), r in links.items() if a in reached and b not in reached]
        if not open_:
            break
        best = min(open_, key=lambda r: (r["cost"], r["hops"], r["nodes"]))
        reached.add(best["id"])
        rows.append((len(rows) + 1, best["start"], best["id"], best["nodes"], best["cost"]))
    return spark.createDataFrame(rows, f"place int, start {kind}, id {kind}, nodes array<{kind}>, cost bigint")


def within_two_hops(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row, reached: whether ``b`` is within two steps of ``a``."""
    near = edges.filter(F.col("src") == a).select("dst")
    two = near.join(edges.withColumnRenamed("dst", "end"), near["dst"] == edges["src"]).filter(F.col("end") == b).select("end")
    return near.filter(F.col("dst") == b).select("dst").unionAll(two).agg((F.count("*") > 0).alias("reached"))


def remaining_cost(x1: Column, y1: Column, x2: Column, y2: Column, near: Column, max_nodes: int = MAX_NODES) -> Column:
    """Euclidean distance where all coordinates are known, else 2 within two hops, else half of the longest path."""
    known = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(known, F.hypot(x1 - x2, y1 - y2)).when(near, 2.0).otherwise(max_nodes / 2)
