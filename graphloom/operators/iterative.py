"""Graph algorithms in rounds.  Each round is a plan of joins and aggregates; lineage is cut in the shared folder."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import both_ways, degrees, triangles
from graphloom.session import cut


FLUSH = 1_000_000  # nodes that a task joins up before it hands them on


def contracted(edges: DataFrame) -> DataFrame:
    """a, b: for each partition of the edges, its nodes with the smallest that edges of the partition lead to; the same components from fewer edges."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, top(x)) for x in list(up)]
            found = [(x, r) for x, r in found if x != r]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], ids), pa.array([r for _, r in found], ids)], names=["a", "b"])

        ids = None
        for batch in batches:
            ids = batch.column(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > FLUSH:
                yield stars()
        if up:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id), by alternating large-star and small-star rounds.

    Each partition's edges are contracted first.  Every round links neighbours to the smallest id seen, so the rounds grow with
    the logarithm of the longest path, and no neighbourhood is ever collected.
    """

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first())

    e = cut(contracted(edges.filter("a <> b")).distinct())
    before = mark(e)
    while True:
        ways = both_ways(e)
        low = ways.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("m", "src").alias("m"))
        large = ways.join(low, "src").filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: each node's smaller neighbours, and itself, to the least of them.
        down = large.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(least, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("a"), F.col("m").alias("b")), F.struct(F.col("src").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        e = cut(small)
        after = mark(e)
        if before == after:
            break
        before = after
    stars = e.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def placed(rows: DataFrame, by: str) -> DataFrame:
    """Rows kept on disk where rounds look for them, so that a round only shuffles what changes; lost ones are made again.

    What changes is joined with a hash table of its partition, so that the rows aren't sorted in each round.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).persist(StorageLevel.DISK_ONLY)


def cut_as_planned(df: DataFrame) -> DataFrame:
    """``cut`` without planning again after each of many shuffles of like size, which would take longer than they do."""
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, together: int = 4) -> DataFrame:
    """id, rank on a simple undirected graph, uniform start; ends with the first round whose total change is below tolerance * n.

    ``together`` rounds are one plan, of a join and a sum each: a loop at each node carries its ranks before along,
    so that the changes of all of them are known at once.
    """
    ways = both_ways(cut(edges.select("a", "b")))
    deg = cut(ways.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")))
    n = deg.count()
    if not n:
        return deg.select("id", F.lit(0.0).alias("rank"))
    share = ways.join(deg.withColumnRenamed("id", "src"), "src").select("src", "dst", (1.0 / F.col("d")).alias("w"))
    out = placed(share.union(deg.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("w"))), "src")
    rank, done, last = deg.select("id", F.lit(1.0 / n).alias("r0")), 0, 0
    while done < rounds:
        steps = min(together, rounds - done)
        for i in range(1, steps + 1):
            kept = [F.max(F.when(F.col("w").isNull(), F.col(f"r{j}"))).alias(f"r{j}") for j in range(i)]
            # Every node of this graph has an edge, so each gets a sum and none dangles.
            given = out.join(rank.withColumnRenamed("id", "src").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col(f"r{i - 1}") * F.col("w")).alias("s"), *kept)
            rank = given.select("id", *[f"r{j}" for j in range(i)], ((1 - damping) / n + damping * F.col("s")).alias(f"r{i}"))
        rank = cut(rank)
        changes = rank.agg(*[F.sum(F.abs(F.col(f"r{i}") - F.col(f"r{i - 1}"))) for i in range(1, steps + 1)]).first()
        last = next((i for i in range(1, steps + 1) if changes[i - 1] < n * tolerance), 0)
        if last:
            break
        done, rank = done + steps, rank.select("id", F.col(f"r{steps}").alias("r0"))
    out.unpersist()
    return rank.select("id", F.col(f"r{last}").alias("rank"))


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, centrality of length one: power iteration on the adjacency matrix plus the identity.

    Every fifth round is compared with the fifth before; the iteration ends where the total change is below tolerance * n.
    """
    both = both_ways(cut(edges.select("a", "b")))
    # With a loop at each node, a round is one join and one sum.
    ways = placed(both.union(both.select("src", F.col("src").alias("dst")).distinct()), "src")
    x = ways.filter("src = dst").select(F.col("src").alias("id"), F.lit(1.0).alias("x"))
    n = x.count()
    last = None
    for i in range(1, rounds + 1):
        x = ways.join(x.withColumnRenamed("id", "src").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("x"))
        if i % 5 and i < rounds:
            continue
        top = cut(x)
        size = top.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        x = top.select("id", (F.col("x") / size).alias("x"))
        if last is not None and (x.join(last.withColumnRenamed("x", "was"), "id").agg(F.sum(F.abs(F.col("x") - F.col("was")))).first()[0] or 0.0) < n * tolerance:
            break
        last = x
    ways.unpersist()
    return x.select("id", F.col("x").alias("centrality"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """id, core: repeated h-index of the neighbours' values, from the degrees down to the fixpoint.

    Values of neighbours are counted before they are ranked, so a hub is a few rows, not its whole neighbourhood.
    """
    ways = cut(both_ways(edges))
    core = cut(ways.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("int").alias("core")))
    while True:
        seen = ways.join(core.select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").join(core.select(F.col("id").alias("src"), "core"), "src")
        counted = seen.groupBy("src", "core", F.least("c", "core").alias("c")).agg(F.count("*").alias("n"))
        ranked = counted.withColumn("to", F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("c"))))
        new = cut(ranked.groupBy(F.col("src").alias("id"), F.col("core").alias("old")).agg(F.max(F.least("c", "to")).cast("int").alias("core")))
        changed = new.filter("core <> old").limit(1).count()
        core = new.select("id", "core")
        if not changed:
            return core


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community: all nodes take the most frequent label around them at once, ties to the smallest; fixed rounds, deterministic."""
    ways = cut(both_ways(edges))
    label = ways.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for i in range(rounds):
        votes = ways.join(label.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        label = votes.groupBy(F.col("src").alias("id")).agg(F.min_by("community", F.struct((-F.col("n")).alias("n"), "community")).alias("community"))
        if i % 2 or i == rounds - 1:
            label = cut(label)
    return label


def ego_distances(edges: DataFrame, centers: DataFrame, depth: int) -> DataFrame:
    """center, id, dist of all nodes within ``depth`` steps of each center (column ``id``); a center without edges has no rows."""
    ways = cut(both_ways(edges))
    front = centers.select(F.col("id").alias("center"), "id").distinct().join(ways.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("center", "id", F.lit(0).alias("dist"))
    seen = front = cut(front)
    for d in range(1, depth + 1):
        step = front.join(ways.withColumnRenamed("src", "id"), "id").select("center", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, ["center", "id"], "left_anti").withColumn("dist", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def ego_edges(relationships: DataFrame, distances: DataFrame, depth: int) -> DataFrame:
    """center, src, dst, type: edges with an end nearer than ``depth``."""
    a, b = distances.select("center", F.col("id").alias("src"), F.col("dist").alias("ds")), distances.select("center", F.col("id").alias("dst"), F.col("dist").alias("dd"))
    return relationships.join(a, "src").join(b, ["center", "dst"]).filter(F.least("ds", "dd") <= depth - 1).select("center", "src", "dst", "type").distinct()


def all_distances(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """source, id, dist, sigma (number of shortest paths) from each source, breadth first."""
    ways = cut(both_ways(edges))
    start = ways.select(F.col("src").alias("id")).distinct() if sources is None else sources
    front = cut(start.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    levels = [front]
    seen = front
    while True:
        step = front.join(ways.withColumnRenamed("src", "id"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(len(levels)).alias("dist"), "sigma"))
        if not front.limit(1).count():
            return seen
        levels.append(front)
        seen = seen.unionByName(front)
        if len(levels) % 4 == 0:
            seen = cut(seen)


def path_lengths(distances: DataFrame) -> DataFrame:
    """avg_path_length over ordered pairs, and diameter."""
    return distances.filter("dist > 0").agg(F.avg("dist").alias("avg_path_length"), F.max("dist").alias("diameter"))


def betweenness(edges: DataFrame) -> DataFrame:
    """id, betweenness: exact, unweighted, normalised by (n - 1)(n - 2) over ordered pairs; dependencies go back level by level."""
    ways = cut(both_ways(edges))
    dist = cut(all_distances(edges))
    n = dist.filter("dist = 0").count()
    deepest = dist.agg(F.max("dist")).first()[0] or 0
    delta = None
    parts = []
    for d in range(deepest, 0, -1):
        w = dist.filter(F.col("dist") == d).select("source", F.col("id").alias("w"), F.col("sigma").alias("sw"))
        if delta is None:
            w = w.withColumn("delta", F.lit(0.0))
        else:
            w = w.join(delta.withColumnRenamed("id", "w"), ["source", "w"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        v = dist.filter(F.col("dist") == d - 1).select("source", F.col("id").alias("v"), F.col("sigma").alias("sv"))
        back = w.join(ways.select(F.col("src").alias("w"), F.col("dst").alias("v")), "w").join(v, ["source", "v"])
        delta = cut(back.groupBy("source", F.col("v").alias("id")).agg(F.sum(F.col("sv") / F.col("sw") * (1 + F.col("delta"))).alias("delta")))
        parts.append(delta.filter("source <> id"))
    nodes = dist.filter("dist = 0").select("id")
    if not parts:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(total.groupBy("id").agg(F.sum("delta").alias("b")), "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def clique_communities(edges: DataFrame) -> DataFrame:
    """community, id: unions of triangles that share an edge; a node may be in several."""
    t = cut(triangles(edges).withColumn("t", F.concat_ws("|", "x", "y", "z")))
    sides = t.select("t", F.explode(F.array(*[F.concat_ws("|", F.col(a), F.col(b)) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))])).alias("side"))
    first = sides.groupBy("side").agg(F.min("t").alias("m"))
    linked = sides.join(first, "side").filter("t <> m").select(F.col("t").alias("a"), F.col("m").alias("b")).distinct()
    groups = components(linked)
    tagged = t.join(groups.withColumnRenamed("id", "t"), "t", "left").withColumn("community", F.coalesce("component", "t"))
    return tagged.select("community", F.explode(F.array("x", "y", "z")).alias("id")).distinct()


def random_walks(edges: DataFrame, starts: DataFrame, steps: int = 20, seed: int = 42) -> DataFrame:
    """walk, step, id: seeded walks; the neighbour with the least hash of seed, walk, step and itself is taken."""
    ways = cut(both_ways(edges))
    at = starts.select(F.col("id").alias("walk"), F.lit(0).alias("step"), "id")
    out = at
    for s in range(1, steps + 1):
        moves = at.join(ways.withColumnRenamed("src", "id"), "id")
        at = moves.groupBy("walk").agg(F.min_by("dst", F.xxhash64(F.lit(seed), "walk", F.lit(s), "dst")).alias("id")).select("walk", F.lit(s).alias("step"), "id")
        if s % 4 == 0:
            at = cut(at)
        out = out.unionByName(at)
    return out


POWERS, MOST_POWERS = 6, 10  # products with the matrix between two orthonormalisations: in the first round, at most
APART = 1e5  # how far vectors may grow apart between two orthonormalisations


def leading_vectors(entries: DataFrame, k: int, shift: float = 0.0, rounds: int = 30, tolerance: float = 1e-4, seed: int = 42, definite: bool = False) -> tuple[DataFrame, list[float]]:
    """id, x0 ... (k columns) and the k eigenvalues of greatest size of a symmetric matrix plus ``shift`` times the identity.

    ``entries`` are src, dst, w, each in both orientations.  Orthogonal iteration: the matrix meets the vectors by a join,
    and only the k x k products of the vectors reach the driver.  Some start vectors more than wanted speed it up, and from the
    second round on the products are those of the Chebyshev polynomial that stays small where eigenvalues aren't wanted:
    up to the least found so far by size, or between 0 and it where no eigenvalue is negative (``definite``, with the shift).
    """
    ids = cut(entries.select(F.col("src").alias("id")).distinct())
    n = ids.count()
    same = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(float(shift)).alias("w"))
    loops = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("w"))  # carry a node's own values along
    m = placed((entries.select("src", "dst", "w").union(same) if shift else entries.select("src", "dst", "w")).union(loops), "src")
    cols = [f"x{i}" for i in range(min(max(k + 2, 8), n))]

    def product(x: DataFrame, to: str = "x") -> DataFrame:
        sums = [F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in cols]
        moved = m.join(x.withColumnRenamed("id", "src").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(*sums)
        return moved.select("id", *[F.col(f"s{c}").alias(to + c[1:]) for c in cols])

    def filtered(x: DataFrame, low: float, high: float, powers: int) -> DataFrame:
        """Chebyshev polynomial on low ... high, up to a factor; each term is a join and a sum.

        The interval is data, not part of the plan, so that code is compiled in one round only.
        """
        x = x.select("*", F.lit((high + low) / 2).alias("mid"), F.lit(((high - low) / 4) ** 2).alias("q"), *[F.lit(0.0).alias(f"b{c}") for c in cols])
        for step in range(powers):
            moved = m.join(x.withColumnRenamed("id", "src").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id"))
            sums = [F.expr(f"sum(if(w is null, -{c} * mid - b{c} * q, {c} * w)) AS s{c}") for c in cols]
            own = [F.expr(f"max(if(w is null, {c}, null)) * {1 if step else 2}D AS b{c}") for c in cols]
            x = moved.agg(*sums, *own, F.expr("max(mid) AS mid"), F.expr("max(q) AS q")).selectExpr("id", "mid", "q", *[f"s{c} AS {c}" for c in cols], *[f"b{c}" for c in cols])
        return x.select("id", *cols)

    def whitening(g: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(g)
        return vectors / np.sqrt(np.maximum(values, values.max() * 1e-13))

    x = ids.select("id", *[(F.xxhash64(F.lit(seed), F.lit(c), "id") / float(2**63)).alias(c) for c in cols])
    before = None
    for _ in range(rounds):
        edge = 0.0 if before is None else float(np.abs(before).min())
        low = 0.0 if definite else -edge
        if before is not None and edge > np.abs(before).max() * 1e-6:
            reach = (np.abs(before).max() - (edge + low) / 2) / ((edge - low) / 2)
            powers = int(np.clip(np.log(2 * APART) / max(np.arccosh(max(reach, 1.0)), 1e-9), 2, MOST_POWERS))
            x = filtered(x, low, edge, powers)
        else:
            for _ in range(POWERS):
                x = product(x)
        x = cut_as_planned(x)
        basis = whitening(products(x, cols, cols))
        both = cut(product(x, "y").join(x, "id"))
        # The matrix seen from the basis, and the best vectors that it holds.
        values, turn = np.linalg.eigh(basis.T @ products(both, cols, [f"y{c[1:]}" for c in cols]) @ basis)
        order = np.argsort(-np.abs(values))
        values, x = values[order], combined(both.select("id", *cols), cols, basis @ turn[:, order])
        if before is not None and np.abs(values[:k] - before[:k]).max() <= tolerance * max(1.0, np.abs(values).max()):
            break
        before = values
    x = cut(x.select("id", *cols[:k]))
    m.unpersist()
    return x, [float(v) - shift for v in values[:k]]


def as_matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) if batch.num_rows else np.zeros((0, len(names)))


def products(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Matrix of the sums of products of each left with each right column; a matrix a partition reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((len(left), len(right)))
        for b in batches:
            g += as_matrix(b, left).T @ as_matrix(b, right)
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

    parts = rows.select(*dict.fromkeys([*left, *right])).mapInArrow(run, "g binary").collect()
    return sum((np.frombuffer(r["g"]).reshape(len(left), len(right)) for r in parts), np.zeros((len(left), len(right))))


def combined(rows: DataFrame, cols: list[str], by: np.ndarray) -> DataFrame:
    """id and the combinations of the columns that the columns of a matrix name."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = as_matrix(b, cols) @ by
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(y[:, j]) for j in range(y.shape[1]))], names=["id", *cols])

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in cols))


def estimate_clusters(values: list[float], nodes: int, faithful: bool = False) -> int:
    """Number of clusters by the largest drop between eigenvalues by size (``faithful``: the smallest), within 2 and the root of the nodes."""
    drops = np.diff(np.sort(np.abs(values))[::-1])
    elbow = int(drops.argmax() if faithful else drops.argmin()) + 1 if len(drops) else 2
    return max(2, min(elbow, math.isqrt(nodes)))


def nearest_centres(x: DataFrame, k: int, rounds: int = 50, seed: int = 42) -> DataFrame:
    """id, community: k-means on the columns of ``x`` besides id, from the farthest points.

    The driver holds k rows of centres, and gets k rows of sums from each partition.
    """
    cols = [c for c in x.columns if c != "id"]
    kind = x.schema["id"].dataType.simpleString()
    point = F.array(*cols)
    centres = np.array([x.agg(F.min_by(point, F.struct(F.xxhash64(F.lit(seed), "id"), "id"))).first()[0]])

    def away(y: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((y[:, None] - centres[None]) ** 2).sum(axis=2)

    while len(centres) < k:

        def far(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.round(away(as_matrix(b, cols), centres).min(axis=1), 9))], names=["id", "far"])

        best = x.mapInArrow(far, f"id {kind}, far double").agg(F.max_by("id", F.struct("far", "id")).alias("id"))
        centres = np.vstack([centres, x.join(F.broadcast(best), "id", "left_semi").select(point.alias("p")).first()["p"]])  # one row
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            held = np.zeros((len(centres), len(cols) + 1))
            for b in batches:
                y = as_matrix(b, cols)
                np.add.at(held, away(y, centres).argmin(axis=1), np.hstack([y, np.ones((len(y), 1))]))
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["g"])

        total = sum(np.frombuffer(r["g"]).reshape(len(centres), -1) for r in x.mapInArrow(sums, "g binary").collect())
        moved = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centres)
        if np.allclose(moved, centres):
            break
        centres = moved

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(away(as_matrix(b, cols), centres).argmin(axis=1), pa.int32())], names=["id", "community"])

    return x.mapInArrow(own, f"id {kind}, community int")


def spectral_communities(edges: DataFrame, weight: str | None = None, n_clusters: int | None = None, faithful: bool = False, most_clusters: int = 12, least_size: int = 1) -> DataFrame:
    """id, community by the leading eigenvectors of the normalised adjacency matrix and k-means, at every size.

    Both are rounds of joins and aggregates (see ``leading_vectors``).  Without ``n_clusters``, their number is where
    the leading most_clusters + 1 eigenvalues of the adjacency matrix drop most, at most the root of n (``faithful``: where they drop
    least).  Communities of fewer than ``least_size`` nodes are left out.  A graph of fewer than two nodes has no rows.
    """
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    ways = cut(edges.select(F.explode(ends).alias("_e"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).select("_e.src", "_e.dst", "w"))
    total = ways.groupBy("src").agg(F.sum("w").alias("d"))
    n = total.count()
    if n < 2:
        return total.select(F.col("src").alias("id"), F.lit(0).alias("community")).limit(0)
    k = n_clusters or estimate_clusters(leading_vectors(ways, min(most_clusters + 1, n))[1], n, faithful)
    k = min(k, n)
    total = cut(total)
    scaled = ways.join(total, "src").join(total.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.greatest(F.col("d") * F.col("e"), F.lit(1e-12)))).alias("w"))
    x, _ = leading_vectors(scaled, k, shift=1.0, definite=weight is None)
    cols = [c for c in x.columns if c != "id"]
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    found = nearest_centres(cut(x.select("id", *[(F.col(c) / F.greatest(length, F.lit(1e-12))).alias(c) for c in cols])), k)
    if least_size <= 1:
        return found
    return found.join(found.groupBy("community").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_size).select("community"), "community", "left_semi").select("id", "community")


def node_metrics(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id with degree_centrality, betweenness, centrality, rank, clustering, core: computed on the whole graph, then restricted."""
    from graphloom.operators.graph import clustering, degree_centrality

    edges = cut(edges)
    out = degree_centrality(edges)
    for part in (betweenness(edges), eigenvector(edges), pagerank(edges), clustering(edges), core_numbers(edges)):
        out = out.join(part, "id")
    return out if ids is None else out.join(ids.select("id"), "id", "left_semi")


def graph_metrics(edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density, avg_clustering, assortativity, n_components, largest, avg_path_length and diameter of the largest component."""
    from graphloom.operators.graph import assortativity, clustering, density

    edges = cut(edges)
    comp = cut(components(edges))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    shape = sizes.agg(F.count("*").alias("n_components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.max_by("component", F.struct("n", "component")).alias("_top"))
    inner = comp.join(F.broadcast(shape.select(F.col("_top").alias("component"))), "component", "left_semi").select("id")  # one row
    main = edges.join(inner.withColumnRenamed("id", "a"), "a", "left_semi")
    out = density(edges)
    for part in (clustering(edges).agg(F.avg("clustering").alias("avg_clustering")), assortativity(edges), shape.drop("_top"), path_lengths(all_distances(main))):
        out = out.join(part, F.lit(True))  # one row each
    return out


def community_metrics(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """community, size, density, avg_clustering, diameter, hubs, on each community's own edges.

    ``size`` counts the members, the diameter is infinite where the community falls apart, and ``hubs`` are the three
    members with the most links in it, ties to the smaller id.
    """
    a, b = membership.select(F.col("id").alias("a"), "community"), membership.select(F.col("id").alias("b"), "community")
    inner = cut(edges.join(a, "a").join(b, ["b", "community"]).select("community", "a", "b"))
    size = membership.groupBy("community").agg(F.count("*").alias("size"))
    # Ids are tagged with their community, so that one pass over the union of all induced graphs serves them all.
    tag = lambda c: F.struct(F.col("community"), F.col(c).alias("id"))
    tagged = cut(inner.select(tag("a").alias("a"), tag("b").alias("b")))
    nodes = cut(degrees(tagged).select("id.community", "id.id", "degree"))
    first = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    top = nodes.withColumn("_k", F.row_number().over(first)).filter("_k <= 3").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id"))), lambda x: x["id"]).alias("hubs"))  # three each
    from graphloom.operators.graph import clustering

    local = clustering(tagged).groupBy("id.community").agg(F.avg("clustering").alias("avg_clustering"))
    shape = nodes.groupBy("community").agg(F.count("*").alias("n"), (F.sum("degree") / 2).alias("m"))
    far = all_distances(tagged).groupBy("id.community").agg(F.max("dist").alias("far"), F.count("*").alias("reached"))
    j = size.join(shape, "community", "left").join(local, "community", "left").join(far, "community", "left").join(top, "community", "left")
    whole = F.col("reached") == F.col("n") * F.col("n")
    return j.select(
        "community", "size", F.coalesce(F.try_divide(2.0 * F.col("m"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("density"),
        F.coalesce("avg_clustering", F.lit(0.0)).alias("avg_clustering"), F.when(whole, F.col("far").cast("double")).otherwise(F.lit(float("inf"))).alias("diameter"), "hubs",
    )


def patterns(edges: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Hubs, bridges, dense groups and motifs."""
    from graphloom.operators.graph import degree_centrality, motifs

    b = cut(betweenness(edges))
    top = b.agg(F.percentile("betweenness", F.lit(0.9)).alias("p"))
    return {
        "hubs": degree_centrality(edges).orderBy(F.desc("degree_centrality"), "id").limit(k),
        "bridges": b.join(F.broadcast(top), F.lit(True)).filter("betweenness >= p").select("id", "betweenness"),  # one row
        "dense": clique_communities(edges),
        "motifs": motifs(edges),
    }


def random_rows(df: DataFrame, k: int = 1, seed: int = 42) -> DataFrame:
    """A seeded sample of k rows, as for replaying experiences."""
    return df.orderBy(F.rand(seed)).limit(k)


def experiences(edges: DataFrame, entities: DataFrame, relationships: DataFrame, steps: int = 20) -> DataFrame:
    """state, action, reward, next_state, done: the moves of a seeded walk from every node with their rewards."""
    from graphloom.operators.retrieval import rewards

    walks = cut(random_walks(edges, degrees(edges).select("id"), steps))
    moves = walks.join(walks.select("walk", (F.col("step") - 1).alias("step"), F.col("id").alias("next_state")), ["walk", "step"]).select(F.col("id").alias("state"), "next_state", (F.col("step") == steps - 1).alias("done"))
    paid = rewards(moves.select("state", "next_state").distinct(), entities, relationships)
    return moves.join(paid, ["state", "next_state"]).select("state", F.col("next_state").alias("action"), "reward", "next_state", "done")
