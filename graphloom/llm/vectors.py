"""The k most similar vectors of every vector, by low-dimensional stable projections.

Vectors of length one are projected with a Gaussian matrix: the squared projected distance of two of
them, divided by their true one, is chi-square distributed.  The projections are indexed by a kd-tree,
fitted on a bounded sample and filled with all rows; its leaves are blocks.  A query takes the cells
of a block in the order of their projected distance and verifies their vectors, until the test holds: a
neighbour nearer than its k-th so far would, with the wanted probability, have a projected distance below
that of any cell left.  The same test says which other blocks a query must visit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

WIDTH, PROJECTED, SEED = 64, 8, 20240717
SAMPLE = 100_000  # rows that the tree of blocks is fitted on, and at most twice as many
PER_LEAF = 8  # rows of the sample that a leaf needs at least
BLOCK, CELL = 32_768, 512  # rows of a block and of a cell inside it
CHUNK = 65_536  # queries that visit a block at once
CONFIDENCE = 0.9  # of the stopping test; what it costs in recall was measured (README)


def chi_square(confidence: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 10.0 * m + 200
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < confidence else (low, mid)
    return high


def projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((WIDTH, PROJECTED)).astype(np.float32)


def unit_rows(embeddings: list) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and their directions."""
    at = [i for i, e in enumerate(embeddings) if e is not None and len(e) == WIDTH and None not in e]
    x = np.array([embeddings[i] for i in at], np.float64).reshape(-1, WIDTH)
    top = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
    good = np.isfinite(top) & (top > 0)
    x = x[good] / top[good, None]
    return np.array(at, np.int64)[good], (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = [np.frombuffer(p.buffers()[2], np.float32)[p.offset * width : (p.offset + len(p)) * width].reshape(-1, width) for p in parts if len(p)]
    return np.concatenate(out) if out else np.zeros((0, width), np.float32)


class BlockTree:
    """Complete kd-tree over projections: the split dimension and value of each inner node."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth, np.float32)
        groups = {1: points}
        for node in range(1, 1 << depth):
            own = groups.pop(node)
            if len(own):
                self.dim[node] = d = int(own.var(axis=0).argmax())
                self.at[node] = np.median(own[:, d])
            right = own[:, self.dim[node]] > self.at[node]
            groups[2 * node], groups[2 * node + 1] = own[~right], own[right]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.at[node])
        return node - (1 << self.depth)


def cells(points: np.ndarray) -> list[np.ndarray]:
    """Rows of a block in cells of at most CELL rows, by kd-tree splits at the median."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= CELL:
            done.append(rows)
            continue
        order = rows[np.argsort(points[rows, points[rows].var(axis=0).argmax()], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return [r for r in done if len(r)]


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)), np.float32)
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d]))
        out += gap * gap
    return out


def search(u: np.ndarray, p: np.ndarray, r2: np.ndarray, names: np.ndarray, du: np.ndarray, dp: np.ndarray, dnames: np.ndarray, k: int, chi: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarity and row of the k best of a block for each query; -2 and -1 where there are fewer.

    ``r2`` is the squared true distance that still matters; a query's own name is not its neighbour.
    """
    best, who = np.full((len(u), k), -2, np.float32), np.full((len(u), k), -1, np.int64)
    parts = cells(dp)
    if not parts or not len(u):
        return best, who
    low, high = np.array([dp[c].min(axis=0) for c in parts]), np.array([dp[c].max(axis=0) for c in parts])
    for start in range(0, len(u), 8192):
        q = np.arange(start, min(len(u), start + 8192))
        away = box_distance(p[q], low, high)
        order = np.argsort(away, axis=1, kind="stable")
        away = np.take_along_axis(away, order, axis=1)
        for turn in range(len(parts)):
            radius = np.minimum(r2[q], 2 - 2 * best[q, k - 1])
            going = np.flatnonzero(away[:, turn] <= radius * chi + 1e-6)
            if not len(going):
                break
            cell = order[going, turn]
            by = np.argsort(cell, kind="stable")
            going, cell = going[by], cell[by]
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                rows, data = q[going[a:b]], parts[cell[a]]
                s = u[rows] @ du[data].T
                hit = s.max(axis=1) > best[rows, k - 1]
                if not hit.any():
                    continue
                rows, s = rows[hit], s[hit]
                s[names[rows][:, None] == dnames[data][None, :]] = -2
                take = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                both = np.concatenate([best[rows], np.take_along_axis(s, take, axis=1)], axis=1)
                ids = np.concatenate([who[rows], data[take]], axis=1)
                first = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best[rows], who[rows] = np.take_along_axis(both, first, axis=1), np.take_along_axis(ids, first, axis=1)
    return best, who


def project(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """key, u and p (direction and projection as bytes) of every usable vector; each key once."""
    a = projection()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, u = unit_rows(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), binary(u), binary(u @ a)], names=["id", "u", "p"])

    rows = df.filter(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    return rows.mapInArrow(run, f"id {kind}, u binary, p binary").groupBy("id").agg(F.min(F.struct("u", "p")).alias("_v")).select("id", "_v.u", "_v.p")


def nearest(df: DataFrame, key: str = "id", embedding: str = "embedding", k: int = 5, least: float | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """id, other, similarity, place: the k most similar other vectors of every usable vector.

    Usable are vectors of 64 finite values that aren't all zero; similarity is the cosine.  With ``least``
    only neighbours of at least that similarity are wanted.  Repeated keys count once, and other columns are
    ignored.  Vectors that are equal are neighbours of one another; ties in similarity go to the smaller key.
    A collection of one vector, or none, gives no row.  ``confidence`` is that of the stopping test: a neighbour
    is missed with at most that much less than certainty, and the fewer cells are verified the lower it is.
    """
    chi = chi_square(confidence, PROJECTED)
    farthest = 4.0 if least is None else max(0.0, 2 - 2 * least) + 1e-5
    kind = df.schema[key].dataType.simpleString()
    base = cut(project(df, key, embedding))
    n = base.count()
    every = max(1, n // SAMPLE)
    sample = base.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("p").limit(2 * SAMPLE).toArrow()  # the bound of the fit
    wanted, fitted = math.ceil(math.log2(max(1, n / BLOCK))), int(math.log2(max(1, sample.num_rows / PER_LEAF)))
    tree = BlockTree(matrix(sample.column("p"), PROJECTED), max(0, min(wanted, fitted)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaf(matrix(b.column(2), PROJECTED))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["id", "u", "p", "leaf"])

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            p, leaf = matrix(b.column(2), PROJECTED), b.column(3).to_numpy()
            for x in np.unique(leaf):
                own = p[leaf == x]
                old = held.get(x)
                lo, hi = own.min(axis=0), own.max(axis=0)
                held[x] = [len(own), lo, hi] if old is None else [old[0] + len(own), np.minimum(old[1], lo), np.maximum(old[2], hi)]
        flat = [(int(x), int(c), d, float(lo[d]), float(hi[d])) for x, (c, lo, hi) in held.items() for d in range(PROJECTED)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.float32(), pa.float32()))], names=["leaf", "c", "d", "lo", "hi"])

    placed = cut(base.mapInArrow(place, f"id {kind}, u binary, p binary, leaf int"))
    per = placed.mapInArrow(boxes, "leaf int, c long, d int, lo float, hi float").groupBy("leaf", "d").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    leaves = 1 << tree.depth
    count, low, high = np.zeros(leaves, np.int64), np.full((leaves, PROJECTED), np.inf, np.float32), np.full((leaves, PROJECTED), -np.inf, np.float32)
    for r in per.collect():  # as many rows as the tree has leaves (by its sample 16,384 at most), times 8
        count[r["leaf"]], low[r["leaf"], r["d"]], high[r["leaf"], r["d"]] = r["c"], r["lo"], r["hi"]
    # A leaf that holds too much, as by many equal vectors, is dealt out over several blocks of the same box.
    parts = np.maximum(1, -(-count // (2 * BLOCK)))
    first = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(leaves), parts)
    low, high = low[owner], high[owner]

    deal = F.create_map(*[x for i in np.flatnonzero(parts > 1) for x in (F.lit(int(i)), F.lit(int(parts[i])))]) if (parts > 1).any() else None
    salts = F.coalesce(deal[F.col("leaf")], F.lit(1)) if deal is not None else F.lit(1)
    starts = F.array(*[F.lit(int(x)) for x in first])
    block = (F.get(starts, F.col("leaf")) + F.pmod(F.xxhash64("id"), salts)).cast("int")
    placed = placed.withColumn("blk", block).drop("leaf")
    found = "array<struct<other: " + kind + ", similarity: float>>"

    def named(best: np.ndarray, who: np.ndarray, names: pa.Array) -> pa.Array:
        keep = (best > -1.5) & (best >= (-2 if least is None else least))
        ends = np.r_[0, np.cumsum(keep.sum(axis=1))].astype(np.int32)
        inner = pa.StructArray.from_arrays([names.take(pa.array(who[keep])), pa.array(best[keep], pa.float32())], names=["other", "similarity"])
        return pa.ListArray.from_arrays(pa.array(ends), inner)

    def codes(*tables: pa.Array) -> list[np.ndarray]:
        """Ids as numbers, equal for equal ids."""
        whole = pa.concat_arrays(tables).dictionary_encode()
        numbers = whole.indices.to_numpy()
        ends = np.cumsum([len(t) for t in tables])
        return [numbers[e - len(t) : e] for t, e in zip(tables, ends)]

    def one(column: pa.ChunkedArray) -> pa.Array:
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)

    def within(table: pa.Table) -> pa.Table:
        ids, u, p = one(table["id"]), matrix(table["u"], WIDTH), matrix(table["p"], PROJECTED)
        (numbers,) = codes(ids)
        best, who = search(u, p, np.full(len(u), farthest, np.float32), numbers, u, p, numbers, k, chi)
        r2 = np.minimum(farthest, 2 - 2 * best[:, k - 1] + 1e-6).astype(np.float32)
        own = table["blk"][0].as_py()
        visits = []
        for start in range(0, len(u), 8192):
            go = box_distance(p[start : start + 8192], low, high) <= r2[start : start + 8192, None] * chi + 1e-6
            go[:, own] = False
            visits += [np.flatnonzero(g).astype(np.int32) for g in go]
        return pa.table({"id": ids, "u": table["u"], "r2": pa.array(r2), "near": named(best, who, ids), "visits": pa.array(visits, pa.list_(pa.int32()))})

    own = placed.groupBy("blk").applyInArrow(within, f"id {kind}, u binary, r2 float, near {found}, visits array<int>")
    own = cut(own)
    calls = own.select("id", "u", "r2", F.explode("visits").alias("blk"))  # the projection is made again where it is needed
    sizes = calls.groupBy("blk").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # a row a block
    queries = calls.join(F.broadcast(sizes), "blk").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    data = placed.select(*[F.col(c).alias(c) for c in ("id", "u", "p", "blk")]).join(F.broadcast(sizes), "blk").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    data = data.toDF("d_blk", "d_id", "d_u", "d_p", "d_chunk")

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = one(left["id"]), one(right["d_id"])
        a, b = codes(ids, names)
        u = matrix(left["u"], WIDTH)
        best, who = search(u, u @ projection(), left["r2"].to_numpy(), a, matrix(right["d_u"], WIDTH), matrix(right["d_p"], PROJECTED), b, k, chi)
        return pa.table({"id": ids, "near": named(best, who, names)})

    far = queries.groupBy("blk", "chunk").cogroup(data.groupBy("d_blk", "d_chunk")).applyInArrow(across, f"id {kind}, near {found}")
    every_one = own.select("id", "near").union(far).select("id", F.explode("near").alias("_n")).select("id", "_n.other", F.col("_n.similarity").cast("double").alias("similarity"))
    ranked = every_one.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other")))
    return ranked.filter(F.col("place") <= k)


def neighbour_pairs(df: DataFrame, k: int = 5, least: float = 0.80) -> DataFrame:
    """id_a, id_b (smaller first) where one is among the k most similar of the other, at ``least`` or more."""
    found = nearest(df, k=k, least=least)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
