"""Vector expressions, and the join of all vectors with all others in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 16_384  # rows of a block
TILE = 2048  # rows of a matrix product
SMALL = 200_000  # pairs of blocks that are broadcast at most
SAMPLE = 20_000  # rows, at most twice as many, that pivots are chosen from


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where one of the vectors is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def mean_vector(vectors: DataFrame, groups: list[str], embedding: str = "embedding") -> DataFrame:
    """groups and the mean of their vectors, element by element."""
    each = vectors.select(*groups, F.posexplode(embedding).alias("_i", "_x"))
    means = each.groupBy(*groups, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(embedding))  # as long as a vector


def units(column) -> np.ndarray:
    """Rows of a list column as vectors of length one; a vector of zeros stays."""
    x = np.stack([np.asarray(e, np.float64) for e in column.to_pylist()]) if len(column) else np.zeros((0, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def pivots_of(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of a sample, each the farthest in angle from those before."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def similar_pairs(df: DataFrame, key: str, embedding: str, least: float) -> DataFrame:
    """src, dst, sim of all pairs src < dst whose cosine is at least ``least``; exact.

    Rows are dealt to the pivot nearest in angle, of which there are enough for blocks of BLOCK rows, and a pivot of more
    rows holds several blocks.  By the triangle inequality two blocks can only hold such a pair if the angle of their
    pivots is at most that of ``least`` and the angles of their farthest rows; other pairs of blocks are never met.  A pair of
    blocks is one task's matrix products, so that no row pair is shuffled.  Rows without a vector have no pairs.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    base = df.filter(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(F.col(key).alias("k"), F.col(embedding).cast("array<double>").alias("e"))
    n = base.count()
    if n <= BLOCK:
        pivots = np.zeros((1, 1))  # one block, which meets itself
    else:
        every = max(1, n // SAMPLE)
        sample = base.filter(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).select("e").limit(2 * SAMPLE).toArrow().column("e")  # the bound of the fit
        pivots = pivots_of(units(sample), -(-n // BLOCK)) if len(sample) else np.zeros((1, 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = units(b.column(1))
            if least > 0:  # a vector of zeros has cosine 0 with all
                some = x.any(axis=1)
                x, b = x[some], b.filter(pa.array(some))
            s = np.clip(x @ pivots.T, -1, 1)
            own = s.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(np.arccos(s[np.arange(len(own)), own]) if len(own) else np.zeros(0))], names=["k", "e", "p", "angle"])

    if len(pivots) == 1:
        dealt, sizes = base.withColumn("p", F.lit(0)), {0: (n, math.pi)} if n else {}
    else:
        dealt = base.mapInArrow(deal, f"k {kind}, e array<double>, p int, angle double")
        sizes = {r["p"]: (r["n"], r["far"]) for r in dealt.groupBy("p").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()}  # a row a pivot
    blocks = [(p, i) for p in sorted(sizes) for i in range(-(-sizes[p][0] // BLOCK))]
    first = {p: next(b for b, (q, _) in enumerate(blocks) if q == p) for p in sizes}
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) > 1 else np.zeros((1, 1))
    reach = float(np.arccos(np.clip(least, -1, 1)))
    meets = [(a, b) for a, (p, _) in enumerate(blocks) for b, (q, _) in enumerate(blocks) if a <= b and (least <= 0 or between[p, q] <= reach + sizes[p][1] + sizes[q][1] + 1e-9)]
    if not meets:
        return spark.createDataFrame([], f"src {kind}, dst {kind}, sim double")
    parts = spark.createDataFrame([(p, first[p], -(-n // BLOCK)) for p, (n, _) in sizes.items()], "p int, first int, n int")
    rows = dealt.join(F.broadcast(parts), "p").select("k", "e", (F.col("first") + F.pmod(F.xxhash64("k"), F.col("n"))).cast("int").alias("b"))  # a row a pivot
    pairs = spark.createDataFrame(meets, "i int, j int")
    pairs = F.broadcast(pairs) if len(meets) <= SMALL else pairs  # two numbers a row, counted
    left = rows.join(pairs.withColumn("b", F.col("i")), "b").select("k", "e", "i", "j", F.lit(0).alias("side"))
    right = rows.join(pairs.withColumn("b", F.col("j")), "b").select("k", "e", "i", "j", F.lit(1).alias("side"))

    def run(pair: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        sides = [table.filter(pa.array(side == x)) for x in (0, 1)]
        keys = [t["k"].to_numpy() for t in sides]
        a, b = (units(t["e"]) for t in sides)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x in range(0, len(a), TILE):
            for y in range(0, len(b), TILE):
                s = a[x : x + TILE] @ b[y : y + TILE].T
                r, c = np.nonzero(s >= least)
                ka, kb, v = keys[0][x + r], keys[1][y + c], s[r, c]
                keep = ka != kb if pair[0].as_py() != pair[1].as_py() else ka < kb
                ka, kb, v = ka[keep], kb[keep], v[keep]
                swap = ka > kb
                out.append((np.where(swap, kb, ka), np.where(swap, ka, kb), v))
        joined = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        ids = table["k"].type
        return pa.table({"src": pa.array(joined[0], ids), "dst": pa.array(joined[1], ids), "sim": pa.array(joined[2], pa.float64())})

    return left.union(right).groupBy("i", "j").applyInArrow(run, f"src {kind}, dst {kind}, sim double")
