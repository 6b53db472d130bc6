"""Filling containers of fixed capacity by best fit decreasing.

Items of equal size, and open containers with equal room, are interchangeable, so the packing
follows from the number of items of each size alone: at most capacity + 1 counts.  The plan is made
on the driver with a segment tree over remaining capacities and says which ranks of a size go to
which containers; ranks are given to the items in parallel.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tokens import count_tokens
from graphloom.session import cut

CAPACITY = 2048


class CapacityTree:
    """Segment tree over remaining capacities: finds the least one, from a bound on, that some open container has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity).bit_length()
        self.open = np.zeros(2 * self.leaves, np.int64)

    def add(self, room: int, count: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += count
            at >>= 1

    def tightest(self, size: int) -> int | None:
        at = size + self.leaves
        if self.open[at]:
            return size
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit decreasing from the number of items of each size (1 to capacity).

    Gives the number of containers and rows of size, first rank, first container and items per container;
    rank r of a row goes to container first + (r - first rank) // items per container.
    """
    tree, room = CapacityTree(capacity), {}
    rows: list[tuple[int, int, int, int]] = []
    used = 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            room.setdefault(left, deque()).append((first, count))
            tree.add(left, count)

    for size in sorted(counts, reverse=True):
        items, rank = counts[size], 0
        while items:
            left = tree.tightest(size)
            if left is None:
                left, first, count = capacity, used, -(-items // (capacity // size))
                used += count
            else:
                first, count = room[left].popleft()
                tree.add(left, -count)
            each = left // size
            rows.append((size, rank, first, each))
            full = min(count, items // each)
            rest = items - full * each if full < count and items - full * each < each else 0
            put(left - each * size, first, full)
            if rest:
                put(left - rest * size, first + full, 1)
            put(left, first + full + bool(rest), count - full - bool(rest))
            placed = full * each + rest
            items, rank = items - placed, rank + placed
    return np.array(rows, np.int64).reshape(-1, 4), used


def fill(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """key, part_no, n_tokens, container_id for items of ``sizes``.

    An item over the capacity gives full parts and a last part with the rest; all others stay whole.
    Items without content (size 0, null or negative) take no room and are dealt out over the containers.
    Repeated keys are items of their own.  Items of one size are ranked by partition, then by key: how full the
    containers are doesn't depend on the layout of ``sizes``, but which of them an item gets does.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.lit(0), F.ceil(n / F.lit(capacity)) - 1).cast("int")
    items = sizes.select(F.col(key).alias("_key"), n.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("part_no"))
    items = items.select("_key", "part_no", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("part_no").cast("long") * capacity).cast("int").alias("_size"), F.spark_partition_id().alias("_at"))
    items = cut(items)  # read several times, in one layout
    # The rank of an item among its size: those of earlier partitions, then those before it in its own.
    per = items.groupBy("_at", "_size").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(Window.partitionBy("_size").orderBy("_at")) - F.col("_c"))
    per = cut(per)
    counts = {r["_size"]: r["n"] for r in per.groupBy("_size").agg(F.sum("_c").alias("n")).collect()}  # capacity + 1 rows at most
    rows, used = plan({s: c for s, c in counts.items() if s > 0}, capacity)
    keys = (rows[:, 0] << 40) + rows[:, 1]
    order = np.argsort(keys)
    table = items.sparkSession.sparkContext.broadcast((keys[order], rows[order]))  # as long as the plan: bounded by the capacity, not by the items
    containers = max(1, used)
    local = F.row_number().over(Window.partitionBy("_at", "_size").orderBy("_key", "part_no")) - 1
    ranked = items.withColumn("_local", local).join(per.drop("_c"), ["_at", "_size"]).select("_key", "part_no", "_size", (F.col("_local") + F.col("_before")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, seg = table.value
        for batch in batches:
            s, r = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            out = r % containers
            some = s > 0
            row = seg[np.searchsorted(starts, (s[some] << 40) + r[some], side="right") - 1] if len(seg) else seg
            if some.any():
                out[some] = row[:, 2] + (r[some] - row[:, 1]) // row[:, 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out)], names=[key, "part_no", "n_tokens", "container_id"])

    kind = sizes.schema[key].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{key}` {kind}, part_no int, n_tokens int, container_id long")


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``fill`` with the tokens of each text as its size."""
    return fill(count_tokens(docs, key, text, path=path), key, "n_tokens", capacity)
