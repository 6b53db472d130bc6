"""Percentiles of very large numeric columns by radix selection.

Values become integers of the same order.  A pass counts the bits down to one digit further
for each group, and only rows under the digits that hold a wanted rank go on.  Counts of one
resolution add up, so histograms of days or files can be stored and combined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import cut

DIGIT = 16  # bits a pass; a group has at most 2**16 bins in one
SMALL = 200_000  # prefixes that are broadcast at most
SALTS = 32  # tasks that a prefix is dealt out over beyond that
PERCENTILES = (0.25, 0.5, 0.9, 0.95, 0.99)
_LOW = np.int64(0x7FFFFFFFFFFFFFFF)


def to_ordered(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; both zeros are the same."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _LOW, bits)


def from_ordered(ordered: np.ndarray) -> np.ndarray:
    return np.where(ordered < 0, ordered ^ _LOW, ordered).view(np.float64)


def ordered_rows(df: DataFrame, value: str) -> DataFrame:
    """Replace the double column ``value`` by ``_o``, its ordered integer; it must hold finite values only."""
    keep = [c for c in df.columns if c != value]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("_o", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o = to_ordered(batch.column(len(keep)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(o)], names=[*keep, "_o"])

    return df.select(*keep, F.col(value).cast("double").alias(value)).mapInArrow(run, schema)


def with_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn ordered integers in ``columns`` back into doubles."""
    names = df.columns
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pa.array(from_ordered(c.to_numpy(zero_copy_only=False))) if n in columns else c for n, c in zip(names, batch.columns)]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(run, schema)


def finite(value: Column) -> Column:
    """Whether a value is a number: not null, NaN or infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def once(df: DataFrame, key: str, groups: Sequence[str], value: str) -> DataFrame:
    """Groups and ``_o`` with each key's row once (the least value, should they differ); null keys are no rows."""
    rows = ordered_rows(df.filter(F.col(key).isNotNull() & finite(F.col(value))).select(key, *groups, value), value)
    return rows.groupBy(key, *groups).agg(F.min("_o").alias("_o")).drop(key)


def histogram(rows: DataFrame, groups: Sequence[str], bits: int = 32) -> DataFrame:
    """Mergeable histogram of groups: ``bin`` (the leading ``bits`` bits) and ``n``.

    With 12 + k bits a value is known to a relative error of 2**-k.
    """
    return rows.groupBy(*groups, F.shiftright("_o", 64 - bits).alias("bin")).agg(F.count("*").alias("n"))


def merge(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add up histograms of one resolution, as from several days."""
    return parts.groupBy(*groups, "bin").agg(F.sum("n").alias("n"))


def _wanted(hist: DataFrame, within: Sequence[str], targets: DataFrame | None, percentiles: Sequence[float]) -> DataFrame:
    """Bins that hold a wanted rank: within columns, p, bin, k (the rank inside the bin), n of the whole group.

    ``within`` are the groups, and from the second pass on also the prefix.
    """
    w = Window.partitionBy(*within).orderBy("bin")
    run = hist.withColumn("_to", F.sum("n").over(w))
    if targets is None:
        total = F.sum("n").over(Window.partitionBy(*within))
        run = run.withColumn("_total", total).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
        run = run.withColumn("_k", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("_total"), 6))))
    else:
        run = run.join(targets, list(within))
    hit = (F.col("_k") > F.col("_to") - F.col("n")) & (F.col("_k") <= F.col("_to"))
    return run.filter(hit).select(*[c for c in within if c != "_prefix"], "p", "bin", (F.col("_k") - (F.col("_to") - F.col("n"))).alias("_k"), "_total")


def percentiles(rows: DataFrame, groups: Sequence[str], wanted: Sequence[float] = PERCENTILES, bits: int = 64) -> DataFrame:
    """groups, p, n (values in the group), value: the value of rank ceil(p * n).

    ``rows`` are the groups and ``_o`` (see ``once``).  Groups are compared with nulls equal.  With 64 bits
    the result is exact; with 12 + k bits the lower end of its bin, at most a share of 2**-k off.
    """
    if bits % DIGIT:
        raise ValueError(f"bits must be a multiple of {DIGIT}")
    # Null labels are one group, also in joins: keys are wrapped so that they never are null.
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = cut(rows.select(*[F.struct(F.col(g).alias("v")).alias(k) for g, k in zip(groups, keys)], "_o"))
    found = _select(rows, keys, wanted, bits)
    named = found.select(*[F.col(f"{k}.v").alias(g) for g, k in zip(groups, keys)], "p", F.col("_total").alias("n"), F.shiftleft("bin", 64 - bits).alias("value"))
    return with_doubles(named, ["value"])


def _select(rows: DataFrame, keys: Sequence[str], wanted: Sequence[float], bits: int) -> DataFrame:
    """Passes of the selection over ``rows`` (keys, that are never null, and ``_o``): keys, p, bin, _k, _total.

    A pass reads the rows once, keeps those under the prefixes that the last one found, and counts them before they
    are shuffled.  Prefixes are broadcast where they are counted to be at most SMALL; beyond that they are joined
    by a shuffle, each dealt out over SALTS tasks, as one prefix may hold any share of the rows.
    """
    hist = histogram(rows, keys, DIGIT)
    found = cut(_wanted(hist, keys, None, wanted))
    for depth in range(2 * DIGIT, bits + 1, DIGIT):
        targets = found.withColumnRenamed("bin", "_prefix")
        follow, on = targets.select(*keys, "_prefix").distinct(), [*keys, "_prefix"]
        under = rows.withColumn("_prefix", F.shiftright("_o", 64 - depth + DIGIT))
        if follow.count() <= SMALL:
            follow = F.broadcast(follow)  # two numbers a row, counted
        else:
            follow = follow.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            under = under.withColumn("_salt", F.pmod(F.xxhash64("_o", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
            on = [*on, "_salt"]
        hist = under.join(follow, on, "left_semi").groupBy(*keys, "_prefix", F.shiftright("_o", 64 - depth).alias("bin")).agg(F.count("*").alias("n"))
        found = cut(_wanted(hist, [*keys, "_prefix"], targets, wanted))
    return found


def of_histogram(hist: DataFrame, groups: Sequence[str], wanted: Sequence[float] = PERCENTILES, bits: int = 32) -> DataFrame:
    """Percentiles of a stored or merged histogram: groups, p, n, low and high (the value lies between them)."""
    keys = [f"_g{i}" for i in range(len(groups))]
    inner = hist.select(*[F.struct(F.col(g).alias("v")).alias(k) for g, k in zip(groups, keys)], "bin", "n")
    found = _wanted(inner, keys, None, wanted)
    low = F.shiftleft("bin", 64 - bits)
    named = found.select(*[F.col(f"{k}.v").alias(g) for g, k in zip(groups, keys)], "p", F.col("_total").alias("n"), low.alias("low"), (low + F.lit((1 << (64 - bits)) - 1)).alias("high"))
    return with_doubles(named, ["low", "high"])


def metric_rows(points: DataFrame, label: str = "component") -> DataFrame:
    """metric, label and ``_o`` of metric_points: each point_id once, finite values of any sign.  Missing labels are null."""
    return once(points.select("point_id", "metric", F.col("labels").getItem(label).alias("label"), "value"), "point_id", ["metric", "label"], "value")


def label_entries(labels: Column, always: str = "component") -> Column:
    """Entries of a map of labels; one that lacks ``always``, or is null, has it with a null value."""
    some = F.coalesce(F.map_entries(labels), F.array().cast("array<struct<key:string,value:string>>"))
    missing = F.concat(F.filter(some, lambda e: e["key"] != always), F.array(F.struct(F.lit(always).alias("key"), F.lit(None).cast("string").alias("value"))))
    return F.when(labels.getItem(always).isNull(), missing).otherwise(some)


def label_percentiles(points: DataFrame, wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    """metric, label_key, label, p, n, value: exact percentiles of metric_points for every label that its points hold.

    Each point_id counts once, with finite values of any sign, in the group of each of its labels; a point
    without component is in that of the null component.  Groups go by their 64-bit hash until the end.
    """

    def group(key: Column, value: Column) -> Column:
        return F.xxhash64("metric", F.isnull("metric"), key, value, F.isnull(value))

    entries = label_entries(F.col("labels"))
    groups = F.sort_array(F.transform(entries, lambda e: group(e["key"], e["value"])))
    rows = cut(once(points.select("point_id", groups.alias("_groups"), "value"), "point_id", ["_groups"], "value"))
    found = _select(rows.select(F.explode("_groups").alias("_g"), "_o"), ["_g"], wanted, 64)
    each = points.select("metric", F.explode(entries).alias("_e")).select("metric", F.col("_e.key").alias("label_key"), F.col("_e.value").alias("label")).distinct()
    names = each.withColumn("_g", group(F.col("label_key"), F.col("label")))
    return with_doubles(found.join(names, "_g").select("metric", "label_key", "label", "p", F.col("_total").alias("n"), F.col("bin").alias("value")), ["value"])


def query_rows(stats: DataFrame) -> DataFrame:
    """query_type and ``_o`` of query_stats: each query_id once; negative times weren't measured and don't count."""
    return once(stats.filter(F.col("execution_time") >= 0).select("query_id", "query_type", "execution_time"), "query_id", ["query_type"], "execution_time")
