"""Near-duplicate texts by fuzzy hashing with the binary Golay code.

A text's fingerprint is a row of blocks made of minima of hashed word sequences.  A block has an
anchor, one minimum as it is, and a segment of 23 bits out of three further minima.  The perfect
(23, 12) code decodes a segment to the codewords near it, and anchor and codeword index together are
a key.  Segments that differ in one bit share a codeword always, in two or three often; the errors
of two similar texts are spread over all segments, so some segment has few of them.  Texts with a
common key are compared by their exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.words import mix, sequences, word_hashes
from graphloom.operators.iterative import components
from graphloom.session import cut

BLOCKS, MINIMA = 20, 4  # 20 anchors and 20 segments of three minima: a pair at 0.6 is missed once in about 80
RADIUS = 4  # a segment's keys are the codewords within four bits, one to seven
KEY_BITS = 40  # chance matches of keys are settled by comparing signatures
HOT = 256  # keys of more classes than this are left to the exact join
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1 (fixed value of the code)
#: Of one in so many classes the keys are counted first: keys that so many of these share are hot for certain and are left out of the grouping.
SAMPLED, SURE = 64, 16
#: Rows up to which a set of ids is sent to all executors instead of being joined by a shuffle.
SMALL_ROWS = 200_000


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@lru_cache(maxsize=1)
def patterns() -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of up to four bits by syndrome (2048 rows, padded) and their number."""
    from itertools import combinations

    every = np.array([sum(1 << b for b in c) for k in range(RADIUS + 1) for c in combinations(range(23), k)], np.int64)
    s = syndrome(every)
    order = np.argsort(s, kind="stable")
    counts = np.bincount(s, minlength=2048)
    table = np.zeros((2048, counts.max()), np.int64)
    table[s[order], np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)] = every[order]
    return table, counts


@lru_cache(maxsize=1)
def multipliers() -> np.ndarray:
    return mix(np.arange(1, BLOCKS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the sequences, in stretches of bounded size."""
    out = np.full(BLOCKS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(out, (shingles[i : i + 4096, None] * multipliers()[None, :]).min(axis=0), out=out)
    return out


def keys_of(mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints (rows of minima) and the row of each."""
    m = mix(mins.reshape(-1, BLOCKS, MINIMA))
    segment = ((m[:, :, 1] >> np.uint64(56)) << np.uint64(15) | (m[:, :, 2] >> np.uint64(56)) << np.uint64(7) | m[:, :, 3] >> np.uint64(57)).astype(np.int64)
    table, counts = patterns()
    s = syndrome(segment)
    index = (segment[:, :, None] ^ table[s]) >> 11  # systematic: the upper 12 bits name the codeword
    used = np.arange(table.shape[1])[None, None, :] < counts[s][:, :, None]
    base = mix(m[:, :, 0] + np.arange(1, BLOCKS + 1, dtype=np.uint64)[None, :])
    keys = mix(base[:, :, None] + index.astype(np.uint64)) >> np.uint64(64 - KEY_BITS)
    row = np.broadcast_to(np.arange(len(m))[:, None, None], keys.shape)
    return keys[used].view(np.int64), row[used]


def signatures(mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit of 64 minima, and four bits of all 80, of each fingerprint."""
    m = mix(mins ^ np.uint64(0x5851F42D4C957F2D))
    at = np.arange(64, dtype=np.uint64)
    short = ((m[:, :64] & np.uint64(1)) << at).sum(axis=1, dtype=np.uint64)
    nibbles = (m >> np.uint64(60)).reshape(len(m), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return short.view(np.int64), nibbles.sum(axis=2, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, cls (hash of the set of sequences), keys and signatures of every text that has ``n`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, mins, cls = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    s = np.unique(sequences(word_hashes(text), n))
                    if len(s):
                        ids.append(i)
                        mins.append(minima(s))
                        cls.append(int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True))
                if not ids:
                    continue
                keys, row = keys_of(np.array(mins))
                short, wide = signatures(np.array(mins))
                ends = np.searchsorted(row, np.arange(len(ids) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(cls, pa.int64()), lists, pa.array(short), pa.array(list(wide), pa.list_(pa.int64()))], names=["doc_id", "cls", "keys", "short", "wide"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, cls long, keys array<long>, short long, wide array<long>")


def shingle_sets(docs: DataFrame, key: str, n: int) -> DataFrame:
    """key and its different sequences as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(sequences(word_hashes(t), n)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=[key, "_set"])

    return docs.select(key, "content").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, _set array<long>")


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only behind a check of the number of rows (each a few numbers or ids)."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Exact similarity of the pairs a, b; those of at least ``least`` stay."""
    both = pairs.join(sets.withColumnRenamed("cls", "a").withColumnRenamed("_set", "_sa"), "a").join(sets.withColumnRenamed("cls", "b").withColumnRenamed("_set", "_sb"), "b")
    shared = F.size(F.array_intersect("_sa", "_sb"))
    return both.withColumn("_n", shared).withColumn("similarity", F.col("_n") / (F.size("_sa") + F.size("_sb") - F.col("_n"))).filter(F.col("similarity") >= least).select("a", "b", "similarity")


def exact_pairs(sets: DataFrame, least: float) -> DataFrame:
    """All pairs with at least ``least`` by prefix filtering, for classes whose keys are hot.

    Sequences are ordered from rare to common.  Similar sets share one among the rarest
    size - ceil(least * size) + 1 of each, so blocks of text that many share are not looked at.
    """
    each = sets.select("cls", F.size("_set").alias("_size"), F.explode("_set").alias("_x"))
    df = each.groupBy("_x").agg(F.count("*").alias("_df"))
    ranked = each.join(df, "_x").withColumn("_r", F.row_number().over(Window.partitionBy("cls").orderBy("_df", "_x")))
    prefix = cut(ranked.filter((F.col("_r") <= F.col("_size") - F.ceil(F.col("_size") * least - 1e-9) + 1) & (F.col("_df") > 1)).select("cls", "_x", "_size"))
    a, b = prefix.select(F.col("cls").alias("a"), "_x", F.col("_size").alias("_na")), prefix.select(F.col("cls").alias("b"), "_x", F.col("_size").alias("_nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("_na", "_nb") >= F.greatest("_na", "_nb") * least)
    return a.join(b, "_x").filter(fits).select("a", "b").distinct()


def far_bits(least: float, minima: int, bits: int) -> int:
    """Differing bits that signatures of a pair at ``least`` exceed about once in ten thousand times.

    A minimum differs with probability 1 - least, and each of its bits then differs in half of the cases.
    """
    p = 1 - least
    mean = p * bits / 2
    spread = (p * (bits / 4 + bits * bits / 4) - mean * mean) ** 0.5
    return int(minima * mean + 3.8 * spread * minima**0.5)


def near_duplicates(docs: DataFrame, least: float = 0.60, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and the links between them.

    ``docs`` has doc_id and content; other columns are ignored.  Gives members (doc_id, cls), one row for
    each document with at least ``n`` words, and links (a, b, similarity) between classes, a < b.  Documents
    with the same set of word sequences are one class.  A doc_id that is repeated counts once.  Null, empty
    and shorter texts have no sequences and are in neither table, as are rows without doc_id.
    """
    docs = docs.select("doc_id", "content").filter(F.col("doc_id").isNotNull() & F.col("content").isNotNull())
    prints = cut(fingerprints(docs, n))
    members = prints.select("doc_id", "cls").distinct()
    classes = prints.groupBy("cls").agg(F.first(F.struct("keys", "short")).alias("_f"))
    keyed = classes.select("cls", "_f.short", F.explode("_f.keys").alias("key"))
    sample = prints.filter(F.pmod(F.xxhash64("cls"), F.lit(SAMPLED)) == 0).groupBy("cls").agg(F.first("keys").alias("keys"))
    common = cut(sample.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("_c")).filter(F.col("_c") >= SURE).select("key"))
    n_common = common.count()
    early = keyed.filter("false").select("cls")
    if n_common:
        early = cut(keyed.join(maybe_broadcast(common, n_common), "key", "left_semi").select("cls").distinct())
        keyed = keyed.join(maybe_broadcast(common, n_common), "key", "left_anti")
    size = F.count("*").over(Window.partitionBy("key"))
    shared = cut(keyed.withColumn("_n", size).filter(F.col("_n") > 1))
    some = shared.filter(F.col("_n") <= HOT)
    a, b = some.select(F.col("cls").alias("a"), F.col("short").alias("_sa"), "key"), some.select(F.col("cls").alias("b"), F.col("short").alias("_sb"), "key")
    near = F.bit_count(F.col("_sa").bitwiseXOR(F.col("_sb"))) <= far_bits(least, 64, 1)
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    wide = prints.groupBy("cls").agg(F.first("wide").alias("w"))
    both = pairs.join(wide.select(F.col("cls").alias("a"), F.col("w").alias("_wa")), "a").join(wide.select(F.col("cls").alias("b"), F.col("w").alias("_wb")), "b")
    differ = sum((F.bit_count(F.col("_wa")[i].bitwiseXOR(F.col("_wb")[i])) for i in range(BLOCKS * MINIMA // 16)), F.lit(0))
    pairs = cut(both.filter(differ <= far_bits(least, BLOCKS * MINIMA, 4)).select("a", "b"))
    hot = shared.filter(F.col("_n") > HOT).select("cls").union(early).distinct().withColumn("_hot", F.lit(1))
    held = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(hot, "cls", "full_outer")
    reps = cut(held.join(members, "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.max("_hot"), F.lit(0)).alias("_hot")))
    total, hot = reps.agg(F.count("*"), F.coalesce(F.sum("_hot"), F.lit(0))).first()
    texts = docs.join(maybe_broadcast(reps, total), "doc_id").select("cls", "content", "_hot")
    once = texts.groupBy("cls").agg(F.first("content").alias("content"), F.first("_hot").alias("_hot"))
    sets = shingle_sets(once, "cls", n)
    if hot:
        sets = cut(sets)
        pairs = pairs.union(exact_pairs(sets.join(reps.filter("_hot = 1").select("cls"), "cls", "left_semi"), least)).distinct()
    return members, verify(pairs, sets, least)


def grouped_pairs(docs: DataFrame, least: float = 0.60, n: int = 3) -> DataFrame:
    """doc_id_a, doc_id_b of every pair of documents with at least ``least``, smaller id first.

    The pairs within a class of equal texts are part of the result, as the result's columns ask for them.
    """
    members, links = near_duplicates(docs, least, n)
    a, b = members.select(F.col("doc_id").alias("x"), F.col("cls").alias("a")), members.select(F.col("doc_id").alias("y"), F.col("cls").alias("b"))
    across = links.join(a, "a").join(b, "b").select("x", "y")
    many = members.groupBy("cls").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("cls").alias("a"))
    equal = a.join(many, "a", "left_semi").join(b.withColumnRenamed("b", "a"), "a").filter(F.col("x") < F.col("y")).select("x", "y")
    return across.union(equal).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, group_id, n: documents that links lead to from one another, under the smallest doc_id, with their number.

    Takes what ``near_duplicates`` gives.  A document without links is in the group of those with its own text.
    """
    found = components(links.select("a", "b")).withColumnRenamed("id", "cls")
    placed = cut(members.join(found, "cls", "left").select("doc_id", F.coalesce("component", "cls").alias("_g")))
    named = placed.groupBy("_g").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n"))
    return placed.join(named, "_g").select("doc_id", "group_id", "n")
