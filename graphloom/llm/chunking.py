"""Splitting oversized texts at natural boundaries by bounded-quantifier regular expressions.

One pattern per configuration lists alternatives from the strongest boundary to the weakest;
each takes as much as the limit allows, and a plain run of characters is the last resort.
All work is done by built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_CONFIG, DEFAULT_SIZE, DEFAULT_OVERLAP = "default", 1000, 200

ANY_SPACE = r"(?<=[\s])"  # before a word is cut, white space in the first half counts as well

#: Boundaries from strong to weak, each as what must precede (and follow) the cut.
BOUNDARIES = (
    r"(?<=\n[ \t]{0,8}\r?\n|\r[ \t]{0,8}\r)(?!\s)",  # paragraph
    r"(?<=[.!?…。！？][\"'»”’)\]]?\s)",  # sentence
    r"(?<=\n|\r(?!\n))",  # line
    r"(?<=[;:,|]\s)",  # clause or cell
    r"(?<=\s)",  # word
    ANY_SPACE,
    r"(?![\p{M}\u200d\ufe0f])(?<!\u200d)(?<!\r(?=\n))",  # whole character with its marks
    "",  # any character
)


def boundary_pattern(first: Column, later: Column) -> Column:
    """Pattern for bodies: the first of up to ``first`` characters, the later ones of up to ``later``.

    A boundary counts from half of the limit on, so that no piece becomes tiny; before a word would be cut, any white space counts.
    """

    def run(size: Column, boundary: str) -> Column:
        low = F.lit(1) if boundary == ANY_SPACE else F.greatest(F.lit(1), F.floor(size / 2).cast("int"))
        return F.concat(F.lit(".{"), low.cast("string"), F.lit(","), size.cast("string"), F.lit("}" + boundary))

    def whole(size: Column) -> Column:
        return F.concat(F.lit(".{1,"), size.cast("string"), F.lit(r"}\z"))

    def alternatives(size: Column) -> Column:
        return F.concat_ws("|", whole(size), *[run(size, b) for b in BOUNDARIES])

    return F.concat(F.lit(r"(?s)\A(?:"), alternatives(first), F.lit(r")|(?!\A)(?:"), alternatives(later), F.lit(")"))


def with_settings(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """Add ``_size`` and ``_overlap`` of each row's configuration.

    Rows without a config_id use the row ``default``; an unknown config_id counts as 1000 and 200.
    A missing or non-positive chunk_size counts as 1000.  A missing or negative overlap is 0; one
    that isn't below its chunk_size is cut to half of it, so that every piece goes forward.
    """
    settings = configs.groupBy(F.col("config_id").alias("_config")).agg(F.max(F.struct("chunk_size", "overlap")).alias("_c"))
    size = F.coalesce(F.when(F.col("_c.chunk_size") > 0, F.col("_c.chunk_size")), F.lit(DEFAULT_SIZE))
    overlap = F.when(F.col("_c").isNull(), F.lit(DEFAULT_OVERLAP)).otherwise(F.greatest(F.coalesce(F.col("_c.overlap"), F.lit(0)), F.lit(0)))
    return (
        docs.withColumn("_key", F.coalesce(F.col("config_id"), F.lit(DEFAULT_CONFIG)))
        .join(settings, F.col("_key") == F.col("_config"), "left")
        .withColumn("_size", size)
        .withColumn("_overlap", F.when(overlap >= F.col("_size"), F.floor(F.col("_size") / 2)).otherwise(overlap).cast("int"))
        .drop("_config", "_key", "_c")
    )


def bodies(content: Column, size: Column, overlap: Column) -> Column:
    """Consecutive parts of the text that cover it once, as lengths in characters.

    Characters outside the basic plane are replaced by one private character before matching, so
    that the matcher's fast loop over equally wide characters holds for every text.
    """
    flat = F.regexp_replace(content, r"[\x{10000}-\x{10FFFF}]", "\ue000")
    return F.regexp_extract_all(flat, boundary_pattern(size, size - overlap), F.lit(0))


def cut_lengths(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """doc rows with ``_size``, ``_overlap`` and ``_lengths``, the lengths of the bodies; empty for null and empty texts."""
    return with_settings(docs, configs).withColumn(
        "_lengths",
        F.transform(F.coalesce(bodies(F.col("content"), F.col("_size"), F.col("_overlap")), F.array().cast("array<string>")), F.length),
    )


def latest(df: DataFrame, key: str, by: str, ties: list[str]) -> DataFrame:
    """One row for each ``key``: the one with the greatest ``by``, then the greatest hash of ``ties``."""
    rest = [c for c in df.columns if c != key]
    found = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(by, F.xxhash64(*ties))).alias("_r"))
    return found.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


#: Pieces whose text is taken out of the document at once, so that long documents aren't searched from their start for each piece.
STRETCH = 64


def split_texts(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """Every document in pieces: doc_id, piece_no (from 0), start, end (code points, end exclusive), piece.

    ``docs`` has doc_id, content, config_id, ingested_at; other columns are ignored.  A document taken
    in again counts once, by its latest row.  Each piece is at most chunk_size long and the next begins
    ``overlap`` characters before its end; the pieces without their overlaps give the text back.  A text
    within the limit is one piece; null and empty texts, and rows without doc_id, give none.
    """
    rows = docs.select("doc_id", "content", "config_id", "ingested_at").filter(F.col("doc_id").isNotNull())
    cuts = cut_lengths(latest(rows, "doc_id", "ingested_at", ["content", "config_id"]), configs)
    # Ends are running sums: of the stretches first, then inside each, so that the work grows with the pieces of a text.
    sums = f"transform(sequence(0, size(_lengths) - 1, {STRETCH}), i -> aggregate(slice(_lengths, i + 1, {STRETCH}), 0, (a, x) -> a + x))"
    running = "aggregate({}, array({}), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    some = cuts.filter(F.size("_lengths") > 0).withColumn("_sums", F.expr(sums)).withColumn("_starts", F.expr(running.format("_sums", "0")))
    stretches = some.withColumn("_b", F.explode(F.sequence(F.lit(0), F.size("_sums") - 1))).select(
        "doc_id", "_overlap", (F.col("_b") * STRETCH).alias("_at"),
        F.expr(running.format(f"slice(_lengths, _b * {STRETCH} + 1, {STRETCH})", "_starts[_b]")).alias("_ends"),
        F.greatest(F.lit(0), F.expr("_starts[_b]") - F.col("_overlap")).alias("_from"),
        F.expr("substring(content, greatest(0, _starts[_b] - _overlap) + 1, _starts[_b + 1] - greatest(0, _starts[_b] - _overlap))").alias("_text"),
    )
    each = stretches.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_ends") - 2)))
    start, end = F.greatest(F.lit(0), F.expr("_ends[_i]") - F.col("_overlap")), F.expr("_ends[_i + 1]")
    return each.select(
        "doc_id", (F.col("_at") + F.col("_i")).alias("piece_no"), start.alias("start"), end.alias("end"),
        F.substring("_text", start - F.col("_from") + 1, end - start).alias("piece"),
    )


def oversized(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """doc_id of every document that the splitter cuts into more than one piece, each once."""
    return (
        cut_lengths(docs.select("doc_id", "content", "config_id").filter(F.col("doc_id").isNotNull()), configs)
        .filter(F.size("_lengths") > 1)
        .select("doc_id")
        .distinct()
    )
