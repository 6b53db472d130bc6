"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import chunking, names, neardup, packing, percentiles, repetition, residue, scans, tokens, vectors
from graphloom.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.oversized(read_table(spark, sf_dir, "source_documents"), read_table(spark, sf_dir, "run_configs"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_texts(read_table(spark, sf_dir, "source_documents"), read_table(spark, sf_dir, "run_configs"))


def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, holds: whether the pieces are in order, within the size, cover the text and overlap as set."""
    docs, configs = read_table(spark, sf_dir, "source_documents"), read_table(spark, sf_dir, "run_configs")
    pieces = chunking.split_texts(docs, configs)
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "content", "config_id", "ingested_at")
    settings = chunking.with_settings(chunking.latest(rows, "doc_id", "ingested_at", ["content", "config_id"]), configs).select("doc_id", "content", "_size", "_overlap")
    after = Window.partitionBy("doc_id").orderBy("piece_no")
    each = pieces.join(settings, "doc_id").withColumn("_last", F.lag("end").over(after)).withColumn("_no", F.row_number().over(after) - 1)
    begins = F.when(F.col("_last").isNull(), F.col("start") == 0).otherwise(F.col("start") == F.greatest(F.lit(0), F.col("_last") - F.col("_overlap")))
    fits = (F.col("end") - F.col("start") <= F.col("_size")) & (F.col("piece_no") == F.col("_no")) & (F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("piece"))
    return each.groupBy("doc_id").agg(F.max("end").alias("n_chars"), F.bool_and(begins & fits).alias("holds"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.decode(docs).select("doc_id", F.size("ids").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding the ids gives each text back, and where its last token ends."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(docs)).select("doc_id", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))
    ends = tokens.offsets(docs).select("doc_id", F.coalesce(F.array_max("tokens.end"), F.lit(0)).alias("last_end"))
    return back.join(ends, "doc_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(read_table(spark, sf_dir, "source_documents")).select("doc_id", F.explode("noise").alias("noise"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(read_table(spark, sf_dir, "source_documents")).select("doc_id", F.array_join("noise", ",").alias("noise"), "repaired")


def p3_label_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of every metric; ``p3_metric_percentiles`` has the component alone."""
    return percentiles.label_percentiles(read_table(spark, sf_dir, "metric_points"))


def p3_metric_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(percentiles.metric_rows(read_table(spark, sf_dir, "metric_points")), ["metric", "label"])


def p3_query_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(percentiles.query_rows(read_table(spark, sf_dir, "query_stats")), ["query_type"])


def p3_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of each day, added up: the same percentiles within a share of 2**-20."""
    stats = read_table(spark, sf_dir, "query_stats").filter(F.col("execution_time") >= 0)
    rows = percentiles.once(stats.select("query_id", "query_type", F.to_date("started_at").alias("day"), "execution_time"), "query_id", ["day", "query_type"], "execution_time")
    days = percentiles.histogram(rows, ["day", "query_type"])
    return percentiles.of_histogram(percentiles.merge(days, ["query_type"]), ["query_type"])


def p3_merged_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact percentiles lie within the bounds of ``p3_merged_days``, which are at most a share of 2**-20 apart."""
    low_high = p3_merged_days(spark, sf_dir).select(F.struct("query_type").alias("_g"), "p", "n", "low", "high")
    exact = p3_query_percentiles(spark, sf_dir).select(F.struct("query_type").alias("_g"), "p", "value")
    near = (F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high")) & (F.col("high") - F.col("low") <= F.abs(F.col("low")) * 2.0**-19)
    return low_high.join(exact, ["_g", "p"]).select("_g.query_type", "p", "n", near.alias("within"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_pairs(read_table(spark, sf_dir, "extraction_results"))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_names(read_table(spark, sf_dir, "extraction_results"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbour_pairs(read_table(spark, sf_dir, "embedding_cache"))


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every vector, at any similarity."""
    return vectors.nearest(read_table(spark, sf_dir, "embedding_cache")).select("id", "other", F.round("similarity", 4).alias("similarity"), "place")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped_pairs(read_table(spark, sf_dir, "source_documents"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class of equal texts and the number of links of the class to others."""
    members, links = neardup.near_duplicates(read_table(spark, sf_dir, "source_documents"), 0.8, 5)
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    return members.join(ends, "cls", "left").select("doc_id", F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the group that links of at least 0.60 lead to from it."""
    return neardup.groups(*neardup.near_duplicates(read_table(spark, sf_dir, "source_documents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(read_table(spark, sf_dir, "graph_summaries")).filter("repeated").select("id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(read_table(spark, sf_dir, "graph_summaries")).select("id", "n_sequences", F.round("repeated_share", 6).alias("repeated_share"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(read_table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(read_table(spark, sf_dir, "documents")).filter("excluded").select("doc_id")


def p10_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(read_table(spark, sf_dir, "documents"))


def p10_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of recurrent lines of each host, the first step of ``p10_found``."""
    return residue.recurrent_lines(read_table(spark, sf_dir, "documents")).groupBy(F.col("_host").alias("host")).agg(F.count("*").alias("n_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_cover": p1_cover,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_label_percentiles": p3_label_percentiles,
    "p3_metric_percentiles": p3_metric_percentiles,
    "p3_query_percentiles": p3_query_percentiles,
    "p3_merged_days": p3_merged_days,
    "p3_merged_bounds": p3_merged_bounds,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p8_round_trip": p8_round_trip,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_evidence": p10_evidence,
    "p10_recurrent": p10_recurrent,
}

_SEQUENCES = """
    WITH t AS (SELECT id, max_by(content, last_updated) AS content, max(content) AS c FROM graph_summaries WHERE id IS NOT NULL GROUP BY id),
    w AS (SELECT id, regexp_extract_all(lower(coalesce(content, c, '')), '[\\p{L}\\p{N}]+') AS w FROM t),
    s AS (SELECT id, [array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)] AS s FROM w),
    r AS (SELECT id, len(s) AS n, CASE WHEN len(s) > 0 THEN 1 - len(list_distinct(s)) / len(s) ELSE 0 END AS share FROM s)"""
_RANKS = """
    , r AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY v) AS k, count(*) OVER (PARTITION BY {g}) AS n FROM v),
    q AS (SELECT unnest([0.25, 0.5, 0.9, 0.95, 0.99])::DOUBLE AS p)
    SELECT {g}, p, n, v + 0.0 AS value FROM r, q WHERE k = greatest(1, ceil(round(p * n, 6)))"""

_LINKS = """
    WITH RECURSIVE d AS (SELECT doc_id, any_value(content) AS c FROM source_documents WHERE doc_id IS NOT NULL AND content IS NOT NULL GROUP BY doc_id),
    w AS (SELECT doc_id, regexp_extract_all(lower(c), '[\\p{L}\\p{N}]+') AS w FROM d),
    s AS (SELECT doc_id, unnest(list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)])) AS s FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.60 * (x.n + y.n - c)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    walk(id, g) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, walk.g FROM walk JOIN e ON e.a = walk.id),
    m AS (SELECT id, min(g) AS g FROM walk GROUP BY 1)"""
_PLAIN = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&#39;": "''", "&nbsp;": " "}
_TEXT = "regexp_replace(text, '[\\x{ad}\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{feff}]', '', 'g')"
for _a, _b in _PLAIN.items():
    _TEXT = f"replace({_TEXT}, '{_a}', '{_b}')"
_BLANK = "[\\t-\\r\\x{1c}-\\x{1f} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_RECURRENT = f"""
    WITH t AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL),
    x AS (SELECT host, text, unnest(regexp_split_to_array(regexp_replace({_TEXT}, '(?i)</?(?:{"|".join(residue.TAGS)})\\b[^<>]{{0,200}}>', chr(10), 'g'), '\\r\\n|[\\n-\\r\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM t),
    y AS (SELECT DISTINCT host, text, array_to_string([CASE WHEN regexp_matches(w, '\\p{{Nd}}') THEN '0' ELSE w END FOR w IN list_filter(regexp_split_to_array(lower(line), '{_BLANK}'), lambda w: w <> '')], ' ') AS line FROM x),
    n AS (SELECT host, count(DISTINCT text) AS of FROM y WHERE line <> '' GROUP BY 1),
    c AS (SELECT host, line, count(*) AS k FROM y WHERE line <> '' GROUP BY ALL)
    SELECT host, count(*) AS n_lines FROM c JOIN n USING (host) WHERE k >= {residue.RECURRENT} AND k >= {residue.RECURRENT_SHARE} * of GROUP BY 1"""

ORACLES: dict[str, str] = {
    "p1_cover": """
        SELECT doc_id, length(max_by(content, ingested_at)) AS n_chars, true AS holds FROM source_documents WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING length(max_by(content, ingested_at)) > 0""",
    "p8_round_trip": "SELECT doc_id, true AS same, coalesce(length(text), 0) AS last_end FROM documents",
    "p3_merged_bounds": """
    WITH v AS (SELECT query_id, query_type, min(execution_time) AS v FROM query_stats WHERE query_id IS NOT NULL AND isfinite(execution_time) AND execution_time >= 0 GROUP BY ALL)
    SELECT query_type, p, count(*) AS n, true AS within FROM v, (SELECT unnest([0.25, 0.5, 0.9, 0.95, 0.99])::DOUBLE AS p) GROUP BY ALL""",
    "p6_groups": _LINKS + " SELECT id AS doc_id, g AS group_id, count(*) OVER (PARTITION BY g) AS n FROM m",
    "p10_recurrent": _RECURRENT,
    "p1_found": """
        SELECT DISTINCT d.doc_id FROM source_documents d LEFT JOIN run_configs c ON c.config_id = coalesce(d.config_id, 'default')
        WHERE d.doc_id IS NOT NULL AND length(d.content) > coalesce(c.chunk_size, 1000)""",
    "p3_label_percentiles": """
    WITH e AS (SELECT point_id, metric, value, unnest(map_entries(labels)) AS e FROM metric_points
               UNION ALL SELECT point_id, metric, value, {'key': 'component', 'value': NULL} FROM metric_points WHERE labels['component'] IS NULL),
    v AS (SELECT point_id, metric, e['key'] AS label_key, e['value'] AS label, min(value) AS v FROM e
          WHERE point_id IS NOT NULL AND isfinite(value) GROUP BY ALL)"""
    + _RANKS.format(g="metric, label_key, label"),
    "p3_metric_percentiles": """
    WITH v AS (SELECT point_id, metric, labels['component'] AS label, min(value) AS v FROM metric_points
               WHERE point_id IS NOT NULL AND isfinite(value) GROUP BY ALL)"""
    + _RANKS.format(g="metric, label"),
    "p3_query_percentiles": """
    WITH v AS (SELECT query_id, query_type, min(execution_time) AS v FROM query_stats
               WHERE query_id IS NOT NULL AND isfinite(execution_time) AND execution_time >= 0 GROUP BY ALL)"""
    + _RANKS.format(g="query_type"),
    "p5_found": """
    WITH e AS (SELECT id, any_value(embedding)::DOUBLE[] AS v FROM embedding_cache WHERE id IS NOT NULL AND len(embedding) = 64 GROUP BY id),
    u AS (SELECT id, v FROM e WHERE list_bool_and([isfinite(x) FOR x IN v]) AND list_bool_or([x <> 0 FOR x IN v])),
    s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
    SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k WHERE s >= 0.80""",
    "p6_found": """
    WITH d AS (SELECT doc_id, any_value(content) AS c FROM source_documents WHERE doc_id IS NOT NULL AND content IS NOT NULL GROUP BY doc_id),
    w AS (SELECT doc_id, regexp_extract_all(lower(c), '[\\p{L}\\p{N}]+') AS w FROM d),
    s AS (SELECT doc_id, unnest(list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)])) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT a AS doc_id_a, b AS doc_id_b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.60 * (x.n + y.n - c)""",
    "p7_found": _SEQUENCES + " SELECT id FROM r WHERE share >= 0.30",
    "p7_shares": _SEQUENCES + " SELECT id, n AS n_sequences, round(share, 6)::DOUBLE AS repeated_share FROM r",
}
