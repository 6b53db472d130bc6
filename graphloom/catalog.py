"""Queries of the engine's operators over the data folder, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import fixtures as X
from graphloom.fixtures import ENT, GEO, OPS, PS, REL, SIM, TRI
from graphloom.functions import text as T
from graphloom.functions import vector as V
from graphloom.operators import events as E
from graphloom.operators import graph as G
from graphloom.operators import ingest as N
from graphloom.operators import iterative as I
from graphloom.operators import paths as P
from graphloom.operators import retrieval as R
from graphloom.operators import summary as S
from graphloom.operators import upserts as U
from graphloom.operators import validation as B
from graphloom.plans import specs
from graphloom.session import read_table as table
from graphloom.sources import documents as D
from graphloom.sources import tables as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# ---- texts, responses and query strings ----

CLEAN = r"trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.,!?-]', '', 'g'))"


@query(r"""WITH t AS (SELECT doc_kind, length(text) AS n, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w, len(regexp_split_to_array(text, '[.!?]+')) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_kind, count(*) AS n_docs, sum(n)::BIGINT AS chars, sum(w)::BIGINT AS words, sum(s)::BIGINT AS sentences FROM t GROUP BY 1""")
def doc_profile(spark, d):
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_kind", T.char_count(F.col("text")).alias("n"), T.word_count(F.col("text")).alias("w"), T.sentence_count(F.col("text")).alias("s"))
    return t.groupBy("doc_kind").agg(F.count("*").alias("n_docs"), F.sum("n").alias("chars"), F.sum("w").alias("words"), F.sum("s").alias("sentences"))


@query(f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def x_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


BLANK = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(rf"""WITH RECURSIVE c AS (
 SELECT doc_id, text, 0 AS s, CASE WHEN length(text) <= 1000 THEN length(text) ELSE coalesce(nullif(length(regexp_extract(substr(text, 2, 1000), '^(?s:.*){BLANK}')), 0), 1000) END AS e FROM documents WHERE length(text) > 0
 UNION ALL
 SELECT doc_id, text, n, CASE WHEN length(text) <= n + 1000 THEN length(text) ELSE n + coalesce(nullif(length(regexp_extract(substr(text, n + 2, 1000), '^(?s:.*){BLANK}')), 0), 1000) END
 FROM (SELECT doc_id, text, CASE WHEN e - 200 > s THEN e - 200 ELSE e END AS n FROM c WHERE e < length(text))),
p AS (SELECT doc_id, regexp_replace(substr(text, s + 1, e - s), '^{BLANK}+|{BLANK}+$', '', 'g') AS chunk_text, s, e FROM c)
SELECT doc_id, 'chunk_' || (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1) AS chunk_id, chunk_text, s::INT AS start_idx, e::INT AS end_idx FROM p WHERE chunk_text <> ''""")
def x_chunks(spark, d):
    return T.chunks(table(spark, d, "documents"))


RESPONSE = "format('Sure.\nEntities:\nPART: {}\nBRAND: {}\n\nRelationships:\n{} - made_by - {}\nnot-a-real-line\n', p_name, p_brand, p_name, replace(p_brand, '#', ' '))"


def _responses(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.format_string("Sure.\nEntities:\nPART: %s\nBRAND: %s\n\nRelationships:\n%s - made_by - %s\nnot-a-real-line\n", "p_name", "p_brand", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("response"))


@query("SELECT p_partkey, unnest([{'type': 'PART', 'text': trim(p_name)}, {'type': 'BRAND', 'text': trim(p_brand)}, {'type': 'Relationships', 'text': ''}], recursive := true) FROM part")
def x_parse_entities(spark, d):
    return _responses(spark, d).select("p_partkey", F.explode(T.parse_entities(F.col("response"))).alias("e")).select("p_partkey", "e.type", "e.text")


@query("""WITH l AS (SELECT p_partkey, string_split(trim(x), '-') AS p FROM (SELECT p_partkey, unnest(string_split(p_name || ' - made_by - ' || replace(p_brand, '#', ' '), '\n')) AS x FROM part))
SELECT p_partkey, trim(p[1]) AS source, trim(p[2]) AS relationship, trim(p[3]) AS target, 0.8::DOUBLE AS confidence FROM l WHERE len(p) = 3""")
def x_parse_relationships(spark, d):
    return _responses(spark, d).select("p_partkey", F.explode(T.parse_relationships(F.col("response"))).alias("r")).select("p_partkey", "r.*")


@query("""WITH c AS (SELECT result_id, coalesce(len(entities), 0) AS n, coalesce(len(relationships), 0) AS r FROM extraction_results GROUP BY ALL)
SELECT result_id, round(CASE WHEN n > 0 THEN (least(1, n / 10) + least(1, r / (n * 0.5))) / 2 ELSE 0 END, 6)::DOUBLE AS confidence FROM c""")
def x_extraction_confidence(spark, d):
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    r = table(spark, d, "extraction_results").select("result_id", size("entities").alias("n"), size("relationships").alias("r")).distinct()
    return r.select("result_id", F.round(T.extraction_confidence(F.col("n"), F.col("r")), 6).alias("confidence"))


@query("""SELECT p_partkey, 'Extract from: ' || p_name || ' of ' || p_brand || '' AS prompt, md5('{"brand":"' || p_brand || '","name":"' || p_name || '"}') AS key, sha256(p_name) AS sha FROM part""")
def x_prompts_and_keys(spark, d):
    p = table(spark, d, "part")
    prompt = T.fill_template("Extract from: {name} of {brand}", name=F.col("p_name"), brand=F.col("p_brand"))
    return p.select("p_partkey", prompt.alias("prompt"), F.md5(T.sorted_json(name=F.col("p_name"), brand=F.col("p_brand"))).alias("key"), F.sha2("p_name", 256).alias("sha"))


QTEXT = "CASE (query_id % 5)::INT WHEN 0 THEN 'MATCH (n:' || coalesce(query_type, 'X') || ') WHERE n.size > ' || nodes_accessed || ' RETURN n, COUNT(n)' WHEN 1 THEN 'match  (a)-[r]-(b) return a, b limit 5' WHEN 2 THEN 'RETURN shortest  path' WHEN 3 THEN 'WITH x ORDER BY x.id RETURN account' ELSE 'CALL subgraph($depth: 3, $size = 2.5)' END"


def _query_strings(spark, d):
    q = table(spark, d, "query_stats").select("query_id", "query_type", "nodes_accessed").distinct()
    m = F.col("query_id") % 5
    text = (
        F.when(m == 0, F.concat(F.lit("MATCH (n:"), F.coalesce("query_type", F.lit("X")), F.lit(") WHERE n.size > "), F.col("nodes_accessed").cast("string"), F.lit(" RETURN n, COUNT(n)")))
        .when(m == 1, F.lit("match  (a)-[r]-(b) return a, b limit 5")).when(m == 2, F.lit("RETURN shortest  path")).when(m == 3, F.lit("WITH x ORDER BY x.id RETURN account")).otherwise(F.lit("CALL subgraph($depth: 3, $size = 2.5)"))
    )
    return q.select("query_id", text.alias("q"))


@query(f"""WITH s AS (SELECT DISTINCT query_id, {QTEXT} AS q FROM query_stats), u AS (SELECT query_id, upper(regexp_replace(trim(q), '\\s+', ' ', 'g')) AS q FROM s)
SELECT CASE WHEN regexp_matches(q, 'MATCH.*WHERE') THEN 'pattern_matching' WHEN regexp_matches(q, 'PATH|SHORTEST') THEN 'path_finding' WHEN regexp_matches(q, 'COUNT|SUM|AVG') THEN 'aggregation'
 WHEN regexp_matches(q, 'SUBGRAPH') THEN 'subgraph' WHEN regexp_matches(q, 'MATCH.*RETURN') THEN 'entity_search' ELSE 'custom' END AS kind,
 round(1 + CASE WHEN contains(q, 'MATCH') THEN 1 ELSE 0 END + CASE WHEN contains(q, 'WHERE') THEN 0.5 ELSE 0 END + CASE WHEN contains(q, 'WITH') THEN 0.3 ELSE 0 END + CASE WHEN contains(q, 'ORDER BY') THEN 2 ELSE 0 END + CASE WHEN contains(q, 'RETURN') THEN 0.1 ELSE 0 END, 2)::DOUBLE AS cost,
 contains(q, 'RETURN') AND NOT contains(q, 'LIMIT') AS needs_limit, count(*) AS n FROM u GROUP BY ALL""")
def x_query_classes(spark, d):
    q = _query_strings(spark, d)
    return q.select(T.query_type(F.col("q")).alias("kind"), F.round(T.query_cost(F.col("q")), 2).alias("cost"), T.needs_limit(F.col("q")).alias("needs_limit")).groupBy("kind", "cost", "needs_limit").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT DISTINCT query_id, {QTEXT} AS q FROM query_stats), p AS (SELECT query_id, regexp_extract_all(q, '\\$(\\w+)\\s*[:=]\\s*(-?\\d+(?:\\.\\d+)?)', 1) AS k, regexp_extract_all(q, '\\$(\\w+)\\s*[:=]\\s*(-?\\d+(?:\\.\\d+)?)', 2) AS v FROM s)
SELECT name, value, count(*) AS n FROM (SELECT unnest(k) AS name, unnest(v)::DOUBLE AS value FROM p) GROUP BY ALL""")
def x_query_parameters(spark, d):
    q = _query_strings(spark, d).select(F.explode(T.query_numbers(F.col("q"))).alias("name", "value"))
    return q.groupBy("name", "value").agg(F.count("*").alias("n"))


# The five texts of QTEXT have these parts: a pattern, a condition and two items; a pattern and two items; an item; an item; none.
@query("SELECT DISTINCT query_id, [1, 1, 0, 0, 0][query_id % 5 + 1]::INT AS patterns, [1, 0, 0, 0, 0][query_id % 5 + 1]::INT AS conditions, [2, 2, 1, 1, 0][query_id % 5 + 1]::INT AS items FROM query_stats")
def x_query_components(spark, d):
    c = _query_strings(spark, d).select("query_id", T.query_components(F.col("q")).alias("c"))
    return c.select("query_id", F.size("c.patterns").alias("patterns"), F.size("c.conditions").alias("conditions"), F.size("c.items").alias("items"))


@query("SELECT DISTINCT query_id, 'tenant' AS name, coalesce(tenant, '') AS value FROM query_stats WHERE query_id IS NOT NULL UNION ALL SELECT DISTINCT query_id, 'kind', query_type FROM query_stats WHERE query_id IS NOT NULL AND query_type IS NOT NULL")
def x_query_strings(spark, d):
    """Quoted parameters of query strings."""
    q = table(spark, d, "query_stats").filter("query_id IS NOT NULL").select("query_id", "tenant", "query_type").distinct()
    text = F.concat(F.lit("CALL stats($tenant: '"), F.coalesce("tenant", F.lit("")), F.lit("', $n = 4"), F.coalesce(F.concat(F.lit(', $kind = "'), F.col("query_type"), F.lit('"')), F.lit("")), F.lit(")"))
    return q.select("query_id", F.explode(T.query_strings(text)).alias("name", "value"))


@query("""SELECT query_id, CASE WHEN s < 1000 AND h > 0.7 THEN 'full' WHEN s < 1000 AND h > 0.3 THEN 'partial' WHEN q THEN 'stream' ELSE 'none' END AS strategy, least(60, pow(2, query_id % 9))::DOUBLE AS backoff
FROM (SELECT DISTINCT query_id, nodes_accessed AS s, cache_hits / nullif(nodes_accessed, 0) AS h, coalesce(index_hits = 0, false) AS q FROM query_stats)""")
def x_cache_strategy(spark, d):
    q = table(spark, d, "query_stats").select("query_id", F.col("nodes_accessed").alias("s"), F.try_divide("cache_hits", "nodes_accessed").alias("h"), F.coalesce(F.col("index_hits") == 0, F.lit(False)).alias("q")).distinct()
    return q.select("query_id", T.cache_strategy(F.col("s"), F.col("h"), F.col("q")).alias("strategy"), T.backoff((F.col("query_id") % 9).cast("double")).alias("backoff"))


# ---- sources and sinks ----


@query("SELECT p_partkey, concat_ws(' | ', 'p_partkey: ' || p_partkey, 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_type: ' || p_type, 'p_size: ' || p_size) AS line FROM part")
def s_row_text(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return p.select("p_partkey", D.row_text(p).alias("line"))


@query("SELECT count(*) AS num_rows, 6 AS num_columns, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS columns, 'bigint,string,string,string,int,double' AS data_types FROM part")
def s_profile(spark, d):
    p = D.profile(table(spark, d, "part"))
    return p.select("num_rows", "num_columns", F.array_join("columns", ",").alias("columns"), F.array_join(F.transform("columns", lambda c: F.element_at("data_types", c)), ",").alias("data_types"))


@query(r"""SELECT CASE lower(regexp_extract(source_path, '(\.[^./\\]+)$', 1)) WHEN '.csv' THEN 'csv' WHEN '.docx' THEN 'docx' WHEN '.pdf' THEN 'pdf' END AS reader, count(*) AS n FROM source_documents GROUP BY 1""")
def s_reader_dispatch(spark, d):
    return table(spark, d, "source_documents").groupBy(D.processor_of(F.col("source_path")).alias("reader")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(concat_ws('|', source_path, content)) AS stable_id FROM source_documents GROUP BY ALL")
def s_document_ids(spark, d):
    return table(spark, d, "source_documents").select("doc_id", D.document_id(F.col("source_path"), F.col("content")).alias("stable_id")).distinct()


@query("SELECT id, last_accessed, access_count FROM embedding_cache WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed DESC NULLS LAST) = 1")
def s_embedding_upsert(spark, d):
    return U.latest_by_key(table(spark, d, "embedding_cache").filter("id IS NOT NULL"), "id", "last_accessed").select("id", "last_accessed", "access_count")


@query("""WITH n AS (SELECT DISTINCT doc_id FROM extraction_results), c AS (SELECT DISTINCT doc_id FROM source_documents) SELECT c.doc_id IS NOT NULL AS hit, count(*) AS n FROM n LEFT JOIN c USING (doc_id) GROUP BY 1""")
def j_cache_probe(spark, d):
    """Texts (here ids of documents) looked up in a cache that is keyed by their md5."""
    wanted = table(spark, d, "extraction_results").select(F.col("doc_id").alias("text")).distinct()
    held = table(spark, d, "source_documents").select(F.md5("doc_id").alias("id"), F.array(F.lit(1.0)).alias("embedding")).distinct()
    return K.cached_embeddings(wanted, held).groupBy("hit").agg(F.count("*").alias("n"))


@query("SELECT p_name AS text, p_partkey <= 100 AS hit, CASE WHEN p_partkey <= 100 THEN p_partkey ELSE -length(p_name) END::DOUBLE AS x FROM (SELECT p_name, min(p_partkey) AS p_partkey FROM part WHERE p_name IS NOT NULL GROUP BY 1)")
def j_embeddings(spark, d):
    """Vectors of texts, from the cache where it has them, and else from an encoder that knows their length."""
    names = table(spark, d, "part").filter("p_name IS NOT NULL").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("k"))
    cache = names.filter("k <= 100").select(F.md5("text").alias("id"), F.array(F.col("k").cast("double")).alias("embedding"))
    found = K.embeddings_for(names, cache, lambda texts: [[-float(len(t))] for t in texts])
    return found.select("text", "hit", F.col("embedding")[0].alias("x"))


@query("""WITH c AS (SELECT id, coalesce(access_count, 0) AS n, last_accessed FROM embedding_cache WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_accessed DESC NULLS LAST) = 1)
SELECT id, n + (n >= 3)::INT AS access_count, CASE WHEN n >= 3 THEN TIMESTAMP '2030-01-01' ELSE last_accessed END AS last_accessed FROM c""")
def s_cache_access(spark, d):
    """The cache after its often used entries were looked up once more."""
    c = U.latest_by_key(table(spark, d, "embedding_cache").filter("id IS NOT NULL"), "id", "last_accessed")
    return K.accessed(c, c.filter("access_count >= 3").select("id"), F.lit("2030-01-01").cast("timestamp_ntz")).select("id", "access_count", "last_accessed")


@query("SELECT doc_id, count(*) AS n FROM source_documents GROUP BY 1 HAVING count(*) > 1")
def s_uniqueness(spark, d):
    return B.duplicates(table(spark, d, "source_documents"), "doc_id")


@query("""WITH r AS (SELECT doc_id, max(content IS NOT NULL AND trim(content, ' \n\r\t') <> '') AS ok FROM source_documents GROUP BY 1), x AS (SELECT doc_id, sum(e) AS e, sum(l) AS l FROM (SELECT DISTINCT result_id, doc_id, coalesce(len(entities), 0) AS e, coalesce(len(relationships), 0) AS l FROM extraction_results) GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, coalesce(sum(e), 0)::BIGINT AS entities, coalesce(sum(l), 0)::BIGINT AS relationships FROM r LEFT JOIN x USING (doc_id)""")
def a_processing_summary(spark, d):
    ok = table(spark, d, "source_documents").groupBy("doc_id").agg(F.max(F.coalesce(F.trim(F.col("content"), F.lit(" \n\r\t")) != "", F.lit(False))).alias("success"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    x = table(spark, d, "extraction_results").select("result_id", "doc_id", size("entities").alias("e"), size("relationships").alias("l")).distinct().groupBy("doc_id").agg(F.sum("e").alias("entity_count"), F.sum("l").alias("relationship_count"))
    return D.processing_summary(ok.join(x, "doc_id", "left"))


# ---- lookups and filters ----


@query(with_(ENT) + "SELECT id, type, text FROM ent WHERE id = 'supplier_1'")
def f_entity_by_id(spark, d):
    return X.entities(spark, d).filter(F.col("id") == "supplier_1")


@query(with_(ENT) + "SELECT id, type, text FROM ent WHERE type = 'CUSTOMER' AND contains(text, '7')")
def f_entities(spark, d):
    return X.entities(spark, d).filter((F.col("type") == "CUSTOMER") & F.contains("text", F.lit("7")))


REL_NAMED = "JOIN ent a ON a.id = r.src JOIN ent b ON b.id = r.dst"


@query(with_(ENT, REL) + f"SELECT a.text AS source, r.type AS relationship, b.text AS target, r.confidence FROM rel r {REL_NAMED} WHERE r.confidence >= 0.99 AND r.type = 'supplied_by'")
def f_relationships(spark, d):
    r = X.relationships(spark, d).filter("confidence >= 0.99 AND type = 'supplied_by'")
    e = X.entities(spark, d)
    a, b = e.select(F.col("id").alias("src"), F.col("text").alias("source")), e.select(F.col("id").alias("dst"), F.col("text").alias("target"))
    return r.join(a, "src").join(b, "dst").select("source", F.col("type").alias("relationship"), "target", "confidence")


@query(with_(REL) + "SELECT src AS id, count(*) AS n, count(DISTINCT dst) AS different FROM ways GROUP BY 1")
def f_neighbours(spark, d):
    return G.undirected(X.relationships(spark, d)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("dst").alias("different"))


@query(with_(ENT, REL) + "SELECT w.src AS id, w.type AS relationship, round(w.confidence, 6) AS confidence, e.text AS related FROM ways w JOIN ent e ON e.id = w.dst WHERE w.src IN ('nation_3', 'region_1')")
def f_entity_relationships(spark, d):
    w = G.undirected(X.relationships(spark, d)).filter(F.col("src").isin("nation_3", "region_1"))
    return w.join(X.entities(spark, d).select(F.col("id").alias("dst"), F.col("text").alias("related")), "dst").select(F.col("src").alias("id"), F.col("type").alias("relationship"), F.round("confidence", 6).alias("confidence"), "related")


MEN = "men AS (SELECT 'part_' || l_partkey AS entity_id, 'order_' || l_orderkey AS doc_id, list(DISTINCT 'chunk_' || l_linenumber ORDER BY 'chunk_' || l_linenumber) AS chunks, count(DISTINCT l_linenumber) AS mention_count FROM lineitem GROUP BY 1, 2)"


@query(with_(ENT, MEN) + "SELECT m.doc_id, e.text, e.type, m.mention_count, array_to_string(m.chunks, ',') AS chunks FROM men m JOIN ent e ON e.id = m.entity_id")
def f_document_entities(spark, d):
    m = U.upsert_mentions(X.mention_calls(spark, d))
    e = X.entities(spark, d).select(F.col("id").alias("entity_id"), "text", "type")
    return m.join(e, "entity_id").select("doc_id", "text", "type", "mention_count", F.array_join("chunks", ",").alias("chunks"))


@query(with_(REL) + "SELECT type, count(*) AS n FROM rel WHERE src IN (SELECT 'supplier_' || s_suppkey FROM supplier WHERE s_acctbal > 0) AND dst NOT IN ('nation_1', 'nation_2') GROUP BY 1")
def f_membership(spark, d):
    good = table(spark, d, "supplier").filter("s_acctbal > 0").select(X.ident("supplier", "s_suppkey").alias("src"))
    out = spark.createDataFrame([("nation_1",), ("nation_2",)], "dst string")
    return X.relationships(spark, d).join(good, "src", "left_semi").join(out, "dst", "left_anti").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3")
def f_compiled_filter(spark, d):
    spec = {"c_acctbal": {"ge": 5000}, "c_mktsegment": {"in": ["BUILDING", "MACHINERY"]}, "c_nationkey": {"ne": 3}}
    return table(spark, d, "customer").filter(G.condition(spec)).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (content IS NULL) AS content, count(*) FILTER (source_path IS NULL) AS source_path, count(*) FILTER (config_id IS NULL) AS config_id FROM source_documents")
def f_integrity(spark, d):
    rows = B.integrity(table(spark, d, "source_documents"), ["doc_id", "content", "source_path", "config_id"])
    return rows.groupBy().pivot("column", ["doc_id", "content", "source_path", "config_id"]).agg(F.first("nulls"))


@query(with_(ENT) + "SELECT type, count(*) FILTER (regexp_full_match(id, '[a-zA-Z0-9_-]+')) AS ids_fit, count(*) FILTER (regexp_full_match(text, '[a-zA-Z0-9_-]+')) AS texts_fit FROM ent GROUP BY 1")
def f_id_format(spark, d):
    return X.entities(spark, d).groupBy("type").agg(F.count_if(F.col("id").rlike(T.ID_FORMAT)).alias("ids_fit"), F.count_if(F.col("text").rlike(T.ID_FORMAT)).alias("texts_fit"))


@query("""WITH r AS (SELECT max(last_accessed) AS ref FROM embedding_cache), l AS (SELECT id, max(last_accessed) AS la FROM embedding_cache GROUP BY 1) SELECT count(*) AS kept, (SELECT count(*) FROM l) - count(*) AS expired FROM l, r WHERE la >= ref - INTERVAL 10 DAYS""")
def f_cache_expiry(spark, d):
    c = table(spark, d, "embedding_cache").groupBy("id").agg(F.max("last_accessed").alias("la"))
    ref = c.agg(F.max("la").alias("ref"))
    young = F.count_if(F.col("la") >= F.col("ref") - F.expr("INTERVAL 10 DAYS"))
    return c.join(F.broadcast(ref), F.lit(True)).agg(young.alias("kept"), (F.count("*") - young).alias("expired"))


@query(with_(ENT, MEN) + "SELECT e.id FROM ent e WHERE e.type = 'PART' AND e.id NOT IN (SELECT entity_id FROM men)")
def f_isolated(spark, d):
    return X.entities(spark, d).filter("type = 'PART'").join(X.mention_calls(spark, d).select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")


@query("""WITH r AS (SELECT max(ingested_at) AS ref FROM source_documents), d AS (SELECT doc_id AS id, max(ingested_at) AS la FROM source_documents WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT id FROM d, r WHERE la < ref - INTERVAL 10 DAYS AND id NOT IN (SELECT doc_id FROM extraction_results WHERE doc_id IS NOT NULL AND len(entities) > 0)""")
def f_stale_isolated(spark, d):
    """Documents long not taken in again that no extraction mentions."""
    s = table(spark, d, "source_documents").filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("ingested_at").alias("last_accessed"))
    links = table(spark, d, "extraction_results").filter("doc_id IS NOT NULL AND size(entities) > 0").select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"))
    ref = table(spark, d, "source_documents").agg(F.max("ingested_at").alias("ref"))
    return G.stale_isolated(s, links, ref, 10).select("id")


@query(f"WITH s AS (SELECT DISTINCT query_id, {QTEXT} AS q FROM query_stats) SELECT query_id, len(regexp_extract_all(q, ':\\w+')) AS entities, len(regexp_extract_all(q, '\\w+\\(')) AS functions, len(regexp_extract_all(q, '\\$\\w+')) AS variables FROM s")
def x_query_tokens(spark, d):
    q = _query_strings(spark, d)
    return q.select("query_id", *[F.size(T.query_tokens(F.col("q"), k)).cast("long").alias(n) for k, n in (("entity", "entities"), ("function", "functions"), ("variable", "variables"))])


# ---- joins ----


@query("""SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey WHERE p.p_size > 25""")
def j_point_pairs(spark, d):
    p, s = table(spark, d, "part").filter("p_size > 25"), table(spark, d, "supplier")
    return p.join(s, p["p_partkey"] == s["s_suppkey"]).select("p_partkey", "s_suppkey")


@query(with_(ENT) + "SELECT count(*) AS edges, count(DISTINCT a.id) AS sources FROM (SELECT n_name AS source, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey) t JOIN ent a ON a.text = t.source JOIN ent b ON b.text = t.target")
def j_by_text(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rel = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    return U.edges_by_text(rel, X.entities(spark, d)).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


@query("SELECT s.id, s.level, coalesce(array_to_string(list_sort(list_distinct(s.entities)), ','), '') AS entity_ids FROM (SELECT DISTINCT id, level, entities FROM graph_summaries WHERE id IS NOT NULL) s")
def j_optional_collect(spark, d):
    s = table(spark, d, "graph_summaries").filter("id IS NOT NULL").select("id", "level", "entities").distinct()
    links = s.select(F.col("id").alias("summary_id"), F.explode("entities").alias("entity_id"))
    return S.with_entities(s.select("id", "level"), links).select("id", "level", F.array_join("entity_ids", ",").alias("entity_ids"))


@query(with_(REL) + ", hop AS (SELECT DISTINCT src, dst FROM ways) SELECT count(*) > 0 AS reached FROM (SELECT 1 FROM hop WHERE src = 'nation_1' AND dst = 'nation_2' UNION ALL SELECT 1 FROM hop a JOIN hop b ON a.dst = b.src WHERE a.src = 'nation_1' AND b.dst = 'nation_2')")
def j_two_hops(spark, d):
    return P.within_two_hops(P.costed(X.relationships(spark, d)), "nation_1", "nation_2")


@query(with_(ENT, REL) + """SELECT DISTINCT w1.src AS part, w1.dst AS supplier, w2.dst AS nation FROM ways w1 JOIN ways w2 ON w1.dst = w2.src
JOIN ent p ON p.id = w1.src AND p.type = 'PART' JOIN ent s ON s.id = w1.dst AND s.type = 'SUPPLIER' JOIN ent n ON n.id = w2.dst AND n.type = 'NATION' WHERE w1.type = 'supplied_by' AND w2.type = 'located_in'""")
def j_pattern(spark, d):
    spec = {"pattern": {"nodes": [{"name": "part", "type": "PART"}, {"name": "supplier", "type": "SUPPLIER"}, {"name": "nation", "type": "NATION"}], "edges": ["supplied_by", "located_in"]}}
    return specs.compile_spec(X.graph(spark, d), spec)


@query(with_(SIM) + "SELECT a AS src, b AS dst, round(s, 6) AS sim FROM sim")
def j_similarity(spark, d):
    return X.similar(spark, d).select("src", "dst", F.round("sim", 6).alias("sim"))


@query(with_(REL) + "SELECT src, dst, type FROM rel WHERE src IN (SELECT 'customer_' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND dst IN (SELECT 'nation_' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def j_expansion(spark, d):
    base = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(X.ident("customer", "c_custkey").alias("id"))
    more = table(spark, d, "nation").filter("n_regionkey = 1").select(X.ident("nation", "n_nationkey").alias("id"))
    return R.expansion_edges(X.relationships(spark, d), base, more).select("src", "dst", "type")


# ---- aggregates ----


@query(with_(ENT) + "SELECT type, count(*) AS n FROM ent GROUP BY 1")
def a_entity_types(spark, d):
    return X.entities(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(with_(REL) + "SELECT label, type, count(*) AS n FROM rel GROUP BY ALL")
def a_relationship_types(spark, d):
    return X.relationships(spark, d).groupBy("label", "type").agg(F.count("*").alias("n"))


@query(with_(ENT, REL) + "SELECT (SELECT count(*) FROM ent) AS nodes, (SELECT count(*) FROM rel) AS edges, round((SELECT count(*) FROM rel) / pow((SELECT count(*) FROM ent), 2), 9) AS density")
def a_graph_counts(spark, d):
    n, m = X.entities(spark, d).agg(F.count("*").alias("nodes")), X.relationships(spark, d).agg(F.count("*").alias("edges"))
    return n.join(m, F.lit(True)).withColumn("density", F.round(F.col("edges") / F.pow(F.col("nodes").cast("double"), F.lit(2.0)), 9))


@query("SELECT c_mktsegment, count(*) AS count_c_acctbal, round(avg(c_acctbal), 4) AS avg_c_acctbal FROM customer GROUP BY 1")
def a_spec_grouped(spark, d):
    from types import SimpleNamespace

    g = SimpleNamespace(customers=table(spark, d, "customer"))
    spec = lambda f: {"aggregation": {"function": f, "field": "c_acctbal", "on": "customers", "grouping": ["c_mktsegment"]}}
    a, b = specs.compile_spec(g, spec("count")), specs.compile_spec(g, spec("avg"))
    return a.join(b, "c_mktsegment").withColumn("avg_c_acctbal", F.round("avg_c_acctbal", 4))


@query(with_(ENT, REL) + ", l AS (SELECT DISTINCT src AS id FROM ways) SELECT round(count(l.id) / count(*), 6) AS connectivity, round(2 * count(l.id) / count(*), 6) AS connectivity_raw FROM ent LEFT JOIN l USING (id)")
def a_connectivity(spark, d):
    return G.connectivity(X.entities(spark, d), X.relationships(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("connectivity", "connectivity_raw")])


SUPPLY_GROUPS = "mem AS (SELECT 'supplier_' || s_suppkey AS id, s_nationkey AS community FROM supplier UNION ALL SELECT 'customer_' || c_custkey, c_nationkey FROM customer UNION ALL SELECT 'nation_' || n_nationkey, n_nationkey FROM nation)"


def _groups(spark, d):
    s, c, n = table(spark, d, "supplier"), table(spark, d, "customer"), table(spark, d, "nation")
    rows = [t.select(X.ident(k, key).alias("id"), F.col(g).alias("community")) for t, k, key, g in ((s, "supplier", "s_suppkey", "s_nationkey"), (c, "customer", "c_custkey", "c_nationkey"), (n, "nation", "n_nationkey", "n_nationkey"))]
    return rows[0].union(rows[1]).union(rows[2])


INNER = "inr AS (SELECT a.community, r.* FROM rel r JOIN mem a ON a.id = r.src JOIN mem b ON b.id = r.dst AND b.community = a.community)"


@query(with_(ENT, REL, SUPPLY_GROUPS, INNER) + """, n AS (SELECT community, count(*) AS node_count, count(*) FILTER (type = 'SUPPLIER') AS supplier_count, count(*) FILTER (type = 'CUSTOMER') AS customer_count FROM mem LEFT JOIN ent USING (id) GROUP BY 1)
SELECT n.*, coalesce(e, 0) AS internal_edges, round(coalesce(e, 0) / (node_count * (node_count - 1)), 8) AS density, round(2 * coalesce(e, 0) / node_count, 8) AS avg_degree FROM n LEFT JOIN (SELECT community, count(*) AS e FROM inr GROUP BY 1) USING (community)""")
def a_community_statistics(spark, d):
    s = G.community_statistics(X.entities(spark, d), X.relationships(spark, d), _groups(spark, d), ("SUPPLIER", "CUSTOMER"))
    return s.withColumn("density", F.round("density", 8)).withColumn("avg_degree", F.round("avg_degree", 8))


@query(with_(ENT, REL, SUPPLY_GROUPS, INNER) + """, n AS (SELECT community, count(*) AS size FROM mem GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT community, count(*) AS e FROM inr GROUP BY 1),
nt AS (SELECT community, string_agg(type || ':' || n, ',' ORDER BY type) AS node_types FROM (SELECT community, type, count(*) AS n FROM mem JOIN ent USING (id) GROUP BY ALL) GROUP BY 1),
et AS (SELECT community, string_agg(type || ':' || n, ',' ORDER BY type) AS edge_types FROM (SELECT community, type, count(*) AS n FROM inr GROUP BY ALL) GROUP BY 1)
SELECT 'comm_' || (row_number() OVER (ORDER BY size DESC, n.community) - 1) AS comm_id, n.community, size, round(coalesce(e, 0) / (size * (size - 1)), 8) AS density, round(2 * coalesce(e, 0) / size, 8) AS avg_degree, node_types, edge_types FROM n LEFT JOIN e USING (community) LEFT JOIN nt USING (community) LEFT JOIN et USING (community)""")
def a_community_objects(spark, d):
    c = G.community_objects(X.entities(spark, d), X.relationships(spark, d), _groups(spark, d))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias(m)
    return c.select("comm_id", "community", "size", F.round("density", 8).alias("density"), F.round("avg_degree", 8).alias("avg_degree"), flat("node_types"), flat("edge_types"))


@query(with_(REL, SUPPLY_GROUPS, INNER) + """, e AS (SELECT community, src AS id FROM inr UNION ALL SELECT community, dst FROM inr), g AS (SELECT community, id, count(*) AS degree FROM e GROUP BY ALL)
SELECT community, id, degree FROM g QUALIFY row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) <= 3""")
def a_community_centers(spark, d):
    return G.community_center(X.relationships(spark, d), _groups(spark, d), 3).drop("place")


@query(with_(REL) + ", s AS (SELECT 'nation_' || n_nationkey AS id FROM nation WHERE n_regionkey = 2) SELECT dst AS id, count(*) AS connections FROM ways WHERE src IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM s) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def a_connected_outside(spark, d):
    seeds = table(spark, d, "nation").filter("n_regionkey = 2").select(X.ident("nation", "n_nationkey").alias("id"))
    return R.connected_outside(X.relationships(spark, d), seeds)


@query(with_(REL) + "SELECT coalesce(i.id, o.id) AS id, coalesce(ni, 0) AS in_degree, coalesce(no, 0) AS out_degree FROM (SELECT dst AS id, count(*) AS ni FROM rel GROUP BY 1) i FULL JOIN (SELECT src AS id, count(*) AS no FROM rel GROUP BY 1) o ON i.id = o.id")
def a_in_out_degree(spark, d):
    return G.in_out_degree(X.relationships(spark, d))


@query(with_(SUPPLY_GROUPS, ENT, REL) + ", c AS (SELECT community, count(*) AS s FROM mem GROUP BY 1) SELECT (SELECT count(*) FROM ent) AS total_nodes, (SELECT count(*) FROM rel) AS total_edges, count(*) AS n_communities, round(avg(s), 6) AS avg_size, max(s) AS max_size FROM c")
def a_global_statistics(spark, d):
    return S.global_statistics(X.entities(spark, d), X.relationships(spark, d), _groups(spark, d)).withColumn("avg_size", F.round("avg_size", 6))


@query(with_(OPS) + "SELECT count(*) AS total, round(avg(success::INT), 6) AS success_rate, round(avg((NOT success)::INT), 6) AS error_rate, round(avg(duration), 6) AS avg_time, round(avg((user_id % 3 > 0)::INT), 6) AS retry_rate FROM ops")
def a_operation_metrics(spark, d):
    m = E.operation_metrics(X.operations(spark, d).withColumn("retries", F.col("user_id") % 3))
    return m.select("total", *[F.round(c, 6).alias(c) for c in ("success_rate", "error_rate", "avg_time", "retry_rate")])


@query(with_(OPS) + "SELECT op_type, count(duration) AS n, round(avg(duration), 6) AS mean, min(duration) AS low, max(duration) AS high, round(stddev_pop(duration), 6) AS std FROM ops GROUP BY 1")
def a_metric_statistics(spark, d):
    s = E.statistics(X.operations(spark, d), ["op_type"], "duration")
    return s.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("""SELECT n, round(CASE WHEN n < 2 OR s = 0 THEN 0 ELSE n * 60 / s END, 6)::DOUBLE AS per_minute FROM (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM events WHERE event_type = 'error')""")
def a_error_rate(spark, d):
    return E.errors_per_minute(X.operations(spark, d).filter("NOT success")).withColumn("per_minute", F.round("per_minute", 6))


@query(with_(OPS) + "SELECT op_type, count(*) AS n, max_by(event_id, (ts, event_id)) AS latest FROM ops GROUP BY 1")
def a_latest_by_type(spark, d):
    return X.operations(spark, d).groupBy("op_type").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("SELECT round(avg(CASE WHEN cache_hits > 0 THEN 1 ELSE 0 END), 6) AS l1_rate, round(avg(CASE WHEN coalesce(cache_hits, 0) <= 0 AND index_hits > 0 THEN 1 ELSE 0 END), 6) AS l2_rate, round(avg(CASE WHEN cache_hits > 0 OR index_hits > 0 THEN 1 ELSE 0 END), 6) AS total_rate FROM (SELECT DISTINCT query_id, cache_hits, index_hits FROM query_stats)")
def a_hit_rates(spark, d):
    q = table(spark, d, "query_stats").select("query_id", "cache_hits", "index_hits").distinct()
    h = E.hit_rates(q.select(F.when(F.col("cache_hits") > 0, 1).when(F.col("index_hits") > 0, 2).alias("level")))
    return h.select(*[F.round(c, 6).alias(c) for c in h.columns])


@query("""WITH q AS (SELECT DISTINCT query_type, query_id, execution_time FROM query_stats WHERE execution_time >= 0 AND query_type IS NOT NULL AND isfinite(execution_time)), k AS (SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY query_id DESC) AS k FROM q)
SELECT query_type, count(*) AS n, round(sum(0.1 * pow(0.9, k - 1) * execution_time), 6) AS ema FROM k GROUP BY 1""")
def a_moving_average(spark, d):
    q = table(spark, d, "query_stats").filter("execution_time >= 0 AND query_type IS NOT NULL AND NOT isnan(execution_time) AND execution_time < double('infinity')").select("query_type", "query_id", "execution_time").distinct()
    return E.moving_average(q, "query_type", "query_id", "execution_time").withColumn("ema", F.round("ema", 6))


@query("SELECT round(avg((least(1, n / 100) + CASE WHEN n > 1 THEN e / (n * (n - 1)) ELSE 0 END) / 2), 9) AS confidence FROM (SELECT coalesce(len(entities), 0) AS n, coalesce(len(relationships), 0) AS e FROM (SELECT DISTINCT id, entities, relationships FROM graph_summaries))")
def a_subgraph_confidence(spark, d):
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    s = table(spark, d, "graph_summaries").select("id", "entities", "relationships").distinct().select(size("entities").alias("n_nodes"), size("relationships").alias("n_edges"))
    return R.subgraph_confidence(s).withColumn("confidence", F.round("confidence", 9))


# ---- upserts ----

NAMED = "e AS (SELECT DISTINCT result_id, unnest(entities) AS e FROM extraction_results), ex AS (SELECT e.type AS type, e.text AS text FROM e WHERE e.text IS NOT NULL)"


def _extracted(spark, d):
    r = table(spark, d, "extraction_results").select("result_id", "entities").distinct()
    return r.select("result_id", F.explode("entities").alias("e")).distinct().select("e.type", "e.text", F.current_timestamp().alias("ts")).filter("text IS NOT NULL")


@query(with_(NAMED) + "SELECT type, text, md5(concat_ws('#', type, text)) AS id, count(*) AS occurrence_count FROM ex GROUP BY ALL")
def u_entities(spark, d):
    return U.upsert_entities(_extracted(spark, d)).select("type", "text", "id", "occurrence_count")


@query("SELECT 'customer_' || o_custkey AS id, CASE WHEN count(*) > 1 THEN count(*) - 1 END AS update_count, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS priority, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def u_entities_by_id(spark, d):
    o = table(spark, d, "orders")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    changes = o.select(X.ident("customer", "o_custkey").alias("id"), F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")).alias("properties"), seq.alias("seq"), F.col("o_orderdate").alias("ts"))
    s = U.upsert_entities_by_id(changes)
    return s.select("id", "update_count", F.col("properties")["priority"].alias("priority"), F.col("properties")["status"].alias("status"))


@query(with_(MEN) + "SELECT entity_id, doc_id, array_to_string(chunks, ',') AS chunks, mention_count FROM men")
def u_mentions(spark, d):
    return U.upsert_mentions(X.mention_calls(spark, d)).select("entity_id", "doc_id", F.array_join("chunks", ",").alias("chunks"), "mention_count")


@query(with_(PS) + "SELECT src, dst, type, confidence, occurrence_count FROM ps")
def u_relationships(spark, d):
    li = table(spark, d, "lineitem").select(X.ident("part", "l_partkey").alias("src"), X.ident("supplier", "l_suppkey").alias("dst"), F.lit("supplied_by").alias("type"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_shipdate").alias("ts"))
    return U.upsert_relationships(li).drop("created_at")


@query("SELECT c_custkey AS id, c_name, CASE WHEN c_nationkey < 5 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 7")
def u_update_delete(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal", "c_nationkey")
    changed = U.update(c, c.filter("c_nationkey < 5").select("id", F.lit(0.0).alias("c_acctbal")))
    none = spark.createDataFrame([], "src bigint, dst bigint")
    return U.delete(changed, c.filter("c_nationkey = 7").select("id"), none)[0].drop("c_nationkey")


@query(with_(ENT, REL) + ", gone AS (SELECT 'supplier_' || s_suppkey AS id FROM supplier WHERE s_nationkey IN (3, 4)) SELECT 'node' AS kind, type, count(*) AS n FROM ent WHERE id NOT IN (SELECT id FROM gone) GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM rel WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY ALL")
def u_delete_cascade(spark, d):
    gone = table(spark, d, "supplier").filter("s_nationkey IN (3, 4)").select(X.ident("supplier", "s_suppkey").alias("id"))
    left, edges = U.delete(X.entities(spark, d), gone, X.relationships(spark, d), cascade=True)
    return left.groupBy(F.lit("node").alias("kind"), "type").agg(F.count("*").alias("n")).union(edges.groupBy(F.lit("edge").alias("kind"), "type").agg(F.count("*").alias("n")))


@query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN 'update' WHEN 1 THEN 'delete' WHEN 2 THEN 'create' WHEN 3 THEN 'merge' ELSE 'fly' END AS op FROM customer)
SELECT 'c' || c_custkey AS id, CASE WHEN op IN ('update', 'merge') THEN 'changed' ELSE c_name END AS name, c_mktsegment AS segment FROM c WHERE op <> 'delete' UNION ALL SELECT 'n' || c_custkey, c_name, NULL FROM c WHERE op = 'create'""")
def u_operations(spark, d):
    """A batch of operations of all kinds; creates of ids that are there fail and leave them as they are."""
    c = table(spark, d, "customer")
    rows = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    kind = F.element_at(F.array(*map(F.lit, ("update", "delete", "create", "merge", "fly"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    named = lambda prefix, value: (F.concat(F.lit(prefix), F.col("c_custkey").cast("string")).alias("id"), F.create_map(F.lit("name"), value).alias("data"))
    ops = c.select((F.col("c_custkey") * 2).alias("seq"), kind.alias("operation"), *named("c", F.lit("changed")))
    more = c.filter("c_custkey % 5 = 2").select((F.col("c_custkey") * 2 + 1).alias("seq"), F.lit("create").alias("operation"), *named("n", F.col("c_name")))
    return N.apply_operations(rows, spark.createDataFrame([], "src string, dst string"), ops.union(more))[0]


CHUNKS = rf"""c AS (
 SELECT doc_id, text, 0 AS s, CASE WHEN length(text) <= 1000 THEN length(text) ELSE coalesce(nullif(length(regexp_extract(substr(text, 2, 1000), '^(?s:.*){BLANK}')), 0), 1000) END AS e FROM documents WHERE length(regexp_replace(text, '{BLANK}', '', 'g')) > 0
 UNION ALL
 SELECT doc_id, text, n, CASE WHEN length(text) <= n + 1000 THEN length(text) ELSE n + coalesce(nullif(length(regexp_extract(substr(text, n + 2, 1000), '^(?s:.*){BLANK}')), 0), 1000) END
 FROM (SELECT doc_id, text, CASE WHEN e - 200 > s THEN e - 200 ELSE e END AS n FROM c WHERE e < length(text))),
k AS (SELECT doc_id, s, regexp_replace(substr(text, s + 1, e - s), '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM c),
w AS (SELECT doc_id, s, regexp_extract(t, '[A-Za-z]+') AS a, regexp_extract(t, '^(?s:.*)([^A-Za-z]|^)([A-Za-z]+)', 2) AS z FROM k WHERE t <> '')"""
INGEST = f"WITH RECURSIVE {CHUNKS}, x AS (SELECT doc_id, s, unnest(list_distinct([struct_pack(type := 'FIRST', text := a), struct_pack(type := 'LAST', text := z)])) AS e FROM w), m AS (SELECT doc_id, s, e.type AS type, e.text AS text FROM x WHERE e.text <> '') "


def _ingested(spark, d):
    """The documents taken in with an extractor that names the first and the last word of each chunk."""

    def extractor(t):
        first, last = F.regexp_extract(t, "[A-Za-z]+", 0), F.regexp_extract(t, r"(?s)^.*(?:[^A-Za-z]|^)([A-Za-z]+)", 1)
        return F.concat(F.lit("Entities:\nFIRST: "), first, F.lit("\nLAST: "), last, F.lit("\n\nRelationships:\n"), first, F.lit(" - precedes - "), last)

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("error"), F.col("ingested_at").cast("timestamp").alias("ts"))
    return N.ingest(docs, extractor)


@query(INGEST + "SELECT type, text, md5(type || '#' || text) AS id, count(*) AS occurrence_count FROM m GROUP BY ALL")
def u_ingest_entities(spark, d):
    return _ingested(spark, d)["entities"].select("type", "text", "id", "occurrence_count")


@query(INGEST + """, e AS (SELECT DISTINCT type, text FROM m), r AS (SELECT a, z FROM w WHERE a <> '' AND z <> '')
SELECT md5(x.type || '#' || x.text) AS src, md5(y.type || '#' || y.text) AS dst, 'precedes' AS type, 0.8::DOUBLE AS confidence, count(*) AS occurrence_count FROM r JOIN e x ON x.text = a JOIN e y ON y.text = z GROUP BY ALL""")
def u_ingest_relationships(spark, d):
    return _ingested(spark, d)["relationships"].drop("created_at")


@query(INGEST + """, n AS (SELECT doc_id, count(*) AS chunk_count FROM w GROUP BY 1)
SELECT d.doc_id::VARCHAR AS doc_id, n.doc_id IS NOT NULL AS success, CASE WHEN n.doc_id IS NULL THEN 'no content' END AS error, coalesce(chunk_count, 0) AS chunk_count, 3 * coalesce(chunk_count, 0) AS entity_count, coalesce(chunk_count, 0) AS relationship_count FROM documents d LEFT JOIN n USING (doc_id)""")
def u_ingest_status(spark, d):
    """The line that opens the relationships is read as an entity without text too; it counts here, and is refused by validation."""
    return _ingested(spark, d)["status"].drop("confidence")


@query("SELECT sum(coalesce(len(entities), 0))::BIGINT AS entity_count, sum(coalesce(len(relationships), 0))::BIGINT AS relationship_count, sum(ceil(coalesce(len(entities), 0) / 1000))::BIGINT AS batch_count FROM extraction_results")
def u_ingest_metrics(spark, d):
    return U.ingest_metrics(table(spark, d, "extraction_results"))


# ---- sorts, top-k, sets ----


@query(with_(REL) + "SELECT id, degree FROM (SELECT src AS id, count(DISTINCT dst) AS degree FROM ways GROUP BY 1) ORDER BY degree DESC, id LIMIT 10")
def t_hubs(spark, d):
    return G.degrees(G.simple(X.relationships(spark, d))).orderBy(F.desc("degree"), "id").limit(10)


@query(with_(REL) + ", g AS (SELECT src AS id, count(DISTINCT dst) AS degree FROM ways GROUP BY 1) SELECT id, degree FROM g WHERE degree >= (SELECT quantile_cont(degree, 0.9) FROM g)")
def t_above_percentile(spark, d):
    g = G.degrees(G.simple(X.relationships(spark, d)))
    return g.join(F.broadcast(g.agg(F.percentile("degree", F.lit(0.9)).alias("p"))), F.lit(True)).filter("degree >= p").drop("p")  # one row


@query(with_(SUPPLY_GROUPS) + "SELECT community, count(*) AS size FROM mem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def t_top_communities(spark, d):
    return S.top_communities(_groups(spark, d))


@query("WITH r AS (SELECT max(ts) AS ref FROM events) SELECT event_id, ts FROM events, r WHERE event_type = 'error' AND ts >= ref - INTERVAL 60 MINUTES")
def t_recent_errors(spark, d):
    e = table(spark, d, "events")
    ref = e.agg(F.max("ts").alias("ref"))
    return e.filter("event_type = 'error'").join(F.broadcast(ref), F.lit(True)).filter(F.col("ts") >= F.col("ref") - F.expr("INTERVAL 60 MINUTES")).select("event_id", "ts")


@query(with_(PS) + "SELECT count(*) AS kept, round(min(confidence), 6) AS weakest FROM (SELECT * FROM ps ORDER BY confidence, src, dst, type OFFSET (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM ps))")
def t_drop_weakest(spark, d):
    return G.drop_weakest(X.supplied(spark, d), 0.3).agg(F.count("*").alias("kept"), F.round(F.min("confidence"), 6).alias("weakest"))


@query("SELECT min_by(id, (coalesce(la, ca), id)) AS key FROM (SELECT id, max(last_accessed) AS la, max(created_at) AS ca FROM embedding_cache GROUP BY 1)")
def t_lru_victim(spark, d):
    return E.lru_victim(table(spark, d, "embedding_cache").groupBy(F.col("id").alias("key")).agg(F.max("last_accessed").alias("last_accessed"), F.max("created_at").alias("created_at")))


@query("""WITH f AS (SELECT doc_id AS key, max(ingested_at) AS mtime, max(length(coalesce(content, ''))) AS size FROM source_documents GROUP BY 1), r AS (SELECT *, sum(size) OVER (ORDER BY mtime, key) - size AS gone FROM f)
SELECT key, mtime, size FROM r WHERE gone < (SELECT sum(size) FROM f) - 1000000""")
def t_evicted(spark, d):
    f = table(spark, d, "source_documents").groupBy(F.col("doc_id").alias("key")).agg(F.max("ingested_at").alias("mtime"), F.max(F.length(F.coalesce("content", F.lit("")))).alias("size"))
    return E.evicted(f, 1_000_000)


@query(with_(SIM) + """, n AS (SELECT src, list(dst ORDER BY dst) AS l FROM sw GROUP BY 1)
SELECT a, b, round(len(list_intersect(x.l, y.l)) / len(list_distinct(list_concat(x.l, y.l))), 6) AS jaccard FROM sim JOIN n x ON x.src = a JOIN n y ON y.src = b""")
def t_neighbour_sets(spark, d):
    return G.edge_similarity(X.sim_edges(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT doc_id, ingested_at FROM source_documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) > 1")
def t_redundant(spark, d):
    w = Window.partitionBy("doc_id").orderBy(F.desc("ingested_at"))
    return table(spark, d, "source_documents").select("doc_id", "ingested_at").withColumn("k", F.row_number().over(w)).filter("k > 1").drop("k")


# ---- graph algorithms ----


@query(with_(REL) + ", g AS (SELECT src AS id, count(DISTINCT dst) AS d FROM ways GROUP BY 1) SELECT id, round(d / ((SELECT count(*) FROM g) - 1), 9) AS degree_centrality FROM g")
def g_degree_centrality(spark, d):
    return G.degree_centrality(G.simple(X.relationships(spark, d))).withColumn("degree_centrality", F.round("degree_centrality", 9))


@query(with_(SIM, TRI) + ", t AS (SELECT id, count(*) AS t FROM (SELECT unnest([x, y, z]) AS id FROM tri) GROUP BY 1) SELECT id, round(CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (d * (d - 1)) END, 9)::DOUBLE AS clustering FROM sd LEFT JOIN t USING (id)")
def g_clustering(spark, d):
    return G.clustering(X.sim_edges(spark, d)).withColumn("clustering", F.round("clustering", 9))


@query(with_(SIM, TRI) + "SELECT x, y, z FROM tri")
def g_triangles(spark, d):
    return G.triangles(X.sim_edges(spark, d))


@query(with_(SIM, TRI) + ", n AS (SELECT 3 * (SELECT count(*) FROM tri) AS t, (SELECT sum(d * (d - 1) // 2) FROM sd)::BIGINT AS w) SELECT 'triangle' AS motif, t AS n FROM n WHERE t > 0 UNION ALL SELECT 'v_shape', w - t FROM n WHERE w > t")
def g_motifs(spark, d):
    return G.motifs(X.sim_edges(spark, d))


@query(with_(REL) + ", s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM rel), n AS (SELECT count(DISTINCT src) AS n FROM ways) SELECT n AS n_nodes, (SELECT count(*) FROM s) AS n_edges, round(2 * (SELECT count(*) FROM s) / (n * (n - 1)), 9) AS density FROM n")
def g_density(spark, d):
    return G.density(G.simple(X.relationships(spark, d))).withColumn("density", F.round("density", 9))


@query(with_(SIM) + "SELECT round(corr(x.d, y.d), 6) AS assortativity FROM sw JOIN sd x ON x.id = src JOIN sd y ON y.id = dst")
def g_assortativity(spark, d):
    return G.assortativity(X.sim_edges(spark, d)).withColumn("assortativity", F.round("assortativity", 6))


@query(with_(SIM) + """, t AS (SELECT label, sum(d) AS d FROM sd JOIN embeddings ON vec_id = id GROUP BY 1), i AS (SELECT x.label, count(*) AS l FROM sim JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b AND y.label = x.label GROUP BY 1), m AS (SELECT count(*) AS m FROM sim)
SELECT round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 9) AS modularity FROM t LEFT JOIN i USING (label), m""")
def g_modularity(spark, d):
    m = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"))
    return G.modularity(X.sim_edges(spark, d), m).withColumn("modularity", F.round("modularity", 9))


def rounds(n: int, first: str, step: str) -> str:
    """n + 1 common tables r0 ... rn, each made from the one before (named in ``step`` as {last})."""
    parts = [f"r0 AS MATERIALIZED ({first})"]
    parts += [f"r{i} AS MATERIALIZED ({step.format(last=f'r{i - 1}')})" for i in range(1, n + 1)]
    return ", ".join(parts)


@query(with_(SIM, rounds(24, "SELECT id, id AS c FROM sd", "SELECT l.id, least(l.c, min(m.c)) AS c FROM {last} l JOIN sw ON sw.src = l.id JOIN {last} m ON m.id = sw.dst GROUP BY l.id, l.c")) + "SELECT id, c AS component FROM r24")
def g_components(spark, d):
    return I.components(X.sim_edges(spark, d))


@query(with_(REL, rounds(12, "SELECT DISTINCT src AS id, src AS c FROM ways", "SELECT l.id, least(l.c, min(m.c)) AS c FROM {last} l JOIN ways ON ways.src = l.id JOIN {last} m ON m.id = ways.dst GROUP BY l.id, l.c")) + "SELECT c AS component, count(*) AS n FROM r12 GROUP BY 1")
def g_components_of_all(spark, d):
    return I.components(G.simple(X.relationships(spark, d))).groupBy("component").agg(F.count("*").alias("n"))


RANKS = ("s AS MATERIALIZED (SELECT DISTINCT src, dst FROM {w})", "g AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM s GROUP BY 1)", rounds(60, "SELECT id, 1.0 / (SELECT count(*) FROM g) AS r FROM g", "SELECT s.dst AS id, 0.15 / (SELECT count(*) FROM g) + 0.85 * sum(p.r / g.d) AS r FROM s JOIN {last} p ON p.id = s.src JOIN g ON g.id = s.src GROUP BY 1"))
# The first round whose total change is below a millionth for each node.
LAST_RANK = "chg AS (" + " UNION ALL ".join(f"SELECT {i} AS i, (SELECT sum(abs(x.r - y.r)) FROM r{i} x JOIN r{i - 1} y USING (id)) AS c" for i in range(1, 61)) + "), stop AS (SELECT min(i) AS i FROM chg WHERE c < 1e-6 * (SELECT count(*) FROM g)), pr AS (" + " UNION ALL ".join(f"SELECT id, r FROM r{i}, stop WHERE stop.i = {i}" for i in range(1, 61)) + ")"


@query(with_(REL, RANKS[0].replace("{w}", "ways"), *RANKS[1:], LAST_RANK) + "SELECT id, round(r, 9) AS rank FROM pr")
def g_pagerank(spark, d):
    return I.pagerank(G.simple(X.relationships(spark, d))).withColumn("rank", F.round("rank", 9))


@query(with_(SIM, rounds(200, "SELECT id, 1.0::DOUBLE AS x FROM sd", "SELECT l.id, (sum(m.x) + l.x) / 4 AS x FROM {last} l JOIN sw ON sw.dst = l.id JOIN {last} m ON m.id = sw.src GROUP BY l.id, l.x")) + "SELECT id, round(x / (SELECT sqrt(sum(x * x)) FROM r200), 6) AS centrality FROM r200")
def g_eigenvector(spark, d):
    """To convergence: 200 rounds at most, fewer where five rounds change less than 1e-12 for each node."""
    return I.eigenvector(X.sim_edges(spark, d), 200, 1e-12).withColumn("centrality", F.round("centrality", 6))


@query(with_(SIM, rounds(14, "SELECT id, d AS c FROM sd", "SELECT id, max(least(c, k)) AS c FROM (SELECT sw.src AS id, least(m.c, l.c) AS c, row_number() OVER (PARTITION BY sw.src ORDER BY least(m.c, l.c) DESC) AS k FROM sw JOIN {last} l ON l.id = sw.src JOIN {last} m ON m.id = sw.dst) GROUP BY 1")) + "SELECT id, c::INT AS core FROM r14")
def g_core_numbers(spark, d):
    return I.core_numbers(X.sim_edges(spark, d))


@query(with_(REL, "s AS MATERIALIZED (SELECT DISTINCT src, dst FROM ways)", rounds(14, "SELECT src AS id, count(*) AS c FROM s GROUP BY 1", "SELECT id, max(least(c, k)) AS c FROM (SELECT s.src AS id, least(m.c, l.c) AS c, row_number() OVER (PARTITION BY s.src ORDER BY least(m.c, l.c) DESC) AS k FROM s JOIN {last} l ON l.id = s.src JOIN {last} m ON m.id = s.dst) GROUP BY 1")) + "SELECT id, c::INT AS core FROM r14")
def g_core_numbers_of_all(spark, d):
    return I.core_numbers(G.simple(X.relationships(spark, d)))


@query(with_(SIM, rounds(5, "SELECT id, id AS c FROM sd", "SELECT id, c FROM (SELECT sw.src AS id, m.c, count(*) AS n FROM sw JOIN {last} m ON m.id = sw.dst GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, c) = 1")) + "SELECT id, c AS community FROM r5")
def g_label_propagation(spark, d):
    return I.label_propagation(X.sim_edges(spark, d))


DIST = "WITH RECURSIVE " + SIM + ", walk(source, id, dist) AS (SELECT id, id, 0 FROM sd UNION SELECT w.source, sw.dst, w.dist + 1 FROM walk w JOIN sw ON sw.src = w.id WHERE w.dist < 16), dist AS MATERIALIZED (SELECT source, id, min(dist) AS dist FROM walk GROUP BY ALL) "
# Shortest paths from each source level by level, and for each node the share of those of all pairs that pass it.
SIGMA = ", l0 AS (SELECT id AS source, id, 1.0::DOUBLE AS sigma FROM sd)" + "".join(f", l{k} AS MATERIALIZED (SELECT l.source, sw.dst AS id, sum(sigma) AS sigma FROM l{k - 1} l JOIN sw ON sw.src = l.id JOIN dist ON dist.source = l.source AND dist.id = sw.dst AND dist.dist = {k} GROUP BY ALL)" for k in range(1, 17)) + ", sg AS MATERIALIZED (SELECT source, id, dist, sigma FROM (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(17)) + ") JOIN dist USING (source, id))"
BETWEEN = SIGMA + ", bt AS MATERIALIZED (SELECT sd.id, coalesce(b, 0) / (((SELECT count(*) FROM sd) - 1) * ((SELECT count(*) FROM sd) - 2)) AS b FROM sd LEFT JOIN (SELECT x.id, sum(x.sigma * y.sigma / z.sigma) AS b FROM sg x JOIN sg y ON y.source = x.id AND y.dist > 0 JOIN sg z ON z.source = x.source AND z.id = y.id AND z.dist = x.dist + y.dist WHERE x.dist > 0 GROUP BY 1) USING (id))"


@query(DIST + BETWEEN + " SELECT id, round(b, 9) AS betweenness FROM bt")
def g_betweenness(spark, d):
    return I.betweenness(X.sim_edges(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query(DIST + BETWEEN + " SELECT id FROM bt WHERE b >= (SELECT quantile_cont(b, 0.9) FROM bt)")
def g_bridges(spark, d):
    """Nodes whose betweenness is at least the 90th percentile."""
    b = I.betweenness(X.sim_edges(spark, d))
    return b.join(F.broadcast(b.agg(F.percentile("betweenness", F.lit(0.9)).alias("p"))), F.lit(True)).filter("betweenness >= p").select("id")  # one row


@query(DIST + "SELECT round(avg(dist), 6) AS avg_path_length, max(dist) AS diameter FROM dist WHERE dist > 0")
def g_path_lengths(spark, d):
    """Over all reachable pairs; the largest component holds them all here."""
    return I.path_lengths(I.all_distances(X.sim_edges(spark, d))).withColumn("avg_path_length", F.round("avg_path_length", 6))


@query(DIST + "SELECT source, dist, count(*) AS n FROM dist GROUP BY ALL")
def g_distances(spark, d):
    return I.all_distances(X.sim_edges(spark, d)).groupBy("source", "dist").agg(F.count("*").alias("n"))


@query(with_(SIM, TRI, "p AS (SELECT DISTINCT t.x || '|' || t.y || '|' || t.z AS a, u.x || '|' || u.y || '|' || u.z AS b FROM tri t JOIN tri u ON len(list_intersect([t.x, t.y, t.z], [u.x, u.y, u.z])) >= 2)", rounds(20, "SELECT DISTINCT a AS id, a AS c FROM p", "SELECT l.id, min(m.c) AS c FROM {last} l JOIN p ON p.a = l.id JOIN {last} m ON m.id = p.b GROUP BY 1")) + "SELECT DISTINCT c AS community, unnest(string_split(id, '|'))::BIGINT AS id FROM r20")
def g_clique_communities(spark, d):
    return I.clique_communities(X.sim_edges(spark, d))


@query()
def g_spectral(spark, d):
    """Communities of three nodes or more; the test compares the vectors and groups with a dense solver."""
    return I.spectral_communities(X.sim_edges(spark, d), least_size=3)


@query(with_(REL) + """, c AS (SELECT 'nation_' || n_nationkey AS id FROM nation), s AS (SELECT DISTINCT src, dst FROM ways), h1 AS (SELECT c.id AS center, dst AS id FROM c JOIN s ON s.src = c.id),
h2 AS (SELECT DISTINCT h1.center, s.dst AS id FROM h1 JOIN s ON s.src = h1.id), a AS (SELECT id AS center, id, 0 AS dist FROM c UNION ALL SELECT center, id, 1 FROM h1 UNION ALL SELECT center, id, 2 FROM h2), b AS (SELECT center, id, min(dist) AS dist FROM a GROUP BY ALL)
SELECT center, id, dist FROM b""")
def g_ego_networks(spark, d):
    centers = table(spark, d, "nation").select(X.ident("nation", "n_nationkey").alias("id"))
    return I.ego_distances(G.simple(X.relationships(spark, d)), centers, 2)


@query(with_(REL) + """, s AS (SELECT DISTINCT src, dst FROM ways), a AS (SELECT 'region_0' AS id, 0 AS dist UNION ALL SELECT dst, 1 FROM s WHERE src = 'region_0' UNION ALL SELECT t.dst, 2 FROM s JOIN s t ON t.src = s.dst WHERE s.src = 'region_0'), b AS (SELECT id, min(dist) AS dist FROM a GROUP BY 1)
SELECT DISTINCT 'region_0' AS center, r.src, r.dst, r.type FROM rel r JOIN b x ON x.id = r.src JOIN b y ON y.id = r.dst WHERE least(x.dist, y.dist) <= 1""")
def g_ego_edges(spark, d):
    spec = {"subgraph": {"nodes": ["region_0"], "depth": 2}}
    return specs.compile_spec(X.graph(spark, d), spec)


@query(with_(SIM, "nb AS (SELECT src, list(dst) AS l FROM sw GROUP BY 1)", "al AS MATERIALIZED (SELECT x.src AS a, y.src AS b FROM nb x JOIN nb y ON x.src <> y.src WHERE len(list_intersect(x.l, y.l)) / len(list_distinct(list_concat(x.l, y.l))) >= 0.75)", rounds(12, "SELECT DISTINCT a AS id, a AS c FROM al", "SELECT l.id, least(l.c, min(m.c)) AS c FROM {last} l JOIN al ON al.a = l.id JOIN {last} m ON m.id = al.b GROUP BY l.id, l.c"))
+ """, mg AS (SELECT DISTINCT coalesce(x.c, a) AS src, coalesce(y.c, b) AS dst FROM sim LEFT JOIN r12 x ON x.id = a LEFT JOIN r12 y ON y.id = b WHERE coalesce(x.c, a) <> coalesce(y.c, b))
SELECT (SELECT count(*) - floor(count(*) * 0.5)::BIGINT FROM mg) AS edges_left, (SELECT count(*) FROM r12) AS merged_nodes, (SELECT count(DISTINCT c) FROM r12) AS groups, (SELECT count(*) FROM sim) AS edges_before""")
def g_compression(spark, d):
    edges = X.similar(spark, d).select("src", "dst", F.lit("similar").alias("type"), F.col("sim").alias("confidence"))
    left, groups = G.compress(edges, 0.5, I.components)
    one = left.agg(F.count("*").alias("edges_left"))
    return one.join(groups.agg(F.count("*").alias("merged_nodes"), F.count_distinct("rep").alias("groups")), F.lit(True)).join(edges.agg(F.count("*").alias("edges_before")), F.lit(True))


@query()
def g_random_walks(spark, d):
    e = X.sim_edges(spark, d)
    return I.random_walks(e, G.degrees(e).select("id"))


@query(with_(SIM) + "SELECT x.label AS community, count(*) AS edges, count(DISTINCT a) + count(DISTINCT b) - (SELECT count(*) FROM (SELECT a FROM sim s JOIN embeddings p ON p.vec_id = a JOIN embeddings q ON q.vec_id = b WHERE p.label = x.label AND q.label = x.label INTERSECT SELECT b FROM sim s JOIN embeddings p ON p.vec_id = a JOIN embeddings q ON q.vec_id = b WHERE p.label = x.label AND q.label = x.label)) AS nodes FROM sim JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b AND y.label = x.label GROUP BY 1")
def g_community_metrics(spark, d):
    """Edges and nodes of each community's induced graph."""
    m = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"))
    inner = G.induced(X.similar(spark, d).select("src", "dst"), m)
    ends = inner.select("community", F.explode(F.array("src", "dst")).alias("id")).groupBy("community").agg(F.count_distinct("id").alias("nodes"))
    return inner.groupBy("community").agg(F.count("*").alias("edges")).join(ends, "community")


@query()
def g_importance_ranking(spark, d):
    """Mean of degree, betweenness, eigenvector centrality and PageRank."""
    e = X.sim_edges(spark, d)
    parts = G.degree_centrality(e).join(I.betweenness(e), "id").join(I.eigenvector(e), "id").join(I.pagerank(e), "id")
    return parts.select("id", F.round((F.col("degree_centrality") + F.col("betweenness") + F.col("centrality") + F.col("rank")) / 4, 9).alias("importance"))


@query(DIST + ", " + TRI + """, t AS (SELECT id, count(*) AS t FROM (SELECT unnest([x, y, z]) AS id FROM tri) GROUP BY 1), cl AS (SELECT avg(CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (d * (d - 1)) END) AS c FROM sd LEFT JOIN t USING (id)),
comp AS (SELECT source, min(id) AS c, count(*) AS n FROM dist GROUP BY 1), top AS (SELECT c FROM comp ORDER BY n DESC, c DESC LIMIT 1)
SELECT (SELECT count(*) FROM sd) AS n_nodes, (SELECT count(*) FROM sim) AS n_edges, round((SELECT 2 * count(*) FROM sim) / ((SELECT count(*) FROM sd) * ((SELECT count(*) FROM sd) - 1)), 9) AS density, round((SELECT c FROM cl), 9) AS avg_clustering,
 (SELECT count(DISTINCT c) FROM comp) AS n_components, (SELECT max(n) FROM comp) AS largest, (SELECT max(dist) FROM dist JOIN comp USING (source) WHERE c = (SELECT c FROM top)) AS diameter, (SELECT round(avg(dist), 6) FROM dist JOIN comp USING (source) WHERE dist > 0 AND c = (SELECT c FROM top)) AS avg_path_length, (SELECT round(corr(x.d, y.d), 6) FROM sw JOIN sd x ON x.id = src JOIN sd y ON y.id = dst) AS assortativity""")
def g_metrics(spark, d):
    m = I.graph_metrics(X.sim_edges(spark, d))
    return m.select("n_nodes", "n_edges", F.round("density", 9).alias("density"), F.round("avg_clustering", 9).alias("avg_clustering"), "n_components", "largest", "diameter", F.round("avg_path_length", 6).alias("avg_path_length"), F.round("assortativity", 6).alias("assortativity"))


@query()
def g_node_metrics(spark, d):
    e = X.sim_edges(spark, d)
    return I.node_metrics(e, table(spark, d, "embeddings").filter("label = 3").select(F.col("vec_id").alias("id")))


@query("WITH RECURSIVE " + SIM + """, c AS MATERIALIZED (SELECT a, b, x.label AS l FROM sim JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b AND y.label = x.label), w AS MATERIALIZED (SELECT l, a AS src, b AS dst FROM c UNION ALL SELECT l, b, a FROM c), g AS MATERIALIZED (SELECT l, src AS id, count(*) AS d FROM w GROUP BY ALL),
t AS (SELECT l, id, count(*) AS t FROM (SELECT e.l, unnest([e.a, e.b, f.b]) AS id FROM c e JOIN c f ON e.b = f.a AND e.l = f.l JOIN c h ON h.a = e.a AND h.b = f.b AND h.l = e.l) GROUP BY ALL), cl AS (SELECT l, avg(CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (d * (d - 1)) END) AS c FROM g LEFT JOIN t USING (l, id) GROUP BY 1),
walk(l, source, id, dist) AS (SELECT l, id, id, 0 FROM g UNION SELECT k.l, k.source, w.dst, k.dist + 1 FROM walk k JOIN w ON w.src = k.id AND w.l = k.l WHERE k.dist < 24), dist AS (SELECT l, source, id, min(dist) AS dist FROM walk GROUP BY ALL), far AS (SELECT l, max(dist) AS far, count(*) AS reached FROM dist GROUP BY 1),
n AS (SELECT l, count(*) AS n, sum(d) / 2 AS m FROM g GROUP BY 1), h AS (SELECT l, string_agg(id, ',' ORDER BY k) AS hubs FROM (SELECT l, id, row_number() OVER (PARTITION BY l ORDER BY d DESC, id) AS k FROM g) WHERE k <= 3 GROUP BY 1)
SELECT label AS community, size, round(coalesce(2 * m / (n * (n - 1)), 0), 9) AS density, round(coalesce(c, 0), 9) AS avg_clustering, CASE WHEN reached = n * n THEN far::DOUBLE ELSE 'inf'::DOUBLE END AS diameter, hubs
FROM (SELECT label, count(*) AS size FROM embeddings GROUP BY 1) LEFT JOIN n ON n.l = label LEFT JOIN cl ON cl.l = label LEFT JOIN far ON far.l = label LEFT JOIN h ON h.l = label""")
def g_community_shapes(spark, d):
    m = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"))
    c = I.community_metrics(X.sim_edges(spark, d), m)
    return c.select("community", "size", F.round("density", 9).alias("density"), F.round("avg_clustering", 9).alias("avg_clustering"), "diameter", F.array_join(F.transform("hubs", lambda x: x.cast("string")), ",").alias("hubs"))


@query(DIST + BETWEEN + """, tr AS MATERIALIZED (SELECT e.a AS x, e.b AS y, f.b AS z FROM sim e JOIN sim f ON e.b = f.a JOIN sim g ON g.a = e.a AND g.b = f.b),
q AS MATERIALIZED (SELECT DISTINCT t.x || '|' || t.y || '|' || t.z AS a, u.x || '|' || u.y || '|' || u.z AS b FROM tr t JOIN tr u ON len(list_intersect([t.x, t.y, t.z], [u.x, u.y, u.z])) >= 2), """ + rounds(20, "SELECT DISTINCT a AS id, a AS c FROM q", "SELECT l.id, min(m.c) AS c FROM {last} l JOIN q ON q.a = l.id JOIN {last} m ON m.id = q.b GROUP BY 1") + """
SELECT 'hubs' AS pattern, least(10, (SELECT count(*) FROM sd)) AS n UNION ALL SELECT 'bridges', count(*) FROM bt WHERE b >= (SELECT quantile_cont(b, 0.9) FROM bt)
UNION ALL SELECT 'dense', count(*) FROM (SELECT DISTINCT c, unnest(string_split(id, '|')) FROM r20) UNION ALL SELECT 'motifs', (SELECT count(*) > 0 FROM tr)::INT + (SELECT sum(d * (d - 1) // 2) > 3 * (SELECT count(*) FROM tr) FROM sd)::INT""")
def g_patterns(spark, d):
    p = I.patterns(X.sim_edges(spark, d))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("pattern"), "n") for k, df in p.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query()
def g_experiences(spark, d):
    e, _ = _vectors(spark, d)
    return I.experiences(X.sim_edges(spark, d), e.select("id", F.col("community").alias("type")), X.similar(spark, d).select("src", "dst")).groupBy("reward", "done").agg(F.count("*").alias("n"))


# ---- paths ----

COSTED = "cst AS MATERIALIZED (SELECT src, dst, min(round((1 + 0.6 * (1 - confidence)) * 1000000)::BIGINT) AS cost FROM ways GROUP BY ALL)"


@query(with_(REL) + ", c AS (SELECT src, dst, min(round((1 + 0.6 * (1 - confidence)) * 1000000)::BIGINT) AS cost FROM ways GROUP BY ALL) SELECT count(*) AS n, sum(cost)::BIGINT AS cost FROM c")
def path_edge_costs(spark, d):
    return P.costed(X.relationships(spark, d)).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


@query(with_(REL, COSTED, "src0 AS (SELECT 'nation_' || n_nationkey AS id FROM nation)", rounds(5, "SELECT id AS start, id, 0::BIGINT AS cost FROM src0", "SELECT start, dst AS id, min(l.cost + c.cost) AS cost FROM {last} l JOIN cst c ON c.src = l.id GROUP BY ALL")) + "SELECT start, id, min(cost) AS cost FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5) WHERE start <> id AND id LIKE 'region%' GROUP BY ALL")
def path_cheapest(spark, d):
    """Least cost from every nation to every region over at most five edges (walks with repeats are never cheaper)."""
    starts = table(spark, d, "nation").select(X.ident("nation", "n_nationkey").alias("id"))
    ends = table(spark, d, "region").select(X.ident("region", "r_regionkey").alias("id"))
    return P.cheapest_paths(P.costed(X.relationships(spark, d)), starts, targets=ends).select("start", "id", "cost")


SIMPLE = "WITH RECURSIVE " + GEO + """, gw AS (SELECT src, dst FROM geo UNION SELECT dst, src FROM geo), walk(id, nodes, hops) AS (SELECT 'nation_1', ['nation_1'], 0 UNION ALL
  SELECT gw.dst, list_append(w.nodes, gw.dst), w.hops + 1 FROM walk w JOIN gw ON gw.src = w.id WHERE w.hops < 5 AND w.id <> 'nation_6' AND NOT list_contains(w.nodes, gw.dst)) """


@query(SIMPLE + "SELECT array_to_string(nodes, '>') AS path, hops FROM walk WHERE id = 'nation_6'")
def path_all_simple(spark, d):
    p = P.simple_paths(P.costed(X.located(spark, d)), "nation_1", "nation_6")
    return p.select(F.array_join("nodes", ">").alias("path"), "hops")


TYPED = "WITH RECURSIVE " + GEO + """, gw AS (SELECT src, dst, type FROM geo UNION SELECT dst, src, type FROM geo), walk(id, nodes, types, hops) AS (SELECT 'nation_1', ['nation_1'], []::VARCHAR[], 0 UNION ALL
  SELECT gw.dst, list_append(w.nodes, gw.dst), list_append(w.types, gw.type), w.hops + 1 FROM walk w JOIN gw ON gw.src = w.id WHERE w.hops < 5 AND w.id <> 'nation_6' AND NOT list_contains(w.nodes, gw.dst)) """


@query(TYPED + "SELECT array_to_string(nodes, '>') AS path, array_to_string(types, '>') AS types, hops AS distance, 0.0::DOUBLE AS semantic, 1.0::DOUBLE AS confidence, hops::DOUBLE AS total FROM walk WHERE id = 'nation_6'")
def path_cost_records(spark, d):
    """The cost records of the paths of ``path_all_simple``."""
    e = P.costed(X.located(spark, d))
    r = P.path_records(P.simple_paths(e, "nation_1", "nation_6"), e)
    return r.select(F.array_join("nodes", ">").alias("path"), F.array_join("relationships.type", ">").alias("types"), "distance", "semantic", "confidence", "total")


@query(with_(SIM, "q AS MATERIALIZED (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))) AS s FROM embeddings)",
"cst AS MATERIALIZED (SELECT src, dst, round((1 + 0.6 * (1 - s.s) + 0.4 * (1 - (x.s + y.s) / 3)) * 1000000)::BIGINT AS cost FROM (SELECT a AS src, b AS dst, s FROM sim UNION ALL SELECT b, a, s FROM sim) s JOIN q x ON x.id = src JOIN q y ON y.id = dst)",
rounds(5, "SELECT vec_id AS start, vec_id AS id, 0::BIGINT AS cost FROM embeddings WHERE label = 3", "SELECT start, dst AS id, min(l.cost + c.cost) AS cost FROM {last} l JOIN cst c ON c.src = l.id GROUP BY ALL")) + "SELECT start, id, min(cost) AS cost FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5) WHERE start <> id AND id IN (SELECT vec_id FROM embeddings WHERE label = 4) GROUP BY ALL")
def path_semantic(spark, d):
    """Least costs from the vectors of one label to those of another, where edges away from a query's vector cost more."""
    e, q = _vectors(spark, d)
    rel = X.similar(spark, d).select("src", "dst", F.lit("similar").alias("type"), F.col("sim").alias("confidence"))
    ids = lambda label: e.filter(F.col("community") == label).select("id")
    return P.cheapest_paths(P.costed(rel, e.select("id", "embedding"), q), ids(3), targets=ids(4)).select("start", "id", "cost")


@query()
def path_all_simple_whole(spark, d):
    """All simple paths over the whole graph; ``path_all_simple`` leaves the parts out."""
    p = P.simple_paths(P.costed(X.relationships(spark, d)), "nation_1", "nation_6")
    return p.select(F.array_join("nodes", ">").alias("path"), "hops")


@query()
def path_diverse(spark, d):
    p = P.simple_paths(P.costed(X.relationships(spark, d)), "nation_1", "region_4", 5)
    return P.diverse_paths(p).select("place", F.array_join("nodes", ">").alias("path"), "cost")


@query()
def path_multi_target(spark, d):
    p = P.multi_target_paths(P.costed(X.relationships(spark, d)), "nation_1", ["region_0", "region_1", "region_2", "nation_9"])
    return p.select("place", "id", "cost")


@query()
def path_connecting(spark, d):
    p = P.connecting_paths(P.costed(X.relationships(spark, d)), ["nation_1", "nation_2", "region_3", "nation_8"], "nation_1")
    return p.select("place", "start", "id", "cost")


# ---- vectors and retrieval ----

PROBE = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("community"))
    return e, [float(x) for x in e.orderBy("id").first()["embedding"]]


@query(f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE}), 6) AS similarity FROM embeddings")
def v_cosine(spark, d):
    e, q = _vectors(spark, d)
    return e.select("id", F.round(V.cosine(F.col("embedding"), V.literal(q)), 6).alias("similarity"))


@query(f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {PROBE}) DESC, vec_id LIMIT 10")
def v_top_similar(spark, d):
    e, q = _vectors(spark, d)
    return R.top_similar(e, "id", q, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL), l AS (SELECT label, list(v ORDER BY i) AS e FROM m GROUP BY 1)
SELECT label AS community, round(list_cosine_similarity(e, {PROBE}), 6) AS similarity FROM l WHERE list_cosine_similarity(e, {PROBE}) >= 0.0 ORDER BY list_cosine_similarity(e, {PROBE}) DESC, label LIMIT 5""")
def v_communities(spark, d):
    e, q = _vectors(spark, d)
    # No community here is as alike as the default asks for.
    return R.communities_for(e.select("id", "embedding"), e.select("id", "community"), q, least=0.0).withColumn("similarity", F.round("similarity", 6))


@query(with_(SIM) + f""", a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], {PROBE}) DESC, vec_id) AS k FROM embeddings), b AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS k FROM sd)
SELECT coalesce(a.id, b.id) AS id, round(coalesce(1 / (60 + a.k), 0) + coalesce(1 / (60 + b.k), 0), 9)::DOUBLE AS fused FROM (SELECT * FROM a WHERE k <= 50) a FULL JOIN (SELECT * FROM b WHERE k <= 50) b ON a.id = b.id""")
def v_hybrid(spark, d):
    e, q = _vectors(spark, d)
    a = R.top_similar(e, "id", q, 50).withColumnRenamed("similarity", "score")
    b = G.degrees(X.sim_edges(spark, d)).withColumnRenamed("degree", "score").orderBy(F.desc("score"), "id").limit(50)
    return R.reciprocal_rank_fusion(a, b, "id").withColumn("fused", F.round("fused", 9))


@query(with_(SIM) + f", v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {PROBE}) AS s FROM embeddings), n AS (SELECT id AS subgraph, id FROM sd UNION SELECT src, dst FROM sw) SELECT subgraph, round(avg(s), 6) AS relevance FROM n JOIN v USING (id) GROUP BY 1")
def v_relevance(spark, d):
    e, q = _vectors(spark, d)
    edges = X.sim_edges(spark, d)
    nodes = G.both_ways(edges).select(F.col("src").alias("subgraph"), F.col("dst").alias("id")).unionByName(G.degrees(edges).select(F.col("id").alias("subgraph"), "id"))
    return R.relevance(nodes, e.select("id", "embedding"), q).withColumn("relevance", F.round("relevance", 6))


@query()
def v_staged(spark, d):
    e, q = _vectors(spark, d)
    rel = X.similar(spark, d).select("src", "dst", F.lit("similar").alias("type"), F.col("sim").alias("confidence"))
    return R.staged(rel, e.select("id", "embedding"), e.select("id", "community"), q, least=-1.0, community_least=-1.0)["ranked"].withColumn("score", F.round("score", 6))


@query()
def v_best_first(spark, d):
    e, q = _vectors(spark, d)
    rel = X.similar(spark, d).select("src", "dst")
    groups = e.select("id", "community").join(R.communities_for(e.select("id", "embedding"), e.select("id", "community"), q, least=-1.0), "community", "left_semi")
    centers = [r["id"] for r in G.community_center(rel, groups).select("id").collect()]  # one for each of five communities
    return R.best_first(rel, e.select("id", "embedding"), centers, q)[1].groupBy("center", "dist").agg(F.count("*").alias("n"))


@query(with_(SIM) + "SELECT a AS state, b AS next_state, CASE WHEN x.label <> y.label THEN 1.3 ELSE 1.0 END::DOUBLE AS reward FROM sim JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b")
def v_rewards(spark, d):
    e, _ = _vectors(spark, d)
    steps = X.sim_edges(spark, d).toDF("state", "next_state")
    return R.rewards(steps, e.select("id", F.col("community").alias("type")), X.similar(spark, d).select("src", "dst"))


# ---- summaries ----


NODES = """k AS (SELECT w.src, w.type, w.dst, e.text, row_number() OVER (PARTITION BY w.src ORDER BY w.confidence DESC, w.dst, w.type) AS k FROM ways w JOIN ent e ON e.id = w.dst),
nodes AS (SELECT ent.id, 'Entity: ' || ent.text || '\nType: ' || ent.type || '\nRelationships:\n' || coalesce(r, '') AS content FROM ent LEFT JOIN (SELECT src, string_agg('- ' || type || ' ' || text, '\n' ORDER BY k) AS r FROM k WHERE k <= 10 GROUP BY 1) ON src = ent.id)"""


@query(with_(ENT, REL, NODES) + "SELECT id, content FROM nodes")
def z_node_summaries(spark, d):
    return S.node_summaries(X.entities(spark, d), X.relationships(spark, d))


@query(with_(ENT, REL) + "SELECT e.id, e.type, e.text, (SELECT count(*) FROM rel WHERE dst = e.id) AS in_degree, (SELECT count(*) FROM rel WHERE src = e.id) AS out_degree FROM ent e")
def z_node_metadata(spark, d):
    return S.node_metadata(X.entities(spark, d), X.relationships(spark, d))


GROUPS = """n AS (SELECT community, count(*) AS node_count FROM mem GROUP BY 1), i AS (SELECT community, count(*) AS e FROM inr GROUP BY 1),
l AS (SELECT community, '- ' || a.text || ' ' || inr.type || ' ' || b.text AS line, row_number() OVER (PARTITION BY community ORDER BY confidence DESC, src, dst, inr.type) AS k FROM inr JOIN ent a ON a.id = src JOIN ent b ON b.id = dst), j AS (SELECT community, string_agg(line, '\n' ORDER BY k) AS r FROM l WHERE k <= 20 GROUP BY 1),
groups AS (SELECT community, node_count, 'Nodes: ' || node_count || '\nDensity: ' || printf('%.2f', round_even(coalesce(e, 0) / (node_count * (node_count - 1)), 2)) || '\nTypes: \nRelations:\n' || coalesce(r, '') AS content FROM n LEFT JOIN i USING (community) LEFT JOIN j USING (community) WHERE node_count >= 3)"""


@query(with_(ENT, REL, SUPPLY_GROUPS, INNER, GROUPS) + "SELECT community, node_count, content FROM groups")
def z_community_summaries(spark, d):
    return S.community_summaries(X.entities(spark, d), X.relationships(spark, d), _groups(spark, d)).select("community", "node_count", "content")


COMMUNITY_SIZES = "cs AS (SELECT community, count(*) AS s FROM mem GROUP BY 1)"
GLOBAL = """SELECT count(*) AS n_communities, (SELECT sum(s) FROM (SELECT s FROM cs ORDER BY s DESC, community LIMIT 10))::BIGINT AS covered, 'Communities: ' || count(*) || '\nAverage size: ' || printf('%.1f', round_even(avg(s), 1)) || '\nLargest:\n' || (SELECT string_agg('- ' || community || ': ' || s, '\n' ORDER BY s DESC, community::VARCHAR DESC) FROM (SELECT * FROM cs ORDER BY s DESC, community LIMIT 10)) AS content FROM cs"""


@query(with_(SUPPLY_GROUPS, COMMUNITY_SIZES) + GLOBAL)
def z_global_summary(spark, d):
    return S.global_summary(X.entities(spark, d), X.relationships(spark, d), _groups(spark, d))


@query(with_(ENT, REL, SUPPLY_GROUPS, INNER, NODES, GROUPS, COMMUNITY_SIZES, f"whole AS ({GLOBAL})") + "SELECT id, 'node' AS level, content FROM nodes WHERE id IN (SELECT id FROM mem) UNION ALL SELECT 'comm_' || community, 'community', content FROM groups UNION ALL SELECT 'global', 'global', content FROM whole")
def z_hierarchy(spark, d):
    return S.hierarchy(X.entities(spark, d), X.relationships(spark, d), _groups(spark, d))


CURRENT = "cur AS (SELECT id, lower(trim(level)) AS level, content, last_updated FROM graph_summaries WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_updated DESC NULLS LAST) = 1)"


@query(f"WITH {CURRENT} SELECT level, count(*) AS n, max(last_updated) AS latest FROM cur GROUP BY 1")
def z_by_level(spark, d):
    return S.level_counts(S.current(table(spark, d, "graph_summaries")))


@query(f"WITH {CURRENT} SELECT id, level, content FROM cur WHERE level = 'community' UNION ALL SELECT id, 'by id', content FROM cur WHERE id = (SELECT min(id) FROM cur)")
def z_stored(spark, d):
    """Stored summaries of one level, and one by its id."""
    s = S.current(table(spark, d, "graph_summaries"))
    one = s.agg(F.min("id")).first()[0]
    return S.by_level(s, "community").select("id", "level", "content").union(S.by_id(s, one).select("id", F.lit("by id"), "content"))


# ---- time windows ----


@query("WITH r AS (SELECT max(ts) AS ref FROM events), m AS (SELECT unnest([15, 60, 240]) AS window_min) SELECT window_min, count(e.ts) AS n, round(count(e.ts) / window_min, 9) AS rate FROM m CROSS JOIN r LEFT JOIN events e ON e.event_type = 'error' AND e.ts >= r.ref - to_minutes(window_min) GROUP BY 1")
def w_error_trends(spark, d):
    ops = X.operations(spark, d)
    return E.trends(ops.filter("NOT success"), ops.agg(F.max("ts").alias("ref"))).withColumn("rate", F.round("rate", 9))


@query(with_(OPS) + "SELECT event_id, count(*) OVER w AS n, round(avg(success::INT) OVER w, 9) AS success_rate FROM ops WINDOW w AS (PARTITION BY op_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)")
def w_rolling_rates(spark, d):
    return E.rolling_rates(X.operations(spark, d)).select("event_id", "n", F.round("success_rate", 9).alias("success_rate"))


@query("SELECT query_id, count(*) OVER (ORDER BY epoch_us(started_at) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM (SELECT DISTINCT query_id, started_at FROM query_stats WHERE started_at IS NOT NULL)")
def w_throughput(spark, d):
    q = table(spark, d, "query_stats").filter("started_at IS NOT NULL").select("query_id", F.col("started_at").alias("ts")).distinct()
    return E.throughput(q).select("query_id", "n")


@query("SELECT metric, count(*) AS n FROM (SELECT DISTINCT point_id, metric, ts FROM metric_points) WHERE ts > (SELECT max(ts) FROM metric_points) - INTERVAL 24 HOURS GROUP BY 1")
def w_retained(spark, d):
    m = table(spark, d, "metric_points").select("point_id", "metric", "ts").distinct()
    return E.retained(m, m.agg(F.max("ts").alias("ref")), 24).groupBy("metric").agg(F.count("*").alias("n"))


@query("SELECT bucket, (SELECT count(*) FROM events WHERE value <= bucket) AS n FROM (SELECT unnest([10, 50, 100, 500]) AS bucket)")
def w_latency_histogram(spark, d):
    return E.latency_histogram(table(spark, d, "events"), "value")


@query()
def w_circuit_breaker(spark, d):
    ops = X.operations(spark, d).select(F.col("op_type").alias("circuit"), "ts", "success")
    return E.breaker_states(ops).groupBy("circuit", "state").agg(F.count("*").alias("n"))


@query("SELECT query_id, CASE WHEN m > 80 AND n > 80 THEN 'warning' WHEN m > 80 OR n > 80 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT DISTINCT query_id, coalesce(memory_usage, 0) AS m, coalesce(nodes_accessed, 0) AS n FROM query_stats)")
def w_health(spark, d):
    q = table(spark, d, "query_stats").select("query_id", F.coalesce("memory_usage", F.lit(0.0)).alias("m"), F.coalesce("nodes_accessed", F.lit(0)).alias("n")).distinct()
    return q.select("query_id", E.health(F.col("n"), F.col("m"), F.lit(0), F.lit(0.0))["status"].alias("status"))


@query(with_(OPS) + "SELECT op_type, CASE WHEN avg((NOT success)::INT) > 0.1 THEN 'unhealthy' ELSE 'healthy' END AS status, round(avg((NOT success)::INT), 6) AS error_rate FROM ops GROUP BY 1")
def w_operation_health(spark, d):
    """Health of each kind of operation by its own error rate."""
    rates = X.operations(spark, d).groupBy("op_type").agg(F.avg((~F.col("success")).cast("int")).alias("error_rate"))
    return rates.select("op_type", E.health(F.lit(0), F.lit(0), F.lit(0), F.col("error_rate"))["status"].alias("status"), F.round("error_rate", 6).alias("error_rate"))


@query(with_(ENT, REL) + ", l AS (SELECT DISTINCT src AS id FROM ways) SELECT CASE WHEN count(l.id) / count(*) < 0.8 OR (SELECT count(*) FROM rel WHERE confidence IS NULL) > 0 THEN 'degraded' ELSE 'healthy' END AS status, round(count(l.id) / count(*), 6) AS connectivity, (SELECT count(*) FROM rel WHERE confidence IS NULL) AS missing FROM ent LEFT JOIN l USING (id)")
def w_graph_health(spark, d):
    r = X.relationships(spark, d)
    c = G.connectivity(X.entities(spark, d), r).join(B.integrity(r, ["confidence"]).agg(F.sum("nulls").alias("missing")), F.lit(True))  # one row each
    return c.select(E.graph_health(F.col("connectivity"), F.col("missing"))["status"].alias("status"), F.round("connectivity", 6).alias("connectivity"), "missing")


@query("SELECT coalesce(query_type, 'none') AS category, CASE WHEN query_type = 'path' THEN 'info' ELSE 'info' END AS severity, '[' || coalesce(query_type, 'none') || '] took ' || max(query_id) AS message FROM query_stats GROUP BY 1, 2, query_type")
def w_error_messages(spark, d):
    q = table(spark, d, "query_stats").groupBy(F.coalesce("query_type", F.lit("none")).alias("category")).agg(F.max("query_id").alias("q"))
    return q.select("category", E.severity(F.col("category")).alias("severity"), T.error_message(F.col("category"), F.concat(F.lit("took "), F.col("q").cast("string")), F.lit(None).cast("map<string,string>")).alias("message"))


@query("SELECT coalesce(query_type, 'none') AS kind, round(least(1, 5 / count(*)), 9) AS selection, round(least(1, 100 / count(*)), 9) AS retrieval FROM (SELECT DISTINCT query_id, query_type FROM query_stats) GROUP BY 1")
def v_stage_rates(spark, d):
    q = table(spark, d, "query_stats").select("query_id", "query_type").distinct().groupBy(F.coalesce("query_type", F.lit("none")).alias("kind")).agg(F.count("*").cast("double").alias("n"))
    r = q.select("kind", R.stage_rates(F.col("n"), F.col("n"), F.lit(1.0), F.lit(1.0), F.lit(10.0)).alias("r"))
    return r.select("kind", F.round("r.selection", 9).alias("selection"), F.round("r.retrieval", 9).alias("retrieval"))


# ---- validation ----


@query(with_(NAMED) + "SELECT CASE WHEN type IS NULL THEN 'missing_required' WHEN NOT regexp_full_match(text, '[a-zA-Z0-9_-]+') THEN 'format_error' ELSE '' END AS error_code, count(*) AS n FROM ex GROUP BY 1")
def b_validate_entities(spark, d):
    e = _extracted(spark, d).select(F.col("text").alias("id"), "type")
    return B.Validator().entities(e).groupBy("result.error_code").agg(F.count("*").alias("n"))


@query(with_(NAMED, "rr AS (SELECT DISTINCT result_id, unnest(relationships) AS r FROM extraction_results)", "t AS (SELECT DISTINCT text FROM ex)") + """SELECT CASE WHEN r.source IS NULL OR r.target IS NULL OR r.relationship IS NULL THEN 'missing_required' WHEN r.source NOT IN (SELECT text FROM t) OR r.target NOT IN (SELECT text FROM t) THEN 'relationship_error' ELSE '' END AS error_code, count(*) AS n FROM rr GROUP BY 1""")
def b_validate_relationships(spark, d):
    r = table(spark, d, "extraction_results").select("result_id", "relationships").distinct().select("result_id", F.explode("relationships").alias("r")).distinct().select("r.source", "r.relationship", "r.target")
    ids = _extracted(spark, d).select(F.col("text").alias("id"))
    return B.Validator().relationships(r, ids).groupBy("result.error_code").agg(F.count("*").alias("n"))


@query(with_(ENT, REL) + ", l AS (SELECT DISTINCT src AS id FROM ways) SELECT CASE WHEN count(l.id) / count(*) >= 0.8 THEN '' ELSE 'structure_error' END AS error_code FROM ent LEFT JOIN l USING (id)")
def b_validate_structure(spark, d):
    c = G.connectivity(X.entities(spark, d), X.relationships(spark, d))
    return B.Validator().structure(c).select("result.error_code")


@query(with_(ENT, REL) + """, t AS (SELECT r.src, a.type AS st, r.type AS rel, r.dst, b.type AS dt FROM rel r JOIN ent a ON a.id = r.src JOIN ent b ON b.id = r.dst), k AS (SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY dst) AS k FROM t)
SELECT CASE WHEN rel = 'part_of' THEN 'unknown_relation' WHEN (rel = 'located_in' AND k > 1) OR (rel = 'supplied_by' AND k > 20) THEN 'cardinality' END AS error, count(*) AS n FROM k GROUP BY 1""")
def b_semantic_triples(spark, d):
    e = X.entities(spark, d)
    t = X.relationships(spark, d).select("src", F.col("type").alias("rel"), "dst").join(e.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src").join(e.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
    ontology = spark.createDataFrame([("PART", "supplied_by", "SUPPLIER", 20), ("CUSTOMER", "located_in", "NATION", 1), ("SUPPLIER", "located_in", "NATION", 1)], "src_type string, rel string, dst_type string, max_card int")
    return B.semantic_errors(t, ontology).groupBy("error").agg(F.count("*").alias("n"))


@query(with_(NAMED) + "SELECT type IS NOT NULL AND regexp_full_match(text, '[a-zA-Z0-9_-]+') AS valid, count(*) AS n, count(DISTINCT text) AS texts FROM ex GROUP BY 1")
def b_split_batch(spark, d):
    """A validated batch, split."""
    good, bad = B.split_batch(B.Validator().entities(_extracted(spark, d).select(F.col("text").alias("id"), "type")))
    count = lambda rows, flag: rows.agg(F.lit(flag).alias("valid"), F.count("*").alias("n"), F.count_distinct("id").alias("texts"))
    return count(good, True).union(count(bad, False))


@query("""SELECT s.source_path AS id, CASE WHEN s.source_path IS NULL OR NOT regexp_full_match(s.source_path, '[a-zA-Z0-9_-]+') THEN 'format_error' ELSE 'duplicate' END AS error FROM source_documents s GROUP BY 1 HAVING count(*) > 1 OR s.source_path IS NULL OR NOT regexp_full_match(s.source_path, '[a-zA-Z0-9_-]+')
UNION ALL SELECT doc_id, CASE WHEN doc_id IS NULL OR NOT regexp_full_match(doc_id, '[a-zA-Z0-9_-]+') THEN 'format_error' ELSE 'duplicate' END FROM source_documents GROUP BY 1 HAVING count(*) > 1 OR doc_id IS NULL OR NOT regexp_full_match(doc_id, '[a-zA-Z0-9_-]+')""")
def b_document_ids(spark, d):
    """Errors of two columns taken as ids of documents."""
    s = table(spark, d, "source_documents")
    return B.document_id_errors(s.select(F.col("source_path").alias("id")), "id").union(B.document_id_errors(s.select(F.col("doc_id").alias("id")), "id"))


@query("SELECT query_type AS operation, count(*) AS n FROM (SELECT DISTINCT query_id, query_type FROM query_stats) GROUP BY 1")
def b_operations(spark, d):
    q = table(spark, d, "query_stats").select("query_id", "query_type").distinct()
    ops = q.select(F.col("query_type").alias("operation"), F.create_map(F.lit("id"), F.col("query_id").cast("string")).alias("data"))
    return B.operation_errors(ops).groupBy("operation").agg(F.count("*").alias("n"))


@query(with_(ENT) + "SELECT id, text FROM ent WHERE type = 'NATION' ORDER BY text LIMIT 10")
def y_spec_entities(spark, d):
    return specs.compile_spec(X.graph(spark, d), {"criteria": {"type": "NATION"}, "fields": ["id", "text"], "sort": "text", "limit": 10})


@query(with_(ENT) + "SELECT id, text FROM ent WHERE type = 'CUSTOMER' ORDER BY id LIMIT 1000")
def y_interactive_limit(spark, d):
    """A query that names no limit, asked interactively."""
    return specs.compile_spec(X.graph(spark, d), {"criteria": {"type": "CUSTOMER"}, "fields": ["id", "text"], "sort": "id"}, interactive=True)


@query(SIMPLE + "SELECT array_to_string(nodes, '>') AS path FROM walk WHERE id = 'nation_6' AND hops <= 4")
def y_spec_path(spark, d):
    p = specs.compile_spec(X.PropertyGraph(X.entities(spark, d), X.located(spark, d), X.entities(spark, d)), {"path": {"start": "nation_1", "end": "nation_6", "max_length": 4}})
    return p.select(F.array_join("nodes", ">").alias("path"))


@query()
def y_spec_path_whole(spark, d):
    """The same over the whole graph, parts included."""
    p = specs.compile_spec(X.PropertyGraph(X.entities(spark, d), X.relationships(spark, d), X.entities(spark, d)), {"path": {"start": "nation_1", "end": "nation_6", "max_length": 4}})
    return p.select(F.array_join("nodes", ">").alias("path"))
