"""Scalar functions over texts, model responses and query strings, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: patterns, rules in their order, weights of clauses ----
WHITE = r"\s+"
KEPT = r"[^\p{L}\p{N}_\s.,!?-]"
ID_FORMAT = r"\A[a-zA-Z0-9_-]+\z"
QUERY_RULES = (("MATCH.*WHERE", "pattern_matching"), ("PATH|SHORTEST", "path_finding"), ("COUNT|SUM|AVG", "aggregation"), ("SUBGRAPH", "subgraph"), ("MATCH.*RETURN", "entity_search"))
COSTS = (("MATCH", 1.0), ("WHERE", 0.5), ("WITH", 0.3), ("ORDER BY", 2.0), ("RETURN", 0.1))
TOKENS = {"entity": r":\w+", "relationship": r"\[.*?\]", "property": r"\.\w+", "function": r"\w+\(", "variable": r"\$\w+"}
# ---- End of fixed values ----


def clean_text(text: Column) -> Column:
    """Collapse white space, then drop all but letters, digits, underscore and ``.,!?-``, then strip."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, WHITE, " "), KEPT, ""))


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WHITE), lambda w: w != ""))


def sentence_count(text: Column) -> Column:
    """Parts between runs of ``.!?``; a last empty part counts."""
    return F.size(F.split(text, "[.!?]+", -1))


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, chunk_id, chunk_text, start_idx, end_idx: word-boundary chunks with overlap.

    A chunk that doesn't reach the end is cut back to the last white space (of any kind) that it holds or that follows it.
    The next begins ``overlap`` before its end, or at its end where that wouldn't move on.  Blank chunks are
    left out and take no number; offsets are those before stripping.
    """
    import pandas as pd

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, chunk_id string, chunk_text string, start_idx int, end_idx int"

    def run(frames):
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text]):
                start, n = 0, 0
                t = t or ""
                while start < len(t):
                    end = min(len(t), start + size)
                    if end < len(t):
                        at = next((i for i in range(end, start, -1) if t[i].isspace()), start)
                        end = at if at > start else end
                    piece = t[start:end].strip()
                    if piece:
                        out.append((k, f"chunk_{n}", piece, start, end))
                        n += 1
                    if end == len(t):
                        break
                    start = end - overlap if end - overlap > start else end
            yield pd.DataFrame(out, columns=[key, "chunk_id", "chunk_text", "start_idx", "end_idx"])

    return docs.select(key, text).mapInPandas(run, schema)


def fill_template(template: str, **values: Column) -> Column:
    """A prompt template with ``{name}`` places filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def parse_entities(response: Column) -> Column:
    """array<struct<type, text>> of the lines ``TYPE: text`` after the first ``Entities:``."""
    body = F.when(F.contains(response, F.lit("Entities:")), F.substring(response, F.locate("Entities:", response) + 9, F.length(response)))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")) & (x != ""))
    return F.coalesce(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("type"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("text"))), F.array())


def parse_relationships(response: Column) -> Column:
    """array<struct<source, relationship, target, confidence>> of lines with exactly three ``-`` parts after ``Relationships:``."""
    body = F.when(F.contains(response, F.lit("Relationships:")), F.substring(response, F.locate("Relationships:", response) + 14, F.length(response)))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.split(F.trim(x), "-")), lambda p: F.size(p) == 3)
    made = F.transform(lines, lambda p: F.struct(F.trim(p[0]).alias("source"), F.trim(p[1]).alias("relationship"), F.trim(p[2]).alias("target"), F.lit(0.8).alias("confidence")))
    return F.coalesce(made, F.array())


def extraction_confidence(entities: Column, relationships: Column) -> Column:
    """0 without entities, else the mean of the saturated entity count and relationship density."""
    n, r = entities.cast("double"), relationships.cast("double")
    return F.when(n > 0, (F.least(F.lit(1.0), n / 10) + F.least(F.lit(1.0), F.try_divide(r, n * 0.5))) / 2).otherwise(0.0)


def clean_query(query: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(query), WHITE, " "))


def query_type(query: Column) -> Column:
    """Class of a query string by the first rule that fits; rules look for substrings."""
    q = clean_query(query)
    out = F
    for pattern, name in QUERY_RULES:
        out = out.when(q.rlike(pattern), F.lit(name))
    return out.otherwise("custom")


def query_components(query: Column) -> Column:
    """Patterns, conditions and returned items of a query string."""
    q = F.regexp_replace(F.trim(query), WHITE, " ")
    part = lambda pattern: F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))
    return F.struct(
        part(r"(?i)MATCH (.+?)(?= WHERE| RETURN| WITH| ORDER BY| LIMIT|$)").alias("patterns"),
        F.flatten(F.transform(part(r"(?i)WHERE (.+?)(?= RETURN| WITH| ORDER BY| LIMIT|$)"), lambda x: F.split(x, r"(?i) AND "))).alias("conditions"),
        F.flatten(F.transform(part(r"(?i)RETURN (.+?)(?= ORDER BY| LIMIT|$)"), lambda x: F.split(x, r" ?, ?"))).alias("items"),
    )


def query_numbers(query: Column) -> Column:
    """map of ``$name: number`` and ``$name = number`` parameters."""
    pattern = r"\$(\w+)\s*[:=]\s*(-?\d+(?:\.\d+)?)"
    return F.map_from_arrays(F.regexp_extract_all(query, F.lit(pattern), F.lit(1)), F.transform(F.regexp_extract_all(query, F.lit(pattern), F.lit(2)), lambda x: x.cast("double")))


def query_strings(query: Column) -> Column:
    """map of ``$name: 'text'`` and ``$name = "text"`` parameters, without their quotes."""
    pattern = r"\$(\w+)\s*[:=]\s*(?:'([^']*)'|\"([^\"]*)\")"
    part = lambda i: F.regexp_extract_all(query, F.lit(pattern), F.lit(i))
    return F.map_from_arrays(part(1), F.zip_with(part(2), part(3), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))


def query_cost(query: Column) -> Column:
    """1 plus the weight of each clause that is present."""
    q = F.upper(query)
    return sum((F.when(F.contains(q, F.lit(k)), w).otherwise(0.0) for k, w in COSTS), F.lit(1.0))


def needs_limit(query: Column) -> Column:
    q = F.upper(query)
    return F.contains(q, F.lit("RETURN")) & ~F.contains(q, F.lit("LIMIT"))


def may_use_index(query: Column) -> Column:
    return F.upper(query).rlike(r"MATCH.*\(\w*:\w+.*WHERE|MATCH.*\{\w+:")


def query_tokens(query: Column, kind: str) -> Column:
    return F.regexp_extract_all(query, F.lit(TOKENS[kind]), F.lit(0))


def cache_strategy(size: Column, reuse: Column, sequential: Column) -> Column:
    small = size < 1000
    return F.when(small & (reuse > 0.7), "full").when(small & (reuse > 0.3), "partial").when(sequential, "stream").otherwise("none")


def sorted_json(**values: Column) -> Column:
    """JSON with keys in order, for hashed keys."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def jittered(delay: Column, key: Column, share: float = 0.05) -> Column:
    """A delay up to ``share`` longer or shorter, by the hash of a key, so that it is the same when it is computed again."""
    return delay * (1 + share * (F.pmod(F.xxhash64(key), F.lit(2001)) - 1000) / 1000)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def error_message(code: Column, message: Column, details: Column) -> Column:
    return F.concat(F.lit("["), code, F.lit("] "), message, F.when(details.isNotNull(), F.concat(F.lit(" ("), F.to_json(details), F.lit(")"))).otherwise(""))
