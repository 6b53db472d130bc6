import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.config import Settings
from graphloom.functions import text as T
from graphloom.functions.vector import similar_pairs
from graphloom.operators import events as E
from graphloom.operators import retrieval as R
from graphloom.operators import upserts as U
from graphloom.operators import validation as B
from graphloom.plans import specs
from graphloom.sources import documents as D
from graphloom.sources import tables as K
from graphloom.streaming import metrics as M

T0 = dt.datetime(2024, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    assert value(spark, T.clean_text(F.lit("a  b:c\td"))) == "a bc d"
    assert value(spark, T.sentence_count(F.lit("A. B."))) == 3 and value(spark, T.sentence_count(F.lit(""))) == 1
    assert value(spark, T.word_count(F.lit("A. B."))) == 2 and value(spark, T.word_count(F.lit(""))) == 0
    parse = T.parse_entities(F.lit("Entities:\nDATE: 10:30\n\nno colon\nORG: Acme"))
    assert [tuple(x) for x in value(spark, parse)] == [("DATE", "10:30"), ("ORG", "Acme")] and value(spark, T.parse_entities(F.lit("nothing"))) == []
    rel = T.parse_relationships(F.lit("Relationships:\nJean-Luc - knows - Will\na - b - c"))
    assert [x.target for x in value(spark, rel)] == ["c"]
    conf = lambda n, r: value(spark, T.extraction_confidence(F.lit(n), F.lit(r)))
    late = spark.range(500).select(T.jittered(F.lit(10.0), F.col("id")).alias("v")).agg(F.min("v"), F.max("v")).first()
    assert 9.5 <= late[0] < 9.7 and 10.3 < late[1] <= 10.5
    assert value(spark, T.query_strings(F.lit("f($a: 'x y', $b = \"\", $c: 3)"))) == {"a": "x y", "b": ""}
    assert conf(0, 0) == 0.0 and conf(10, 5) == 1.0 and conf(2, 0) == pytest.approx(0.1)
    assert value(spark, T.query_type(F.lit("MATCH (n) WHERE n.x=1 RETURN COUNT(n)"))) == "pattern_matching"
    assert value(spark, T.query_type(F.lit("RETURN account"))) == "aggregation"
    assert value(spark, T.query_tokens(F.lit("MATCH (n:Part)-[r]-(m) RETURN n.x, f($p)"), "variable")) == ["$p"]


@pytest.mark.parametrize("size,overlap", [(100, 20), (10, 10), (7, 0), (50, 60)])
def test_chunks_cover(spark, size, overlap):
    texts = ["", "short", "word " * 60, "x" * 250, "a b " + "y" * 120]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in T.chunks(df, size, overlap).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert 0 not in got
    for i, rows in got.items():
        assert [r.chunk_id for r in rows] == [f"chunk_{k}" for k in range(len(rows))]
        # Blank chunks are left out, so only white space may lie between two chunks or after the last.
        assert rows[0].start_idx == 0 and not texts[i][rows[-1].end_idx :].strip() and all(b.start_idx > a.start_idx and not texts[i][a.end_idx : b.start_idx].strip() for a, b in zip(rows, rows[1:]))
        assert all(0 < r.end_idx - r.start_idx <= size for r in rows)


def test_chunks_end_at_any_white_space(spark):
    texts = ["aa aa bbb cc", "ab   cd ef      gh", "ab\u2003cdef\x0bgh", " \n ", None]
    got = {}
    for r in T.chunks(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, chunk_id string"), 5, 0).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_id, r.chunk_text))
    assert [t for _, t in got[0]] == ["aa aa", "bbb", "cc"] and [t for _, t in got[2]] == ["ab", "cdef", "gh"]
    four = [(r.chunk_id, r.chunk_text) for r in T.chunks(spark.createDataFrame([(1, texts[1])], "doc_id int, text string"), 4, 0).collect()]
    assert four == [("chunk_0", "ab"), ("chunk_1", "cd"), ("chunk_2", "ef"), ("chunk_3", "gh")] and set(got) == {0, 1, 2}


def test_similarity_join_in_blocks(spark, monkeypatch):
    from graphloom.functions import vector

    rows = [(i, [float((i * 7 + k) % 11) - 5 for k in range(4)]) for i in range(40)] + [(99, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, e array<double>")
    whole = sorted((r.src, r.dst) for r in similar_pairs(df, "id", "e", 0.8).collect())
    monkeypatch.setattr(vector, "BLOCK", 7)
    assert sorted((r.src, r.dst) for r in similar_pairs(df, "id", "e", 0.8).collect()) == whole and whole


@pytest.mark.parametrize("least", [-0.5, 0.0, 0.4, 0.9])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, least):
    import numpy as np

    from graphloom.functions import vector

    monkeypatch.setattr(vector, "BLOCK", 9)
    monkeypatch.setattr(vector, "TILE", 4)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6, 5))[rng.integers(0, 6, 90)] + 0.2 * rng.standard_normal((90, 5))
    x[7] = 0
    x[20:45] = x[20]  # one pivot with several blocks
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= least + 1e-9}
    border = {(i, j) for i in range(90) for j in range(i + 1, 90) if abs(s[i, j] - least) < 1e-9}
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(99, None, 0), (None, [1.0] * 5, 0)], "id int, e array<double>, k int")
    got = {(r.src, r.dst): r.sim for r in similar_pairs(df, "id", "e", least).collect()}
    assert want <= set(got) <= want | border and all(v == pytest.approx(s[i, j]) for (i, j), v in got.items())
    assert similar_pairs(df.limit(0), "id", "e", least).count() == 0


def test_upserts(spark):
    log = spark.createDataFrame([("a", {"x": "1", "y": "2"}, 1, T0), ("a", {"x": "3", "y": None}, 2, T0), ("b", None, 1, T0)], "id string, properties map<string,string>, seq int, ts timestamp")
    got = {r.id: r for r in U.upsert_entities_by_id(log).collect()}
    assert got["a"].properties == {"x": "3"} and got["a"].update_count == 1 and got["b"].update_count is None
    names = spark.createDataFrame([("P", "x", T0), ("P", "x", T0), ("Q", "x", T0)], "type string, text string, ts timestamp")
    made = U.upsert_entities(names)
    assert sorted(r.occurrence_count for r in made.collect()) == [1, 2]
    links = spark.createDataFrame([("x", "x", "r")], "source string, target string, type string")
    assert U.edges_by_text(links, made).count() == 4
    calls = spark.createDataFrame([("e", "d", "c2", 1), ("e", "d", "c2", 1), ("e", "d", "c1", 2), ("e", "d", "c2", 3)], "entity_id string, doc_id string, chunk_id string, seq int")
    m = U.upsert_mentions(calls).first()
    assert m.chunks == ["c2", "c1"] and m.mention_count == 3
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    rel = spark.createDataFrame([("a", "z")], "src string, dst string")
    both = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r.id for r in U.delete(table, both, rel)[0].collect()] == ["a"]
    left, links = U.delete(table, both, rel, cascade=True)
    assert left.count() == 0 and links.count() == 0
    assert U.create(table, spark.createDataFrame([("a", 9), ("c", 3)], "id string, v int")).count() == 3


def test_event_metrics(spark):
    ops = spark.createDataFrame([], "op_type string, ts timestamp, duration double, success boolean")
    assert E.operation_metrics(ops).first().error_rate == 0.0
    at = lambda *s: spark.createDataFrame([(T0 + dt.timedelta(seconds=x),) for x in s], "ts timestamp")
    rate = lambda df: E.errors_per_minute(df).first().per_minute
    assert rate(at(0)) == 0 and rate(at(0, 0)) == 0 and rate(at(0, 60)) == 2.0
    log = [(s, ok) for s, ok in [(0, False), (1, False), (2, False), (3, False), (4, False), (5, True), (70, False), (71, True), (72, False)]]
    df = spark.createDataFrame([("c", T0 + dt.timedelta(seconds=s), ok) for s, ok in log], "circuit string, ts timestamp, success boolean")
    states = [r.state for r in E.breaker_states(df).orderBy("t").collect()]
    assert states == ["closed"] * 4 + ["open", "open", "half_open", "closed", "closed"]
    h = value(spark, E.health(F.lit(90), F.lit(10), F.lit(10), F.lit(0.2)))
    assert h.status == "unhealthy" and h.issues == ["high_cpu", "high_error_rate"]


def test_validation(spark):
    v = B.Validator()
    e = spark.createDataFrame([("a b", "X"), ("ok", None), ("ok", "X")], "id string, type string")
    assert [r.result.error_code for r in v.entities(e).collect()] == ["format_error", "missing_required", ""]
    r = spark.createDataFrame([("ok", "gone", "t"), ("ok", "ok", "t"), ("ok", None, "t")], "source string, target string, relationship string")
    assert sorted(x.result.error_code for x in v.relationships(r, e).collect()) == ["", "missing_required", "relationship_error"]
    with pytest.raises(ValueError):
        v.add(v.rules[0])
    good, bad = B.split_batch(v.entities(e))
    assert good.count() == 1 and bad.count() == 2
    ops = spark.createDataFrame([("create", {"type": "X"}), ("fly", None), ("read", {"id": "1"})], "operation string, data map<string,string>")
    assert [(x.known, x.missing) for x in B.operation_errors(ops).collect()] == [(True, ["properties"]), (False, []), (True, [])]


def test_ranking_prefers_what_is_new(spark):
    nodes = spark.createDataFrame([("s1", i) for i in "abc"] + [("s2", i) for i in "abc"] + [("s3", i) for i in "xyz"], "subgraph string, id string")
    scores = spark.createDataFrame([("s1", 1, 0.9), ("s2", 2, 0.89), ("s3", 3, 0.8)], "subgraph string, seq int, relevance double")
    assert [r.subgraph for r in R.ranked(nodes, scores).collect()] == ["s1", "s3", "s2"]


def test_specs(spark):
    assert [specs.query_kind(s) for s in ({"path": 1, "pattern": 1}, {"pattern": 1}, {"aggregation": 1}, {"subgraph": 1}, {})] == ["path_finding", "pattern_matching", "aggregation", "subgraph", "entity_search"]
    assert specs.execution_cost([[1, 3], [2]], "partial") == 2.5
    s = Settings.of({"processing": {"chunk_size": 10, "other": 1}, "model": {"batch_size": 4}})
    assert s.processing.chunk_size == 10 and s.processing.overlap == 200 and s.model.batch_size == 4


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,value\n1,test,100\n2,,\n")
    (tmp_path / "broken.docx").write_text("plain")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\ntest")  # a header and no objects
    (tmp_path / "skip.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "c.DOCX", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="u" xmlns:d="v"><d:creator>Ann</d:creator></c:coreProperties>')
    rows = {r.metadata["file_name"]: r for r in D.read_directory(spark, str(tmp_path), "*.pdf,*.docx,*.csv,*.DOCX").collect()}
    assert set(rows) == {"a.csv", "broken.docx", "b.pdf", "c.DOCX"}
    assert rows["a.csv"].content == "CSV file with columns id, name, value id 1  name test  value 100.0 id 2" and rows["a.csv"].metadata["num_rows"] == "2"
    assert rows["c.DOCX"].content == "First Second" and rows["c.DOCX"].metadata["author"] == "Ann" and int(rows["c.DOCX"].metadata["file_size"]) > 0
    assert rows["broken.docx"].error and rows["b.pdf"].error


def pdf(pages, deflate=True, table=None, info=b""):
    """A PDF file with a content stream for each page."""
    import zlib

    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    out = [b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", b"2 0 obj << /Type /Pages /Kids [" + kids + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >> endobj\n" % len(pages)]
    out.append(b"3 0 obj << /Type /Font " + (b"/ToUnicode 4 0 R" if table else b"") + b" >> endobj\n5 0 obj << " + info + b" >> endobj\n")
    if table:
        out.append(b"4 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(table), table))
    for i, p in enumerate(pages):
        body = zlib.compress(p) if deflate else p
        out.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (10 + 2 * i, 11 + 2 * i))
        out.append(b"%d 0 obj << /Length %d %s >> stream\n%s\nendstream endobj\n" % (11 + 2 * i, len(body), b"/Filter /FlateDecode" if deflate else b"", body))
    return b"".join(out) + b"trailer << /Root 1 0 R /Info 5 0 R >>\nstartxref\n0\n%%EOF"


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf(deflate):
    pages = [b"BT /F1 12 Tf 72 700 Td (Hello \\(first\\) page) Tj 0 -14 Td [(Wo) 20 (rld) -300 (again)] TJ ET", b"", b"BT (Caf\xe9 \\101) ' ET"]
    text, meta = D.read_pdf(pdf(pages, deflate, info=b"/Title (A \\(b\\)) /Author <FEFF00C4>"))
    assert text == "Hello (first) page\nWorld again\nCafé A" and meta == {"title": "A (b)", "author": "Ä", "num_pages": "3"}
    table = b"begincmap 1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0004> <0061> <0005> <0006> [<00660069> <1F600>] endbfrange endcmap"
    assert D.read_pdf(pdf([b"BT /F1 9 Tf <00010002> Tj [<0003>] TJ ET"], deflate, table))[0] == "Hab"
    for bad in (b"%PDF-1.4\ntest", b"", b"no pdf", pdf(pages).replace(b"/Root", b"/Encrypt 9 0 R /Root")):
        with pytest.raises(ValueError):
            D.read_pdf(bad)


@pytest.mark.parametrize("pace", [0.7, 4.0, 30.0])
def test_breaker_in_pieces_equals_one_walk(spark, pace):
    import random

    rng = random.Random(1)
    log, t = [], 0.0
    for _ in range(800):
        t += rng.expovariate(1 / pace)
        log.append((rng.choice("aab"), T0 + dt.timedelta(seconds=round(t, 3)), rng.random() < (0.2 if int(t / 100) % 2 else 0.8)))
    want, held = [], {}
    for k, at, ok in sorted(log):
        state, fails, opened = held.get(k, ("closed", [], 0.0))
        s = (at - T0).total_seconds()
        if state == "open" and s - opened >= 60:
            state = "half_open"
        if state != "open":
            if ok:
                state, fails = "closed", []
            else:
                fails = [*fails, s][-10:]
                if sum(s - x <= 10 for x in fails) >= 5:
                    state, opened = "open", s
        held[k] = state, fails, opened
        want.append((k, s, ok, state))
    df = spark.createDataFrame(log, "circuit string, ts timestamp, success boolean")
    zero = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    got = sorted((r.circuit, round((r.t - zero) / 1e6, 3), r.success, r.state) for r in E.breaker_states(df).collect())
    assert got == sorted((k, round(s, 3), ok, state) for k, s, ok, state in want)
    assert ("open" in {s for *_, s in got}) == (pace < 30)
    assert E.breaker_states(df.limit(0)).count() == 0


def test_ingest_a_folder(spark, tmp_path):
    from graphloom.operators import ingest as N

    (tmp_path / "a.csv").write_text("name,city\nAnn,Rome\nBob,Oslo\n")
    (tmp_path / "b.pdf").write_bytes(pdf([b"BT (Ann met Bob) Tj ET"]))
    (tmp_path / "c.docx").write_text("plain")
    extractor = lambda t: F.concat(F.lit("Entities:\nPERSON: Ann\nPERSON: "), F.when(F.contains(t, F.lit("Bob")), "Bob").otherwise(""), F.lit("\n: nobody\n\nRelationships:\nAnn - knows - Bob\nAnn - knows - Eve"))
    parts = N.ingest_folder(spark, str(tmp_path), extractor, chunk_size=20, overlap=5)
    assert {r.text for r in parts["entities"].collect()} == {"Ann", "Bob"}
    status = parts["status"].collect()
    assert sorted(r.success for r in status) == [False, True, True] and all(r.chunk_count > 0 for r in status if r.success) and [r.error for r in status if not r.success][0].startswith("BadZipFile")
    g = N.graph_of(parts)
    ids = {r.text: r.id for r in g.entities.collect()}
    assert {(r.src, r.dst, r.type) for r in g.relationships.collect()} == {(ids["Ann"], ids["Bob"], "knows")}
    assert {r.entity_id for r in g.mentions.collect()} == set(ids.values())


def test_ingest_names_what_it_does_not_take(spark):
    from graphloom.operators import ingest as N

    rows = [("a", "text", None, T0), ("a", "older", None, T0 - dt.timedelta(1)), ("b", None, None, T0), ("c", " \n", None, T0), ("d e", "text", None, T0), ("f", None, "broken", T0), (None, "text", None, T0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id string, content string, error string, ts timestamp, type string")
    parts = N.ingest(docs, lambda t: F.concat(F.lit("Entities:\nWORD: "), t))
    assert {r.doc_id: r.error for r in parts["status"].collect()} == {"a": None, "b": "no content", "c": "no content", "d e": "format_error", "f": "broken"}
    assert [(r.type, r.text) for r in parts["entities"].collect()] == [("WORD", "text")] and parts["relationships"].count() == 0
    assert N.ingest(docs.limit(0), lambda t: t)["status"].count() == 0


def test_operations_of_a_batch(spark):
    from graphloom.operators import ingest as N

    table = spark.createDataFrame([("a", "x", None), ("b", "y", "1"), ("c", "z", "2")], "id string, name string, note string")
    rel = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    ops = [(1, "create", "d", {"name": "new"}), (2, "create", "a", {}), (3, "update", "a", {"name": "u"}), (4, "update", "a", {"name": "v"}), (5, "delete", "b", None), (6, "update", "q", {}), (7, "merge", "e", {"note": "m"}), (8, "fly", "a", {}), (9, "read", "d", None), (10, "create", None, {})]
    left, edges, results = N.apply_operations(table, rel, spark.createDataFrame(ops, "seq int, operation string, id string, data map<string,string>"))
    assert {tuple(r) for r in left.collect()} == {("a", "v", None), ("c", "z", "2"), ("d", "new", None), ("e", None, "m")} and edges.count() == 0
    assert {r.seq: r.error for r in results.collect() if not r.success} == {2: "duplicate", 6: "not_found", 8: "unknown_operation", 10: "missing_required"}
    assert N.apply_operations(table, rel, spark.createDataFrame(ops[4:5], "seq int, operation string, id string, data map<string,string>"), cascade=False)[0].count() == 3


def test_query_graph(spark):
    from graphloom.operators import retrieval as R
    from graphloom.operators.graph import PropertyGraph

    vec = {i: [1.0, i / 10, 0.0] if i < 6 else [0.0, i / 10, 1.0] for i in range(12)}
    vectors = spark.createDataFrame([(i, v) for i, v in vec.items()], "id int, embedding array<double>")
    members = spark.createDataFrame([(i, "near" if i < 6 else "far") for i in vec], "id int, community string")
    rel = spark.createDataFrame([(i, i + 1, "t", 1.0) for i in range(11)], "src int, dst int, type string, confidence double")
    asked = []
    encode = lambda text: asked.append(text) or [1.0, 0.2, 0.0]
    out = R.query_graph(PropertyGraph(members, rel, members), vectors, members, "who?", encode, depth=1, max_subgraphs=4)
    assert not out["hit"] and asked == ["who?"] and [r.community for r in out["communities"].collect()] == ["near"]
    assert out["context"].first().id == 6 and {r.subgraph for r in out["nodes"].filter("id = 6").collect()} <= set(range(6))
    ranked = out["ranked"].collect()
    assert ranked and ranked == sorted(ranked, key=lambda r: (-r.score, r.subgraph)) and 0 < out["confidence"].first()[0] <= 1
    again = R.query_graph(PropertyGraph(members, rel, members), vectors, members, "who?", encode, out["cached"], depth=1, max_subgraphs=4)
    assert again["hit"] and asked == ["who?"] and "cached" not in again


def test_best_first_equals_a_plain_queue(spark):
    import random

    from graphloom.operators import retrieval as R

    rng = random.Random(7)
    vec = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(40)}
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    query = [1.0, 0.5, -0.2, 0.1]
    cos = lambda v: sum(a * b for a, b in zip(v, query)) / (sum(a * a for a in v) * sum(b * b for b in query)) ** 0.5
    near = {i: sorted({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i}, key=lambda j: (-cos(vec[j]), j)) for i in vec}
    queue, done = {3, 8}, []
    while queue and len(done) < 12:
        node = min(queue, key=lambda i: (-cos(vec[i]), i))
        queue.remove(node)
        done.append(node)
        queue |= {j for j in [j for j in near[node] if j not in done][:3]}
    rel = spark.createDataFrame(pairs, "src int, dst int")
    order, _ = R.best_first(rel, spark.createDataFrame(list(vec.items()), "id int, embedding array<double>"), [3, 8], query, 12, 1, 3)
    assert order == done


def test_tables(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, T0), ("b", 2, T0)], "id string, v int, ts timestamp")
    K.write_table(first, str(tmp_path / "t"))
    new = spark.createDataFrame([("a", 5, T0 + dt.timedelta(1)), ("c", 3, T0)], "id string, v int, ts timestamp")
    merged = K.merge_table(spark, str(tmp_path / "t"), new, "id", "ts", str(tmp_path / "u"))
    assert {r.id: r.v for r in merged.collect()} == {"a": 5, "b": 2, "c": 3}
    s = spark.createDataFrame([("s", "text", ["x", "y", "x"])], "id string, content string, entities array<string>")
    K.write_summaries(s, str(tmp_path / "z"))
    assert spark.read.parquet(str(tmp_path / "z/summary_entities")).count() == 2
    cache = s.select(F.md5(F.lit("hello")).alias("id"), F.array(F.lit(1.0)).alias("embedding"))
    hits = K.cached_embeddings(spark.createDataFrame([("hello",), ("new",)], "text string"), cache)
    assert {r.text: r.hit for r in hits.collect()} == {"hello": True, "new": False}


def run_stream(spark, df, build, name, tmp_path):
    df.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}")


def test_streams(spark, tmp_path):
    log = [(i, "a", T0 + dt.timedelta(minutes=i), 1.0 * i, i % 4 != 0) for i in range(180)]
    df = spark.createDataFrame([*log, log[3]], "event_id int, op_type string, ts timestamp_ntz, duration double, success boolean")
    out = run_stream(spark, df, M.retained_statistics, "stats", tmp_path / "a")
    full = out.filter("n >= 60").first()
    assert full is not None and 0.7 < full.success_rate < 0.8
    once = run_stream(spark, df, lambda s: M.once_by_key(s, "event_id"), "once", tmp_path / "b")
    assert once.count() == 180


def test_breaker_stream(spark, tmp_path):
    log = [("a", T0 + dt.timedelta(seconds=i), False) for i in range(6)]
    df = spark.createDataFrame(log, "op_type string, ts timestamp, success boolean")
    out = run_stream(spark, df, M.breaker_stream, "breaker", tmp_path)
    assert [r.state for r in out.orderBy("ts").collect()] == ["closed"] * 4 + ["open", "open"]


DATA = os.environ.get("GRAPHLOOM_TESTDATA", "/root/testdata/sf0.001")


def names():
    from graphloom import catalog

    return sorted(catalog.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", names())
def test_catalog(spark, name):
    """Every query runs, and gives the rows of its SQL where there is one."""
    import duckdb

    from graphloom import catalog

    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    shown = lambda v: "%.8g" % v if isinstance(v, float) else str(v)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLES:
        con = duckdb.connect()
        con.sql("SET TimeZone='UTC'")
        for f in os.listdir(DATA):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
        out = con.sql(catalog.ORACLES[name])
        at = [out.columns.index(c) for c in columns]
        assert rows == sorted(tuple(shown(r[i]) for i in at) for r in out.fetchall())
