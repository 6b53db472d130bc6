import datetime as dt

from graphloom.llm import chunking

DOCS = "doc_id string, content string, config_id string, ingested_at timestamp, _size string"
CONFIGS = "config_id string, chunk_size int, overlap int"
T0 = dt.datetime(2024, 1, 1)


def pieces(spark, texts, size, overlap):
    docs = spark.createDataFrame([(f"d{i}", t, "c", T0, "clash") for i, t in enumerate(texts)], DOCS)
    configs = spark.createDataFrame([("c", size, overlap)], CONFIGS)
    out = {}
    for r in sorted(chunking.split_texts(docs, configs).collect(), key=lambda r: (r.doc_id, r.piece_no)):
        out.setdefault(r.doc_id, []).append((r.start, r.end, r.piece))
    return out


def test_pieces_cover_the_text_and_overlap(spark):
    text = "First paragraph here. It has two sentences.\n\n" + "Second one goes on and on, with a clause; and more. " * 20 + "\n\n" + "x" * 500 + "😀é" * 130
    for size, overlap in ((100, 20), (64, 0), (90, 60), (50, 49)):
        got = pieces(spark, [text], size, overlap)["d0"]
        assert got[0][0] == 0 and got[-1][1] == len(text)
        for start, end, piece in got:
            assert piece == text[start:end] and 0 < len(piece) <= size
        for (_, end, _), (start, _, _) in zip(got, got[1:]):
            assert end - start == min(overlap, end)


def test_cuts_at_the_strongest_boundary(spark):
    got = pieces(spark, ["A sentence stands here. Another one.\n\nA new paragraph begins and goes on for long"], 50, 0)["d0"]
    assert got[0][2].endswith("\n\n") and got[1][2].endswith("long") or got[1][2].endswith(" ")


def test_odd_settings_and_texts(spark):
    got = pieces(spark, [None, "", " ", "short", "y" * 25], 10, 10)  # overlap too large: cut to half
    assert set(got) == {"d2", "d3", "d4"}
    assert all(len(p) <= 10 for v in got.values() for *_, p in v)
    assert pieces(spark, ["z" * 25], 10, None)["d0"][1][0] == 10


def test_oversized_counts_once_and_uses_default(spark):
    rows = [("a", "x" * 1001, None, T0, ""), ("a", "x" * 1001, None, T0 + dt.timedelta(1), ""), ("b", "x" * 1000, None, T0, ""), (None, "x" * 5000, None, T0, ""), ("c", "x" * 41, "small", T0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    configs = spark.createDataFrame([("default", 1000, 200), ("small", 40, None)], CONFIGS)
    assert sorted(r.doc_id for r in chunking.oversized(docs, configs).collect()) == ["a", "c"]
    assert chunking.oversized(docs.limit(0), configs).count() == 0 and chunking.split_texts(docs.limit(0), configs).count() == 0


def test_very_long_text(spark):
    text = ("word " * 40 + "\n") * 3000
    got = pieces(spark, [text], 1000, 100)["d0"]
    assert got[-1][1] == len(text) and all(text[a:b] == p for a, b, p in got[::97])


def test_no_word_is_cut_while_there_is_white_space(spark):
    got = pieces(spark, ["ab cd " + "w" * 45 + " end"], 50, 0)["d0"]
    assert [p for *_, p in got] == ["ab cd ", "w" * 45 + " end"]
