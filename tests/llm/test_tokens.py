import base64

import pytest

from graphloom.llm import packing, tokens

TEXTS = ["Hello world", "", None, "naïve 😀 中文 <|endoftext|>", " \n\t", "a" * 30000, "Hello world", "‍é"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def reference():
    import tiktoken
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_another_library(docs):
    other = reference()
    for r in tokens.encode(docs).collect():
        assert r.ids == other.encode_ordinary(r.text or "")


def test_round_trip_and_split_characters(docs, spark):
    back = tokens.decode(tokens.encode(docs)).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    ids = [r.ids for r in tokens.encode(docs).collect() if r.doc_id == 3][0]
    cut = spark.createDataFrame([(ids[:i],) for i in range(len(ids))] + [(None,)], "ids array<int>")
    assert all(r.decoded is None if r.ids is None else r.decoded is not None for r in tokens.decode(cut).collect())


def test_offsets(docs):
    for r in tokens.offsets(docs).collect():
        ends = [t.end for t in r.tokens]
        assert ends == sorted(ends) and (not ends or ends[-1] == len(r.text))


def test_empty_table(docs):
    assert tokens.encode(docs.limit(0)).count() == 0 and packing.pack_texts(docs.limit(0)).count() == 0


def brute_force(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_packing_is_best_fit_decreasing(spark):
    import random

    rng = random.Random(5)
    for capacity, n in ((10, 60), (37, 400), (100, 300), (3, 1)):
        sizes = [rng.choice([rng.randint(1, capacity), capacity // 3 + 1]) for _ in range(n)]
        df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens int, container_id string").repartition(3)
        rooms = {}
        for r in packing.fill(df.cache(), "doc_id", "n_tokens", capacity).collect():
            rooms[r.container_id] = rooms.get(r.container_id, capacity) - r.n_tokens
        assert sorted(rooms.values()) == brute_force(sizes, capacity)


def test_packing_splits_only_what_is_too_long(spark):
    sizes = [0, None, 25, 10, 3, 3, 7, 0]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, n_tokens int").cache()
    rows = packing.fill(df, "doc_id", "n_tokens", 10).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r.n_tokens)
    assert sorted(parts[2]) == [5, 10, 10] and all(len(v) == 1 for k, v in parts.items() if k != 2) and len(parts) == 8
    filled = {}
    for r in rows:
        filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
    assert max(filled.values()) <= 10 and len(filled) == 5
