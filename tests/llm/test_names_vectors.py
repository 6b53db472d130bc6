import random

import numpy as np
import pytest

from graphloom.llm import names, vectors

ENTITY = "result_id long, entities array<struct<type: string, text: string, start_idx: int, end_idx: int>>, key string"
PEOPLE = {
    "a": ["Margaret Vuzanerahu", "margaret  vuzanerahu", "Vuzanerahu, Margaret", "VUZANERAHU Margaret", "Prof. M. Vuzanerahu", "Peggy Vuzanerahu", "Margaret Vuzeanerahu", "Margaret J. Vuzanerahu", "Marg. Vuzanerahu", "Margarte Vuzanerahu", "Vuzanerahu, M. J.", "margaret.vuzanerahu", "Margaret Vùzánèráhù"],
    "b": ["Oliver Vuzanerahu", "O. Vuzanerahu", "Ollie Vuzanerahu", "Oliver Vuzanerhau"],
    "c": ["Margaret Bogasaraba", "Maggie Bogasaraba", "Bogasaraba M."],
    "d": ["Thomas Lefabiko", "Tom Lefabiko"],
}
FIRMS = {
    "e": ["Disisidiso Water Association Ltd", "The Disisidiso Water Association", "Water Association, Disisidiso", "Disisidiso-Water Association", "Disisidiso Water Assoc.", "DISISIDISO WATER ASSOCIATION LTD", "Dissidiso Water Association, Ltd."],
    "f": ["Disisidiso Research Foundation", "Disisidiso Rsch. Fdn"],
    "g": ["Mujuremiva Research Foundation plc", "Mujuremiva Research Foundation, p.l.c."],
    "h": ["Kalesijado Water Association"], "i": ["Tebeporefa Research Foundation GmbH", "Tebeporefa Water Association"][:1],
}


def test_spellings_are_linked(spark):
    entities = [("PERSON", t) for v in PEOPLE.values() for t in v] + [("ORGANIZATION", t) for v in FIRMS.values() for t in v]
    entities += [("PERSON", None), ("PERSON", ""), ("PERSON", "n/a"), ("LOCATION", "Margaret Vuzanerahu"), (None, "Oliver Vuzanerahu"), ("PERSON", "x" * 3000)]
    rows = [(i, [(k, t, -1, -1)], "z") for i, (k, t) in enumerate(entities)]
    table = spark.createDataFrame([*rows, rows[0], (-1, None, "z"), (-2, [], "z"), (-3, [None], "z")], ENTITY)
    got = {(r.entity_type, r.name_a, r.name_b) for r in names.name_pairs(table).collect()}
    want = {(k, *sorted((a, b))) for k, groups in (("PERSON", PEOPLE), ("ORGANIZATION", FIRMS)) for v in groups.values() for a in v for b in v if a != b}
    assert got == want
    assert names.name_pairs(table.limit(0)).count() == 0


def test_short_form_of_several_persons_is_left_out(spark):
    texts = ["Margaret Vuzanerahu", "Michael Vuzanerahu", "M. Vuzanerahu"]
    table = spark.createDataFrame([(i, [("PERSON", t, -1, -1)], "z") for i, t in enumerate(texts)], ENTITY)
    assert names.name_pairs(table).count() == 0


def test_chains_of_spellings_end_at_one_standard(spark):
    word = "gablemurtosine"
    chain = [word[:4] + "x" * i + word[4 + i :] for i in range(10)]
    words = spark.createDataFrame([("ORGANIZATION", t, 2**i, 2**i) for i, t in enumerate(chain)], "type string, token string, n long, occ long")
    got = {r.token: r.standard for r in names.standard_tokens(words).collect()}
    assert got == dict.fromkeys(chain[:-1], chain[-1])


def test_trie_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 11))) for _ in range(120)]
    found = {(a, b, d) for a, b, d in names.trie_join(base, base)}
    want = {(a, b, names.distance(a, b, 2)) for a in base for b in base if a != b and names.distance(a, b, 2) <= 2}
    assert found == want
    monkeypatch.setattr(names, "SHARD", 20)  # split shards
    words = spark.createDataFrame([("PERSON", w) for w in sorted(set(base))], "type string, token string")
    got = {(r.token, r.other) for r in names.neighbours(words).collect()}
    assert {(a, b) for a, b, d in want if d <= 1 or max(len(a), len(b)) >= 8} <= got


@pytest.mark.parametrize("least", [None, 0.8])
def test_nearest_vectors(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "BLOCK", 150)
    monkeypatch.setattr(vectors, "CELL", 32)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 64))
    x = centres[rng.integers(0, 12, 900)] + rng.choice([0.1, 0.4, 2.0], 900)[:, None] * rng.standard_normal((900, 64))
    x = x.astype(np.float32) * rng.lognormal(0, 3, 900).astype(np.float32)[:, None]
    rows = [(f"v{i}", [float(y) for y in v], "z") for i, v in enumerate(x)]
    bad = [("n1", None), ("n2", []), ("n3", [1.0] * 63), ("n4", [0.0] * 64), ("n5", [float("nan")] * 64), ("n6", [float("inf")] + [1.0] * 63), ("n7", [None] * 64), (None, [1.0] * 64)]
    table = spark.createDataFrame([*rows, *rows[:30], *[(a, b, "z") for a, b in bad]], "id string, embedding array<float>, similarity string")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"v{i}", f"v{j}") for i in range(900) for j in np.argsort(-s[i])[:5] if least is None or s[i, j] >= least}
    got = {(r.id, r.other) for r in vectors.nearest(table, least=least).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_equal_vectors_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    table = spark.createDataFrame([(f"v{i:03}", [1.0] * 64) for i in range(200)], "id string, embedding array<float>")
    rows = vectors.nearest(table).collect()
    assert len(rows) == 1000 and all(r.similarity == pytest.approx(1) and r.id != r.other for r in rows)
    assert vectors.nearest(table.limit(1)).count() == 0 and vectors.nearest(table.limit(0)).count() == 0
