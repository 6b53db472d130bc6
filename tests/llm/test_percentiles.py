import math
import random

import pytest

from graphloom.llm import percentiles as P


def exact(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(round(p * len(v), 6))) - 1]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        kind = i % 4
        v = [rng.lognormvariate(0, 3), rng.choice([0.0, -0.0, 1.0]), -rng.expovariate(1e-9), rng.gauss(5, 1)][kind]
        rows.append((i, [None, "a", "b", "c"][kind], v))
    return rows


def table(spark, rows):
    bad = [(-1, "a", None), (-2, "a", float("nan")), (-3, "b", float("inf")), (None, "c", 1.0)]
    return spark.createDataFrame([*rows, *rows[:500], *bad], "id long, g string, v double")


@pytest.mark.parametrize("bits", [64, 32])
def test_ranks_are_exact_within_the_bound(spark, data, bits):
    rows = P.once(table(spark, data), "id", ["g"], "v")
    got = P.percentiles(rows, ["g"], (0.0, 0.5, 0.99, 1.0), bits).collect()
    assert len(got) == 16
    for r in got:
        want = exact([v for _, g, v in data if g == r.g], r.p)
        assert r.n == 750
        assert r.value == want if bits == 64 else abs(r.value - want) <= abs(want) * 2.0**-19


def test_histograms_of_parts_add_up(spark, data):
    whole = P.once(table(spark, data), "id", ["g"], "v")
    parts = [P.histogram(P.once(table(spark, data[a : a + 1000]), "id", ["g"], "v"), ["g"]) for a in (0, 1000, 2000)]
    merged = P.merge(parts[0].union(parts[1]).union(parts[2]), ["g"])
    assert sorted(merged.collect(), key=str) == sorted(P.histogram(whole, ["g"]).select("g", "bin", "n").collect(), key=str)
    for r in P.of_histogram(merged, ["g"], (0.5,)).collect():
        assert r.low <= exact([v for _, g, v in data if g == r.g], 0.5) <= r.high


def test_order_of_integers():
    import numpy as np

    v = np.array([-1e308, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1e308])
    o = P.to_ordered(v)
    assert (np.diff(o) > 0).all() and (P.from_ordered(o) == v).all()
    assert P.to_ordered(np.array([-0.0]))[0] == P.to_ordered(np.array([0.0]))[0]


def test_empty_tables(spark, data):
    rows = P.once(table(spark, data).limit(0), "id", ["g"], "v")
    assert P.percentiles(rows, ["g"]).count() == 0 and P.of_histogram(P.histogram(rows, ["g"]), ["g"]).count() == 0


def test_every_label_has_its_percentiles(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        labels = [None, {}, {"zone": "a"}, {"component": "x"}, {"component": "x", "zone": rng.choice("ab"), "status": "ok"}][i % 5]
        rows.append((i, rng.choice(["m", "k", None]), labels, rng.gauss(0, 9)))
    points = spark.createDataFrame([*rows, *rows[:90], (-1, "m", {"zone": "a"}, float("nan")), (None, "m", {"zone": "a"}, 1.0)], "point_id long, metric string, labels map<string,string>, value double")
    groups = {}
    for _, metric, labels, v in rows:
        for key, label in {"component": None, **(labels or {})}.items():
            groups.setdefault((metric, key, label), []).append(v)
    want = {(*g, p): (len(v), exact(v, p)) for g, v in groups.items() for p in (0.0, 0.5, 0.95)}
    got = P.label_percentiles(points, (0.0, 0.5, 0.95)).collect()
    assert len(got) == len(want) and {(r.metric, r.label_key, r.label, r.p): (r.n, r.value) for r in got} == want
    assert P.label_percentiles(points.limit(0)).count() == 0


def test_the_registered_query_has_every_label_key(spark, tmp_path):
    from graphloom.llm import queries

    schema = "point_id long, metric string, labels map<string,string>, value double"
    spark.createDataFrame([(1, "m", dict.fromkeys(("component", "endpoint", "type", "status", "zone"), "a"), 2.0)], schema).write.parquet(f"{tmp_path}/metric_points.parquet")
    first = next(q for n, q in queries.QUERIES.items() if n.startswith("p3_"))
    assert {r.label_key for r in first(spark, str(tmp_path)).collect()} == {"component", "endpoint", "type", "status", "zone"}


@pytest.mark.parametrize("small", [0, 200_000])
def test_one_value_may_hold_half_of_the_rows(spark, monkeypatch, small):
    monkeypatch.setattr(P, "SMALL", small)  # 0: prefixes are joined by a shuffle
    rng = random.Random(5)
    data = [(i, "hot" if i % 3 else "b", 0.0 if i % 2 else rng.uniform(1.0, 1.0625)) for i in range(6000)]
    rows = P.once(spark.createDataFrame(data, "id long, g string, v double"), "id", ["g"], "v")
    for r in P.percentiles(rows, ["g"], (0.3, 0.5, 0.7, 0.99)).collect():
        assert r.value == exact([v for _, g, v in data if g == r.g], r.p)
