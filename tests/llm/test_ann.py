"""Recall against brute force, exact scores, and odd vectors."""

import numpy as np

from paravane.llm import ann


def brute(rows, top):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = x @ q
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:top]
            out[int(i)] = [int(ids[k]) for k in order]
    return out


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(0, 12, 6000)] + 0.6 * rng.normal(size=(6000, 32))).astype(np.float32)
    x[100:1500] = x[100]  # a very common vector
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 20 = 0").collect()
    want = brute(rows, 20)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = r
    assert set(found) == set(want) and all(sorted(v) == list(range(1, 21)) for v in found.values())
    hits = sum(len({r["vec_id"] for r in found[q].values()} & set(ids)) for q, ids in want.items())
    assert hits / (20 * len(want)) >= 0.9
    for q, ranks in list(found.items())[:30]:
        for r in ranks.values():
            assert abs(r["score"] - float(x[q].astype(float) @ x[r["vec_id"]].astype(float))) < 1e-9
            assert r["vec_id"] != q
        order = [(-ranks[k]["score"], ranks[k]["vec_id"]) for k in sorted(ranks)]
        assert order == sorted(order)


def test_small_and_odd(spark):
    schema = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 1.0], "b"), (2, [0.0, 0.0], "c"), (3, None, "d"), (4, [1.0, None], "e"), (5, [float("nan"), 1.0], "f"), (6, [2.0, 0.0], "g"), (7, [1.0], "h"), (20, [1.0, 1.0], "i"), (None, [5.0, 5.0], "j"), (9, [float("inf"), 0.0], "k"), (10, [], "l")]
    got = sorted(tuple(r) for r in ann.search(spark.createDataFrame(rows, schema), "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 6, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 1, 2.0), (20, 2, 6, 2.0), (20, 3, 0, 1.0)]
    assert ann.search(spark.createDataFrame([], schema), "vec_id % 20 = 0").count() == 0


def test_each_length_is_searched(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [3.0, 0.0]), (20, [1.0, 0.0, 1.0]), (21, [0.0, 0.0, 2.0]), (22, [5.0, 1.0, 0.0]), (40, [1.0])]
    got = sorted(tuple(r) for r in ann.search(spark.createDataFrame(rows, schema), "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 2, 3.0), (0, 2, 1, 2.0), (20, 1, 22, 5.0), (20, 2, 21, 2.0)]
