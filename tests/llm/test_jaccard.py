"""The Jaccard join against brute force, and components against union-find."""

import random
import re

import pytest

from paravane.llm import jaccard_join as J
from paravane.llm.components import connected


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "the", "of"]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "two words"), (6, "two words ")]
    for i in range(7, n):
        kind = rng.random()
        if kind < 0.35 or len(out) < 20:
            t = " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 40, 150, 320])))
        else:
            t = (rng.choice(out[7:])[1] or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            t = " ".join(t) + rng.choice(["", "", " tail"])
        out.append((i, t))
    return out


@pytest.mark.parametrize("k,num,seed", [(3, 90, 1), (5, 80, 2)])
def test_components(spark, k, num, seed, monkeypatch):
    rows = corpus(seed, 420)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")
    want = brute(rows, k, num, 100)
    assert sorted(map(tuple, J.components(df, k, num, 100).collect())) == want


def test_tiles_and_second_round(spark):
    """One hot group of near copies, cut into several tiles."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(t)))
    saved, J.BLOCK = J.BLOCK, 24
    try:
        got = J.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    finally:
        J.BLOCK = saved
    assert sorted(map(tuple, got)) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("block,seed", [(8, 3), (3, 4)])
def test_small_blocks_and_a_common_line(spark, monkeypatch, block, seed):
    """Heavy columns, clusters of many tiles and components that several of them share."""
    rng = random.Random(seed)
    line = " ".join(f"longboilerplateword{i}" for i in range(25))
    rows = [(i, f"{line} {t}" if rng.random() < 0.4 else line if rng.random() < 0.1 else t) for i, t in corpus(seed, 220)]
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "HEAVY_BLOCKS", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.components(df, 3, 80, 100).collect())) == brute(rows, 3, 80, 100)


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert J.components(spark.createDataFrame([], schema)).count() == 0
    t = "a b c d e f g h"
    rows = [(None, t), (5, t), (5, t), (7, t), (8, None)]
    got = sorted(map(tuple, J.components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 4, None), (5, 4, 5), (5, 4, 5), (7, 4, 5), (8, 0, 8)], key=str)


def test_connected(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and all(got[200 + i] == 200 for i in range(30))
