"""Decontamination against brute force over all windows."""

import random
import re
from collections import Counter

from paravane.llm.decontaminate import find


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def weighted(w, k=5):
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    return Counter(parts)


def sim(a, b):
    size = lambda s: len(s.replace(" ", ""))
    low = sum(size(s) * min(a[s], b[s]) for s in a)
    return low / (sum(size(s) * n for s, n in (a | b).items()))


def test_against_all_windows(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 35])))) for i in range(12)] + [(90, None), (91, "...")]
    docs = [(0, None), (1, ""), (2, "!!!")]
    for i in range(3, 120):
        body = [rng.choice(vocab) for _ in range(rng.choice([0, 10, 60]))]
        if rng.random() < 0.6:
            leak = words(rng.choice(items[:12])[1])
            for _ in range(rng.choice([0, 0, 1])):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = leak
        docs.append((i, (" " if i % 2 else "  %% ").join(body).upper() if i % 3 else " ".join(body)))
    want = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v = words(it)
            if v and w:
                best = min((-sim(weighted(w[s : s + len(v)]), weighted(v)), s) for s in range(len(w)))
                if best[0] <= -0.8:
                    want[d, i] = (best[1], round(-best[0], 9))
    got = find(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["start_word"], round(r["similarity"], 9)) for r in got} == want
    assert len(want) > 40


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find(docs, none).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find(docs.limit(0), one).count() == 0
    assert [tuple(r) for r in find(docs.union(docs), one).collect()] == [(1, 1, 0, 6, 1.0)]


def test_insertions_and_deletions_against_every_window(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 4, 9, 14])))  # noqa: E731  of very uneven length
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 17, 26, 40])))) for i in range(150)]
    docs = []
    for i, t in items:
        leak, n = t.split(), rng.randrange(1, 7)
        at = rng.randrange(len(leak))
        if rng.random() < 0.5:
            leak[at:at] = [word() for _ in range(n)]
        else:
            del leak[at : at + n]
        before, after = (rng.choice([0, 0, 5, 30]) for _ in range(2))
        docs.append((i, " ".join([word() for _ in range(before)] + leak + [word() for _ in range(after)])))
    want, of = {}, dict(items)
    for d, t in docs:
        w, v = words(t), words(of[d])
        every = [(-sim(weighted(w[s : s + len(v)]), weighted(v)), s, len(w[s : s + len(v)])) for s in range(len(w))]
        best = min(every, default=(0,))
        if best[0] <= -0.8:
            want[d] = (best[1], best[2], round(-best[0], 9))
    got = find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["start_word"], r["n_words"], round(r["similarity"], 9)) for r in got} == want and 20 < len(want) < 150
    assert all(r["doc_id"] == r["item_id"] for r in got)
    assert any(n < len(words(of[d])) for d, (_, n, _) in want.items())  # documents that end before the window does


def test_item_with_two_texts_and_document_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    items = spark.createDataFrame([(1, a), (1, b), (2, b)], "item_id long, text string")
    docs = spark.createDataFrame([(7, a), (7, "x " + b), (8, "y y " + b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start_word"], r["similarity"]) for r in find(docs, items).collect())
    assert got == [(7, 1, 0, 1.0), (7, 2, 1, 1.0), (8, 1, 2, 1.0), (8, 2, 2, 1.0)]
