"""Planted passages are found and clean documents left alone."""

import random

from paravane.llm import passages as S


def planted(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [text(n) for n in (55, 70, 160, 400)]
    rows, holds = [], {}
    for i in range(260):
        body = text(rng.choice([20, 90, 300, 700]))
        if i % 2 == 0:
            which = rng.randrange(4)
            p = list(shared[which])
            fuzzy = which >= 2 and rng.random() < 0.5
            if fuzzy:
                for _ in range(len(p) // 40):
                    at = rng.randrange(len(p))
                    p[at : at + rng.choice([0, 1, 1])] = text(1)
            at = rng.randrange(len(body) + 1)
            body[at:at] = p
            holds[i] = which
        rows.append((i, (" " if i % 3 else "\n").join(body)))
    return rows, holds, [len(s) for s in shared]


def test_planted(spark):
    rows, holds, sizes = planted()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, source_id int")
    got = S.find(df).collect()
    first = {}
    for i in sorted(holds):
        first.setdefault(holds[i], i)
    want = {i for i in holds if i != first[holds[i]]}
    assert {r["doc_id"] for r in got} == want
    assert {r["source_id"] for r in got} <= set(holds)
    for r in got:
        assert holds[r["source_id"]] == holds[r["doc_id"]] and r["n_words"] >= 50 and r["alike"] >= 0.8
    covered = {}
    for r in got:
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    for i, places in covered.items():  # several sources may share the passage between them
        assert -30 <= len(places) - sizes[holds[i]] <= 15
    left = {r["doc_id"]: r["text"] for r in S.remove(df, spark.createDataFrame(got)).collect()}
    assert set(left) == set(range(260))
    for i, t in rows:
        assert (left[i] == t) == (i not in want)
        if i in want:
            assert len(left[i].split()) <= len(t.split()) - 50


def test_copies_and_hot_passage(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    t = " ".join(rng.choice(words) for _ in range(120))
    rows = [(i, t) for i in range(200)] + [(i, " ".join(rng.choice(words) for _ in range(100))) for i in range(200, 230)]
    got = S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["source_id"], r["start_word"], r["n_words"], r["alike"]) for r in got) == [(i, 0, 0, 120, 1.0) for i in range(1, 200)]


def test_odd(spark):
    schema = "doc_id long, text string"
    assert S.find(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(f"a{i}" for i in range(80))
    rows = [(None, t), (1, t), (1, t), (2, None), (3, ""), (4, "short text"), (5, (t + " ") * 3)]
    got = S.find(spark.createDataFrame(rows, schema)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(5, 1)}
    assert S.cut_words("a b  c d\ne", [(1, 2)]) == "a d\ne" and S.cut_words("a b", [(0, 9)]) == ""


def test_chains_against_all_predecessors():
    rng = random.Random(1)
    for _ in range(200):
        runs = []
        for _ in range(rng.randrange(2, 12)):
            a, b, n = rng.randrange(200), rng.randrange(200), rng.randrange(1, 5)
            runs.append((a, a + 6 * (n - 1), b, b + 6 * (n - 1), n))
        runs = sorted(set(runs))
        if len(runs) < 2:
            continue

        def worth(chain):
            gaps = sum(q[0] - p[1] + q[2] - p[3] for p, q in zip(chain, chain[1:]))
            return sum(S.GAIN * r[4] - S.GAP_COST * (r[1] - r[0] + r[3] - r[2]) for r in chain) - S.GAP_COST * gaps

        best = {}
        for r in sorted(runs, key=lambda r: r[0]):
            own = worth([r])
            best[r] = own + max([0.0, *(best[p] - S.GAP_COST * (r[0] - p[1] + r[2] - p[3]) for p in runs if p in best and p[1] < r[0] and p[3] < r[2])])
        got = S.chains(runs)
        assert sorted(r for c in got for r in c) == runs
        assert abs(max(map(worth, got)) - max(best.values())) < 1e-9


def test_repeats_around_new_words(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    header, footer, tail = text(55), text(55), text(60)
    rows = [(gap, " ".join(header + text(gap) + footer + text(200) + tail)) for gap in (50, 30, 120)]
    got = S.find(spark.createDataFrame([(10 + n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    for n, (gap, _) in enumerate(rows):
        spans = [(r["start_word"], r["n_words"]) for r in got if r["doc_id"] == 10 + n]
        assert len(spans) == (3 if n else 0)
        for at, size in ((0, 55), (55 + gap, 55), (310 + gap, 60)):
            assert not n or any(abs(s - at) <= 3 and abs(s + m - at - size) <= 3 for s, m in spans)


def test_split_against_all_parts():
    rng = random.Random(6)
    for _ in range(150):
        x, y, at_x, at_y, pairs = [], [], 0, 0, []
        for _ in range(rng.randrange(2, 12)):
            for _ in range(rng.choice([3, 10, 25, 55])):
                pairs.append((at_x, at_y))
                at_x, at_y = at_x + 1, at_y + 1
            at_x, at_y = at_x + rng.choice([1, 1, 3, 15, 40]), at_y + rng.choice([1, 1, 3, 15, 40])
        got = S.split(S.np.array(pairs), 50, 0.8)
        for a0, a1, b0, b1, alike in got:
            inside = [p for p in pairs if a0 <= p[0] < a1]
            assert min(a1 - a0, b1 - b0) >= 50 and alike == len(inside) / max(a1 - a0, b1 - b0) >= 0.8
            assert inside == [p for p in pairs if b0 <= p[1] < b1]
        covered = {p for a0, a1, *_ in got for p in pairs if a0 <= p[0] < a1}
        run = []  # every exact repeat of 50 words is covered
        for p in pairs + [(-9, -9)]:
            if run and (p[0] - run[-1][0], p[1] - run[-1][1]) != (1, 1):
                assert len(run) < 50 or covered >= set(run)
                run = []
            run.append(p)


def test_first_copy_of_common_words(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    copies = {n: text(n) for n in (50, 60)}
    rows, i = [], 0
    for p in copies.values():  # every run of 9 words occurs in an earlier document of its own
        for at in range(len(p) - 8):
            rows.append((i, " ".join(text(30) + p[at : at + 9] + text(30))))
            i += 1
    for n, p in copies.items():
        rows += [(1000 + n, " ".join(text(40) + p + text(40))), (2000 + n, " ".join(text(70) + p + text(10)))]
    got = S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(2000 + n, 1000 + n) for n in copies}
    for r in got:
        assert abs(r["start_word"] - 70) <= 3 and abs(r["source_start"] - 40) <= 3 and r["n_words"] >= 50 and r["alike"] >= 0.95


def test_recall_of_changed_passages(spark):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, sizes = [], {}
    for size, every in ((50, 10), (50, 8), (60, 10), (60, 8), (60, 6), (80, 8)):
        for _ in range(8):
            p = text(size)
            changed = [f"new{rng.randrange(10**6)}" if i % every == every // 2 else w for i, w in enumerate(p)]
            n = len(sizes)
            rows += [(n, " ".join(text(30) + p + text(30))), (1000 + n, " ".join(text(45) + changed + text(15)))]
            sizes[1000 + n] = size
    got = S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(d, d - 1000) for d in sizes}  # all alike between 0.83 and 0.9
    for r in got:
        assert r["alike"] >= 0.8 and abs(r["start_word"] - 45) <= 3 and abs(r["n_words"] - sizes[r["doc_id"]]) <= 6


def test_recall_between_least_alike_and_equal(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, kinds = [], {}
    for kind in ("changed", "inserted", "deleted"):
        for every in (5, 6, 7, 8, 10, 12):
            for _ in range(20):
                p, q = text(120), []
                for i, w in enumerate(p):
                    new = [f"new{rng.randrange(10**6)}"]
                    q += [w] if i % every != every // 2 else new if kind == "changed" else [w, *new] if kind == "inserted" else []
                n = len(kinds)
                kinds[n] = kind, every
                rows += [(n, " ".join(text(60) + p + text(60))), (10_000 + n, " ".join(text(30) + q + text(90)))]
    got = S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["source_id"] == r["doc_id"] - 10_000 for r in got)
    found = {r["doc_id"] - 10_000: r["n_words"] for r in got}
    for kind in set(kinds.values()):
        own = [n for n, k in kinds.items() if k == kind]
        assert sum(n in found for n in own) >= 0.95 * len(own), kind
        assert sum(found.get(n, 0) for n in own) >= 85 * len(own), kind


def test_gaps_wider_than_an_alignment(spark):
    rng = random.Random(14)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    x = S.np.array([rng.randrange(10**6) for _ in range(400)], S.np.uint32)
    y = S.np.concatenate([x[:150], S.np.array([7, 8, 9], S.np.uint32), x[150:390]])
    assert len(S.fill(x, y)) == 390
    p = text(700)  # one passage of 700 words with 20 foreign ones in its midst
    rows = [(1, " ".join(text(30) + p + text(30))), (2, " ".join(text(50) + p[:350] + text(20) + p[350:] + text(9)))]
    got = S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["source_id"]) for r in got] == [(2, 1)] and abs(got[0]["n_words"] - 720) <= 2 and abs(got[0]["start_word"] - 50) <= 2


def test_texts_that_repeat_a_few_words(spark):
    rows = [(1, "ab cd " * 100), (2, "x y z " + "ab cd " * 150), (3, "ef " * 90), (4, "q " + "ef " * 200)]
    got = S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {}
    for r in got:
        covered.setdefault((r["doc_id"], r["source_id"]), set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    assert set(covered) == {(2, 1), (4, 3)} and len(covered[2, 1]) >= 280 and len(covered[4, 3]) >= 180


def test_one_seed_in_unlike_contexts(spark):
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, n = [], 0
    while n < 12:
        p = text(50)
        changed = [text(1)[0] if i % 5 == 2 else w for i, w in enumerate(p)]
        one, other = (" ".join(text(40) + words + text(40)) for words in (p, changed))
        which, _, h, contexts = S.seeds([one, other])
        _, i, j = S.np.intersect1d(h[which == 0], h[which == 1], return_indices=True)
        unlike = contexts[which == 0][i] ^ contexts[which == 1][j]
        if len(i) == 1 and unlike[0] >> 16 and unlike[0] & 0xFFFF:
            rows += [(n, one), (1000 + n, other)]
            n += 1
    got = S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"], r["start_word"], r["n_words"]) for r in got} == {(1000 + n, n, 40, 50) for n in range(12)}


def test_rows_of_a_group_of_copies(spark, monkeypatch):
    rng = random.Random(31)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    p, met, plain = text(300), {}, S.arrow_map

    def spy(df, run, schema):
        met[run.__name__] = df
        return plain(df, run, schema)

    monkeypatch.setattr(S, "arrow_map", spy)
    rows = [(i, " ".join(text(20) + p[:150] + text(i % 3) + p[150:] + text(20))) for i in range(100)]
    got = S.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r["doc_id"], r["n_words"]) for r in got if r["source_id"] == 0} == {(i, 300 + i % 3) for i in range(1, 100)}
    assert met["chain"].count() <= 8 * 99  # not one for every so many words of every copy


def test_any_dealing_into_tasks(spark):
    rows, _, _ = planted(seed=17)
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in rows[:60]], "doc_id long, text string")
    places = lambda df: {(r["doc_id"], w) for r in S.find(df).collect() for w in range(r["start_word"], r["start_word"] + r["n_words"])}
    together, apart = places(df.coalesce(1)), places(df.repartition(80, "doc_id"))
    assert len(together ^ apart) <= 0.002 * len(apart)
    assert {d for d, _ in together} == {d for d, _ in apart}
