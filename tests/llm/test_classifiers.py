"""Language ID, quality and toxicity: held-out accuracy, brute force and odd inputs."""

import math
import random

import numpy as np
import pytest

from paravane.llm import langid, quality, toxicity
from paravane.llm.common import fold

SYLLABLES = {"aa": "ka lo mi ne su ta".split(), "bb": "schei gra dunk wor zel".split(), "cc": "äo çe iê où ría".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize()


def longest_match_phrases(symbols, sample):
    """Greedy cross parsing by substring search."""
    text, phrases, at = "".join(map(chr, sample)), 0, 0
    s = "".join(map(chr, symbols))
    while at < len(s):
        size = 1
        while at + size <= len(s) and s[at : at + size] in text:
            size += 1
        at += max(1, size - 1)
        phrases += 1
    return phrases


def test_cross_parsing_against_substring_search():
    rng = random.Random(1)
    parser = langid.CrossParser({k: prose(rng, k, 200) for k in SYLLABLES})
    texts = [prose(rng, rng.choice(list(SYLLABLES)), rng.choice([1, 5, 40])) + rng.choice(["", " 12!", " жук"]) for _ in range(60)] + ["", "...", "ж"]
    texts += [prose(rng, k, 900) + " жук 12 " + prose(rng, "bb", 700) for k in SYLLABLES]  # of many segments
    counts, sizes = parser.counted(texts)
    symbols, at = parser.normalise(texts)
    rng2 = random.Random(1)
    samples = {k: prose(rng2, k, 200) for k in SYLLABLES}
    for k, lang in enumerate(parser.languages):
        sample, _ = parser.normalise([samples[lang]])
        for i in range(len(texts)):
            own = symbols[at[i] : at[i + 1]].tolist()
            assert counts[k][i] == longest_match_phrases(own, sample.tolist())
    assert sizes.tolist() == np.diff(at).tolist()


def test_pieces_of_a_long_text_parse_as_the_whole(monkeypatch):
    rng = random.Random(5)
    parser = langid.CrossParser({k: prose(rng, k, 200) for k in SYLLABLES})
    texts = ["   ".join(prose(rng, k, 30) for k in "aa bb cc aa".split()) + "!!  " for _ in range(4)] + ["", "a"]
    whole, sizes = parser.counted(texts)
    for size in (7, 20, 64):
        monkeypatch.setattr(langid, "PIECE", size)
        counts, short = parser.counted(texts)
        assert (counts == whole).all() and (short == sizes).all()


def test_eighty_languages(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = {f"l{n:02d}": ["".join(rng.choice(letters) for _ in range(rng.choice([2, 3]))) for _ in range(12)] for n in range(80)}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(f"l{i % 80:02d}", 60), f"l{i % 80:02d}") for i in range(640)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, df.filter("doc_id < 480")).collect()}
    assert len(set(got.values())) == 80 and sum(got[i] == lang for i, _, lang in rows if i >= 480) >= 0.98 * 160


def test_sample_is_bounded_and_prefers_short_documents(spark):
    rows = [(i, "lang a text " * 400, "a") for i in range(50)] + [(100 + i, f"short {i} " * 20, "a") for i in range(700)] + [(2000, "z" * 100_000, "z"), (None, "x", "a"), (5, None, "a"), (6, "x", None)]
    got = dict(langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert set(got) == {"a", "z"} and len(got["z"]) == langid.SAMPLE_CHARS and "lang" not in got["a"] and 47_000 < len(got["a"]) < 49_000


def test_language_held_out(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice(list(SYLLABLES)), rng.choice([4, 30, 200])), 0.5) for i in range(400)]
    lang = {i: next(k for k in SYLLABLES if any(s in t.lower() for s in SYLLABLES[k])) for i, t, _ in rows}
    rows += [(900, None, 0.1), (901, "", 0.1), (902, "123 !!", 0.1), (903, "ka lo mi", 0.1), (903, "ka lo mi", 0.1)]
    df = spark.createDataFrame([(i, t, s, lang.get(i)) for i, t, s in rows], "doc_id long, text string, score double, lang string")
    train = df.filter(fold("doc_id", 3) != 1).select("doc_id", "text", "lang")
    got = langid.identify(df, train).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert sum(by[i]["lang_pred"] == lang[i] for i in lang) / len(lang) > 0.98
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[900]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["doc_id"] == 903 for r in got) == 2
    assert langid.identify(df.limit(0), train).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, train.limit(0)).collect()} == {"und"}


def test_ordinal_thresholds_are_ordered_and_learned():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    latent = x @ np.array([2, -1, 0.5, 0, 0, 1]) + rng.logistic(size=3000)
    y = np.digitize(latent, [-2, 0.5, 2]).astype(float)
    model = quality.CumulativeLink.fit(x, y)
    assert (np.diff(model.theta) > 0).all() and np.corrcoef(model.weights, [2, -1, 0.5, 0, 0, 1])[0, 1] > 0.98
    mean, tail = model.predict(x, 2.0)
    assert np.corrcoef(mean, y)[0, 1] > 0.7 and ((tail >= 0) & (tail <= 1)).all() and (mean[tail > 0.9] > 2).all()


def test_quality_frame(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        good = i % 3 != 0
        rows.append((i, prose(rng, "aa", 60) if good else " ".join(w.upper() + "!!" for w in prose(rng, "aa", 60).split()), float(good), "x"))
    df = spark.createDataFrame([*rows, (900, None, None, "x"), (901, "", None, "x")], "doc_id long, text string, rating double, selected string")
    train = df.filter("doc_id < 200").select("doc_id", "text", "rating")
    got = {r["doc_id"]: r for r in quality.grade(df, train).collect()}
    assert len(got) == 302 and all(got[i]["selected"] == (i % 3 != 0) for i in range(200, 300))
    assert got[900]["tail_prob"] == got[901]["tail_prob"]
    assert quality.grade(df.limit(0), train).count() == 0
    none = quality.grade(df, train.limit(0)).first()
    assert none["tail_prob"] is None and none["selected"] is False


def test_grammar_readings():
    g = toxicity.Grammar({"moron": 4.0}, {"vequ": 3.0})
    plain = g.clause("such a moron here")
    assert plain == 4.0
    assert g.clause("you moron") > plain > g.clause("he said moron was used") and g.clause("not a moron") < plain
    assert g.clause("a kind word") == 0.0 and g.clause("vequille") == 3.0 and g.clause("vequ") == 0.0
    assert g.clause("i will kill") >= toxicity.THREAT and g.clause("kill the lights") == 0.0
    assert g.clauses("All fine. A moron! Fine again; oxymoron, unmoron.") == [4.0]
    assert len(g.clauses("moron. moron\nmoron | moron")) == 4 and g.clauses("") == []


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    bad = ["moron", "blarg", "vequille", "vequance", "vequeur", "vequique"]
    rows = []
    for i in range(500):
        words = prose(rng, rng.choice(["aa", "bb"]), rng.choice([20, 80, 200])).split()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame([*rows, (900, None, None), (901, "", None)], "doc_id long, text string, predicted int")
    train = df.filter(fold("doc_id", 4) != 2).selectExpr("doc_id", "text", "predicted AS toxic")
    got = {r["doc_id"]: r for r in toxicity.score(df, train).collect()}
    assert len(got) == 502 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert sum(got[i]["predicted"] == y for i, _, y in rows) / 500 > 0.98
    assert got[900]["score"] == got[901]["score"] < 0.3
    assert toxicity.score(df.limit(0), train).count() == 0
    seeds = {r["doc_id"]: r for r in toxicity.score(df, train.limit(0)).collect()}
    assert all(math.isfinite(r["score"]) for r in seeds.values())


@pytest.mark.parametrize("seed", range(3))
def test_logistic_is_stationary(seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 2))])
    y = (rng.random(200) < 1 / (1 + np.exp(-x @ [0.2, 1, -1]))).astype(float)
    w = toxicity.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + 1e-2 * w).max() < 1e-6


def every_path(parts, symbols):
    """Weights of all accepted paths, by walking the five transducers one after the other over whole strings."""
    strings = [([s for s, _ in symbols], 1.0)]
    for k, part in enumerate(parts):
        out = []
        for string, weight in strings:
            walks = [(part.start, [], weight)]
            for place, symbol in enumerate(string):
                walks = [
                    (to, [*done, made], w * v * (symbols[place][1] if k == 0 and made & toxicity.PICK else 1.0))
                    for state, done, w in walks
                    for made, v, to in part.arcs(state, symbol)
                ]
            out += [(done, w) for _, done, w in walks]
        strings = out
    return [w for string, w in strings if any(s & toxicity.PICK for s in string)]


@pytest.mark.parametrize("seed", range(4))
def test_composition_against_all_paths(seed):
    rng = random.Random(seed)
    g = toxicity.Grammar({"moron": 4.0, "kill": 1.5}, {"vequ": 3.0})
    vocab = ["moron", "vequille", "you", "not", "said", '"', "i", "will", "kill", "the", "quiet", "they", "never"]
    parts = [
        toxicity.picking(toxicity.INSULT),
        toxicity.threatening(),
        toxicity.scope(lambda s: toxicity.TARGET_GAP + 1 if s & toxicity.TARGET else 0, toxicity.TARGETED, also=toxicity.ADDRESSED),
        toxicity.scope(lambda s: toxicity.NEGATION_SCOPE if s & toxicity.NEGATION else 0, toxicity.NEGATED),
        toxicity.scope(lambda s: toxicity.REPORT_SCOPE if s & toxicity.REPORT else 0, toxicity.REPORTED, toggles=toxicity.QUOTE),
    ]
    for _ in range(60):
        symbols = g.symbols(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 9))))
        want = every_path(parts, symbols)
        best, total = toxicity.paths(symbols)
        assert best == pytest.approx(max(want, default=0.0)) and total == pytest.approx(sum(want))


def test_target_must_lead_up_to_the_insult():
    g = toxicity.Grammar({"moron": 4.0}, {})
    aimed = 4.0 * toxicity.TARGETED
    assert g.clause("you are a moron") == pytest.approx(aimed) == pytest.approx(g.clause("moron you"))
    for apart in ("the moron left while they slept", "the moron who saw them", "you and all of the other people there saw a moron"):
        assert g.clause(apart) == pytest.approx(4.0)
    assert g.clause("you are not a moron") == pytest.approx(aimed * toxicity.NEGATED)
    assert g.clause('he said "you moron"') == pytest.approx(aimed * toxicity.REPORTED)


def naive_features(text):
    """The quality features of one text, counted one by one."""
    out = np.zeros(quality.FEATURES)
    b, words = text.encode(), ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split()]
    kinds = []
    if len(b) >= 3:
        kinds.append([((b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA77 + b[i + 2] * 0xC2B2AE3D) * 0x27D4EB2F % 2**32) >> 20 for i in range(len(b) - 2)])
    if words:
        n = min(quality.PATTERN_WORDS, len(words))
        bits = []
        for i in range(len(words) - n + 1):
            pairs = [(x, y) for x in range(n) for y in range(x + 1, n)]
            bits.append(sum((words[i + x] == words[i + y]) << k for k, (x, y) in enumerate(pairs)))
        kinds.append(quality.cells(1, np.array(bits)).tolist())
        times = [words.count(w) for w in words]
        kinds.append(quality.cells(2, np.array([int(math.log2(t)) << 8 | len(words).bit_length() for t in times])).tolist())
    for found in kinds:
        for cell in set(found):
            out[cell] += math.sqrt(found.count(cell) / len(found))
    return out


def test_quality_features_one_by_one():
    rng = random.Random(9)
    texts = [prose(rng, rng.choice(list(SYLLABLES)), n) for n in (1, 2, 5, 60)] + ["aa aa aa aa Aa aa aa", "", "x", "  "]
    got = quality.features(texts)
    assert np.abs(got - np.stack([naive_features(t) for t in texts])).max() < 1e-6


def test_quality_fit_against_the_plain_likelihood():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = np.digitize(x @ np.array([1.5, -1, 0.3]) + rng.logistic(size=400), [-1.5, 0, 1.2]).astype(float)  # four grades
    model = quality.CumulativeLink.fit(x, y)

    def loss(weights, theta):
        total = 0.0
        for row, grade in zip(x, y.astype(int)):
            eta = float(row @ weights)
            cdf = [0.0, *(1 / (1 + math.exp(-(t - eta))) for t in theta), 1.0]
            total -= math.log(cdf[grade + 1] - cdf[grade])
        return total / len(y) + quality.RIDGE / 2 * float(weights @ weights)

    least = loss(model.weights, model.theta)
    for _ in range(30):  # no step in any direction helps
        dw, dt = rng.normal(size=3) * 0.05, rng.normal(size=3) * 0.05
        assert loss(model.weights + dw, np.sort(model.theta + dt)) >= least - 1e-5
    mean, tail = model.predict(x[:20], 2.0)
    for row, m, t in zip(x[:20], mean, tail):
        cdf = [0.0, *(1 / (1 + math.exp(-(c - float(row @ model.weights)))) for c in model.theta), 1.0]
        chance = [b - a for a, b in zip(cdf, cdf[1:])]
        assert m == pytest.approx(sum(k * p for k, p in enumerate(chance)), abs=1e-5) and t == pytest.approx(chance[2] + chance[3], abs=1e-5)


def test_quality_takes_any_number_of_grades(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, prose(rng, "aa", 20) + " zz" * (i % 50), float(i % 50)) for i in range(300)], "doc_id long, text string, rating double")
    got = quality.grade(df, df, least=25.0).collect()
    assert len(got) == 300 and sum(r["selected"] == (r["doc_id"] % 50 >= 25) for r in got) > 270
