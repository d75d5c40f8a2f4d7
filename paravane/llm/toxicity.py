"""Toxicity by a weighted finite-state pattern grammar.

A clause is read by five weighted transducers, each one's output being the next
one's input; ``compose`` makes one machine of them.

* **insult** reads words, passes on their classes, and may pick one that is in a
  learned lexicon of words and stems, at its weight;
* **threat** may pick a verb of harm that follows a first-person subject and a
  future or modal word, in this order and with short gaps;
* **target** raises a pick that a word for a person leads up to ("you are a ..."),
  or that such a word follows at once ("... like you" does not, "... you" does);
* **negation** has a scope of a few words in which picks shrink;
* **reported speech** shrinks picks after a verb of saying or inside quotes.

Weights multiply along a path.  An accepted path picks exactly one word, so a
path is a reading of the clause.  The clause's score is the weight of the best
path (the maximum over paths) plus a share of the others' (their sum less it);
a document is scored from its matched clauses.  The lexicon is learned from
labelled documents as log-odds of words and stems, and a logistic model turns a
document's clause scores into a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paravane.llm.common import arrow_map, bounded_sample, keyed_text, settle, text_of, text_slices

#: Labelled documents that are used at most, lexicon entries kept, and documents an entry must mark.
SAMPLE_ROWS, LEXICON, LEAST_DOCS = 6_000, 4_000, 5
#: Lengths of stems; the log-odds an entry needs.
STEMS, LEAST_ODDS = range(4, 9), 2.2

#: The grammar's closed word classes (English, German, French, Spanish).
SEED_INSULTS = "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting clown dumb imbecile dummkopf trottel arschloch abschaum idiote connard imbécile débile estúpido imbécil basura escoria".split()
TARGETS = frozenset("you your you're youre u ya he she they them him her these those du dich dir euch ihr sie tu te toi vous votre tes ton tú ti te usted ustedes vosotros eres".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't doesn't nobody nicht kein keine niemals pas jamais aucun nunca jamás ningún ninguna".split())
REPORTING = frozenset("said says say wrote writes called calls quoted claims claimed alleged sagte sagt schrieb nannte disait écrit appelé dijo dice escribió llamó".split())
SUBJECTS = frozenset("i we i'll we'll ich wir je nous yo nosotros".split())
MODALS = frozenset("will shall going gonna i'll we'll should must werde werden vais allons voy vamos".split())
HARMS = frozenset("kill hurt destroy beat shoot stab burn crush hunt murder töten schlagen umbringen tuer frapper brûler matar golpear quemar".split())

NEGATION_SCOPE, REPORT_SCOPE, THREAT_GAP, TARGET_GAP = 3, 12, 4, 4
NEGATED, REPORTED, TARGETED, THREAT, REST = 0.55, 0.7, 1.15, 4.0, 0.3
SEED_WEIGHT = 2.5

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
PIECE = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»]")
#: Clauses end at these characters.
BORDER = ".!?;:\n\r|"
_BORDERS = re.compile("[" + re.escape(BORDER) + "]")


#: Word classes; PICK marks the word that a path picks, ADDRESSED one that a word for a person follows at once.
INSULT, SUBJECT, MODAL, HARM, TARGET, NEGATION, REPORT, QUOTE, ADDRESSED, PICK = (1 << i for i in range(10))
#: The state that a machine stays in once it has seen the pick: nothing after it changes the path's weight.
DONE = -1


class Transducer:
    """States and weighted arcs: ``arcs(state, symbol)`` gives (output, weight, next state) of each arc.

    Symbols are sets of word classes, as bits.  The arcs of a state and symbol are made when first
    asked for, and kept: there are few of either.
    """

    def __init__(self, start, arcs: Callable, accepts: Callable):
        self.start, self._make, self.accepts = start, arcs, accepts
        self._arcs: dict[tuple, list[tuple]] = {}

    def arcs(self, state, symbol: int) -> list[tuple]:
        if (state, symbol) not in self._arcs:
            self._arcs[state, symbol] = list(self._make(state, symbol))
        return self._arcs[state, symbol]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that reads what ``a`` reads and writes what ``b`` writes for a's output; weights multiply."""

    def arcs(state, symbol):
        for middle, w, p in a.arcs(state[0], symbol):
            for out, v, q in b.arcs(state[1], middle):
                yield out, w * v, (p, q)

    return Transducer((a.start, b.start), arcs, lambda state: a.accepts(state[0]) and b.accepts(state[1]))


def picking(words: int) -> Transducer:
    """Passes symbols on; may pick, once, a word of one of the classes ``words``."""

    def arcs(state, symbol):
        yield symbol, 1.0, state
        if state != DONE and symbol & words:
            yield symbol | PICK, 1.0, DONE

    return Transducer(0, arcs, lambda _: True)


def scope(opens: Callable[[int], int], factor: float, toggles: int = 0, also: int = 0, every: float = 1.0) -> Transducer:
    """A pick within reach of a word weighs ``factor``, another ``every``.

    ``opens`` gives the number of words that a symbol's scope reaches on, 0 if it opens none; symbols
    of the class ``toggles`` open and close a scope without end; a pick of the class ``also`` is in
    reach at any place.  A state is (words left, whether toggled).
    """

    def arcs(state, symbol):
        if state == DONE:
            yield symbol, 1.0, DONE
            return
        left, inside = state
        if symbol & toggles:
            yield symbol, 1.0, (left, not inside)
        elif symbol & PICK:
            yield symbol, factor if left or inside or symbol & also else every, DONE
        else:
            yield symbol, 1.0, (opens(symbol) or max(0, left - 1), inside)

    return Transducer((0, False), arcs, lambda _: True)


def threatening() -> Transducer:
    """May pick a verb of harm, at THREAT, in reach of a modal word that is in reach of a subject.

    A state is the words left in reach of the subject and of the modal word.  Where the word is
    picked already, as an insult, the threat adds nothing.
    """

    def arcs(state, symbol):
        if state == DONE or symbol & PICK:
            yield symbol, 1.0, DONE
            return
        subject, modal = state
        if symbol & SUBJECT:
            subject = THREAT_GAP + 1
        if symbol & MODAL and subject:
            modal = THREAT_GAP + 1
        after = (max(0, subject - 1), max(0, modal - 1))
        if symbol & HARM and modal:
            yield symbol | PICK, THREAT, DONE
        yield symbol, 1.0, after

    return Transducer((0, 0), arcs, lambda _: True)


def machine() -> Transducer:
    """The five transducers, composed."""
    target = scope(lambda s: TARGET_GAP + 1 if s & TARGET else 0, TARGETED, also=ADDRESSED)
    negation = scope(lambda s: NEGATION_SCOPE if s & NEGATION else 0, NEGATED)
    report = scope(lambda s: REPORT_SCOPE if s & REPORT else 0, REPORTED, toggles=QUOTE)
    whole = picking(INSULT)
    for part in (threatening(), target, negation, report):
        whole = compose(whole, part)
    return whole


#: One machine serves all lexicons, as a lexicon only decides which words are insults, and their weights.
MACHINE = machine()


def paths(symbols: Iterable[tuple[int, float]], by: Transducer = MACHINE) -> tuple[float, float]:
    """The best weight of an accepted path over (symbol, insult weight), and the sum of all.

    Forward over the live states; states after the pick are one state, so these are two at most.
    """
    live, best, total = {by.start: 1.0}, 0.0, 0.0
    for symbol, weight in symbols:
        after: dict = {}
        for state, so_far in live.items():
            for out, w, to in by.arcs(state, symbol):
                if out & PICK:  # nothing later changes this path's weight
                    reading = so_far * w * (weight if to_insult(to) else 1.0)
                    best, total = max(best, reading), total + reading
                else:
                    after[to] = max(after.get(to, 0.0), so_far * w)
        live = after
    return best, total


def to_insult(state) -> bool:
    """Whether a path that has just picked did so as an insult."""
    while isinstance(state[0], tuple):
        state = state[0]
    return state[0] == DONE


class Grammar:
    """The composed machine for one lexicon (words and stems with weights)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.finder = ahocorasick.Automaton()
        for entry in {*words, *stems, *HARMS}:
            self.finder.add_word(entry, len(entry))
        self.finder.make_automaton()
        self.sizes = sorted({len(s) for s in stems})
        self.closed = Counter()
        for words_of, bit in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTING, REPORT), (SUBJECTS, SUBJECT), (MODALS, MODAL), (HARMS, HARM)):
            for w in words_of:
                self.closed[w] |= bit

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in self.sizes:
            if n >= len(word):
                break
            found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def symbols(self, text: str) -> list[tuple[int, float]]:
        """A clause as symbols with the weights of its insults."""
        out = []
        for token in PIECE.findall(text):
            if not token[0].isalnum():
                out.append((QUOTE, 0.0))
                continue
            weight, bits = self.insult(token), self.closed.get(token, 0)
            if bits & TARGET and out and out[-1][0] & (INSULT | HARM):
                out[-1] = (out[-1][0] | ADDRESSED, out[-1][1])
            out.append((bits | (INSULT if weight else 0), weight))
        return out

    def clause(self, text: str) -> float:
        """The clause's score; 0 if no path is accepted."""
        best, total = paths(self.symbols(text))
        return best + REST * math.log1p(max(0.0, total - best)) if best else 0.0

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses that hold a lexicon entry, over the whole text."""
        low = text.lower()
        scores, end = [], -1
        for last, size in self.finder.iter(low):
            first = last - size + 1
            if first < end or (first and low[first - 1].isalnum()):
                continue  # scored already, or inside a word
            begin = 0
            for c in BORDER:
                begin = max(begin, low.rfind(c, max(0, end), first) + 1)
            begin = max(begin, end, 0)
            border = _BORDERS.search(low, last + 1)
            end = border.end() if border else len(low)
            score = self.clause(low[begin:end])
            if score:
                scores.append(score)
        return scores

    def features(self, text: str) -> list[float]:
        """Intercept, best clause, the others' sum on a log scale, and whether there is any."""
        scores = self.clauses(text) if text else []
        best = max(scores, default=0.0)
        return [1.0, best, math.log1p(sum(scores) - best), float(bool(scores))]


#: Marks a stem among terms.
STEM = "\0"


def terms(text: str) -> set[str]:
    """Words of a text, and their stems, marked."""
    words = [w for w in set(WORD.findall(text.lower())) if w[0].isalpha()]
    return {*words, *(STEM + w[:n] for w in words for n in STEMS if n < len(w))}


def half_of(text: str) -> int:
    return zlib.crc32(text.encode()) & 1


def count_terms(sample: DataFrame) -> DataFrame:
    """(term, stem, c00, c01, c10, c11): documents of each half and label that hold a term.

    The term '' counts the documents.  A task adds up its own documents before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(4)]

        def batch() -> pa.RecordBatch:
            keys = list(set().union(*held))
            columns = [pa.array([k.lstrip(STEM) for k in keys], pa.string()), pa.array([k.startswith(STEM) for k in keys], pa.bool_()), *(pa.array([c[k] for k in keys], pa.int64()) for c in held)]
            return pa.RecordBatch.from_arrays(columns, names=["term", "stem", "c00", "c01", "c10", "c11"])

        for part in text_slices(batches):
            for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                held[2 * half_of(text) + label].update({*terms(text), ""})
            if sum(map(len, held)) > 500_000:
                yield batch()
                for c in held:
                    c.clear()
        yield batch()

    every = arrow_map(sample, run, "term string, stem boolean, c00 long, c01 long, c10 long, c11 long")
    return every.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")])


def learn_lexicon(counts: DataFrame, total: tuple[int, int], halves: tuple[int, ...]) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of words and stems that mark toxic documents of some halves; at most LEXICON are collected."""
    n = sum((F.col(f"c{h}1") for h in halves), F.lit(0))
    clean = sum((F.col(f"c{h}0") for h in halves), F.lit(0))
    odds = F.log((n + 0.1) / (total[1] + 0.2)) - F.log((clean + 0.5) / (total[0] + 1.0))
    marks = counts.filter(F.col("term") != "").select("term", "stem", n.alias("n"), odds.alias("odds")).filter((F.col("n") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    weight = F.col("odds") * (1 - F.exp(-F.col("n") / 4))
    found = marks.select("term", "stem", weight.alias("weight")).orderBy(F.desc("weight"), "term", "stem").limit(LEXICON).collect()
    words, stems = {w: SEED_WEIGHT for w in SEED_INSULTS}, {}
    for term, stem, value in found:
        if stem:
            stems[term] = value
        else:
            words[term] = max(value, words.get(term, 0.0))
    return words, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame) -> tuple[Grammar, list[float]]:
    """Fit on at most SAMPLE_ROWS of (doc_id, text, toxic): those of smallest hash of the id; equal texts count once.

    Half of the sample teaches the lexicon that scores the other half, and
    the other way round, so the logistic model sees scores of texts that the
    lexicon has not seen; the final lexicon is learned from all of it.  Texts stay
    on the executors: the driver gets at most LEXICON entries of a lexicon, and
    three numbers a row.
    """
    sample = bounded_sample(labelled, labelled.select("doc_id", "toxic"), "toxic", SAMPLE_ROWS)
    sample = sample.select(F.coalesce("text", F.lit("")).alias("text"), F.expr("int(toxic > 0)").alias("toxic"))
    sample = settle(sample.groupBy(F.md5("text").alias("digest")).agg(F.min(F.struct("toxic", "text")).alias("r")).select("r.text", "r.toxic"))
    counts = settle(count_terms(sample))
    documents = counts.filter("term = ''").first()
    size = [[documents[f"c{h}{y}"] for y in (0, 1)] for h in (0, 1)] if documents else [[0, 0], [0, 0]]
    total = (size[0][0] + size[1][0], size[0][1] + size[1][1])
    if not all(total):
        constant = 3.0 if total[1] else -3.0
        return Grammar({w: SEED_WEIGHT for w in SEED_INSULTS}, {}), [constant, 1.0, 1.0, 0.0]
    by_half = {h: learn_lexicon(counts, tuple(size[1 - h]), (1 - h,)) for h in (0, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = {h: Grammar(*found) for h, found in by_half.items()}
        for part in text_slices(batches):
            rows = [grammars[half_of(t)].features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(1, 4)] + [part.column("toxic")], names=["best", "rest", "some", "toxic"])

    rows = sorted(tuple(r) for r in arrow_map(sample, run, "best double, rest double, some double, toxic int").collect())
    table = np.array(rows, float)
    x = np.column_stack([np.ones(len(table)), table[:, :3]])
    return Grammar(*learn_lexicon(counts, total, (0, 1))), fit_logistic(x, table[:, 3]).tolist()


def score(df: DataFrame, labelled: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """Toxicity of each whole text: (doc_id, score double 0..1, predicted int).

    ``labelled`` has (doc_id, text, toxic); predicted is 1 from ``threshold``
    on.  Null and empty texts match no clause and get the score of such a
    text.  Without labels of both kinds the seed lexicon alone scores.
    Repeated rows are scored each, other columns are ignored, an empty table
    gives an empty result.  With text_col None the key is a struct that holds the
    text.  Only the grammar (bounded by LEXICON) is broadcast.
    """
    source = keyed_text(df, id_col, text_col)
    grammar, weights = train(labelled)
    shared = df.sparkSession.sparkContext.broadcast((grammar.words, grammar.stems, weights))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems, w = shared.value
        own = Grammar(words, stems)
        for part in text_slices(batches):
            x = [sum(a * b for a, b in zip(w, own.features(t))) for t in text_of(part).to_pylist()]
            p = [0.5 * (1 + math.tanh(0.5 * v)) for v in x]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(v >= threshold) for v in p], pa.int32())], names=["doc_id", "score", "predicted"])

    return arrow_map(source, run, f"doc_id {kind}, score double, predicted int")
