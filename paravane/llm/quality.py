"""Document quality by ordinal cumulative-link regression.

Graded ratings g_0 < g_1 < ... are modelled by one latent score w.x with
shared weights over hashed text features and ordered thresholds:
P(grade <= g_k) = sigmoid(theta_k - w.x).  The thresholds are kept in order by
writing each as the one before plus the exponential of a free parameter.
All features are hashed text: byte trigrams, and two kinds of patterns without
the words themselves, which of PATTERN_WORDS words in a row are equal, and how
often a word occurs in a text of some length.  Each kind's frequencies are
taken as square roots and added up in one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paravane.llm.common import arrow_map, bounded_sample, keyed_text, text_of, text_slices
from paravane.llm.words import mix, word_hashes

#: Hashed features; labelled rows that are used at most; words that a pattern compares.
FEATURES, SAMPLE_ROWS, PATTERN_WORDS = 4096, 3_000, 6
STEPS, RATE, RIDGE = 250, 0.1, 3e-4
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SHIFT = np.uint64(64 - (FEATURES - 1).bit_length())


def cells(kind: int, values: np.ndarray) -> np.ndarray:
    """Columns of the feature table that values of a kind fall on."""
    return (mix(values.astype(np.uint64) + np.uint64(kind << 48)) >> _SHIFT).astype(np.int64)


def patterns(words: np.ndarray) -> np.ndarray:
    """For each run of PATTERN_WORDS words (or the whole, if shorter) which of its words are equal, as bits."""
    n = min(PATTERN_WORDS, len(words))
    runs = np.lib.stride_tricks.sliding_window_view(words, n)
    out, bit = np.zeros(len(runs), np.uint64), 0
    for i in range(n):
        for j in range(i + 1, n):
            out |= (runs[:, i] == runs[:, j]).astype(np.uint64) << np.uint64(bit)
            bit += 1
    return out


def features(texts: list[str]) -> np.ndarray:
    """A row per text: the hashed features.  An empty text has zeros only."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    shift = np.uint32(32 - (FEATURES - 1).bit_length())
    words, at, _ = word_hashes(texts)

    def add(row: np.ndarray, found: np.ndarray) -> None:
        row += np.sqrt(np.bincount(found, minlength=FEATURES) / len(found))

    for k, text in enumerate(texts):
        b = np.frombuffer(text.encode(), np.uint8)
        if len(b) >= 3:
            b = b.astype(np.uint32)
            add(out[k], ((b[:-2] * _MIX[0] + b[1:-1] * _MIX[1] + b[2:] * _MIX[2]) * np.uint32(0x27D4EB2F)) >> shift)
        own = words[at[k] : at[k + 1]]
        if len(own):
            add(out[k], cells(1, patterns(own)))
            times = np.unique(own, return_counts=True)[1]
            # each word's count by its power of two, with that of the text's length
            add(out[k], cells(2, np.repeat(np.log2(times).astype(np.uint64) << np.uint64(8) | np.uint64(len(own).bit_length()), times)))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class CumulativeLink:
    """Grades, weights and thresholds."""

    def __init__(self, grades: np.ndarray, weights: np.ndarray, theta: np.ndarray):
        self.grades, self.weights, self.theta = grades, weights, theta

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> CumulativeLink:
        """Adam on the penalised likelihood; y holds ratings."""
        grades, level = np.unique(y, return_inverse=True)
        if len(grades) < 2:
            return cls(grades, np.zeros(x.shape[1], np.float32), np.zeros(0))
        top = len(grades) - 1
        share = np.cumsum(np.bincount(level, minlength=top + 1))[:-1] / len(level)
        first = np.log(share / (1 - share))
        free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
        weights = np.zeros(x.shape[1], np.float32)
        m = [np.zeros_like(weights), np.zeros_like(free)]
        v = [np.zeros_like(weights), np.zeros_like(free)]
        for step in range(1, STEPS + 1):
            theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
            eta = x @ weights
            # the thresholds above and below each row's grade
            high = np.where(level < top, sigmoid(theta[np.minimum(level, top - 1)] - eta), 1.0)
            low = np.where(level > 0, sigmoid(theta[np.maximum(level, 1) - 1] - eta), 0.0)
            chance = np.maximum(high - low, 1e-9)
            up, down = high * (1 - high) / chance, low * (1 - low) / chance
            g_eta = (up - down) / len(y)
            g_theta = (np.bincount(level, down, top + 1)[1:] - np.bincount(level, up, top + 1)[:-1]) / len(y)
            tail = np.cumsum(g_theta[::-1])[::-1]  # a threshold moves all that are above it
            g_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
            for p, g, a, b in ((weights, g_eta.astype(np.float32) @ x + np.float32(RIDGE) * weights, m[0], v[0]), (free, g_free, m[1], v[1])):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return cls(grades, weights, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]))

    def predict(self, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of a grade of at least ``least``."""
        cdf = np.column_stack([sigmoid(self.theta[None, :] - (x @ self.weights)[:, None]).reshape(len(x), len(self.theta)), np.ones(len(x))])
        chance = np.diff(cdf, axis=1, prepend=0.0)
        return chance @ self.grades, chance[:, self.grades >= least].sum(axis=1)


def train(labelled: DataFrame) -> CumulativeLink | None:
    """Fit on at most SAMPLE_ROWS of (doc_id, text, rating): those of smallest hash of the id."""
    rows = bounded_sample(labelled, labelled.select("doc_id", "rating"), "rating", SAMPLE_ROWS).select("rating", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            x = features([t or "" for t in text_of(part).to_pylist()]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("rating"), pa.array([r.tobytes() for r in x], pa.binary())], names=["rating", "x"])

    got = arrow_map(rows.withColumn("rating", F.col("rating").cast("double")), run, "rating double, x binary").collect()
    if not got:
        return None
    y = np.array([r["rating"] for r in got])
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in got]).astype(np.float32)
    order = np.lexsort((x[:, 0], x.sum(axis=1), y))  # one order, however rows arrive
    return CumulativeLink.fit(x[order], y[order])


def grade(df: DataFrame, labelled: DataFrame, least: float = 1.0, keep: float = 0.5, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """Expected grade of each whole text: (doc_id, expected_grade, tail_prob, selected).

    ``labelled`` has (doc_id, text, rating).  tail_prob is the probability of a
    grade of at least ``least``; selected says whether it reaches ``keep``.
    Null and empty texts get the grade of an all-zero feature vector; with no
    ratings at all the figures are null and nothing is selected.  Repeated
    rows are graded each, other columns are ignored, an empty table gives an
    empty result.  Only the fitted model (a bounded vector) is broadcast.
    """
    source = keyed_text(df, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(train(labelled))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            if model.value is None:
                mean = tail = [None] * part.num_rows
            else:
                mean, tail = (v.tolist() for v in model.value.predict(features([t or "" for t in text_of(part).to_pylist()]), least))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(mean, pa.float64()), pa.array(tail, pa.float64()), pa.array([p is not None and p >= keep for p in tail], pa.bool_())], names=["doc_id", "expected_grade", "tail_prob", "selected"])

    return arrow_map(source, run, f"doc_id {kind}, expected_grade double, tail_prob double, selected boolean")
