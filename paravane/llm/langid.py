"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A text is
parsed greedily into the longest phrases that occur in the language's text;
few phrases mean that the text is well described by it.  A phrase costs
log2 of the automaton's text length bits (a pointer into it), so the phrase
count times that cost, over the text's length, estimates the cross entropy.
The language that needs the fewest normalised phrases wins.

A text is parsed as a whole.  To move many symbols at once, it is cut into
segments that are parsed side by side, each as if it began a phrase; then each
segment is parsed again from the state in which its predecessor ended, until
both parses are in the same state, from where on they are the same.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paravane.llm.common import arrow_map, keyed_text, text_of, text_slices

#: Bounds of the training sample: documents and symbols a language, and bytes of all transition tables.
SAMPLE_DOCS, SAMPLE_CHARS, TABLE_BYTES = 400, 48_000, 128 << 20
#: Documents are sampled shorter ones first, by steps of this many characters.
LENGTH_STEP = 2_400
#: Symbols of a segment, and of the pieces that a very long text is read in.
SEGMENT, PIECE = 512, 1 << 21
#: Letters that get a symbol of their own; the rest share some, by their place in the code.
MAX_LETTERS, SHARED = 200, 50
UNDETERMINED = "und"


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


class CrossParser:
    """One dense transition table per language."""

    def __init__(self, samples: dict[str, str]):
        letters = Counter(c for text in samples.values() for c in text.lower() if c.isalpha())
        known = sorted(letters, key=lambda c: (-letters[c], c))[:MAX_LETTERS]
        self.symbol = np.zeros(sys.maxunicode + 1, np.uint8)  # 0 is white space and all that is no letter
        every = np.arange(sys.maxunicode + 1)
        alpha = np.fromiter((chr(c).isalpha() for c in every), bool, len(every))
        first = len(known) + 1
        self.symbol[alpha] = first + (every[alpha] >> 5) % SHARED
        self.width = first + SHARED
        for k, c in enumerate(known):
            self.symbol[ord(c)] = k + 1
            if len(c.upper()) == 1 and c.upper().lower() == c:
                self.symbol[ord(c.upper())] = k + 1
        self.languages = sorted(samples)
        # an automaton has up to two states a symbol, with a row of four bytes a symbol each
        most = max(64, TABLE_BYTES // max(1, len(samples) * self.width * 8))
        self.tables, self.bits = [], []
        for language in self.languages:
            symbols = self.normalise([samples[language]])[0][:most]
            moves = automaton(symbols.tolist())
            self.tables.append(self.dense(moves))
            self.bits.append(np.log2(max(2, len(symbols))))

    def dense(self, moves: list[dict[int, int]]) -> np.ndarray:
        """Entry: 4 * (offset of the next state's row) + phrases that end here."""
        w, root = self.width, moves[0]
        restart = np.full(w, 2, np.int64)  # an unknown symbol is a phrase of its own, after the open one
        for c, s in root.items():
            restart[c] = 4 * s * w + 1
        out = np.tile(restart, (len(moves), 1))
        out[0] = np.where(restart % 4 == 2, 1, restart - 1)
        for s, row in enumerate(moves):
            if row:
                out[s, list(row)] = [4 * t * w for t in row.values()]
        return out.astype(np.int32 if out.max() < 2**31 else np.int64).reshape(-1)

    def normalise(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, runs of blanks collapsed, and where each text begins (and the end)."""
        points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        symbols = self.symbol[points]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        keep = symbols != 0
        keep[1:] |= symbols[:-1] != 0
        if len(keep):
            begins[-1] = len(keep)
            at = np.concatenate([[0], np.cumsum(keep)])[np.minimum(begins, len(keep))]
        else:
            at = np.zeros(len(texts) + 1, np.int64)
        return symbols[keep], at

    def phrases(self, texts: list[str], states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end inside each text, by language and text, and the texts' lengths in symbols.

        ``states`` holds the state in which each parse begins, and gets the one in which it ends.
        """
        symbols, at = self.normalise(texts)
        sizes = np.diff(at)
        if states is None:
            states = np.zeros((len(self.tables), len(texts)), np.int64)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # of a segment in its text
        start = np.repeat(at[:-1], pieces) + SEGMENT * place
        size = np.minimum(SEGMENT, np.repeat(at[1:], pieces) - start)
        order = np.argsort(-size, kind="stable")
        lane = np.empty(len(order), np.int64)
        lane[order] = np.arange(len(order))
        longest = int(size.max()) if len(size) else 0
        lanes = np.searchsorted(-size[order], -np.arange(longest), side="left")  # segments longer than t
        padded = np.concatenate([symbols, np.zeros(SEGMENT, np.uint8)])
        columns = np.ascontiguousarray(padded[start[order][:, None] + np.arange(longest)].T).astype(np.int32) if longest else np.zeros((0, 0), np.int32)
        heads, tails = np.flatnonzero(place == 0), np.cumsum(pieces)[pieces > 0] - 1
        later = np.flatnonzero(place > 0)
        out = np.zeros((len(self.tables), len(texts)), np.int64)
        for k, moves in enumerate(self.tables):
            begin = np.zeros(len(size), moves.dtype)  # by lane
            begin[lane[heads]] = states[k][owner[heads]]
            row, ended = begin.copy(), np.zeros(len(size), np.int64)
            for t in range(longest):
                n = lanes[t]
                step = moves[row[:n] + columns[t, :n]]
                ended[:n] += step & 3
                row[:n] = step >> 2
            while len(wrong := later[begin[lane[later]] != row[lane[later - 1]]]):
                mine, was, now = lane[wrong], begin[lane[wrong]], row[lane[wrong - 1]]
                begin[mine] = now
                for t in range(longest):
                    apart = (was != now) & (mine < lanes[t])
                    if not apart.all():
                        ends = mine >= lanes[t]
                        row[mine[ends & (was != now)]] = now[ends & (was != now)]
                        mine, was, now = mine[apart], was[apart], now[apart]
                        if not len(mine):
                            break
                    a, b = moves[was + columns[t, mine]], moves[now + columns[t, mine]]
                    ended[mine] += (b & 3).astype(np.int64) - (a & 3)
                    was, now = a >> 2, b >> 2
                row[mine[was != now]] = now[was != now]
            out[k] = np.bincount(owner[order], ended, len(texts)).astype(np.int64)
            states[k][owner[tails]] = row[lane[tails]]
        return out, sizes

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts of whole texts, the open phrase included; a very long text is read in pieces."""
        states = np.zeros((len(self.tables), len(texts)), np.int64)
        if all(len(t) <= PIECE for t in texts):
            counts, sizes = self.phrases(texts, states)
        else:
            counts, sizes = np.zeros(states.shape, np.int64), np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                for piece in pieces_of(text):
                    now = np.ascontiguousarray(states[:, i : i + 1])
                    found, size = self.phrases([piece], now)
                    states[:, i] = now[:, 0]
                    counts[:, i] += found[:, 0]
                    sizes[i] += size[0]
        return counts + (states != 0), sizes

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        counts, sizes = self.counted(texts)
        cost = counts * np.array(self.bits)[:, None] / np.maximum(1, sizes)
        best = cost.argmin(axis=0)  # ties: the language that sorts first
        weight = np.exp2(-(cost - cost.min(axis=0)) * np.minimum(sizes, 32))
        score = 1.0 / weight.sum(axis=0)
        return [(self.languages[b], float(s)) for b, s in zip(best, score)]


def pieces_of(text: str) -> Iterator[str]:
    """A text in pieces that normalise to the same symbols as the whole: none begins with a blank that counts."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text) and text[end - 1].isalpha() and not text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


@functools.lru_cache(2)
def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(samples))


def sample(labelled: DataFrame) -> tuple[tuple[str, str], ...]:
    """A bounded sample of (doc_id, text, lang): for every language the documents of smallest hash, shorter ones first.

    At most SAMPLE_DOCS documents a language are read, until SAMPLE_CHARS characters are together.
    A language with many more rows is first reduced to those of small hash, before any shuffle, so
    none gathers its rows in one task.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("h"), F.expr(f"length(text) div {LENGTH_STEP}").alias("steps"))
    # a row for each language and step of length
    sizes = rows.groupBy("lang", "steps").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    upto = Window.partitionBy("lang").orderBy("steps").rowsBetween(Window.unboundedPreceding, -1)
    wanted = sizes.withColumn("rows_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("chars_before", F.coalesce(F.sum("chars").over(upto), F.lit(0))).filter(f"rows_before < {SAMPLE_DOCS} AND chars_before < {SAMPLE_CHARS}")
    # twice what is needed and more: fewer than needed pass with a chance below 1e-9
    share = wanted.select("lang", "steps", (F.lit(2.0 * SAMPLE_DOCS + 100) / F.col("n")).alias("share"))
    small = (F.col("h").cast("double") / 2.0**64 + 0.5) <= F.col("share")
    first = Window.partitionBy("lang").orderBy("steps", "h", "doc_id", "text")
    few = rows.join(F.broadcast(share), ["lang", "steps"]).filter(small).dropDuplicates(["lang", "doc_id", "text"])
    before = F.coalesce(F.sum(F.length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = few.withColumn("k", F.row_number().over(first)).withColumn("before", before).filter((F.col("k") <= SAMPLE_DOCS) & (F.col("before") < SAMPLE_CHARS))
    out: dict[str, list[tuple]] = {}
    for r in chosen.select("lang", "k", F.expr(f"substring(text, 1, {SAMPLE_CHARS} - before)").alias("text")).collect():
        out.setdefault(r["lang"], []).append((r["k"], r["text"]))
    return tuple(sorted((lang, "\n".join(t for _, t in sorted(found))) for lang, found in out.items()))


def identify(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """Language of each whole text: (doc_id, lang_pred string, score double).

    ``labelled`` has (doc_id, text, lang).  A text that is null or has no
    letter is ``und`` with score 0; so is every text if nothing is labelled.
    Equal costs go to the language whose name sorts first.  Repeated rows are
    predicted each, an empty table gives an empty result, and other columns of
    the input are ignored.  Every labelled language can be predicted.  The sample
    (bounded, see ``sample``) is broadcast; each worker builds the automata once,
    in TABLE_BYTES bytes at most (with very many languages of fewer symbols each);
    documents are not shuffled.
    """
    source = keyed_text(df, id_col, text_col)
    samples = sample(labelled)
    shared = df.sparkSession.sparkContext.broadcast(samples)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = parser(shared.value) if shared.value else None
        for part in text_slices(batches, 1 << 20):
            texts = [t or "" for t in text_of(part).to_pylist()]
            found = learned.predict(texts) if learned else [(UNDETERMINED, 0.0)] * len(texts)
            found = [x if any(map(str.isalpha, t)) else (UNDETERMINED, 0.0) for x, t in zip(found, texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return arrow_map(source, run, f"doc_id {kind}, lang_pred string, score double")
