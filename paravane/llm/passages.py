"""Substring dedup: fuzzy repeated passages by collinear chaining.

1. Seeds: the hashed runs of SEED_WORDS words whose hash falls into one of
   SAMPLE classes, and all of those where few words repeat over and over.  The
   choice depends on the words alone, so two copies keep the same ones.  Four words are as long a run as a passage in which every
   fifth word is changed still has.
2. Contexts: a seed carries two 16-bit min-hashes, of the word pairs in the
   CONTEXT pairs before and after it.
3. Join: every occurrence of a seed is matched with the first occurrence of the
   same seed that has the same context on the left, and with the first that has
   the same on the right; only where there is neither, with the seed's first
   occurrence.  So a common seed leads to the passage's earlier copy and not to
   some unrelated document, and a seed that occurs n times gives at most 2 n
   matches, not n * n.  Of occurrences in one chunk of texts that agree in
   everything only the first goes to the seed's task.  The others come in runs
   that follow one document of the chunk; a run sends one row, whatever its
   length, to that document's matches and takes over those of its words, merged
   into runs.
4. Chaining: the matches of a document with an earlier one are merged into
   runs on one diagonal, and runs are chained in order of both texts.  A chain
   earns GAIN a seed and pays for the words skipped on either side; the best
   predecessor comes from a Fenwick tree over places in the earlier text.  A
   single seed is a chain too, whatever its contexts: alignment decides.
5. Alignment: chains are extended at both ends, across changed, inserted and
   deleted words, and gaps between their runs are aligned by dynamic
   programming, wide gaps after chaining all their runs of three words.  A chain
   that is alike enough is a passage; another is cut at its unalike gaps, and
   each longest part that is long and alike enough is one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from paravane.llm.common import arrow_map, fit_to_send, keyed_text, settle, slices, text_slices, without_repeats
from paravane.llm.words import mix, shingle_hashes, word_hashes

#: Words of a seed, and one class of how many is kept.
SEED_WORDS, SAMPLE = 4, 3
#: Where a word pair comes again within so many words every seed is kept, as a text that repeats few words has few different ones.
LOOP = 12
#: Word pairs on either side of a seed that its contexts are made of.
CONTEXT = 10
#: Occurrences of a seed within a chunk: with no other that agrees in everything, the first of several, and the others.
ALONE, FOLLOWED, REST = 0, 1, 2
#: Matches of a document, those of a document that others of its chunk follow, and a run that follows.
OWN, KNOWN, RUN = 0, 1, 2
#: What a seed earns; what a skipped word costs on either side; the widest gap inside a run.
GAIN, GAP_COST, RUN_GAP = 16.0, 0.25, 32
#: Words beyond a chain's ends that extension may use; the fall in score that ends it; the widest gap that is aligned as a whole.
REACH, DROP, ALIGN = 64, 8, 96
#: Words within which extension looks for the next equal run after an insertion or deletion, and that run's length.
SIDESTEP, FOOTHOLD = 12, 4
#: Bytes of a word's hash where texts are aligned: two unlike words look alike with a chance of 6e-8.
BYTES = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def seeds(texts: list[str], k: int = SEED_WORDS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, contexts) of the seeds of all texts.

    Contexts holds the left min-hash in its upper and the right one in its lower 16 bits; 0 means
    that there is no word pair on that side.
    """
    words, at, _ = word_hashes(texts)
    runs = shingle_hashes(words, k)
    pairs = shingle_hashes(words, 2)
    kept = runs % np.uint64(sample) == 0
    for d in range(1, min(LOOP, len(runs) - 1) + 1):
        kept[:-d] |= pairs[: len(runs) - d] == pairs[d : len(runs)]
    place = np.flatnonzero(kept)
    text = np.searchsorted(at, place, side="right") - 1
    inside = place + k <= at[text + 1]
    place, text = place[inside], text[inside]
    none = np.uint64(0xFFFFFFFFFFFFFFFF)

    def least(first: np.ndarray) -> np.ndarray:
        found = np.full(len(place), none)
        for j in range(CONTEXT):
            i = first + j
            ok = (i >= at[text]) & (i + 2 <= at[text + 1])
            found = np.minimum(found, np.where(ok, pairs[np.clip(i, 0, max(0, len(pairs) - 1))], none)) if len(pairs) else found
        return np.where(found == none, 0, 1 + found % np.uint64(0xFFFF)).astype(np.int64)

    return text, place - at[text], runs[place], least(place - CONTEXT) << 16 | least(place + k - 1)


def firsts(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the first row of equal hash and value."""
    order = np.lexsort((value, h))  # stable
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (value[order][1:] != value[order][:-1])
    out = np.empty(len(h), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    return out


def followers(doc: np.ndarray, place: np.ndarray, first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the rows ``rest`` that follow one document on one diagonal.

    (document, place, followed document, place there, words to the last seed) of each.
    """
    order = np.lexsort((place[rest], place[rest] - place[first[rest]], doc[first[rest]], doc[rest]))
    rest = rest[order]
    source = first[rest]
    new = np.ones(len(rest), bool)
    new[1:] = (doc[rest][1:] != doc[rest][:-1]) | (doc[source][1:] != doc[source][:-1]) | (np.diff(place[rest] - place[source]) != 0) | (np.diff(place[rest]) > RUN_GAP)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(rest))[: len(begin)] - 1
    return doc[rest[begin]], place[rest[begin]], doc[source[begin]], place[source[begin]], place[rest[last]] - place[rest[begin]]


def apart(doc: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows but those that agree in everything with one of the same document a few words before, as in a text that repeats few words over and over.

    Extension from one kept place reaches beyond the next.
    """
    order = np.lexsort((place, doc, first))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc[order]) != 0) | (np.diff(first[order]) != 0)
    begin = place[order][np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
    part = (place[order] - begin) // (REACH // 2)
    new[1:] |= part[1:] != part[:-1]
    out = np.empty(len(doc), bool)
    out[order] = new
    return out


class Meeting:
    """Matches of seed occurrences that arrive in order of (hash, document, place).

    Between two lots of rows only the last seed's first occurrences are kept: one for each context
    value, of which there are 2 * 65536 at most.
    """

    def __init__(self) -> None:
        self.held = [np.zeros(0, np.int64)] * 3  # hash, document, place and contexts

    def matches(self, h: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, source, source place, whether a context agrees) of the rows; a first occurrence meets itself.

        A spot is place, contexts and kind, from the upper bits to the lower ones.
        """
        old = len(self.held[0])
        rows = [np.concatenate(z) for z in zip(self.held, (h, doc, spot))]
        h, doc, spot = rows
        n = len(h)
        new = np.ones(n, bool)
        new[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(new)
        first = np.repeat(start, np.diff(start, append=n))
        alone = -1 - np.arange(n)  # where a text has no words on that side
        sides = spot >> 18 & 0xFFFF, spot >> 2 & 0xFFFF
        left, right = (firsts(h, np.where(side, side, alone)) for side in sides)
        plain = (doc[left] == doc) & (doc[right] == doc) & (doc[first] != doc)
        fresh = np.arange(n) >= old
        who = [np.flatnonzero(z & fresh) for z in (sides[0] > 0, (sides[1] > 0) & (left != right), plain)]
        row = np.concatenate(who)
        source = np.concatenate([left[who[0]], right[who[1]], first[who[2]]])
        keep = (h == h[-1]) & ((np.arange(n) == left) | (np.arange(n) == right) | (np.arange(n) == first))
        self.held = [r[keep] for r in rows]
        return row - old, doc[source], spot[source] >> 34, np.repeat([True, True, False], [len(w) for w in who])


def taken_over(known: list[np.ndarray], asking: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Matches (document, source, place, source place, words to the last seed, seeds) that runs take over.

    Known are the matches (followed document, source, place, source place), in order of document and
    place; asking are runs (followed document, document, place there, place, words).  Matches on one
    diagonal are merged, once for all runs that follow the same words.
    """
    lots = np.cumsum(asking[4].astype(np.int64) + 1) >> 20
    for lot in np.unique(lots):
        followed, doc, there, place, words = (c[lots == lot].astype(np.int64) for c in asking)
        ids, rank = np.unique(np.concatenate([known[0], followed]), return_inverse=True)
        source, at, source_at = (c.astype(np.int64) for c in known[1:])
        key, low = rank[: len(at)] << 32 | at, rank[len(at) :] << 32 | there
        low, high = np.searchsorted(key, low), np.searchsorted(key, low + words, side="right")
        spans, whose = np.unique(low << 32 | high, return_inverse=True)
        size = (spans & 0xFFFFFFFF) - (spans >> 32)
        span = np.repeat(np.arange(len(spans)), size)
        row = np.repeat((spans >> 32) - np.cumsum(size) + size, size) + np.arange(len(span))
        order = np.lexsort((at[row], at[row] - source_at[row], source[row], span))
        span, row = span[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(span) != 0) | (source[row][1:] != source[row][:-1]) | (np.diff(at[row] - source_at[row]) != 0) | (np.diff(at[row]) > RUN_GAP)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(row))[: len(begin)] - 1
        # each merged run goes to every run that asks for its span
        members, many = np.argsort(whose, kind="stable"), np.bincount(whose, minlength=len(spans))
        times = many[span[begin]]
        run = np.repeat(np.arange(len(begin)), times)
        member = members[np.repeat((np.cumsum(many) - many)[span[begin]] - np.cumsum(times) + times, times) + np.arange(len(run))]
        begin, last = begin[run], last[run]
        yield doc[member], source[row[begin]], at[row[begin]] + (place - there)[member], source_at[row[begin]], at[row[last]] - at[row[begin]], last - begin + 1


class Fenwick:
    """Prefix maxima of (score, run)."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def raise_to(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def below(self, i: int) -> tuple[float, int]:
        out = (-1e18, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(runs: list[tuple[int, int, int, int, int]]) -> list[list[tuple[int, int, int, int, int]]]:
    """Chains of runs (a0, a1, b0, b1, seeds), places of first and last seeds in both texts; best first."""
    if len(runs) == 1:
        return [runs]
    n = len(runs)
    own = [GAIN * r[4] - GAP_COST * (r[1] - r[0] + r[3] - r[2]) for r in runs]
    rank = {b: i for i, b in enumerate(sorted({r[3] for r in runs}))}
    ends = sorted(rank)
    tree = Fenwick(len(ends))
    score, before = own[:], [-1] * n
    waiting = sorted(range(n), key=lambda i: (runs[i][1], i))
    w = 0
    for i in sorted(range(n), key=lambda i: (runs[i][0], runs[i][2], i)):
        a0, _, b0, _, _ = runs[i]
        while w < n and runs[waiting[w]][1] < a0:
            j = waiting[w]
            tree.raise_to(rank[runs[j][3]], (score[j] + GAP_COST * (runs[j][1] + runs[j][3]), j))
            w += 1
        low, high = 0, len(ends)
        while low < high:  # ends before b0
            mid = (low + high) // 2
            low, high = (mid + 1, high) if ends[mid] < b0 else (low, mid)
        best, j = tree.below(low)
        if j >= 0 and best - GAP_COST * (a0 + b0) > 0:
            score[i], before[i] = own[i] + best - GAP_COST * (a0 + b0), j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def overlapping(found: list[list[tuple[int, int, int, int, int]]], k: int) -> list[list[list[tuple[int, int, int, int, int]]]]:
    """Chains dealt into lots that reach over the same words of the document; best first within a lot."""
    order = sorted(range(len(found)), key=lambda i: found[i][0][0])
    lots, end = [], 0
    for i in order:
        if not lots or found[i][0][0] - REACH > end:
            lots.append([])
        lots[-1].append(i)
        end = max(end, found[i][-1][1] + k + REACH)
    return [[found[i] for i in sorted(lot)] for lot in lots]


def common_words(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of x and y; equal words at both ends are matched first."""
    n = min(len(x), len(y))
    unlike = np.flatnonzero(x[:n] != y[:n])
    head = int(unlike[0]) if len(unlike) else n
    n -= head
    unlike = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    tail = int(unlike[0]) if len(unlike) else n
    u, v = x[head : len(x) - tail], y[head : len(y) - tail]
    inner = []
    if len(u) and len(v):
        table = np.zeros((len(u) + 1, len(v) + 1), np.int64)
        for i, a in enumerate(u):
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (v == a)))
        i, j = len(u), len(v)
        while table[i, j]:
            if table[i - 1, j] == table[i, j]:
                i -= 1
            elif table[i, j - 1] == table[i, j]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                inner.append((head + i, head + j))
    ends = [(len(x) - t, len(y) - t) for t in range(tail, 0, -1)]
    return [(i, i) for i in range(head)] + inner[::-1] + ends


def extend(same: np.ndarray) -> int:
    """How far to go along a diagonal: to the best score of +1 a match and -1 a mismatch, ended by a fall of DROP."""
    if not len(same):
        return 0
    score = np.cumsum(np.where(same, 1, -1))
    peak = np.maximum(np.maximum.accumulate(score), 0)
    fallen = np.flatnonzero(peak - score > DROP)
    if len(fallen):
        score = score[: fallen[0]]
    if not len(score) or score.max() <= 0:
        return 0
    return int(score.argmax()) + 1


def shared_runs(x: np.ndarray, y: np.ndarray, k: int = 3) -> list[tuple[int, int, int, int, int]]:
    """Runs of shared k-word runs that are unique in x and in y."""
    u, v = (shingle_hashes(z.astype(np.uint64), k) for z in (x, y))
    (a, i, n), (b, j, m) = (np.unique(z, return_index=True, return_counts=True) for z in (u, v))
    _, p, q = np.intersect1d(a[n == 1], b[m == 1], assume_unique=True, return_indices=True)
    at, source = i[n == 1][p], j[m == 1][q]
    if not len(at):
        return []
    order = np.lexsort((at, at - source))
    at, source = at[order], source[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at - source) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), at[last].tolist(), source[first].tolist(), source[last].tolist(), (last - first + 1).tolist()))


def fill(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of equal words in the gap between two runs; a wide gap is first cut at its own chain of short runs."""
    if max(len(x), len(y)) <= ALIGN:
        return common_words(x, y)
    runs = shared_runs(x, y)
    if not runs:
        return []
    out, at_x, at_y = [], 0, 0
    for a0, a1, b0, b1, _ in chains(runs)[0]:
        a1, b1 = a1 + 3, b1 + 3
        skip = max(0, at_x - a0, at_y - b0)  # runs may overlap by some words
        a0, b0 = a0 + skip, b0 + skip
        if a0 >= a1:
            continue
        if max(a0 - at_x, b0 - at_y) <= ALIGN:
            out += [(at_x + i, at_y + j) for i, j in common_words(x[at_x:a0], y[at_y:b0])]
        out += [(a0 + i, b0 + i) for i in range(a1 - a0)]
        at_x, at_y = a1, b1
    if max(len(x) - at_x, len(y) - at_y) <= ALIGN:
        out += [(at_x + i, at_y + j) for i, j in common_words(x[at_x:], y[at_y:])]
    return out


def onward(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of equal words from the starts of x and y on, as far as they stay alike.

    Along the diagonal first; where that ends, on from the nearest equal run of FOOTHOLD words within
    SIDESTEP words of both.
    """
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        n = min(len(x) - i, len(y) - j)
        same = x[i : i + n] == y[j : j + n]
        n = extend(same)
        out += [(i + z, j + z) for z in np.flatnonzero(same[:n]).tolist()]
        i, j = i + n, j + n
        equal = x[i : i + SIDESTEP, None] == y[None, j : j + SIDESTEP]
        if min(equal.shape) < FOOTHOLD:
            break
        runs = equal[: equal.shape[0] - FOOTHOLD + 1, : equal.shape[1] - FOOTHOLD + 1].copy()
        for z in range(1, FOOTHOLD):
            runs &= equal[z : z + runs.shape[0], z : z + runs.shape[1]]
        at = np.argwhere(runs)
        if not len(at):
            break
        di, dj = at[at.sum(axis=1).argmin()].tolist()
        i, j = i + di, j + dj
    return out


def align(x: np.ndarray, y: np.ndarray, runs: list[tuple[int, int, int, int, int]], k: int) -> np.ndarray:
    """Places in x and y of the words that match, in order, of a chain over word arrays x and y."""
    a, b = runs[0][0], runs[0][2]
    low_x, low_y = max(0, a - REACH), max(0, b - REACH)
    before = [(a - 1 - i, b - 1 - j) for i, j in onward(x[low_x:a][::-1], y[low_y:b][::-1])][::-1]
    out = [np.array(before, np.int64).reshape(-1, 2)]
    at_x, at_y = a, b
    for z, (a0, a1, b0, b1, _) in enumerate(runs):
        if z and a0 > at_x and b0 > at_y:
            found = fill(x[at_x:a0], y[at_y:b0])
            out.append(np.array(found, np.int64).reshape(-1, 2) + np.array([at_x, at_y]))
        shift = b0 - a0
        begin = max(at_x, a0, a0 + (at_y - b0)) if z else at_x
        end = min(a1 + k, len(x), len(y) - shift)
        begin = min(begin, end)
        same = begin + np.flatnonzero(x[begin:end] == y[begin + shift : end + shift])
        out.append(np.stack([same, same + shift], 1))
        at_x, at_y = max(at_x, end), max(at_y, end + shift)
    after = onward(x[at_x : at_x + REACH], y[at_y : at_y + REACH])
    out.append(np.array(after, np.int64).reshape(-1, 2) + np.array([at_x, at_y]))
    return np.concatenate(out)


def split(pairs: np.ndarray, least_words: int, least_alike: float) -> list[tuple[int, int, int, int, float]]:
    """Passages (start and end in x, start and end in y, alike) of an alignment.

    The whole alignment, if it is alike enough; else its longest part that is,
    and then what is left on both sides of that part in the same way.  A part
    begins and ends with equal words such that no piece at either end scores 0
    or less at +1 an equal word and -2 another.
    """
    if len(pairs) < least_words * least_alike:
        return []
    step = np.diff(pairs, axis=0)
    first = np.concatenate([[0], np.flatnonzero((step != 1).any(axis=1)) + 1])
    last = np.append(first[1:], len(pairs))  # blocks of equal words, as places in pairs
    unlike = np.maximum(0, step[first[1:] - 1].max(axis=1) - 1)
    begin = first - 2 * np.concatenate([[0], np.cumsum(unlike)])  # score where a block begins
    done = begin + last - first
    low, high = pairs[first], pairs[last - 1] + 1

    def alike(i: int, j: int | np.ndarray) -> np.ndarray:
        return (last[j] - first[i]) / (high[j] - low[i]).max(axis=-1)

    def best(lo: int, hi: int) -> tuple[int, int, int] | None:
        found = None
        for i in range(lo, hi):
            if found and last[hi - 1] - first[i] <= found[0]:
                break
            fallen = np.flatnonzero(begin[i + 1 : hi] <= begin[i])
            j = np.arange(i, i + 1 + fallen[0] if len(fallen) else hi)
            peak = np.concatenate([[np.iinfo(np.int64).min], np.maximum.accumulate(done[j])[:-1]])
            good = j[(done[j] > peak) & ((high[j] - low[i]).min(axis=1) >= least_words) & (alike(i, j) >= least_alike)]
            if len(good) and (not found or last[good[-1]] - first[i] > found[0]):
                found = int(last[good[-1]] - first[i]), i, int(good[-1])
        return found

    out, todo = [], [(0, len(first))]
    if (high[-1] - low[0]).min() >= least_words and alike(0, len(first) - 1) >= least_alike:
        out, todo = [(0, len(first) - 1)], []
    while todo:
        lo, hi = todo.pop()
        if lo < hi and last[hi - 1] - first[lo] >= least_words * least_alike and (found := best(lo, hi)):
            _, i, j = found
            out.append((i, j))
            todo += [(lo, i), (j + 1, hi)]
    return [(int(low[i, 0]), int(high[j, 0]), int(low[i, 1]), int(high[j, 1]), float(alike(i, j))) for i, j in sorted(out)]


def find(df: DataFrame, least_words: int = 50, least_alike: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated passages: (doc_id, start_word, n_words, source_id, source_start, source_words, alike).

    Each row says that n_words words of a document from start_word on repeat,
    with a share ``alike`` of equal words, a passage of source_id, a document
    of smaller id; words that repeat several places of a source are listed with
    the one whose chain scores best.  The first copy of a passage is thus never listed under its
    own id.  Words are blank-separated and compared with A-Z lower-cased.  Null,
    empty and short texts repeat nothing; rows of equal id count as one
    document, rows without an id take no part; repeats inside one document are
    left alone; other columns are ignored; an empty table gives an empty result.
    """
    k = SEED_WORDS
    docs = keyed_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(without_repeats(batches)):
            text, place, h, contexts = seeds(part.column("text").to_pylist())
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)[text]
            order = np.lexsort((place, doc))
            doc, place, h, contexts = doc[order], place[order], h[order].view(np.int64), contexts[order]
            first = firsts(h, contexts)
            kind = np.where(doc[first] != doc, REST, ALONE)  # the rest agree in everything with an earlier document of this chunk
            kind[first[kind == REST]] = FOLLOWED
            keep = apart(doc, place, first)
            d, p, f, q, size = followers(doc, place, first, np.flatnonzero(keep & (kind == REST)))
            # a run travels as two rows of one mark, that of the followed document, whose id is smaller, first
            mark = mix(mix(mix(mix(d.astype(np.uint64)) + p.astype(np.uint64)) + f.astype(np.uint64)) + q.astype(np.uint64)).view(np.int64)
            keep &= kind != REST
            spot = place << 34 | contexts << 2 | kind
            columns = (h[keep], mark, mark), (doc[keep], f, d), (spot[keep], q << 34 | size << 2 | REST, p << 34 | REST)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z), pa.int64()) for z in columns], names=["h", "doc_id", "spot"])

    sown = arrow_map(docs, sow, "h long, doc_id long, spot long").repartition("h").sortWithinPartitions("h", "doc_id", "spot")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting()
        held = [np.zeros(0, np.int64)] * 3  # the last run's last row
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = rows[2] & 3 == REST
            runs = [np.concatenate([z, c[rest]]) for z, c in zip(held, rows)]
            held = [c[-1:] for c in runs]
            i = np.flatnonzero((runs[0][1:] == runs[0][:-1]) & (runs[1][1:] != runs[1][:-1]))
            _, doc, spot = runs
            parts = [(np.full(len(i), RUN), doc[i], doc[i + 1], spot[i] >> 34, spot[i + 1] >> 34, spot[i] >> 2 & 0xFFFFFFFF)]
            h, doc, spot = (c[~rest] for c in rows)
            if len(h):
                row, source, source_at, sure = meeting.matches(h, doc, spot)
                for what, at in ((OWN, np.flatnonzero(doc[row] != source)), (KNOWN, np.flatnonzero(sure & (spot[row] & 3 == FOLLOWED)))):
                    parts.append((np.full(len(at), what), doc[row[at]], source[at], spot[row[at]] >> 34, source_at[at], np.zeros(len(at), np.int64)))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z), t) for z, t in zip(zip(*parts), kinds)], names=["what", "doc_id", "source_id", "at", "source_at", "words"])

    # read twice, dropped below; a lost executor's part is computed again
    met = arrow_map(sown, meet, "what int, doc_id long, source_id long, at int, source_at int, words int").persist(StorageLevel.DISK_ONLY)
    # a document's followers are of its own chunk, so that none has more than a chunk holds
    followed = met.filter(f"what <> {OWN}").repartition("doc_id").sortWithinPartitions("doc_id", "what", "at", "source_id", "source_at")

    def inherit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last document's matches
        for batch in batches:
            what, *rows = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(what):
                continue
            known = [c[what == KNOWN] for c in rows[:4]]
            known = [np.concatenate(z) for z in zip(held, known)] if held else known
            once = np.ones(len(known[0]), bool)  # rows of one id that several tasks passed on
            once[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in known])
            known = [c[once] for c in known]
            for found in taken_over(known, [c[what == RUN] for c in rows]):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), *[pa.int32()] * 4))], names=["doc_id", "source_id", "at", "source_at", "words", "seeds"])
            last = known[0] == rows[0][-1]
            held = [c[last] for c in known]

    inherited = arrow_map(followed, inherit, "doc_id long, source_id long, at int, source_at int, words int, seeds int")
    matches = met.filter(f"what = {OWN}").select("doc_id", "source_id", "at", "source_at", "words", F.lit(1).alias("seeds")).union(inherited)
    dealt = matches.repartition("doc_id", "source_id").sortWithinPartitions("doc_id", "source_id", "at", "source_at")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(rows: list[np.ndarray]) -> pa.RecordBatch:
            d, s, a, b, words, seeds = (column.astype(np.int64) for column in rows)
            order = np.lexsort((a, a - b, s, d))
            d, s, a, b, words, seeds = (column[order] for column in (d, s, a, b, words, seeds))
            out = [[], [], [], [], []]
            if len(d):
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (np.diff(a - b) != 0)
                base = np.cumsum(new) << 32
                end = np.maximum.accumulate(base + a + words)  # a diagonal's end so far
                reach = np.concatenate([[-1 << 32], end[:-1]]) - base
                new[1:] = (a - reach > RUN_GAP)[1:]
                # a match by both contexts, or of one id that several tasks passed on, counts once
                seeds = np.maximum(0, np.minimum(seeds, a + words - np.maximum(a - 1, reach)))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(d)) - 1
                size = np.add.reduceat(seeds, first)
                until = (end - base)[last]
                group = np.ones(len(first), bool)
                group[1:] = (d[first][1:] != d[first][:-1]) | (s[first][1:] != s[first][:-1])
                cut = np.append(np.flatnonzero(group), len(first))
                runs = list(zip(a[first].tolist(), until.tolist(), b[first].tolist(), (b[first] + until - a[first]).tolist(), size.tolist()))
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    for lot in overlapping(chains(runs[x:y]), k):
                        out[0].append(int(d[first[x]]))
                        out[1].append(int(s[first[x]]))
                        # only words within reach of the chains are sent on
                        spans = [(max(0, min(c[0][z] for c in lot) - REACH), max(c[-1][z + 1] for c in lot) + k + REACH) for z in (0, 2)]
                        (low, high), (source_low, source_high) = spans
                        out[2].append(np.array([(n, a0 - low, a1 - low, b0 - source_low, b1 - source_low, m) for n, c in enumerate(lot) for a0, a1, b0, b1, m in c], np.int32).tobytes())
                        out[3].append((low, high - low))
                        out[4].append((source_low, source_high - source_low))
            ends = [pa.array([v[z] for v in out[c]], pa.int32()) for c in (3, 4) for z in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), *ends], names=["doc_id", "source_id", "runs", "low", "size", "source_low", "source_size"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            rows = [np.concatenate(z) for z in zip(held, now)] if held else now
            # the last group may go on in the next batch
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            keep = len(same) - int(same.sum())
            held = [r[keep:] for r in rows]
            yield work([r[:keep] for r in rows])
        if held:
            yield work(held)

    chained = settle(arrow_map(dealt, chain, "doc_id long, source_id long, runs binary, low int, size int, source_low int, source_size int"))
    met.unpersist()
    ids = fit_to_send(chained.select(F.explode(F.array("doc_id", "source_id")).alias("doc_id")).distinct())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(without_repeats(batches)):
            words, at, _ = word_hashes(part.column("text").to_pylist())
            short = (words >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :BYTES]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([short[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "words"])

    # no column is renamed on either side, so that both joins share one exchange of the words
    words = arrow_map(docs.join(ids, "doc_id", "left_semi"), pack, "doc_id long, words binary")
    part = lambda low, size: F.col("w.words").substr(F.col(low) * BYTES + 1, F.col(size) * BYTES)
    one = chained.alias("c").join(words.alias("w"), F.col("c.doc_id") == F.col("w.doc_id")).select("c.*", part("low", "size").alias("x"))
    both = one.alias("c").join(words.alias("w"), F.col("c.source_id") == F.col("w.doc_id")).select("c.*", part("source_low", "source_size").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for d, s, packed, low, source_low, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                u, v = unpacked(x), unpacked(y)
                done: list[tuple[int, int]] = []
                for _, lot in itertools.groupby(np.frombuffer(packed, np.int32).reshape(-1, 6).tolist(), key=lambda r: r[0]):
                    runs = [tuple(r[1:]) for r in lot]
                    if runs[-1][1] + k > len(u) or runs[-1][3] + k > len(v):
                        continue  # another row of the same id
                    low_x, high_x = max(0, runs[0][0] - REACH // 2), min(len(u), runs[-1][1] + k + REACH // 2)
                    if any(i <= low_x and high_x <= j for i, j in done):
                        continue  # another place in the source of words that are listed already
                    for a0, a1, b0, b1, alike in split(align(u, v, runs, k), least_words, least_alike):
                        if (a0, a1) not in done:
                            done.append((a0, a1))
                            out.append((d, low + a0, a1 - a0, s, source_low + b0, b1 - b0, alike))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start_word", "n_words", "source_id", "source_start", "source_words", "alike"])

    found = arrow_map(both.select("doc_id", "source_id", "runs", "low", "source_low", "x", "y"), verify, "doc_id long, start_word int, n_words int, source_id long, source_start int, source_words int, alike double")
    return found.distinct()


def unpacked(words: bytes) -> np.ndarray:
    """Word hashes of BYTES bytes each as numbers."""
    out = np.zeros((len(words) // BYTES, 4), np.uint8)
    out[:, :BYTES] = np.frombuffer(words, np.uint8).reshape(-1, BYTES)
    return out.view("<u4")[:, 0]


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, count), nor the blanks that follow them."""
    places = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, count in sorted(spans):
        first, last = places[min(start, len(places) - 1)], places[min(start + count, len(places) - 1)]
        if first > at:
            out.append(text[at:first])
        at = max(at, last)
    out.append(text[at:])
    return "".join(out).strip()


def remove(df: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with the listed passages cut from their texts; rows with nothing listed stay as they are.

    A row whose text is left blank by the cut is dropped: all of it repeats
    earlier documents.  All columns are kept.
    """
    spans = passages.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    # whole rows travel as one column, whatever their columns are called
    marked = df.select(F.col(id_col).alias("doc_id"), F.struct(*df.columns).alias("row")).join(fit_to_send(spans), "doc_id", "left")
    names = df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = dict(zip(names, batch.column("row").flatten()))
            texts = [cut_words(t, [(s["start_word"], s["n_words"]) for s in spans]) if t else t for t, spans in zip(columns[text_col].to_pylist(), batch.column("spans").to_pylist())]
            columns[text_col] = pa.array(texts, columns[text_col].type)
            kept = pa.array([i for i, t in enumerate(texts) if t], pa.int64())
            yield pa.RecordBatch.from_arrays([columns[c].take(kept) for c in names], names=names)

    touched = arrow_map(marked.filter("spans IS NOT NULL").select("row", "spans"), cut, df.schema)
    return marked.filter("spans IS NULL").select("row.*").union(touched)
