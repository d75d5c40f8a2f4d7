"""Token counts by heap-and-linked-list byte-pair merging.

For each match of the split pattern the symbols form a linked list and the
adjacent pairs a heap ordered by (merge rank, position).  The lowest pair is
popped, stale entries are skipped, and each merge joins two symbols.  The
count is the number of initial symbols minus the number of merges; no
identifier is ever emitted.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paravane.llm.common import arrow_map, keyed_text, text_of, text_slices

#: Entries of the per-worker cache of counts by match, and the longest match kept.
CACHE, CACHE_CHARS = 200_000, 48

#: Fixed values of the byte-level format: the split pattern, and the bytes that stand for themselves.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself, or the next one from 256 on."""
    spare = iter(range(256, 512))
    return [chr(b) if b in set(PRINTABLE) else chr(next(spare)) for b in range(256)]


class _Counts(dict):
    def __init__(self, count):
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = n
        return n


class HeapCounter:
    """Counter for one byte-level tokenizer file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are supported")
        number = model["vocab"]
        self.start = [number[s] for s in byte_symbols()]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[number[a], number[b]] = (rank, number[a + b])
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(SPLIT)
        self.counts = _Counts(self.count_match)

    def count_match(self, piece: str) -> int:
        symbols = [self.start[b] for b in piece.encode()]
        n = len(symbols)
        if n < 2:
            return n
        merges = self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has been merged away since
            symbols[i], symbols[j] = new, -1
            merged += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = merges.get((new, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], new, symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbols[h], new))
        return n - merged

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token."""
        count = self.counts.__getitem__
        if self.special is None:
            return sum(map(count, self.split.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(count, self.split.findall(p))) for p in parts)


@functools.lru_cache(4)
def counter(data: bytes) -> HeapCounter:
    return HeapCounter(data)


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """Bytes and tokens of each whole text: (doc_id, n_bytes long, n_tokens long).

    A null or empty text has no bytes and no tokens; repeated rows are counted
    each; other input columns are ignored; an empty table gives an empty
    result.  The tokenizer file is read on the driver and broadcast; rows are
    independent, so nothing is shuffled.
    """
    source = keyed_text(df, id_col, text_col)
    with open(tokenizer_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = counter(data.value)
        for part in text_slices(batches):
            texts = text_of(part).to_pylist()
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array([heap.count(t) if t else 0 for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return arrow_map(source, run, f"doc_id {kind}, n_bytes long, n_tokens long")
