"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut into halves until a leaf is small enough; leaves are encoded on
their own; neighbours are joined by re-encoding a window around the border
that grows until the tokens outside provably cannot change.  There are two
levels, because the ranks apply inside each match of the split pattern only:

* **matches**: an element is the list of matches of a segment.  A match that
  ends ``LOOK`` characters before the segment's end was decided by characters
  that are present, so only later ones are redone, together with a growing
  prefix of the right neighbour, until a match border coincides with a border
  of the right neighbour; from there on both agree, since the pattern never
  looks back.
* **tokens of a match**: a sequence of tokens is the encoding of its bytes if
  and only if each adjacent pair is the encoding of the pair's bytes (the
  first merge across a border would happen in the pair alone, too).  So a
  window is wide enough once its border tokens form stable pairs with the
  tokens just outside.

Decoding maps leaves of identifiers to bytes and concatenates up the tree.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paravane.llm.common import arrow_map, keyed_text, text_of, text_slices

#: Characters of a text leaf, bytes of a token leaf, identifiers of a decoding leaf.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 4096, 6, 4096
#: A match is decided by at most this many characters beyond its end.
LOOK = 3
#: Entries of the per-worker cache of encoded matches, and the longest match kept.
CACHE, CACHE_CHARS = 200_000, 48
#: Entries of the caches of encoded windows and of stable pairs.
WINDOWS = 60_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class _Pieces(dict):
    """Encoded matches by text; cleared when full, so its memory is bounded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = packed
        return packed


class TreeBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.token = {v: k for k, v in ranks.items()}
        self.pieces = _Pieces(self.encode_match)
        # short byte strings recur at the borders and leaves of many different matches
        self.window = functools.lru_cache(WINDOWS)(self._window)
        self.stable = functools.lru_cache(WINDOWS)(self._stable)

    # -- tokens of one match ------------------------------------------------
    def _window(self, data: bytes) -> tuple[int, ...]:
        """Merge a short window: the adjacent pair of lowest rank first, leftmost on ties."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple([ranks[p] for p in parts])

    def _stable(self, left: int, right: int) -> bool:
        return self.window(self.token[left] + self.token[right]) == (left, right)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The product of two encoded halves."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            middle = self.window(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))
            fits_left = i >= len(left) or self.stable(left[-i - 1], middle[0])
            fits_right = j >= len(right) or self.stable(middle[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + middle + right[j:]
            i = i if fits_left else min(2 * i, len(left))
            j = j if fits_right else min(2 * j, len(right))

    def reduce(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF_BYTES:
            return self.window(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def encode_match(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one match; a match that is itself a token is that token."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.reduce(data)

    # -- matches of a text --------------------------------------------------
    def matches(self, text: str) -> list[str]:
        """The pattern's matches over the text, by halves."""
        if len(text) <= LEAF_CHARS:
            return self.split.findall(text)
        half = len(text) // 2
        return self.meet(self.matches(text[:half]), text[half:], self.matches(text[half:]))

    def meet(self, left: list[str], after: str, right: list[str]) -> list[str]:
        """The product of two segments' matches; ``after`` is the right segment's text."""
        keep, loose = len(left), 0
        while keep and loose < LOOK:  # matches that end before the last LOOK characters stay
            keep -= 1
            loose += len(left[keep])
        tail = "".join(left[keep:])
        width = 64
        while True:
            width = min(width, len(after))
            borders, at = {}, 0
            for k, piece in enumerate(right):
                if at > width:
                    break
                borders[at] = k
                at += len(piece)
            window, redone, at = tail + after[:width], [], -len(tail)
            for piece in self.split.findall(window):
                if at >= 0 and at in borders and redone:
                    return left[:keep] + redone + right[borders[at] :]
                redone.append(piece)
                at += len(piece)
                if at > width - LOOK and width < len(after):
                    break
            if width == len(after):
                return left[:keep] + redone
            width *= 2

    def encode(self, text: str) -> bytes:
        """Identifiers of the text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.matches(text)))

    def decode(self, ids: tuple[int, ...]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decode_packed(self, packed: bytes) -> bytes:
        return self.decode(struct.unpack(f"<{len(packed) // 4}I", packed))


@functools.lru_cache(4)
def codec(data: bytes, pattern: str) -> TreeBPE:
    return TreeBPE(read_ranks(data), pattern)


def checked_pattern(pattern: str) -> str:
    """The pattern, if LOOK is proved for its kind: no assertion but that white space is not followed by anything else."""
    rest = pattern.replace(r"(?!\S)", "")
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[bBAzZG]|(?<![\[\\])[\^$]", rest):
        raise ValueError("a split pattern that looks around, other than by (?!\\S), is not supported")
    return pattern


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """Encode each whole text and decode the identifiers again.

    Returns (doc_id, token_ids binary, decoded binary): token_ids holds the
    identifiers as little-endian unsigned 32-bit integers, decoded the bytes
    they stand for.  A pattern may look at what follows by ``(?!\\S)`` only, as
    the usual split patterns do; another is refused.  A null or empty text gives empty binaries; repeated rows
    are encoded each; other input columns are ignored; an empty table gives an
    empty result.  With text_col None the key is a struct that holds the text.
    The rank file is read on the driver and broadcast (its size
    is that of a vocabulary and does not grow with the data).  Rows are
    independent: no shuffle, and a lost executor costs only its tasks.
    """
    checked_pattern(pattern)
    source = keyed_text(df, id_col, text_col)
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks.value, pattern)
        for part in text_slices(batches):
            ids = [bpe.encode(t) if t else b"" for t in text_of(part).to_pylist()]
            out = [bpe.decode_packed(x) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(out, pa.binary())], names=["doc_id", "token_ids", "decoded"])

    return arrow_map(source, run, f"doc_id {kind}, token_ids binary, decoded binary")
