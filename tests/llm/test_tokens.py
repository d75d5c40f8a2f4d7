"""The tree codec against tiktoken, the heap counter against tokenizers."""

import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from paravane.llm.bpe_tree import TreeBPE, encode_decode, read_ranks
from paravane.llm.token_count import HeapCounter, count_tokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABETS = ["ab ", "the of and in's 're \n", "éèß ö12 3,.!?", " \t\n\r ", "漢字かな🙂👍🏽 é́", "aaaaaaab", "don't I'll we've 'tis 99 %%%"]


@pytest.fixture(scope="module")
def tree():
    return TreeBPE(read_ranks(open(RANKS, "rb").read()), P.PATTERN)


@pytest.fixture(scope="module")
def library(tree):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tree.ranks, special_tokens={})


def texts(n):
    rng = random.Random(7)
    for _ in range(n):
        a = rng.choice(ALPHABETS)
        yield "".join(rng.choice(a) for _ in range(rng.choice([0, 1, 3, 20, 200])))
    yield "x" * 30_000
    yield "ab" * 9_000 + " " * 5_000 + "\n" * 5_000 + "z"
    yield " don't" * 4_000
    yield "".join(chr(rng.randrange(0x20, 0x2FFF)) for _ in range(20_000))
    yield "<|endoftext|> in a text<|endoftext|>"


def test_tree_matches_library(tree, library):
    import paravane.llm.bpe_tree as m

    for leaf in (8, 4096):
        m.LEAF_CHARS, saved = leaf, m.LEAF_CHARS
        for t in texts(300):
            packed = tree.encode(t)
            got = [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]
            assert got == library.encode_ordinary(t)
            assert tree.decode_packed(packed) == t.encode()
        m.LEAF_CHARS = saved


def test_heap_matches_library():
    heap = HeapCounter(open(P.path("byte_bpe_50k.json"), "rb").read())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in texts(300):
        assert heap.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_frames(spark):
    rows = [(1, None, 5, "x"), (2, "", 6, "y"), (3, "Hello wörld", 7, None), (3, "Hello wörld", 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, token_ids string")
    out = sorted(map(tuple, encode_decode(df, RANKS, P.PATTERN).collect()), key=str)
    assert [(r[0], bytes(r[2]).decode()) for r in out] == [(1, ""), (2, ""), (3, "Hello wörld"), (3, "Hello wörld")]
    counts = sorted(map(tuple, count_tokens(df, P.path("byte_bpe_50k.json")).collect()))
    assert counts[:2] == [(1, 0, 0), (2, 0, 0)] and counts[2][1] == 12 and counts[2] == counts[3]
    assert count_tokens(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    assert encode_decode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_patterns_that_look_around_are_refused():
    import public_tokenizers
    import pytest

    from paravane.llm.bpe_tree import checked_pattern

    assert checked_pattern(public_tokenizers.PATTERN) == public_tokenizers.PATTERN
    for bad in (r"\w+(?=x)|.", r"(?<=a)b|.", r"\bword|.", r"^a|.", r"a$|.", r"x(?!y)|."):
        with pytest.raises(ValueError):
            checked_pattern(bad)
