"""Properties of the operators' kernels, on generated texts."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from paravane.llm import jaccard_join, passages, words
from paravane.llm.bpe_tree import TreeBPE, read_ranks
from paravane.llm.token_count import HeapCounter

texts = st.text(st.sampled_from("abAB  '\n\t\x1c1é漢!. sdtrel"), max_size=120)


@pytest.fixture(scope="module")
def codec():
    tree = TreeBPE(read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), P.PATTERN)
    return tree, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tree.ranks, special_tokens={})


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60) | texts, st.integers(1, 40))
def test_segments_meet_like_the_whole(codec, text, cut):
    tree, library = codec
    left, right = tree.split.findall(text[:cut]), tree.split.findall(text[cut:])
    assert tree.meet(left, text[cut:], right) == tree.split.findall(text)
    packed = tree.encode(text)
    assert [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)] == library.encode_ordinary(text)


@settings(deadline=None, max_examples=100)
@given(st.binary(min_size=1, max_size=80), st.integers(1, 79))
def test_tokens_join_like_the_whole(codec, data, cut):
    tree, _ = codec
    if cut < len(data):
        assert list(tree.join(tree.window(data[:cut]), tree.window(data[cut:]))) == list(tree.window(data))


@settings(deadline=None, max_examples=100)
@given(st.lists(texts, max_size=6))
def test_words_are_blank_separated_runs(found):
    h, at, sizes = words.word_hashes(found)
    for k, t in enumerate(found):
        own = [w.lower() if w.isascii() else w for w in passages.WORD.findall(t)]
        assert at[k + 1] - at[k] == len(own) and sizes[at[k] : at[k + 1]].tolist() == [len(w.encode()) for w in own]
    assert len(h) == at[-1]


@settings(deadline=None, max_examples=200)
@given(st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100), (1, 2)]))
def test_sketch_never_exceeds_the_difference(seed, level):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
    b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)]))
    x, y = (jaccard_join.sketch(g, *level) for g in (a, b))
    bits = 8 * min(len(x), len(y))
    folded = [jaccard_join.fold_to(int.from_bytes(v, "little"), 8 * len(v), bits) for v in (x, y)]
    assert (folded[0] ^ folded[1]).bit_count() <= len(np.setxor1d(a, b))


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10**6))
def test_prefixes_of_linked_sets_meet(seed):
    rng = random.Random(seed)
    a = {rng.randrange(2**63) for _ in range(rng.randrange(1, 120))}
    b = set(a)
    for _ in range(rng.randrange(0, 8)):
        b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.randrange(2**63))
    for num in (80, 90):
        if 100 * len(a & b) >= num * len(a | b):
            heads = [set(jaccard_join.prefix(g, (g % np.uint64(30)).astype(np.int64), num, 100).tolist()) for g in (np.array(sorted(s), np.uint64) for s in (a, b))]
            assert heads[0] & heads[1]


@settings(deadline=None, max_examples=100)
@given(texts, texts)
def test_a_special_string_counts_one(a, b):
    heap = test_a_special_string_counts_one.heap
    assert heap.count(a + "<|endoftext|>" + b) == heap.count(a) + 1 + heap.count(b)


test_a_special_string_counts_one.heap = HeapCounter(open(P.path("byte_bpe_50k.json"), "rb").read())
