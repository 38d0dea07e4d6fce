"""Token ids, counts and packing against the tokenizers library and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webmill.llm import bpe_trie, packing, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    return Tokenizer.from_file(path)


def ids(text, path=WORDS):
    return library_cache(path).encode(text or "", add_special_tokens=False).ids


_LIBRARY = {}


def library_cache(path):
    if path not in _LIBRARY:
        _LIBRARY[path] = library(path)
    return _LIBRARY[path]


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encoding_equals_the_library(odd_docs):
    want = [(r.doc_id, ids(r.text)) for r in odd_docs.collect()]
    assert plain(bpe_trie.encoded(odd_docs, WORDS)) == sorted(want, key=repr)


def test_digests_equal_the_library(odd_docs):
    own = library_cache(WORDS)
    want = []
    for r in odd_docs.collect():
        i = ids(r.text)
        want.append((r.doc_id, len(i), sha(" ".join(map(str, i))), sha(own.decode(i, skip_special_tokens=False))))
    assert plain(bpe_trie.digests(odd_docs, WORDS)) == sorted(want, key=repr)


def test_decoding_equals_the_library(odd_docs):
    own = library_cache(WORDS)
    want = [(r.doc_id, own.decode(ids(r.text), skip_special_tokens=False)) for r in odd_docs.collect()]
    assert plain(bpe_trie.decoded(bpe_trie.encoded(odd_docs, WORDS), WORDS)) == sorted(want, key=repr)


def test_trie_equals_plain_merging():
    encoder = bpe_trie.encoder(WORDS)
    rng = random.Random(1)
    words = {"".join(rng.choice("etaoinsth") for _ in range(rng.randint(1, 14))) for _ in range(3000)}
    for word, got in encoder.walk(words).items():
        assert got == [encoder.vocab[t] for t in encoder.merged([*word[:-1], word[-1] + encoder.end])]


def test_token_counts_equal_the_library(odd_docs):
    want = [(r.doc_id, len((r.text or "").encode()), len(ids(r.text, BYTES))) for r in odd_docs.collect()]
    assert plain(token_counts.count(odd_docs, BYTES)) == sorted(want, key=repr)
    assert plain(token_counts.count(odd_docs, BYTES, table_size=1, sample_words=1)) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_white_space_never_changes_a_count(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "The", "'s", " ", " ", "\n", "\t", " ", "7", ".", "<|endoftext|>"]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    if seed < 2:  # through Spark
        got = {r[0]: r[2] for r in token_counts.count(df, BYTES).collect()}
        assert got == {i: len(ids(t, BYTES)) for i, t in enumerate(texts)}
    encoder = bpe_trie.encoder(WORDS)
    for text in texts:
        parts = [p.decode() for p in text.encode().split()]
        assert [i for w in encoder.encode(parts) for i in w] == ids(text)


def test_runs_of_white_space_go_through_both_tiers(spark):
    """Runs of any white space are cut into pieces; only one right before a special string sends its text whole."""
    rng = random.Random(3)
    marks = [" ", " ", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "\x1c", "a", "bc", "12", "!!", "'s", "é", "日"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    texts += ["a  <|endoftext|>  b", "\n\n<|endoftext|>", "a <|endoftext|>  ", " " * 70_000 + "a", "a" + "\n" * 70_000, "w" * 500 + "  " + "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for size in (32_768, 1):
        got = {r[0]: r[2] for r in token_counts.count(df, BYTES, table_size=size).collect()}
        assert got == {i: len(ids(t, BYTES)) for i, t in enumerate(texts)}
    special = token_counts.before_special(BYTES)
    assert [bool(special.search(t)) for t in texts[3000:3003]] == [True, True, False]


def test_the_table_of_frequent_words_has_a_bound_in_bytes(spark):
    df = spark.createDataFrame([(1, "w" * 5000 + " a b"), (2, "日" * 65 + " " + "日" * 64)], "doc_id long, text string")
    assert set(token_counts.frequent(df, BYTES)) == {" a", " b", " " + "日" * 64}


def test_no_documents(no_docs):
    assert plain(bpe_trie.digests(no_docs, WORDS)) == plain(token_counts.count(no_docs, BYTES)) == plain(packing.pack(packing.pieces(no_docs, WORDS))) == []


def checked(rows, docs, capacity):
    """Sequences of a packing, after all its rules."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for doc in docs:
        own = ids(doc.text) + [0]
        for i, start in enumerate(range(0, len(own), capacity)):
            part = np.array(own[start:start + capacity], "<u4")
            want[doc.doc_id].append((i, start, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return sequences


def test_packing_keeps_all_rules(odd_docs):
    docs = odd_docs.collect()
    for capacity, size in ((2048, 20_000), (64, 5), (1, 3)):
        checked(packing.pack(packing.pieces(odd_docs, WORDS, capacity), capacity, size).collect(), docs, capacity)


def test_sequences_hold_the_ids(odd_docs):
    packed = packing.pack(packing.pieces(odd_docs, WORDS, 64, with_ids=True), 64, 10).cache()
    first = {(r.sequence_id, r.offset): r for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        for (sequence, offset), piece in first.items():
            if sequence == r.sequence_id:
                assert zlib.crc32(np.array(r.ids[offset:offset + piece.length], "<u4").tobytes()) == piece.ids_crc32


def fewest(sizes, capacity):
    """Exact number of bins by search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + sizes[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1:]])
        place(i + 1, [*bins, sizes[i]])
    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bound_and_packing_enclose_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    sizes = np.array(sorted((rng.randint(1, capacity - 1) for _ in range(9)), reverse=True))
    best = fewest(sizes.tolist(), capacity)
    where, at, bins = packing.best_fit(sizes, capacity)
    assert packing.lower_bound(sizes, capacity) <= best <= bins
    assert len(set(where)) == bins and all(sizes[where == b].sum() <= capacity for b in range(bins))
    assert len(set(zip(where, at))) == len(sizes)


def test_bounds_prove_what_volume_cannot():
    assert packing.lower_bound(np.array([6] * 10), 10) == 10
    assert packing.lower_bound(np.array([4] * 9), 10) == 5
    assert packing.lower_bound(np.array([34] * 7), 100) == 4


@pytest.mark.parametrize("seed", range(20))
def test_filling_is_a_packing(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.randint(1, 99) for _ in range(60)])
    where, at, bins = packing.filled(sizes, 100)
    assert sorted(set(where)) == list(range(bins)) and packing.lower_bound(sizes, 100) <= bins
    for b in range(bins):
        own = sorted((a, s) for w, a, s in zip(where, at, sizes) if w == b)
        assert [a for a, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))] and sum(s for _, s in own) <= 100
    assert packing.filled(np.array([6, 5, 5, 4, 7, 3]), 10)[2] == 3


def test_gaps_are_exchanged(spark):
    """Halves dealt apart by chance need no more sequences than all of them together."""
    rows = [(i, 0, 0, 51 if i % 2 else 49, 0) for i in range(400)]
    cut = spark.createDataFrame(rows, packing.PIECE)
    one = packing.pack(cut, 100, 1000).select("sequence_id").distinct().count()
    first = packing.pack(cut, 100, 40, rounds=1).select("sequence_id").distinct().count()
    more = packing.pack(cut, 100, 40, rounds=6).select("sequence_id").distinct().count()
    assert one == 200 and one <= more <= first
