"""Cross-tokenizer alignment against plain loops over bytes."""

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from webmill.llm import token_alignment as ta
from webmill.llm.queries import QUERIES

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def byte_names():
    """The characters of byte-level vocabularies, by byte."""
    kept = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    out, extra = {}, 256
    for b in range(256):
        if b in kept:
            out[chr(b)] = b
        else:
            out[chr(extra)], extra = b, extra + 1
    return out


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, B ids, A byte strings, B byte strings) by the libraries alone."""
    a, b, names = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_names()
    a.encode_special_tokens = True

    def tokens(text):
        if not text:
            return [], [], [], []
        whole = (" " + text).encode()
        e = a.encode(" " + text, add_special_tokens=False)
        ids = b.encode(text)
        left = [bytes(names[c] for c in a.id_to_token(i)) for i in e.ids]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids]
        if b"".join(left) != whole or b"".join(right) != whole:
            return [], [], [], []
        return e.ids, ids, left, right
    return tokens


def spans(parts):
    ends = np.cumsum([len(p) for p in parts])
    return [(int(e) - len(p), int(e)) for p, e in zip(parts, ends)]


def by_hand(plain, texts):
    per_text, pairs = [], Counter()
    for text in texts:
        ia, ib, pa, pb = plain(text)
        sa, sb, links, j = spans(pa), spans(pb), [], 0
        for i, (s, e) in enumerate(sa):
            while j and sb[j - 1][1] > s:
                j -= 1
            while j < len(sb) and sb[j][0] < e:
                if sb[j][1] > s:
                    links.append((i, j, min(e, sb[j][1]) - max(s, sb[j][0])))
                j += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([], []) for _ in cuts]
        for side, ids, at in ((0, ia, sa), (1, ib, sb)):
            for token, (_, e) in zip(ids, at):
                groups[bisect_left(cuts, e)][side].append(token)
        per_text.append((ia, ib, links, groups))
        pairs.update((ia[i], ib[j]) for i, j, _ in links)
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for ia, ib, links, groups in per_text:
        counts = [pairs[ia[i], ib[j]] for i, j, _ in links]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if ia else ""
        out.append((len(ia), len(ib), len(groups), len(links), sum(c == best[ib[j]] for c, (_, j, _) in zip(counts, links)), sum(counts), sha))
    return out


@pytest.mark.parametrize("hot", [1_000_000, 40, 0])
def test_columns_equal_plain_loops(spark, stored_docs, plain, hot):
    rows = stored_docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, by_hand(plain, [r.text for r in rows])))
    assert Counter(map(tuple, ta.weighed(stored_docs, A, B, hot).select(*COLUMNS).collect())) == want
    assert sum(k[1] > 0 for k in want.elements()) > 15 and any(k[1] == 0 for k in want)


def test_query_over_the_whole_table(spark, plain):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, by_hand(plain, [r.text for r in rows])))
    assert Counter(map(tuple, QUERIES["op11_token_alignment"](spark, folder).select(*COLUMNS).collect())) == want


def test_links_are_the_overlaps_and_the_pairs_of_groups(spark, plain):
    texts = ["Straße naïve tokenization 123", "a", "日本語 🙂 mixed", "<|endoftext|> plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    overlaps, shared = set(), set()
    for i, text in enumerate(texts):
        ia, ib, pa, pb = plain(text)
        sa, sb = spans(pa), spans(pb)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        group = lambda end: sum(c < end for c in cuts)
        for x, (s, e) in enumerate(sa):
            for y, (t, u) in enumerate(sb):
                if min(e, u) > max(s, t):
                    overlaps.add((i, x, y, ia[x], ib[y], min(e, u) - max(s, t)))
                if group(e) == group(u):
                    shared.add((i, x, y, ia[x], ib[y], None))
    assert {tuple(r) for r in ta.links(docs, A, B).collect()} == overlaps
    assert {tuple(r) for r in ta.links(docs, A, B, shared_groups=True).collect()} == shared
    counts = {r.doc_id: r.n_group_links for r in ta.weighed(docs, A, B).collect()}
    assert counts == {i: sum(s[0] == i for s in shared) for i in range(len(texts))}


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_products_equal_dense_ones(block):
    rng = np.random.default_rng(4)

    def sparse(rows, columns):
        dense = rng.integers(0, 3, (rows, columns)) * (rng.random((rows, columns)) < 0.3)
        at = [np.flatnonzero(r) for r in dense]
        indptr = np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int64)
        indices = np.concatenate(at).astype(np.int64)
        return dense, ta.Csr(indptr, indices, dense[dense > 0], columns)

    (x, left), (y, right) = sparse(13, 9), sparse(9, 17)
    out = np.zeros((13, 17), np.int64)
    for row, column, value in ta.multiplied(left, right, block):
        out[row, column] += value
    assert (out == x @ y).all()
    back = ta.transposed(right)
    dense = np.zeros((17, 9), np.int64)
    dense[np.repeat(np.arange(17), np.diff(back.indptr)), back.indices] = back.data
    assert (dense == y.T).all()


def test_blocks_do_not_change_the_result(spark, stored_docs, monkeypatch, plain):
    import pyarrow as pa

    texts = pa.array(["some words that both tokenizers cut " * 40, "", "two"], pa.large_string())
    found = ta.align(texts, A, B)
    wide = [np.concatenate(x) for x in zip(*ta.multiplied(ta.incidence(found.a.lengths), ta.transposed(ta.incidence(found.b.lengths))))]
    small = [np.concatenate(x) for x in zip(*ta.multiplied(ta.incidence(found.a.lengths), ta.transposed(ta.incidence(found.b.lengths)), 16))]
    assert all((a == b).all() for a, b in zip(wide, small)) and wide[2].sum() == found.a.lengths.sum()


def test_an_empty_table(spark, no_docs):
    assert ta.weighed(no_docs, A, B).collect() == [] and ta.links(no_docs, A, B).collect() == []


def test_words_are_encoded_as_one_text():
    """The words that a worker's cache lacks cost one encoding, with the ids that each has alone (op11: time)."""
    tokenizer, vocab = ta.byte_level(A)
    words = [" the", " ", "\nnew", "\n", " it's", "'s", " end\t", " café", "\n日本語", " <|endoftext|>", " a ", " 12345", "\x00", " x\u200b", " e\u0301\u0301"]
    one_by_one = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    texts = []

    class Counted:
        def encode_batch_fast(self, batch, **how):
            texts.extend(batch)
            return tokenizer.encode_batch_fast(batch, **how)

    assert [np.frombuffer(x, np.uint32).tolist() for x in ta.joined(words, Counted(), vocab)] == one_by_one
    assert len(texts) == 1 + 4  # those with white space at their end go alone
    # words whose neighbours change their tokens are found out and encoded alone
    odd = ["wo", "rd", "ing"]
    assert [np.frombuffer(x, np.uint32).tolist() for x in ta.joined(odd, tokenizer, vocab)] == [
        tokenizer.encode(w, add_special_tokens=False).ids for w in odd]
    assert ta.joined([], tokenizer, vocab) == []
