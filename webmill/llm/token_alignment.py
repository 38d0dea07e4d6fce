"""Cross-tokenizer alignment: incidence matrices of tokens and bytes in compressed sparse rows, multiplied row by row.

Both tokenizers cut the same bytes (a space and the text). A is the token-byte matrix of the first, B of the second: a
row holds ones at the bytes of its token. The product A·Bᵀ has an entry where two tokens overlap, its value is the
number of bytes they share; these entries are the links. Offsets at which tokens of both end cut the bytes into groups;
the product of the token-group matrices links all tokens of a group. Products are Gustavson's: a row of the result is the
sum of the rows of the right matrix that the entries of a left row name, and rows are made in blocks of bounded size.

How often a pair of token ids is linked is counted over the whole corpus. Each document then needs the counts of its
pairs: the most frequent ones, at most ``hot_pairs`` of them, are sent to every task as sorted arrays; the others, few by
Zipf's law, go through a join on the pair. Texts are encoded once and stay in their tasks; pairs per document are stored.

Cases: a text that is null, empty or whose tokens do not give back its bytes has no tokens; repeated rows and rows with
equal or null ids each get a row; very long texts are a slice of their own and their products come in blocks; extra
columns are ignored; an empty table gives an empty result.
"""

import hashlib
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from webmill.llm.texts import parts, row_id, slices, stored, whole
from webmill.llm.word_ids import flat, gathered, looked_up

SLICE_BYTES = 1 << 20
BLOCK_PRODUCTS = 1 << 20
#: Texts that are encoded whole: runs of white space, very long words, the mark that cuts other texts into words.
UNCUT = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]{2}|[^ \n]{200}|\x{1e}"
CUT = "\x1e"
#: Fixed value: the characters that stand for the bytes of a byte-level vocabulary entry are the printable ones of
#: Latin-1 and, from U+0100 on, the other bytes in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LOADED = {}


class Csr(NamedTuple):
    """A sparse matrix: row ``i`` holds ``data[indptr[i]:indptr[i + 1]]`` in the columns ``indices[...]``."""
    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int


def incidence(lengths):
    """Rows of ones: row ``i`` covers the next ``lengths[i]`` columns."""
    indptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Csr(indptr, np.arange(indptr[-1]), np.ones(indptr[-1], np.int64), int(indptr[-1]))


def membership(groups, columns):
    """One entry a row, in the column of its group."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), columns)


def transposed(m):
    order = np.argsort(m.indices, kind="stable")
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    return Csr(indptr.astype(np.int64), rows[order], m.data[order], len(m.indptr) - 1)


def products(left, right):
    """Number of multiplications of each row of ``left @ right``; the entries of the row where no two fall together."""
    width = np.diff(right.indptr)[left.indices]
    done = np.concatenate([[0], np.cumsum(width)])
    return done[left.indptr[1:]] - done[left.indptr[:-1]]


def multiplied(left, right, block=BLOCK_PRODUCTS):
    """Entries (row, column, value) of ``left @ right`` in order, in blocks of rows with about ``block`` multiplications."""
    ends = np.cumsum(products(left, right))
    start, rows = 0, len(left.indptr) - 1
    while start < rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + block, side="right")))
        at = slice(left.indptr[start], left.indptr[stop])
        inner, first = left.indices[at], right.indptr[:-1]
        width = np.diff(right.indptr)[inner]
        row = np.repeat(np.repeat(np.arange(start, stop), np.diff(left.indptr[start:stop + 1])), width)
        column, _ = gathered(right.indices, first, np.diff(right.indptr), inner)
        value = np.repeat(left.data[at], width) * gathered(right.data, first, np.diff(right.indptr), inner)[0]
        key = row * right.columns + column
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if len(new):
            yield key[new] // right.columns, key[new] % right.columns, np.add.reduceat(value, new)
        start = stop


class Side(NamedTuple):
    """Tokens of one tokenizer over a run of texts: ids, bytes of each, bounds of the texts."""
    ids: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray

    def text(self):
        """The text of each token."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def of(self, texts):
        """Only the tokens of the texts in the mask."""
        keep = np.repeat(texts, np.diff(self.bounds))
        bounds = np.concatenate([[0], np.cumsum(np.diff(self.bounds)[texts])]).astype(np.int64)
        return Side(self.ids[keep], self.lengths[keep], bounds)


class Vocabulary(NamedTuple):
    """Bytes of every id, end to end."""
    pool: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def vocabulary(entries):
    lengths = np.array([len(e) for e in entries], np.int64)
    return Vocabulary(np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lengths) - lengths, lengths)


def byte_level(path):
    """Tokenizer and vocabulary of a byte-level file; strings of special tokens inside texts are plain text."""
    if (path, "bytes") not in _LOADED:
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        found.encode_special_tokens = True
        other = iter(range(0x100, 0x200))
        byte_of = {chr(b if b in PRINTABLE else next(other)): b for b in range(256)}
        names = found.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            entries[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        _LOADED[path, "bytes"] = found, vocabulary(entries)
    return _LOADED[path, "bytes"]


def pieces(path):
    """Processor and vocabulary of a sentence-piece model."""
    if (path, "pieces") not in _LOADED:
        found = SentencePieceProcessor(model_file=path)
        entries = [
            bytes([int(found.id_to_piece(i)[1:-1], 16)]) if found.is_byte(i) else found.id_to_piece(i).replace("▁", " ").encode()
            for i in range(found.get_piece_size())]
        _LOADED[path, "pieces"] = found, vocabulary(entries)
    return _LOADED[path, "pieces"]


def side(ids, bounds, vocab):
    ids = np.asarray(ids, np.int64)
    return Side(ids, vocab.lengths[ids], np.asarray(bounds, np.int64))


def cuts_at_spaces(path):
    """Whether the words of a text can be encoded one by one: no piece reaches over a blank or a line end."""
    if (path, "cuts") not in _LOADED:
        found, _ = pieces(path)
        names = [found.id_to_piece(i) for i in range(found.get_piece_size())]
        _LOADED[path, "cuts"] = b"identity" in found.serialized_model_proto() and not any("▁" in n.lstrip("▁") or "\n" in n for n in names)
    return _LOADED[path, "cuts"]


def encoder(path_a, path_b):
    """words -> (A ids, B ids) of each as bytes; a word begins with its blank or line end."""
    a, vocab = byte_level(path_a)
    b = pieces(path_b)[0]
    blank = b.encode("a ")[len(b.encode("a")):]  # of a blank at the end of a text
    raw = lambda ids: array("I", ids).tobytes()

    def encode(words):
        left = joined(words, a, vocab)
        # the model adds the blank itself, also before a line end, where it is a piece of its own
        right = b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        return [(x, raw(blank if w == " " else y if w[0] == " " else y[1:])) for w, x, y in zip(words, left, right)]
    return encode


def joined(words, tokenizer, vocab):
    """Ids of each word as bytes. Words without white space at their end are encoded as one text and cut where they end.

    They stand in it as in the texts they come from, so the ids are the same, without the cost of an encoding for each. If
    a token reaches over the end of a word after all, the words are encoded one by one.
    """
    one, out = [i for i, w in enumerate(words) if not w[-1].isspace()], [None] * len(words)
    ids = np.array(tokenizer.encode_batch_fast(["".join([words[i] for i in one])], add_special_tokens=False)[0].ids, np.uint32)
    ends = np.cumsum(vocab.lengths[ids])
    stops = np.cumsum(np.fromiter((len(words[i].encode()) for i in one), np.int64, len(one)))
    at = np.searchsorted(ends, stops)
    if len(ids) and len(one) and at[-1] == len(ids) - 1 and np.array_equal(ends[at], stops):
        data, start = ids.tobytes(), 0
        for i, stop in zip(one, (4 * (at + 1)).tolist()):
            out[i], start = data[start:stop], stop
    rest = [i for i, found in enumerate(out) if found is None]
    for i, found in zip(rest, tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
        out[i] = array("I", found.ids).tobytes()
    return out


def encoded(texts, path_a, path_b):
    """Tokens of both, of texts that begin with a blank; distinct words are encoded once and kept in the worker's cache."""
    odd = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False) | (not cuts_at_spaces(path_b))
    cut = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(~odd)), " ", CUT + " "), "\n", CUT + "\n")
    words = parts(pc.split_pattern(cut, CUT))
    known = looked_up(words.vocab.to_pylist(), encoder(path_a, path_b), (path_a, path_b))
    long = texts.filter(pa.array(odd)).to_pylist()
    whole_a = byte_level(path_a)[0].encode_batch_fast(long, add_special_tokens=False)
    whole_b = pieces(path_b)[0].encode([t[1:] for t in long], num_threads=1)
    known += [(array("I", x.ids).tobytes(), array("I", y).tobytes()) for x, y in zip(whole_a, whole_b)]
    # words of each text, or the text itself as one word
    sizes = np.ones(len(odd), np.int64)
    sizes[~odd] = np.diff(words.bounds)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.empty(bounds[-1], np.int64)
    codes[np.repeat(~odd, sizes)] = words.codes
    codes[np.repeat(odd, sizes)] = np.arange(len(words.vocab), len(known))
    out = []
    for which, (_, vocab) in enumerate((byte_level(path_a), pieces(path_b))):
        ids, ends = gathered(*flat([k[which] for k in known]), codes)
        out.append(side(ids, np.concatenate([[0], ends])[bounds], vocab))
    return out


def same_bytes(tokens, vocab, texts):
    """Which texts are the bytes of their tokens end to end."""
    joined, ends = gathered(vocab.pool, vocab.starts, vocab.lengths, tokens.ids)
    at = np.concatenate([[0], ends])[tokens.bounds]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[:len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return np.array([
        b - a == d - c and np.array_equal(joined[a:b], data[c:d])
        for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist())], bool)


class Alignment(NamedTuple):
    """Texts of a slice that both tokenizers give back (``good``), their tokens, and the group of each token."""
    good: np.ndarray
    a: Side
    b: Side
    group_a: np.ndarray
    group_b: np.ndarray
    cuts: np.ndarray  # byte offset at which each group ends
    ends: np.ndarray  # byte offset at which each good text ends

    def overlaps(self):
        """Blocks of (A token, B token, shared bytes)."""
        return multiplied(incidence(self.a.lengths), transposed(incidence(self.b.lengths)))

    def _groups(self):
        return membership(self.group_a, len(self.cuts)), transposed(membership(self.group_b, len(self.cuts)))

    def shared(self):
        """Blocks of (A token, B token) of one group."""
        return ((a, b) for a, b, _ in multiplied(*self._groups()))

    def shared_counts(self):
        """Number of shared-group links of each A token; a row of the product has as many entries as multiplications."""
        return products(*self._groups())


def align(texts, path_a, path_b):
    """The :class:`Alignment` of a large-string array without nulls."""
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    a, b = encoded(spaced, path_a, path_b)
    good = ~empty & same_bytes(a, byte_level(path_a)[1], spaced) & same_bytes(b, pieces(path_b)[1], spaced)
    a, b = a.of(good), b.of(good)
    ends_a, ends_b = np.cumsum(a.lengths), np.cumsum(b.lengths)
    end = np.zeros((2, 1 + int(a.lengths.sum())), bool)
    end[0, ends_a], end[1, ends_b] = True, True
    both = end[0] & end[1]
    before = np.cumsum(both) - both  # groups that end before each byte offset
    return Alignment(good, a, b, before[ends_a], before[ends_b], np.flatnonzero(both), np.concatenate([[0], ends_a])[a.bounds[1:]])


def spelled(found, n_ids):
    """Bytes of ``a1,a2|b1;a3|b2,b3`` for each good text, end to end, and where each begins and ends."""
    a, b, n = found.a, found.b, len(found.cuts)
    of_a, of_b = np.bincount(found.group_a, minlength=n), np.bincount(found.group_b, minlength=n)
    before_a, before_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    ids, kind = (np.empty(len(a.ids) + len(b.ids), np.int64) for _ in range(2))
    at_a = np.arange(len(a.ids)) + before_b[found.group_a]
    at_b = np.arange(len(b.ids)) + (before_a + of_a)[found.group_b]
    ids[at_a], ids[at_b] = a.ids, b.ids
    kind[at_a] = np.where(np.arange(len(a.ids)) == (before_a + of_a)[found.group_a] - 1, 1, 0)
    kind[at_b] = np.where(np.arange(len(b.ids)) == (before_b + of_b)[found.group_b] - 1, 2, 0)
    bounds = a.bounds + b.bounds
    kind[bounds[1:] - 1] = 3
    if ("spelled", n_ids) not in _LOADED:
        _LOADED["spelled", n_ids] = vocabulary([b",", b"|", b";", b"", *(b"%d" % i for i in range(n_ids))])
    text = _LOADED["spelled", n_ids]
    codes = np.stack([ids + 4, kind], axis=1).ravel()
    data, ends = gathered(text.pool, text.starts, text.lengths, codes)
    return data.tobytes(), np.concatenate([[0], ends])[2 * bounds]


def with_row(docs, doc_id="doc_id"):
    return docs.select(row_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def links(docs, path_a, path_b, shared_groups=False):
    """One row for each link: document, token numbers and ids, shared bytes (null for shared-group links)."""
    def run(batches):
        for batch in slices(batches, limit=SLICE_BYTES):
            found = align(whole(batch["text"]), path_a, path_b)
            good, text_of = np.flatnonzero(found.good), found.a.text()
            for block in found.shared() if shared_groups else found.overlaps():
                a, b = block[:2]
                text = text_of[a]
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].take(pa.array(good[text])), pa.array(a - found.a.bounds[text]), pa.array(b - found.b.bounds[text]),
                    pa.array(found.a.ids[a]), pa.array(found.b.ids[b]),
                    pa.nulls(len(a), pa.int64()) if shared_groups else pa.array(block[2])], names=["doc_id", "a", "b", "a_id", "b_id", "n_bytes"])
    return with_row(docs).mapInArrow(run, "doc_id long, a long, b long, a_id long, b_id long, n_bytes long")


def sizes(path_a, path_b):
    """Number of ids of each tokenizer; ``a * len(B) + b`` codes a pair."""
    return len(byte_level(path_a)[1].starts), len(pieces(path_b)[1].starts)


def aligned(docs, path_a, path_b):
    """One row for each document: its numbers, the digest of its groups, its distinct linked pairs and their times."""
    size_a, size_b = sizes(path_a, path_b)
    span = size_a * size_b
    code, number = ("int", np.int32) if span < 2 ** 31 else ("long", np.int64)
    schema = (f"_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, "
              f"pairs array<{code}>, times array<int>")

    def run(batches):
        for batch in slices(batches, limit=SLICE_BYTES):
            found = align(whole(batch["text"]), path_a, path_b)
            n, good, text_of = batch.num_rows, np.flatnonzero(found.good), found.a.text()
            out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "n_group_links")}
            out["n_a"][good], out["n_b"][good] = np.diff(found.a.bounds), np.diff(found.b.bounds)
            out["n_groups"][good] = np.diff(np.searchsorted(found.cuts, np.concatenate([[0], found.ends]), side="right"))
            shared = np.concatenate([[0], np.cumsum(found.shared_counts())])
            out["n_group_links"][good] = np.diff(shared[found.a.bounds])
            # a block of a long text gives a part of its pairs; parts of one text are added up
            keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b, _ in found.overlaps():
                text = text_of[a]
                out["n_links"][good] += np.bincount(text, minlength=len(good))
                key, count = np.unique(text * span + found.a.ids[a] * size_b + found.b.ids[b], return_counts=True)
                keys.append(key)
                times.append(count)
            keys, where = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(where, np.concatenate(times), len(keys)).astype(np.int32)
            per_text = np.zeros(n, np.int64)
            per_text[good] = np.bincount(keys // span, minlength=len(good)) if len(good) else 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32))
            sha = np.full(n, "", object)
            data, ends = spelled(found, max(size_a, size_b))
            sha[good] = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                batch["_row"], batch["doc_id"], *(pa.array(c) for c in out.values()), pa.array(sha, pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array((keys % span).astype(number))), pa.ListArray.from_arrays(offsets, pa.array(times))],
                names=["_row", "doc_id", *out, "groups_sha256", "pairs", "times"])

    return with_row(docs).mapInArrow(run, schema)


def pair_counts(documents, size_b):
    """(pair, count, best) over all documents; ``best``: no pair of the same B id is linked more often."""
    rows = documents.select(F.inline(F.arrays_zip("pairs", "times"))).select(F.col("pairs").cast("long").alias("pair"), "times")
    counts = stored(rows.groupBy("pair").agg(F.sum("times").alias("count")), "pair-counts")
    top = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("top"))  # at most one row for each B id
    return stored(
        counts.join(F.broadcast(top), F.col("pair") % size_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best")),
        "pair-best")


def least_hot(counts, most):
    """The smallest power of two that at most ``most`` pairs reach with their count."""
    sizes = {r.p: r.n for r in counts.groupBy(F.floor(F.log2("count")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    power, taken = 0, 0
    for p in sorted(sizes, reverse=True):
        taken += sizes[p]
        if taken > most:
            power = p + 1
            break
    return 1 << power


def weighed(docs, path_a, path_b, hot_pairs=1_000_000):
    """``aligned`` with n_best and count_sum in place of the pairs."""
    size_b = sizes(path_a, path_b)[1]
    documents = stored(aligned(docs, path_a, path_b), "aligned")
    counts = pair_counts(documents, size_b)
    least = least_hot(counts, hot_pairs)
    hot = counts.filter(F.col("count") >= least).toArrow().sort_by("pair")
    sent = docs.sparkSession.sparkContext.broadcast([hot[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")])

    def looked(batches):
        pair, count, best = sent.value
        for batch in batches:
            times = batch["times"].flatten().to_numpy().astype(np.int64)
            codes = batch["pairs"].flatten().to_numpy().astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(batch["pairs"]).to_numpy())]).astype(np.int64)
            at = np.minimum(np.searchsorted(pair, codes), max(len(pair) - 1, 0))
            known = pair[at] == codes if len(pair) else np.zeros(len(codes), bool)
            per_text = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])
            weight = np.where(known, times, 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(per_text((~known).astype(np.int64)))]).astype(np.int32))
            out = {c: batch[c] for c in batch.schema.names if c not in ("pairs", "times")}
            out["n_best"] = pa.array(per_text(weight * best[at] if len(pair) else weight))
            out["count_sum"] = pa.array(per_text(weight * count[at] if len(pair) else weight))
            out["pairs"] = pa.ListArray.from_arrays(offsets, pa.array(codes[~known]))
            out["times"] = pa.ListArray.from_arrays(offsets, pa.array(times[~known]))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    plain = [f"{f.name} {f.dataType.simpleString()}" for f in documents.drop("pairs", "times").schema]
    found = documents.mapInArrow(looked, ", ".join(plain) + ", n_best long, count_sum long, pairs array<long>, times array<long>")
    if least > 1:  # some pairs were not sent: their counts come by a join on the pair
        found = stored(found, "looked-up")
        rare = counts.filter(F.col("count") < least).withColumnRenamed("pair", "pairs")
        rest = found.select("_row", F.inline(F.arrays_zip("pairs", "times"))).join(rare, "pairs").groupBy("_row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("count")).alias("_sum"))
        found = found.join(rest, "_row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("_best", "_sum")
    return found.drop("_row", "pairs", "times")
