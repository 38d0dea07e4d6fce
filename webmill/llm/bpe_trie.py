"""BPE encoding and decoding by a trie of distinct words.

Byte-pair encoding has two properties that make prefixes shareable: every part of a valid encoding is the encoding of
its own text, and a sequence of tokens is valid if each adjacent pair is. So the encoding of a prefix is given by its
last token alone: the one token that ends there, encodes itself, and stands in a valid pair with the last token of the
prefix before it. Distinct words of a slice of texts are visited in sorted order, which is the depth-first order of
their trie; the last tokens on the path to the current node are kept, so a shared prefix is worked out once. A word of
a million letters takes linear time.

Cases: a null text is an empty one; strings of special tokens inside texts become those tokens, as the library does by
default; repeated rows each get a row; no rows give none; extra columns are ignored.
"""

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from webmill.llm.texts import slices, whole, words_of
from webmill.llm.word_ids import folded, looked_up, tokenizer

#: Fixed value: the tokenizer's pattern for pre-tokens.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Letters that every Unicode version composes, lower-cases and classifies alike.
PLAIN = regex.compile(r"[\x21-\x7eÀ-ɏ]*")
CACHED_DIGESTS = 400_000
_ENCODERS = {}


def byte_letters():
    """The letter that stands for each byte: printable Latin-1 itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Encoder:
    """Encodes words with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.path, self.vocab, self.end = path, model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.endings = {False: {}, True: {}}  # lengths of tokens inside or at the end of a word, by their last two letters
        for token in self.vocab:
            stem = token.removesuffix(self.end) if self.end and len(token) > len(self.end) else token
            self.endings[len(stem) < len(token)].setdefault(stem[-2:], set()).add(len(stem))
        self.letters = byte_letters()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pairs, self.alone = {}, {}

    def merged(self, symbols):
        """Plain byte-pair encoding: the first of the lowest-ranked pairs is merged until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 30:
                break
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def symbols(self, token):
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            stem = token.removesuffix(self.end)
            return [*stem[:-1], stem[-1] + self.end]
        return list(token)

    def encodes_itself(self, token):
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merged(self.symbols(token)) == [token]
        return known

    def adjacent(self, left, right):
        """Whether the two tokens are the encoding of their joint text."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    def last_token(self, text, stop, last, suffix):
        """Start and text of the last token of ``text[:stop]``, given the last tokens of all shorter prefixes.

        Only one token fits, so the order of trials is free: one letter more than the last token of the prefix before
        is the likeliest.
        """
        vocab, lengths = self.vocab, self.endings[suffix != ""]
        likely = stop - last[stop - 1][0] if stop > 1 else 1
        for length in (likely, *lengths.get(text[max(stop - 2, 0):stop], ()), 1):
            start = stop - length
            if start >= 0:
                token = text[start:stop] + suffix
                if token in vocab and (self.adjacent(last[start][1], token) if start else self.encodes_itself(token)):
                    return start, token
        raise ValueError(f"no token ends at {stop} of {text!r}")

    def walk(self, words):
        """{word: ids} of distinct pre-tokens in byte letters, depth first over their trie."""
        out, last, before = {}, [None], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del last[min(shared, len(word) - 1) + 1:]
            while len(last) < len(word):
                last.append(self.last_token(word, len(last), last, ""))
            stop, token = self.last_token(word, len(word), last, self.end)
            ids = [self.vocab[token]]
            while stop:
                stop, token = last[stop]
                ids.append(self.vocab[token])
            out[word] = ids[::-1]
            before = word[:len(last) - 1]
        return out

    def pre_tokens(self, word):
        """Pre-tokens of a word in byte letters, as strings, special tokens as ids."""
        out = []
        for i, part in enumerate(self.cut.split(word)):
            if i % 2:
                out.append(self.special[part])
            elif part and PLAIN.fullmatch(part):
                out += ["".join(self.letters[b] for b in p.encode()) for p in PATTERN.findall(unicodedata.normalize("NFC", part).lower())]
            elif part:  # the library's own tables decide about other scripts
                own = tokenizer(self.path)
                out += [p for p, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(part))]
        return out

    def encode(self, words):
        """Ids of each word."""
        cut = [self.pre_tokens(w) for w in words]
        ids = self.walk({p for ps in cut for p in ps if isinstance(p, str)})
        return [[i for p in ps for i in (ids[p] if isinstance(p, str) else [p])] for ps in cut]

    def digests(self, words):
        """Of each word: number of ids, the ids as text, the decoded text."""
        return [(len(ids), " ".join(map(str, ids)), self.decode(ids)) for ids in self.encode(words)]

    def decode(self, ids):
        """The library's decoding without a decoder: token texts joined by a space."""
        return " ".join(self.tokens[i] for i in ids)


def encoder(path):
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs, path):
    """(doc_id, ids) of each text."""
    def run(batches):
        for batch in slices(batches):
            words = words_of(folded(whole(batch["text"])))
            vocab = looked_up(words.vocab.to_pylist(), encoder(path).encode, (path, "trie"))
            rows = [[i for c in words.codes[a:b].tolist() for i in vocab[c]] for a, b in zip(words.bounds, words.bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids, path):
    """(doc_id, text) of rows (doc_id, ids)."""
    def run(batches):
        for batch in batches:
            texts = [encoder(path).decode(i or []) for i in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])
    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs, path):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encoded`` and ``decoded`` give, without writing it out."""
    def run(batches):
        for batch in slices(batches):
            words = words_of(folded(whole(batch["text"])))
            found = looked_up(words.vocab.to_pylist(), encoder(path).digests, (path, "digests"), CACHED_DIGESTS)
            many = np.array([f[0] for f in found], np.int64)
            # a word of white space that is not ASCII has no tokens and must not leave a separator
            codes, bounds = words.codes, words.bounds
            if len(many) and not many.all():
                kept = many[codes] > 0
                bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
                codes = codes[kept]
            total = np.concatenate([[0], np.cumsum(many[codes])])[bounds]
            out = [[], []]
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                own = codes[a:b].tolist()
                for k in (0, 1):
                    out[k].append(hashlib.sha256(" ".join([found[c][k + 1] for c in own]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(total)), *map(pa.array, out)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
