"""Token ids of whole texts for tokenizers that lower-case and whose tokens never cross white space.

A slice of texts is split at ASCII white space; each distinct word, without full stops and commas at its end, is encoded
once by a function given by the caller and kept in a bounded cache of the Python worker.
"""

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from webmill.llm.texts import words_of

CACHED_WORDS = 250_000
#: Texts in which lower case is the same before and after the tokenizer's own normalisation do not match this.
NOT_FOLDABLE = r"[^\x00-\x7fÀ-ÿ]|<\|"
#: Words that are one pre-token each.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_TOKENIZERS, _CACHES = {}, {}


def folded(texts):
    """Lower case for a tokenizer that lower-cases anyway, where that changes no id: fewer distinct words."""
    return pc.if_else(pc.match_substring_regex(texts, NOT_FOLDABLE), texts, pc.utf8_lower(texts))


def tokenizer(path):
    """The tokenizer of a file, loaded once per worker, without truncation or padding."""
    if path not in _TOKENIZERS:
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _TOKENIZERS[path] = found
    return _TOKENIZERS[path]


def word_ends(path):
    """Whether each id ends a word."""
    if (path, "ends") not in _CACHES:
        vocab = tokenizer(path).get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        _CACHES[path, "ends"] = ends
    return _CACHES[path, "ends"]


def library_ids(path):
    """Encodes words with the tokenizers library, as the bytes of their 32-bit ids.

    Words of plain letters end in one token that ends a word, so they are encoded as one text and cut there.
    """
    def encode(words):
        out, plain = [None] * len(words), [i for i, w in enumerate(words) if LETTERS.fullmatch(w)]
        ids = np.array(tokenizer(path).encode(" ".join([words[i] for i in plain]), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(word_ends(path)[ids]) + 1
        if len(cuts) != len(plain):
            raise ValueError("a word of letters is not one run of tokens")
        raw, start = ids.tobytes(), 0
        for i, stop in zip(plain, (4 * cuts).tolist()):
            out[i], start = raw[start:stop], stop
        rest = [i for i, o in enumerate(out) if o is None]
        for i, e in zip(rest, tokenizer(path).encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out
    return encode


def looked_up(words, encode, name, most=CACHED_WORDS):
    """``encode(words)`` through the worker's cache ``name``, which holds at most about ``most`` words.

    The cache has two generations: words in use move to the young one, and when that is half of the bound the old one is
    dropped, so common words survive.
    """
    old, young = _CACHES.setdefault(name, ({}, {}))
    if len(young) > most // 2:
        old, young = _CACHES[name] = (young, {})
    out = [young.get(w) for w in words]
    if None in out:
        missing = []
        for i, found in enumerate(out):
            if found is None:
                found = out[i] = old.get(words[i])
                if found is None:
                    missing.append(i)
                else:
                    young[words[i]] = found
        for i, found in zip(missing, encode([words[i] for i in missing]) if missing else ()):
            out[i] = young[words[i]] = found
    return out


def gathered(pool, starts, lengths, codes):
    """Runs ``codes`` of ``pool`` end to end, and where each ends."""
    size = lengths[codes]
    ends = np.cumsum(size)
    return pool[np.repeat(starts[codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


def flat(values):
    """Ids of several words end to end, with the start and length of each."""
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
    return np.frombuffer(b"".join(values), np.uint32), np.cumsum(lengths) - lengths, lengths


def stems(vocab):
    """Words without the full stops and commas after their last letter or digit, and those; a token always starts there."""
    stem = pc.utf8_rtrim(vocab, ".,")
    stem = pc.if_else(pc.match_substring_regex(stem, r"[a-z0-9ß-öø-ÿ]$"), stem, vocab)
    size, left = (pc.binary_length(a).to_numpy(zero_copy_only=False) for a in (vocab, stem))
    starts = np.cumsum(size) - size
    data, ends = gathered(np.frombuffer(vocab.buffers()[2] or b"", np.uint8)[np.frombuffer(vocab.buffers()[1], np.int64)[vocab.offset] if len(vocab) else 0:], starts + left, size - left, np.arange(len(vocab)))
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    tails = pa.LargeStringArray.from_buffers(len(vocab), pa.py_buffer(offsets), pa.py_buffer(data))
    return stem.dictionary_encode(), tails.dictionary_encode()


def ids_of(texts, encode, name, end=()):
    """Ids of each text followed by ``end``: all ids in a row, and the bounds of the texts."""
    words = words_of(folded(texts))
    parts = stems(words.vocab)
    both = [p.dictionary.to_pylist() for p in parts]
    pool, starts, lengths = flat(looked_up(both[0] + both[1], encode, name))
    codes = np.stack([parts[0].indices.to_numpy(), parts[1].indices.to_numpy() + len(both[0])], axis=1).ravel()
    vocab, ends = gathered(pool, starts, lengths, codes)
    ends = np.append(ends[1::2], len(vocab) + len(end))
    starts = np.concatenate([[0], ends[:-1]])
    codes = np.insert(words.codes, words.bounds[1:], len(ends) - 1)
    ids, stops = gathered(np.append(vocab, np.array(end, np.uint32)), starts, ends - starts, codes)
    return ids, np.concatenate([[0], stops[words.bounds[1:] + np.arange(len(words.bounds) - 1)]])
