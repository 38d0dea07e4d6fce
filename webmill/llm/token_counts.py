"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

Tier one is a broadcast hash table of the lengths (in tokens) of the ``table_size`` most frequent pre-tokens, learned
from at most ``sample_words`` words of the first partitions, each of at most ``LONGEST`` characters, so the sample and the
table have a bound in bytes; they only save time, so the sample does not touch the counts. Tier two encodes what the table
lacks, once per worker cache. Counts are exact for every text.

This tokenizer's pattern always starts a new pre-token before a run of white space, and before the last character of a
run that something follows. Texts are cut there: at single spaces and line ends, and at any run in texts that hold one.
Only a run right before a special string ends differently, since the string cuts the text first; such texts are encoded
whole.

Cases: a null text is empty and has no tokens; repeated rows each get a row; extra columns are ignored.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from webmill.llm.texts import Parts, parts, per_row, slices, whole
from webmill.llm.word_ids import looked_up, tokenizer

TWO_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]{2}"
#: The characters that the tokenizer's pattern takes as white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run without its last character, a word with the one before it, or a run that ends the text.
PIECE = re.compile(f"[{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]?[^{SPACE}]+|[{SPACE}]+")
#: Characters of the longest words that the broadcast table may hold.
LONGEST = 64


def lengths(path):
    def encode(words):
        return [len(e) for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]
    return encode


def pre_tokens(texts):
    """Pre-tokens of texts without runs of white space, line ends apart; their number of line ends."""
    lines = parts(pc.split_pattern(texts, "\n"), keep_empty=True)
    flat = lines.vocab.take(pa.array(lines.codes))
    found = parts(pc.split_pattern(flat, " "), keep_empty=True)
    spaced = np.ones(len(found.codes), np.int64)
    spaced[found.bounds[:-1]] = 0  # the first of a line has no space before it
    keys, codes = np.unique(found.codes * 2 + spaced, return_inverse=True)
    words = pc.binary_join_element_wise(pa.array(np.where(keys % 2, " ", "").tolist(), pa.large_string()), found.vocab.take(pa.array(keys // 2)), pa.scalar("", pa.large_string()))
    return Parts(codes, found.bounds[lines.bounds], words), np.diff(lines.bounds) - 1


def spaced_pieces(texts):
    """Pieces of texts with runs of white space, cut where a pre-token always starts."""
    found = [PIECE.findall(t) for t in texts.to_pylist()]
    return parts(pa.array(found, pa.list_(pa.large_string())), keep_empty=True)


def before_special(path):
    """Pattern of a run of white space right before an added token of the tokenizer."""
    names = sorted(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
    return re.compile(f"[{SPACE}]{{2}}(?:{'|'.join(map(re.escape, names))})") if names else None


def frequent(docs, path, table_size=32_768, sample_words=500_000):
    """{pre-token: tokens}, at most ``table_size`` entries, from at most ``sample_words`` words of the first partitions."""
    words = docs.select(F.explode(F.split("text", "[ \\n]")).alias("word")).filter(F.length("word") <= LONGEST)
    words = words.limit(sample_words).toPandas()["word"]
    best = (" " + words).value_counts().index[:table_size].to_list()
    return dict(zip(best, lengths(path)(best)))


def count(docs, path, table_size=32_768, sample_words=500_000):
    """(doc_id, n_bytes, n_tokens) of each document."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, table_size, sample_words))

    def counted(batches):
        known = table.value
        encode, special = lengths(path), before_special(path)

        def measure(words):
            found = [known.get(w) for w in words]
            missing = [w for w, n in zip(words, found) if n is None]
            rest = iter(looked_up(missing, encode, (path, "lengths")))
            return np.array([next(rest) if n is None else n for n in found], np.int64)

        for batch in slices(batches):
            texts = whole(batch["text"])
            tokens = np.zeros(len(texts), np.int64)
            odd = pc.match_substring_regex(texts, TWO_SPACES).to_numpy(zero_copy_only=False)
            if odd.any() and special:
                cut = np.array([bool(o and special.search(t)) for o, t in zip(odd.tolist(), texts.to_pylist())])
                if cut.any():
                    tokens[cut] = encode(texts.filter(pa.array(cut)).to_pylist())
            else:
                cut = np.zeros(len(texts), bool)
            runs = odd & ~cut
            if runs.any():
                found = spaced_pieces(texts.filter(pa.array(runs)))
                tokens[runs] = per_row(found.rows, len(found.bounds) - 1, measure(found.vocab.to_pylist())[found.codes])
            if not odd.all():
                found, ends = pre_tokens(texts.filter(pa.array(~odd)))
                tokens[~odd] = per_row(found.rows, len(ends), measure(found.vocab.to_pylist())[found.codes]) + ends * measure(["\n"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pc.binary_length(texts).cast(pa.int64()), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
