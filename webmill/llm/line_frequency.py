"""Cross-document line frequency: drop lines that too many documents of a host share, reject depleted documents.

Lines are normalised (lower case, digit runs as 0, single spaces) and hashed to 64 bits. A line is common if more than
``max(min_docs, min(share * documents of the host, most))`` distinct documents of a host hold it, so the limit lies
between two counts whatever the size of the host; equal texts are one document, so exact copies do not condemn each other
(removing copies is not this operator's work). A document is depleted if more than ``depleted`` of its words stand in
common lines.

First a count of holders that includes copies, combined before its only shuffle, leaves the few lines that may be
common; only for those are distinct texts counted.

Cases: a null text is an empty one; a null host is a host of its own; texts without words have no lines and are not
depleted; repeated rows each get their row; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from webmill.llm.texts import numbered, parts, per_row, repeated, row_id, slices, stored, whole, words_of

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "text_hash long, hashes array<long>, weights array<long>"
HAS_WORD = r"[^\x20\x09-\x0D]"


def signed(values):
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values)).view(np.int64)


def normalised(lines):
    lines = pc.utf8_lower(lines)
    lines = pc.replace_substring_regex(lines, "[0-9]+", "0")
    return pc.ascii_trim_whitespace(pc.replace_substring_regex(lines, r"[\x20\x09-\x0D]+", " "))


def repeat_words(words):
    """Words inside 3-word windows that are found twice or more in the text."""
    n, rows = len(words.bounds) - 1, words.rows
    start = np.flatnonzero(rows[:-2] == rows[2:]) if len(rows) > 2 else np.zeros(0, np.int64)
    size = max(len(words.vocab), 1)
    pair = words.codes[start] * size + words.codes[start + 1]
    if size >= 1 << 20:  # three codes do not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    again, _ = repeated(rows[start], pair * size + words.codes[start + 2])
    inside = np.zeros(len(rows), bool)
    for shift in range(3):
        inside[start[again] + shift] = True
    return per_row(rows[inside], n)


def measured(batches):
    for batch in slices(batches):
        texts = whole(batch["text"])
        n, words = len(texts), words_of(texts)
        chars = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False)
        lines = parts(pc.split_pattern(texts, "\n"), keep_empty=True)
        held = pc.match_substring_regex(lines.vocab, HAS_WORD).to_numpy(zero_copy_only=False)[lines.codes]
        rows, codes = lines.rows[held], lines.codes[held]
        _, later = repeated(rows, codes)
        form = normalised(lines.vocab)
        counts = np.diff(words_of(form).bounds)
        form = form.dictionary_encode()
        codes = form.indices.to_numpy()[codes]
        size = max(len(form.dictionary), 1)
        keys, first, many = np.unique(rows * size + codes, return_index=True, return_counts=True)
        weight = counts[lines.codes[held]][first] * many
        hashes = signed(form.dictionary.to_pylist())[keys % size]
        cuts = np.concatenate([[0], np.cumsum(per_row(keys // size, n))]).astype(np.int32)
        base = {
            "n_words": np.diff(words.bounds), "word_chars": per_row(words.rows, n, chars[words.codes]),
            "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]"),
            "n_dup_lines": per_row(rows[later], n), "n_repeat_words": repeat_words(words),
            "text_hash": signed(texts.to_pylist())}
        columns = [batch["_row"], batch["doc_id"], batch["host"], *(pa.array(v).cast(pa.int64()) for v in base.values())]
        columns += [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v, pa.int64())) for v in (hashes, weight)]
        yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "host", *base, "hashes", "weights"])


def measures(docs, host="source", row=None):
    """Base counts of each document with the hashes of its distinct lines; stored, for the texts are read once.

    ``row`` names a column of row numbers; without one, rows are numbered here.
    """
    rows = docs.select((F.col(row) if row else row_id()).alias("_row"), F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), "text")
    return stored(rows.mapInArrow(measured, f"_row long, doc_id long, host string, {BASE}, {LINES}"), "lines")


def common_lines(lines, min_docs=20, share=0.05, most=25):
    """(host, hash, n_docs) of common lines, and the lines (row, host, hash, words) of documents that hold them."""
    limits = (
        lines.groupBy("host", "text_hash").agg(F.lit(1).alias("one"))
        .groupBy("host").agg(F.greatest(F.lit(min_docs), F.least(F.count("one") * share, F.lit(most))).alias("most")))
    each = lines.select("_row", "host", "text_hash", F.explode(F.arrays_zip("hashes", "weights")).alias("l"))
    each = each.select("_row", "host", "text_hash", F.col("l.hashes").alias("hash"), F.col("l.weights").alias("words"))
    maybe = each.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    limits = limits.withColumnRenamed("host", "_host")
    maybe = stored(maybe.join(limits, F.col("host").eqNullSafe(F.col("_host"))).filter("n > most")
                   .select(F.col("host").alias("_host"), F.col("hash").alias("_hash"), "most"), "maybe-common")
    same = F.col("host").eqNullSafe(F.col("_host")) & (F.col("hash") == F.col("_hash"))
    found = stored(each.join(maybe, same).drop("_host", "_hash"), "held-lines")
    common = (
        found.groupBy("host", "hash", "text_hash").agg(F.max("most").alias("most"))
        .groupBy("host", "hash").agg(F.count("*").alias("n_docs"), F.max("most").alias("most"))
        .filter("n_docs > most").select("host", "hash", "n_docs"))
    other = common.select(F.col("host").alias("_host"), F.col("hash").alias("_hash"))
    return common, found.join(other, same, "left_semi").select("_row", "host", "hash", "words")


def judge(docs, host="source", min_docs=20, share=0.05, depleted=0.5, most=25, row=None):
    """One row per document: base counts, words and lines in common lines, the hashes of those lines, verdict."""
    lines = measures(docs, host, row)
    _, held = common_lines(lines, min_docs, share, most)
    removed = held.groupBy("_row").agg(
        F.sum("words").alias("removed_words"), F.collect_list("hash").alias("removed"))
    out = lines.drop("hashes", "weights", "text_hash").join(removed, "_row", "left")
    words = F.coalesce("removed_words", F.lit(0))
    return out.withColumns({"removed_words": words, "depleted": words > F.col("n_words") * depleted})


def stripped(batches):
    for batch in slices(batches):
        out = []
        for text, gone in zip(batch["text"].to_pylist(), batch["removed"].to_pylist()):
            if text and gone:
                lines = text.split("\n")
                hashes = signed(normalised(pa.array(lines, pa.large_string())).to_pylist())
                gone = set(gone)
                text = "\n".join(l for l, h in zip(lines, hashes.tolist()) if h not in gone)
            out.append(text)
        yield batch.drop_columns(["text", "removed"]).append_column("text", pa.array(out, pa.string()))


def clean(docs, host="source", **limits):
    """(doc_id, text) of the documents that are not depleted, without their common lines; one row for each row of ``docs``."""
    rows = numbered(docs).select("_row", "_doc.doc_id", F.col(f"_doc.{host}").alias("_host"), "_doc.text")
    verdicts = judge(rows, "_host", row="_row", **limits).filter(~F.col("depleted"))
    kept = verdicts.select(F.col("_row").alias("_kept"), F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))
    found = rows.join(kept, F.col("_row") == F.col("_kept")).select(F.col("doc_id").cast("long"), "text", "removed")
    return found.mapInArrow(stripped, "doc_id long, text string")
