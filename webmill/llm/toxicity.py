"""Counterfactual-regularised toxicity classifier.

A document's score is a logistic function of the words and word beginnings it holds. These are chosen by the
log-likelihood ratio of their document counts in both classes. Identity terms are always features: every labelled
sentence that names a group is read again with the term swapped for each other term of its set, and the squared change of
its score (in log-odds, the mean over the other terms) is penalised. So the terms of a set end up with nearly equal
weights, and a group that toxic sentences mention often does not make neutral sentences about it toxic. A sentence that
names both terms loses one feature and gains none. Weights common to a whole set are kept down by the ridge; so are the
terms of a set that no labelled sentence names.

The fit uses at most ``per_class`` labelled documents of each class, distinct texts only, and at most ``features``
words; scoring covers whole texts of all documents.

Cases: a null or empty text gets the score of a document without known words; without labels of both classes every
score is near 0 or near 1 as the one class says, near 0 without labels; repeated rows each get a row; other columns
are ignored by ``score`` and kept by ``without_toxic``.
"""

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from webmill.llm.logistic import fit as fit_weights
from webmill.llm.logistic import labelled, logistic, sample_of
from webmill.llm.texts import parts, per_row, slices, stored, whole

#: Sets of identity terms that may stand for each other.
IDENTITY_SETS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"), ("african", "european", "american", "arab", "mexican", "chinese"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind", "autistic"),
    ("old", "young"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
SENTENCE_END = r"[.!?\n]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
STEMS = (4, 5)
STAR, EMPTY = (pa.scalar(t, pa.large_string()) for t in ("*", ""))


class Model(NamedTuple):
    words: list
    weights: np.ndarray
    intercept: float


def words_in(texts):
    """Lower-case runs of letters and digits."""
    return parts(pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), NOT_WORD, " ")))


def features_of(words):
    """Features of each distinct word: itself, and its first four and five letters marked with a star."""
    stems = [pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), STAR, EMPTY) for n in STEMS]
    longer = [pc.greater(pc.utf8_length(words), n) for n in STEMS]
    return [words, *(pc.if_else(more, stem, pa.scalar(None, pa.large_string())) for more, stem in zip(longer, stems))]


def numbers(vocab, known):
    """Number in ``known`` of each feature of each distinct word, -1 for none."""
    known = pa.array(known, pa.large_string())
    return [pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False) for names in features_of(vocab)]


def features_held(rows, codes, number, size):
    """Sorted keys ``row * size + feature`` of the known features, each once, of words ``codes`` in ``rows``."""
    size = max(size, 1)
    keys = [np.zeros(0, np.int64)]
    for own in number:
        found = own[codes]
        keys.append(rows[found >= 0] * size + found[found >= 0])
    return np.unique(np.concatenate(keys))


def held(words, known):
    """Row and number in ``known`` of the known features of each text, each once."""
    keys = features_held(words.rows, words.codes, numbers(words.vocab, known), len(known))
    return np.divmod(keys, max(len(known), 1))


def terms_of(sets):
    return sorted({t for s in sets for t in s})


def chosen_words(docs, features=256, least=4, ratio=16.0):
    """Words and stems whose document counts differ between the classes, most telling first."""
    def holders(batches):
        for batch in slices(batches):
            words = words_in(whole(batch["text"]))
            for names in features_of(words.vocab):
                coded = names.dictionary_encode()
                codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)[words.codes]
                size = max(len(coded.dictionary), 1)
                keys = np.unique(words.rows[codes >= 0] * size + codes[codes >= 0])
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(keys % size)).cast(pa.string()), batch["label"].take(pa.array(keys // size))], names=["word", "label"])
    n1, n0 = (docs.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first())
    if not n1 or not n0:
        return []
    counts = docs.select("text", "label").mapInArrow(holders, "word string, label int").groupBy("word").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).filter(F.col("a") + F.col("b") >= least)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    seen, n = F.col("a") + F.col("b"), n0 + n1
    table = ((F.col("a"), n1), (F.col("b"), n0), (n1 - F.col("a"), n1), (n0 - F.col("b"), n0))
    gain = 2 * sum((part(x, (seen if i < 2 else n - seen) * m / n) for i, (x, m) in enumerate(table)), F.lit(0.0))
    best = counts.withColumn("gain", gain).filter(F.col("gain") >= ratio).orderBy(F.desc("gain"), "word").limit(features)
    return [r["word"] for r in best.collect()]


def swapped(sentences, known, sets):
    """Counter of (features lost, features gained, number of other terms) over all swaps of a term in these sentences."""
    words = words_in(sentences)
    terms = terms_of(sets)
    place = dict(zip(words.vocab.to_pylist(), range(len(words.vocab))))
    missing = [t for t in terms if t not in place]
    place.update(zip(missing, range(len(words.vocab), len(words.vocab) + len(missing))))
    number = numbers(pa.concat_arrays([words.vocab, pa.array(missing, words.vocab.type)]), known)
    rows, size, out = words.rows, max(len(known), 1), Counter()
    naming = np.isin(words.codes, [place[t] for t in terms])
    kept = np.isin(rows, rows[naming])
    rows, codes = rows[kept], words.codes[kept]
    for group in sets:
        for term in group:
            own = np.isin(rows, rows[codes == place[term]])
            at, before = rows[own], codes[own]
            if not len(at):
                continue
            plain = features_held(at, before, number, size)
            for other in group:
                if other == term:
                    continue
                again = features_held(at, np.where(before == place[term], place[other], before), number, size)
                sides = [{}, {}]
                for side, keys in zip(sides, (np.setdiff1d(plain, again), np.setdiff1d(again, plain))):
                    for row, feature in zip(*(k.tolist() for k in np.divmod(keys, size))):
                        side[row] = (*side.get(row, ()), feature)
                out.update((sides[0].get(r, ()), sides[1].get(r, ()), len(group) - 1) for r in sides[0].keys() | sides[1].keys())
    return out


def swaps(docs, known, sets):
    """What swapping a term changes in the features of labelled sentences: (lost, gained, others, n).

    Each sentence that names a term is read again with all its mentions of the term replaced by each other term of the
    set. Only terms change, so there are at most two rows for each ordered pair of terms.
    """
    def changes(batches):
        total = Counter()
        for batch in slices(batches):
            total += swapped(pc.split_pattern_regex(whole(batch["text"]), SENTENCE_END).flatten(), known, sets)
        lost, gained, others = zip(*total) if total else ((), (), ())
        kinds = pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((lost, gained, others, list(total.values())), kinds)], names=["lost", "gained", "others", "n"])
    found = docs.select("text").mapInArrow(changes, "lost array<int>, gained array<int>, others int, n long")
    return [tuple(r) for r in found.groupBy("lost", "gained", "others").agg(F.sum("n")).collect()]


def penalty(size, changes, strength):
    """Quadratic form of the squared score changes of swapped sentences, the mean over the other terms of the set."""
    out = np.zeros((size, size))
    for lost, gained, others, n in sorted(changes):
        places = np.array([*lost, *gained])
        signs = np.array([-1.0] * len(lost) + [1.0] * len(gained))
        out[np.ix_(places, places)] += strength * n / others * np.outer(signs, signs)
    return out


def train(docs, labels, column="toxic", sets=IDENTITY_SETS, strength=1.0, per_class=10_000, features=256, ridge=0.06):
    """Fit on documents (doc_id, text) and labels (doc_id, ``column``), never on held-out rows."""
    sample, rate = sample_of(labels, column, per_class)
    docs = labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sample)
    docs = stored(docs.groupBy(F.xxhash64("text").alias("_h")).agg(F.max_by("text", "label").alias("text"), F.max("label").alias("label")).select("text", "label"), "labelled")
    # a beginning that terms share with other words would change with each swap and be tied to them
    starts = {f"{t[:n]}*" for t in terms_of(sets) for n in STEMS}
    words = list(dict.fromkeys([*(w for w in chosen_words(docs, features) if w not in starts), *terms_of(sets)]))

    def rows(batches):
        for batch in slices(batches):
            at, number = held(words_in(whole(batch["text"])), words)
            cuts = np.concatenate([[0], np.cumsum(per_row(at, batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["label"], pa.ListArray.from_arrays(pa.array(cuts), pa.array(number, pa.int32()))], names=["label", "held"])
    data = sorted(tuple(r) for r in docs.mapInArrow(rows, "label int, held array<int>").collect())
    x = np.zeros((len(data), len(words)), np.float32)
    for i, (_, own) in enumerate(data):
        x[i, own] = 1
    y = np.array([label for label, _ in data], np.float64)
    weights, intercept = fit_weights(x, y, rate or 0.0, ridge, penalty(len(words), swaps(docs, words, sets), strength))
    used = np.flatnonzero(np.abs(weights) > 1e-9)
    return Model([words[i] for i in used], weights[used], float(intercept))


def scores(texts, model):
    rows, number = held(words_in(texts), model.words)
    return logistic(model.intercept + np.bincount(rows, model.weights[number] if len(number) else None, len(texts)))


def score(docs, model):
    """(doc_id, score) of each document."""
    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores(whole(batch["text"]), model))], names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs, model, threshold=0.5):
    """The documents that score below the threshold, with all their columns; nothing is shuffled."""
    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(scores(whole(batch["text"]), model) < threshold))
    return docs.mapInArrow(run, docs.schema)
