"""Quality by hierarchical empirical Bayes: a document classifier's evidence combined with host and path posteriors.

The classifier sees the make-up of a text only (shares of capitals, digits, symbols, repeated words and so on). Its probabilities are
summed per host and per path of a host in one grouped aggregation. A host's rate of good documents is shrunk towards
the global rate, a path's rate towards its host's, each by a concentration that the method of moments takes from the
spread between hosts and between paths. A document's posterior odds are its evidence times the odds of its path, from
which its own contribution is taken out, so that a site with one document says nothing about it.

The fit uses at most ``per_class`` labelled documents of each class; sites and scores cover all documents.

Cases: a null text is empty and leaves the decision to its site; null hosts and paths are those named by the empty
string; without labels of both classes the evidence is that one class (good without labels); repeated rows each count
and get a row; no rows give none; other columns are kept by ``accepted`` whatever their names.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webmill.llm.line_frequency import repeat_words
from webmill.llm.logistic import fit as fit_weights
from webmill.llm.logistic import labelled, logistic, sample_of
from webmill.llm.texts import per_row, slices, stored, whole, words_of

#: Classes of bytes; the rest (UTF-8 continuation and lead bytes) is the last class.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "\n", "#*$%&", "|", "<>{}[]=\\/_~^`@+", "!?", ".,;:", "\"'()-")
FEATURES = len(CLASSES) + 6


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float
    center: np.ndarray
    scale: np.ndarray


def byte_classes():
    table = np.full(256, len(CLASSES), np.uint8)
    for i, letters in enumerate(CLASSES):
        table[[ord(c) for c in letters]] = i
    return table


def make_up(texts):
    """Features of each text: byte class shares, repetition, word and line lengths, size."""
    n = len(texts)
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]) if n else np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if n else 0
    kind = byte_classes()[data[first:first + size.sum()]]
    starts, full = np.cumsum(size) - size, size > 0
    out = np.zeros((n, FEATURES))

    def summed(mask):
        total = np.zeros(n)
        if full.any():
            total[full] = np.add.reduceat(mask, starts[full], dtype=np.int64)
        return total

    for i in range(len(CLASSES) + 1):
        out[:, i] = summed(kind == i)
    space = (kind == 3) | (kind == 4)
    words = summed(np.concatenate([space[1:] < space[:-1], [False]]) if len(space) else space) + 1
    lines, most = out[:, 4] + 1, np.maximum(size, 1)
    own = words_of(texts)
    again = (own.codes[1:] == own.codes[:-1]) & (own.rows[1:] == own.rows[:-1])
    number = np.maximum(np.diff(own.bounds), 1)
    out[:, -5] = per_row(own.rows[1:][again], n) / number
    out[:, -4] = repeat_words(own) / number
    out[:, :len(CLASSES) + 1] /= most[:, None]
    out[:, -3] = np.log1p(size / words)
    out[:, -2] = np.log1p(size / lines)
    out[:, -1] = np.log1p(size)
    return out


def train(docs, labels, column="quality", per_class=10_000, ridge=0.1):
    """Fit the document classifier on documents (doc_id, text) and labels, never on held-out rows."""
    sample, rate = sample_of(labels, column, per_class)

    def rows(batches):
        for batch in slices(batches):
            values = make_up(whole(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [batch["label"], pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["label", "x"])
    docs = labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sample)
    data = docs.select("text", "label").mapInArrow(rows, "label int, x array<double>").distinct().orderBy("label", "x").toPandas()
    if data["label"].nunique() < 2:
        only_bad = len(data) and not data["label"].iloc[0]
        return Model(np.zeros(FEATURES), -20.0 if only_bad else 20.0, np.zeros(FEATURES), np.ones(FEATURES))
    x = np.stack(data["x"].to_numpy())
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    weights, intercept = fit_weights((x - center) / scale, data["label"].to_numpy(np.float64), rate, ridge)
    return Model(weights, float(intercept), center, scale)


def evidence(texts, model):
    """Probability that each text is good, by its own make-up."""
    return logistic(np.clip(model.intercept + (make_up(texts) - model.center) / model.scale @ model.weights, -20, 20))


def with_evidence(docs, model, host, path, keep=()):
    """The columns ``keep`` as c0, c1, .. with ``_host``, ``_path`` and the evidence ``_p``; no name of docs can clash."""
    keep = list(keep)
    text = f"c{keep.index('text')}" if "text" in keep else "_text"
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((host, "_host"), (path, "_path"))]
    rows = docs.select(*carried, *site, *([] if "text" in keep else [F.col("text").alias("_text")]))
    out = [f"c{i}" for i in range(len(keep))] + ["_host", "_path"]

    def run(batches):
        for batch in slices(batches, text):
            yield batch.select(out).append_column("_p", pa.array(evidence(whole(batch[text]), model)))
    return rows.mapInArrow(run, rows.select(*out).withColumn("_p", F.lit(0.0)).schema)


def concentration(cells, rate, parent):
    """How many documents' worth a parent's rate weighs, by the method of moments over cells (n, s)."""
    spread = cells.select(F.col("n").cast("double"), (F.col("s") / F.col("n")).alias("r"), parent.alias("m"))
    total, squares, gap, noise, many = spread.agg(
        F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * (F.col("r") - F.col("m")) ** 2),
        F.sum(F.col("m") * (1 - F.col("m"))), F.count("*")).first()
    if not total or total * total <= squares:
        return 10.0
    between = (gap - noise * (many - 1) / many) / (total - squares / total)
    return float(np.clip(rate * (1 - rate) / between - 1, 1.0, 1e6)) if between > 0 else 1e6


def sites(scored):
    """(_h, _q, n, s, host_rate, k): sums of each path, the rate of its host, the weight of that rate; and the global rate."""
    paths = stored(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_p").alias("s")), "paths")
    hosts = stored(paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = float(np.clip(s / n, 1e-6, 1 - 1e-6)) if n else 0.5
    k = concentration(hosts, rate, F.lit(rate))
    hosts = hosts.select(F.col("_host").alias("_h"), ((F.lit(k * rate) + F.col("s")) / (F.lit(k) + F.col("n"))).alias("host_rate"))
    paths = paths.join(hosts, F.col("_host") == F.col("_h"))
    k = concentration(paths, rate, F.col("host_rate"))
    return stored(paths.select("_h", F.col("_path").alias("_q"), "n", "s", "host_rate", F.lit(k).alias("k")), "sites"), rate


def odds(p):
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def scored(docs, model, host, path, keep):
    """``with_evidence`` with ``host_rate``, ``path_rate``, ``score`` and ``kept``.

    The site table is stored first, so its size is known: a small one is broadcast, a large one joined by shuffle with
    skewed hosts split. Rows without the text are stored with their evidence, so every text is read once; with the text
    they are not written, and the texts are read a second time.
    """
    rows = with_evidence(docs, model, host, path, keep)
    rows = rows if "text" in keep else stored(rows, "evidence")
    table, rate = sites(with_evidence(docs, model, host, path) if "text" in keep else rows)
    joined = rows.join(table, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_q")))
    own = (F.col("k") * F.col("host_rate") + F.col("s") - F.col("_p")) / (F.col("k") + F.col("n") - 1)
    joined = joined.withColumn("path_rate", F.least(F.greatest(own, F.lit(0.0)), F.lit(1.0)))
    posterior = odds(F.col("_p")) - F.lit(float(np.log(rate / (1 - rate)))) + odds(F.col("path_rate"))
    return joined.withColumn("score", 1 / (1 + F.exp(-posterior))).withColumn("kept", F.col("score") >= 0.5)


def judge(docs, model, host="source", path="lang", key="doc_id"):
    """(key, evidence, host_rate, path_rate, quality_score, kept) of each document."""
    return scored(docs, model, host, path, [key]).select(
        F.col("c0").alias(key), F.col("_p").alias("evidence"), "host_rate", "path_rate", F.col("score").alias("quality_score"), "kept")


def accepted(docs, model, host="source", path="lang"):
    """The documents that are kept, with all their columns."""
    return scored(docs, model, host, path, docs.columns).filter("kept").select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
