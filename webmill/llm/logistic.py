"""Logistic regression on a bounded sample of labelled documents."""

import numpy as np
from pyspark.sql import functions as F

from webmill.llm.texts import stored


def held_out(key="doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_of(labels, column, per_class=10_000, key="doc_id"):
    """At most ``per_class`` labelled ids of each class, those of the smallest hashes, and the share of class 1 in all."""
    rows = labels.select(F.col(key).cast("long").alias(key), F.col(column).cast("int").alias("label")).filter(
        F.col(key).isNotNull() & F.col("label").isin(0, 1) & ~held_out(key))
    rows = rows.groupBy(key).agg(F.max("label").alias("label"))
    rate = rows.agg(F.avg("label")).first()[0]
    taken = [rows.filter(F.col("label") == v).orderBy(F.xxhash64(key), key).limit(per_class) for v in (0, 1)]
    return stored(taken[0].union(taken[1]).select(F.col(key).alias("_id"), "label"), "sample"), rate


def labelled(docs, sample, key="doc_id"):
    """Documents of the sample. It has a bounded number of rows of 12 bytes each, so it is broadcast."""
    return docs.join(F.broadcast(sample), F.col(key) == F.col("_id")).drop("_id")


def fit(x, y, rate, ridge=1.0, penalty=None, steps=25):
    """(weights, intercept) by Newton's method; ``rate`` is the share of class 1 that the intercept should reflect.

    The loss is the mean-preserving log loss of the rows plus ``ridge / 2 * |w|^2 + w' penalty w / 2``. Without rows of
    both classes all weights are 0 and the intercept alone tells the class.
    """
    n, d = x.shape
    share = y.mean() if n else 0.0
    if not 0 < share < 1:
        return np.zeros(d), -20.0 if share <= 0.5 else 20.0
    x1 = np.hstack([x, np.ones((n, 1))])
    quad = np.zeros((d + 1, d + 1))
    quad[:d, :d] = ridge * np.eye(d) + (0 if penalty is None else penalty)
    quad[d, d] = 1e-6
    w = np.zeros(d + 1)
    w[d] = np.log(share / (1 - share))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + quad @ w
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + quad, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    shift = np.log(rate / (1 - rate)) - np.log(share / (1 - share)) if 0 < rate < 1 else 0.0
    return w[:d], w[d] + shift


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
