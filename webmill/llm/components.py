"""Distributed connected components by alternating stars."""

from pyspark.sql import functions as F

from webmill.llm.texts import stored


def fingerprint(links):
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()


def components(edges):
    """(id, root) of every id in ``edges(a, b)`` that is not itself the smallest id reachable from it.

    Each round links the larger neighbours of a node to its smallest one, then the smaller ones; the number of rounds
    grows with the logarithm of the longest chain. Every round is stored, edges are never gathered, and a node with
    very many neighbours is only ever aggregated (combined before the shuffle) or joined (split if skewed).
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = stored(links, "links")
    before = fingerprint(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n")).select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        links = stored(small, "links")
        after = fingerprint(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("id"), F.col("b").alias("root"))


def forest(n, left, right):
    """Smallest member of each of ``n`` local nodes' component, from parallel arrays of linked nodes."""
    import numpy as np

    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root
