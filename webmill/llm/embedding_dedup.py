"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors are one class with a multiplicity. Each class goes into one bucket of every table; a bucket is compared
as a block of double-precision cosines, and buckets above ``block`` members are cut into pairs of blocks that run as
tasks of their own, so no task holds more than two blocks. A pair counts in the first table that brings it together.
Blocks give per-vector counts and a spanning forest, never pairs.

With n classes a table has log2(n) - 8 sign bits, about 256 classes a bucket by chance, and there are as many tables as
keep the chance of missing a pair at the threshold below ``miss``; closer pairs are missed less often still.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths are never compared; rows with equal ids are separate rows whose links all
count, and a component is named by the smallest id; a null id takes part, but names a component only where there is
no other id; extra columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webmill.llm.components import components, forest
from webmill.llm.texts import row_id, stored


def plan(n, threshold=0.9, miss=1e-4):
    """(bits, tables) for n classes."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(1, round(math.log2(max(n, 2))) - 8)
    return bits, math.ceil(math.log(miss) / math.log(1 - agree ** bits))


def signatures(unit, bits, tables):
    """Sign bits of unit vectors against fixed random hyperplanes, one number per table."""
    planes = np.random.default_rng(1_000_003 * unit.shape[1] + 1).standard_normal((unit.shape[1], tables * bits))
    signs = (unit @ planes > 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def units(lists):
    """Vectors of one length as rows of unit length; dividing by the largest part first keeps squares finite."""
    x = np.stack(lists.to_numpy(zero_copy_only=False)).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors, key="vec_id", column="embedding"):
    """Rows with their class, and classes (cls, size, vec); rows whose vector cannot link have a null class."""
    vec = F.col(column).cast("array<double>")
    good = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    # minus zero equals zero; the sum also turns one into the other
    rows = stored(vectors.select(
        row_id().alias("_row"), F.col(key).cast("long").alias("id"),
        F.when(F.coalesce(good, F.lit(False)), F.transform(vec, lambda x: x + F.lit(0.0))).alias("vec")), "vectors")
    groups = stored(rows.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("_row").alias("cls"), F.count("*").alias("size")), "classes")
    many = groups.filter("size > 1").withColumnsRenamed({"vec": "_vec", "cls": "_cls"}).select("_vec", "_cls")
    member = rows.join(many, F.col("vec") == F.col("_vec"), "left").select(
        "_row", "id", F.when(F.col("vec").isNotNull(), F.coalesce("_cls", "_row")).alias("cls"))
    return stored(member, "members"), groups


def compared(threshold, bits, tables):
    """Links of one pair of blocks: (cls, links, root)."""
    def run(group):
        table, i, j = (group[c][0].as_py() for c in ("tab", "i", "j"))
        cls, size = group["cls"].to_numpy(), group["size"].to_numpy()
        unit, own = units(group["vec"]), group["own"].to_numpy()
        codes = signatures(unit, bits, tables)[:, :table]
        left, right = (np.arange(len(cls)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        links, found = np.zeros(len(cls), np.int64), []
        for start in range(0, len(left), 512):
            rows = left[start:start + 512]
            near = unit[rows] @ unit[right].T >= threshold
            if i == j:
                near &= rows[:, None] < right[None, :]
            a, b = np.nonzero(near)
            a, b = rows[a], right[b]
            root = forest(len(cls), a, b)
            at = np.flatnonzero(root != np.arange(len(cls)))
            found.append((at, root[at]))
            new = ~(codes[a] == codes[b]).any(axis=1) if table else np.ones(len(a), bool)
            links += np.bincount(a[new], size[b[new]], len(cls)).astype(np.int64) + np.bincount(b[new], size[a[new]], len(cls)).astype(np.int64)
        pairs = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
        root = forest(len(cls), *pairs)
        keep = (links > 0) | (root != np.arange(len(cls)))
        return pa.table({"cls": cls[keep], "links": links[keep], "root": cls[root[keep]]})
    return run


def near_duplicates(vectors, key="vec_id", column="embedding", threshold=0.9, block=4096, miss=1e-4):
    """(id, n_links, component) of every row."""
    members, groups = classes(vectors, key, column)
    bits, tables = plan(groups.count(), threshold, miss)

    def hashed(batches):
        for batch in batches:
            lengths = np.array([len(v) for v in batch["vec"].to_numpy(zero_copy_only=False)], np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                some = batch.take(pa.array(at))
                codes = signatures(units(some["vec"]), bits, tables)
                for t in range(tables):
                    yield some.append_column("tab", pa.array(np.full(len(at), t, np.int32))).append_column("code", pa.array(codes[:, t])).append_column(
                        "dim", pa.array(np.full(len(at), length, np.int32)))

    dealt = groups.mapInArrow(hashed, "vec array<double>, cls long, size long, tab int, code long, dim int")
    bucket = ["dim", "tab", "code"]
    large = stored(dealt.groupBy(*bucket).count().filter(F.col("count") > block).select(
        *(F.col(c).alias(f"_{c}") for c in bucket), F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-buckets")
    dealt = dealt.join(large, [F.col(c) == F.col(f"_{c}") for c in bucket], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    found = stored(
        dealt.groupBy(*bucket, "i", "j").applyInArrow(compared(threshold, bits, tables), "cls long, links long, root long"), "vector-links")
    links = found.groupBy(F.col("cls").alias("_cls")).agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    sizes = groups.filter("size > 1").select(F.col("cls").alias("_cls"), "size")
    out = (
        members.join(sizes, F.col("cls") == F.col("_cls"), "left").drop("_cls")
        .join(links, F.col("cls") == F.col("_cls"), "left").drop("_cls")
        .join(roots.withColumnRenamed("id", "_id"), F.col("cls") == F.col("_id"), "left"))
    out = out.withColumn("root", F.coalesce("root", "cls", "_row"))
    names = out.groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("component"))
    return out.join(names, F.col("root") == F.col("_root")).select(
        "id", (F.coalesce("links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("n_links"), "component")
