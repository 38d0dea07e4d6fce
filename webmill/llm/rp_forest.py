"""Approximate nearest neighbours: a forest of random-projection trees, one shared priority queue, exact reranking.

Every tree projects on one random direction per level and cuts each node at the median of its projections. Directions
come from a seed; medians are fitted on at most ``sample`` distinct vectors, so the model is bounded however many rows are
indexed. Depth follows the number of vectors: a leaf holds about ``leaf`` of them. Every vector goes into one leaf of every
tree. A query descends all trees through one queue: the branch with the least sum of squared distances to the cuts on its
way comes first, whichever tree it belongs to. The leaves it reaches are probed: leaf and queries meet in one task, in
blocks of at most ``block`` rows a side, where exact cosines rank the candidates; the best of all leaves are merged.

How many leaves a query reaches is measured, not guessed: at most ``fitted`` queries are answered exactly against all
vectors, and the least number that finds ``recall`` of their neighbours is taken. Vectors without structure need
a large share of all leaves, clustered ones very few.

Equal vectors are one class: it is indexed and searched once, and carries its first rows for the answer.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths
are never compared; rows with equal ids are separate rows, only a query's own row is left out; a null id is a candidate,
last among ties; fewer than ``k`` candidates are all returned; extra columns are ignored; an empty table gives none.
"""

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from webmill.llm.embedding_dedup import classes
from webmill.llm.texts import stored

SLACK = 1e-12


class Forest(NamedTuple):
    """Trees over vectors of one length."""
    directions: np.ndarray  # tree, level, component
    cuts: list  # per tree and level: cuts of the nodes, or one for all nodes below the sample's resolution

    @property
    def trees(self):
        return self.directions.shape[0]

    @property
    def depth(self):
        return self.directions.shape[1]


def scaled(vectors):
    """Rows times a power of two, which changes no digit, so that squares stay finite."""
    x = np.stack(vectors).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def norms(x):
    return np.sqrt((x * x).sum(axis=1))


def grown(unit, n, trees, leaf):
    """A forest for ``n`` vectors from a sample of unit vectors."""
    dim, depth = unit.shape[1], max(0, round(math.log2(max(n, 1) / leaf)))
    trees = trees if depth else 1  # one leaf needs one tree
    rng = np.random.default_rng(7_000_003 * dim + 1)
    directions, cuts = np.empty((trees, depth, dim)), []
    for t in range(trees):
        for start in range(0, depth, dim):  # orthogonal directions cut independently
            square = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            directions[t, start:start + dim] = square[:depth - start]
        code, levels = np.zeros(len(unit), np.int64), []
        for level in range(depth):
            at = unit @ directions[t, level]
            if 8 << level <= len(unit):
                order = np.lexsort((at, code))
                first = np.searchsorted(code[order], np.arange((1 << level) + 1))
                middle = at[order[np.minimum((first[:-1] + first[1:]) // 2, len(unit) - 1)]]
                levels.append(np.where(first[1:] > first[:-1], middle, np.median(at)))
            else:
                levels.append(np.array([np.median(at)]))
            code = 2 * code + (at > levels[-1][code if len(levels[-1]) > 1 else 0])
        cuts.append(levels)
    return Forest(directions, cuts)


def fit(groups, trees, leaf, sample):
    """{length: forest}; a length without a vector in the sample has one leaf."""
    counts = {r.dim: r["count"] for r in groups.groupBy(F.size("vec").alias("dim")).count().collect()}
    some = groups.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("vec").toArrow()["vec"].to_pylist()
    forests = {}
    for dim, n in counts.items():
        own = [v for v in some if len(v) == dim]
        unit = scaled(own) if own else np.zeros((0, dim))
        unit = unit / norms(unit)[:, None]
        forests[dim] = grown(unit, n if own else 1, trees, leaf)
    return forests


def leaves(unit, forest):
    """The leaf of each vector in every tree."""
    out = np.zeros((len(unit), forest.trees), np.int64)
    for t in range(forest.trees):
        for at, cut in zip((unit @ forest.directions[t].T).T, forest.cuts[t]):
            out[:, t] = 2 * out[:, t] + (at > cut[out[:, t] if len(cut) > 1 else 0])
    return out


def reached(unit, forest):
    """Leaves (tree, leaf) of one query, nearest first, from one queue over all trees."""
    at = forest.directions @ unit
    queue = [(0.0, t, 0, 0) for t in range(forest.trees)]
    while queue:
        far, tree, level, node = heapq.heappop(queue)
        for below in range(level, forest.depth):
            cut = forest.cuts[tree][below]
            side = at[tree, below] - cut[node if len(cut) > 1 else 0]
            node = 2 * node + (side > 0)
            heapq.heappush(queue, (far + side * side, tree, below + 1, int(node ^ 1)))
        yield tree, int(node)


def by_length(column):
    """Rows of each vector length, with their vectors as unit rows."""
    vectors = column.to_numpy(zero_copy_only=False)
    lengths = np.array([len(v) for v in vectors], np.int64)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        x = scaled(vectors[at])
        yield int(dim), at, x / norms(x)[:, None]


def ranked(query, candidates, k):
    """(row of query, row of candidate, cosine) of the best ``k`` candidates of each query, and all that tie with them.

    A matrix product finds them; their cosines are summed anew row by row, so a pair scores the same in every task.
    """
    out, size, own = [np.zeros((0, 3))], norms(candidates), norms(query)
    for start in range(0, len(query), 512):
        rows = query[start:start + 512]
        near = (rows @ candidates.T) / own[start:start + 512, None] / size
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(rows), -np.inf)
        a, b = np.nonzero(near >= least[:, None] - SLACK)
        exact = (rows[a] * candidates[b]).sum(axis=1) / (own[start + a] * size[b])
        out.append(np.stack([a + start, b, exact], axis=1))
    found = np.concatenate(out)
    return found[:, 0].astype(np.int64), found[:, 1].astype(np.int64), found[:, 2]


def exact_neighbours(groups, queries, k):
    """(q, qvec, cls, vec, score) of the ``k`` nearest classes of each of a bounded set of queries, by brute force."""
    asked = [(r.cls, r.vec) for r in queries.collect()]

    def run(batches):
        best = {}
        for batch in batches:
            vectors, cls = batch["vec"].to_numpy(zero_copy_only=False), batch["cls"].to_numpy()
            for dim, at, _ in by_length(batch["vec"]):
                mine = [i for i, (_, v) in enumerate(asked) if len(v) == dim]
                if mine:
                    for q, c, score in zip(*ranked(scaled([asked[i][1] for i in mine]), scaled(vectors[at]), k + 1)):
                        i, c = mine[q], at[c]
                        if asked[i][0] != cls[c]:
                            best.setdefault(i, []).append((-score, int(cls[c]), vectors[c].tolist()))
            best = {i: sorted(v)[:k] for i, v in best.items()}
        rows = [(asked[i][0], asked[i][1], c, v, -s) for i, found in best.items() for s, c, v in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*rows) if rows else [[]] * 5,
            (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.float64()), pa.float64()))], names=["q", "qvec", "cls", "vec", "score"])

    found = groups.select("cls", "vec").mapInArrow(run, "q long, qvec array<double>, cls long, vec array<double>, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def probes_needed(groups, queries, forests, k, recall, fitted):
    """Leaves that a query must reach so that ``recall`` of the neighbours of at most ``fitted`` queries are found."""
    some = queries.orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(fitted)
    truth = exact_neighbours(groups, some, k)

    def needed(table):
        _, _, unit = next(by_length(table["qvec"].combine_chunks().slice(0, 1)))
        forest = forests[unit.shape[1]]
        _, _, near = next(by_length(table["vec"].combine_chunks()))
        left = {i: set(enumerate(row.tolist())) for i, row in enumerate(leaves(near, forest))}
        steps = []
        for step, leaf in enumerate(reached(unit[0], forest), 1):
            hit = [i for i, own in left.items() if leaf in own]
            steps += [step] * len(hit)
            for i in hit:
                del left[i]
            if not left:
                break
        return pa.table({"step": pa.array(steps, pa.int64())})

    steps = sorted(r.step for r in truth.groupBy("q").applyInArrow(needed, "step long").collect())
    return steps[math.ceil(recall * len(steps)) - 1] if steps else 1


def nearest(vectors, queries, k=5, key="vec_id", column="embedding", trees=4, leaf=512, sample=32_768, recall=0.95, fitted=200, block=4096):
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each row whose id meets ``queries``.

    ``queries`` is a condition on the column ``id``, the cast ``key``.
    """
    members, groups = classes(vectors, key, column)
    members = members.filter("cls IS NOT NULL")
    asking = members.filter(queries)
    asked = stored(asking.select(F.col("cls").alias("_cls")).distinct().join(groups, F.col("_cls") == F.col("cls")).select("cls", "vec"), "queries")
    forests = fit(groups, trees, leaf, sample)
    sent = vectors.sparkSession.sparkContext.broadcast(forests)
    probes = probes_needed(groups, asked, forests, k, recall, fitted)
    element = "float" if vectors.schema[column].dataType.simpleString() == "array<float>" else "double"
    schema = f"cls long, vec array<{element}>, dim int, tree int, leaf long"
    kind = pa.list_(pa.float32() if element == "float" else pa.float64())

    def dealt(batch, at, dim, row, tree, leaf):
        return pa.RecordBatch.from_arrays([
            batch["cls"].take(pa.array(at[row])), batch["vec"].take(pa.array(at[row])).cast(kind), pa.array(np.full(len(row), dim, np.int32)),
            pa.array(tree, pa.int32()), pa.array(leaf, pa.int64())], names=["cls", "vec", "dim", "tree", "leaf"])

    def index(batches):
        for batch in batches:
            for dim, at, unit in by_length(batch["vec"]):
                found = leaves(unit, sent.value[dim])
                for t in range(found.shape[1]):
                    yield dealt(batch, at, dim, np.arange(len(at)), np.full(len(at), t), found[:, t])

    def search(batches):
        for batch in batches:
            for dim, at, unit in by_length(batch["vec"]):
                for i, one in enumerate(unit):
                    found = [leaf for leaf, _ in zip(reached(one, sent.value[dim]), range(probes))]
                    yield dealt(batch, at, dim, np.full(len(found), i), *map(list, zip(*found)))

    place = ["dim", "tree", "leaf"]
    indexed, searched = groups.select("cls", "vec").mapInArrow(index, schema), asked.mapInArrow(search, schema)
    # leaves with more rows than a block on a side are cut; every block of one side meets every block of the other
    size = lambda d, name: d.groupBy(*place).agg(F.ceil(F.count("*") / block).cast("int").alias(name)).filter(F.col(name) > 1)
    large = stored(size(indexed, "across").join(size(searched, "down"), place, "full").select(
        *(F.col(c).alias(f"_{c}") for c in place), F.coalesce("across", F.lit(1)).alias("across"), F.coalesce("down", F.lit(1)).alias("down")), "large-leaves")

    def blocks(d, side):
        d = d.join(large, [F.col(c) == F.col(f"_{c}") for c in place], "left")
        parts = {c: F.coalesce(c, F.lit(1)) for c in ("across", "down")}
        own, other = ("down", "across") if side else ("across", "down")
        own_part = F.pmod(F.xxhash64("cls"), parts[own]).cast("int")
        return d.select(*place, own_part.alias(own), F.explode(F.sequence(F.lit(0), parts[other] - 1)).alias(other), F.lit(side).alias("side"), "cls", "vec")

    def compared(table):
        side = table["side"].to_numpy()
        cls, vec = table["cls"].to_numpy(), table["vec"].to_numpy()
        ask, held = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(ask) or not len(held):
            return pa.table({"q": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, c, score = ranked(scaled(vec[ask]), scaled(vec[held]), k + 1)
        return pa.table({"q": cls[ask][q], "cls": cls[held][c], "score": score})

    both = blocks(indexed, 0).unionByName(blocks(searched, 1))
    found = both.groupBy(*place, "across", "down").applyInArrow(compared, "q long, cls long, score double")
    found = stored(found.groupBy("q", "cls").agg(F.max("score").alias("score")), "found")
    # a class enters with its first rows, one more than asked for, as one of them may be the query's own
    rows = members.withColumn("_n", F.row_number().over(Window.partitionBy("cls").orderBy(F.col("id").asc_nulls_last(), "_row")))
    rows = rows.filter(F.col("_n") <= k + 1).select(F.col("cls").alias("_cls"), F.col("id").alias("vec_id"), "_row")
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("_row")]
    near = found.withColumn("_rank", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("_rank") <= k + 1)
    near = near.join(rows, F.col("cls") == F.col("_cls")).withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
    near = near.filter(F.col("_n") <= k + 1).select("q", "vec_id", "_row", "score")
    own = asking.select(F.col("id").alias("query_id"), F.col("cls").alias("q"), F.col("_row").alias("_own"))
    out = own.join(near, "q").filter(F.col("_row") != F.col("_own"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("_own").orderBy(*order)))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
