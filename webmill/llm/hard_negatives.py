"""Hard negatives by exact search in lists that the anchors of a cluster share.

Anchors are clustered by angle. For a cluster whose members lie within an angle b of its centre, no member u can score more
than |u|·|x|·cos(max(0, angle(x, centre) - b)) with a candidate x. The candidates of a cluster are sorted by this bound
(without |u|) once; every member walks down the list, scores exactly, and stops where the bound certifies that no later
candidate can enter its answer. Two walks use a list: one for the positives of each anchor, then one for the negatives of
each (anchor, positive), whose scores must lie in a window below the positive's.

On a cluster the list is not one group: its head, about ``head`` candidates found from a histogram of the bounds, is walked
first; the scores found there bound from below what any later candidate must reach, and only candidates whose bound
reaches that for some member are sent at all, in segments of at most ``segment`` that are walked apart. Clusters above
``members`` anchors are cut into blocks. Components travel in as few bytes as they need.

Centres are fitted on at most ``sample`` anchors; every anchor and every row is searched. Where vectors have no structure
the bounds certify little and the walks reach most of the rows: then each block of anchors meets all rows, in segments.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of different lengths
are never compared; zero vectors score 0; ties go to the smaller id, null ids last, then to the earlier row; rows with
equal ids are separate rows; extra columns are ignored; an empty table gives none. Scores must fit 63 bits: larger
vectors raise an error.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from webmill.llm.texts import row_id, stored

BINS = 1024
#: Bounds are made a little larger than computed, so that rounding never hides a candidate; angles near 0 are least exact.
SLACK, ANGLE_SLACK = 1e-9, 1e-7
LOWEST = np.iinfo(np.int64).min
FOUND = "_anchor long, _positive long, low long, high long, _row long, vec_id long, score long"


def quantised(vectors, key="vec_id", label="label", column="embedding", scale=256):
    """Rows that take part: (_row, vec_id, label, dim, q, norm); ``q`` holds floor(scale * x) in as few bytes as all rows need."""
    vec = F.col(column).cast("array<double>")
    good = F.col(label).isNotNull() & vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(
        row_id().alias("_row"), F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.size(vec).alias("dim"), F.transform(vec, lambda x: F.floor(x * scale).cast("double")).alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    rows = stored(rows, "quantised")
    peak, norm = rows.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max("norm")).first()
    if (norm or 0) ** 2 >= 2 ** 63:
        raise ValueError("scores of these vectors do not fit 63 bits")
    kind = next(t for t in ("int16", "int32", "int64") if (peak or 0) < 2 ** (8 * np.dtype(t).itemsize - 1))

    def packed(batches):
        for batch in batches:
            out = [np.array(v, np.float64).astype(kind).tobytes() for v in batch["v"].to_numpy(zero_copy_only=False)]
            yield batch.drop_columns(["v"]).append_column("q", pa.array(out, pa.binary()))

    return rows.mapInArrow(packed, "_row long, vec_id long, label long, dim int, norm double, q binary"), kind


def matrix(column, kind):
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def products(left, right, exact):
    """Integer inner products; by double precision only where that is exact."""
    if exact:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def directions(x):
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x, dtype=np.float64), where=size > 0)


def centres(unit, k, rounds=8):
    """Spherical k-means: the centres of ``unit`` rows."""
    rng = np.random.default_rng(11)
    found = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        own = (unit @ found.T).argmax(axis=1)
        total = np.zeros_like(found)
        np.add.at(total, own, unit)
        moved = directions(total)
        found = np.where((moved != 0).any(axis=1, keepdims=True), moved, found)
    return found


def clustered(anchors, kind, members, sample):
    """Anchors with their cluster and angle, and {length: centres}."""
    n = anchors.count()
    some = anchors.orderBy(F.xxhash64("_row"), "_row").limit(sample).select("dim", "q").toArrow()
    found = {}
    dims = some["dim"].to_numpy()
    for dim in np.unique(dims):
        unit = directions(matrix(some["q"].filter(pa.array(dims == dim)), kind).astype(np.float64)) if dim else np.zeros((1, 0))
        k = min(len(unit), max(1, math.ceil(n / members * (dims == dim).mean())))
        found[int(dim)] = centres(unit, k)

    def assign(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy()
            cluster, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                unit = directions(matrix(batch["q"].take(pa.array(at)), kind).astype(np.float64))
                near = unit @ found.get(int(dim), np.zeros((1, dim))).T
                cluster[at] = near.argmax(axis=1)
                # an anchor without a direction scores 0 with everything and widens no cluster
                angle[at] = np.where((unit != 0).any(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1)), 0)
            yield batch.append_column("cluster", pa.array(cluster)).append_column("angle", pa.array(angle))

    schema = "_row long, vec_id long, label long, dim int, norm double, q binary, cluster int, angle double"
    return stored(anchors.mapInArrow(assign, schema), "anchors"), found


def bounds(batch, kind, lists):
    """Some rows of one length, and their bounds in each cluster's list; ``lists`` is {length: (clusters, centres, angles)}."""
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims):
        if int(dim) in lists:
            clusters, middle, wide = lists[int(dim)]
            own, step = np.flatnonzero(dims == dim), max(1, 4_000_000 // len(clusters))
            for start in range(0, len(own), step):
                at = own[start:start + step]
                unit = directions(matrix(batch["q"].take(pa.array(at)), kind).astype(np.float64))
                angle = np.arccos(np.clip(unit @ middle.T, -1, 1))
                size = batch["norm"].to_numpy()[at][:, None]
                yield int(dim), at, clusters, size * np.cos(np.clip(angle - wide - ANGLE_SLACK, 0, np.pi)) + SLACK * (size + 1)


def pairs(rows, kind, lists, least, below=None):
    """Candidates with each (dim, cluster) in whose list their bound is at least ``least`` and less than ``below``."""
    def run(batches):
        for batch in batches:
            for dim, at, clusters, bound in bounds(batch, kind, lists):
                keep = bound >= np.array([least.get((dim, int(c)), np.inf) for c in clusters])
                if below is not None:
                    keep &= bound < np.array([below.get((dim, int(c)), np.inf) for c in clusters])
                i, c = np.nonzero(keep)
                yield batch.take(pa.array(at[i])).append_column("cluster", pa.array(clusters[c].astype(np.int32))).append_column("bound", pa.array(bound[i, c]))
    return rows.mapInArrow(run, "_row long, vec_id long, label long, dim int, norm double, q binary, cluster int, bound double")


def heads(rows, kind, lists, head):
    """The bound that about ``head`` candidates of each list reach; one number per bin and list is summed."""
    top = rows.agg(F.max("norm")).first()[0] or 1.0
    edges = np.linspace(-1, 1, BINS + 1) * top * 1.001

    def run(batches):
        seen = {}
        for batch in batches:
            for dim, _, clusters, bound in bounds(batch, kind, lists):
                for c, column in zip(clusters.tolist(), np.searchsorted(edges, bound, side="right").T):
                    seen[dim, c] = seen.get((dim, c), 0) + np.bincount(np.minimum(column, BINS), minlength=BINS + 1)
        flat = [(d, c, b, int(n)) for (d, c), bins in seen.items() for b, n in enumerate(bins) if n]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*flat) if flat else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["dim", "cluster", "bin", "n"])

    bins = rows.mapInArrow(run, "dim int, cluster int, bin int, n long").groupBy("dim", "cluster", "bin").agg(F.sum("n").alias("n"))
    over = F.sum("n").over(Window.partitionBy("dim", "cluster").orderBy(F.desc("bin")))
    last = bins.withColumn("over", over).groupBy("dim", "cluster").agg(F.max(F.when(F.col("over") >= head, F.col("bin"))).alias("bin"))
    return {(r.dim, r.cluster): -np.inf if not r.bin else float(edges[r.bin - 1]) for r in last.collect()}


def walk(kind, k, same, exact, chunk=1024):
    """Best ``k`` candidates of each walker of one block of anchors and one segment of their list.

    A walker is an anchor with a window of scores; ``same`` says whether candidates share its label. The scores of a chunk
    are computed for the anchors that still walk; a walker stops when the next bound is below what it needs.
    """
    def run(table):
        side = table["side"].to_numpy()
        asks, held = table.filter(pa.array(side == 1)), table.filter(pa.array(side == 0))
        empty = pa.table({n: pa.array([], pa.int64()) for n in ("_anchor", "_positive", "low", "high", "_row", "vec_id", "score")})
        if not len(asks) or not len(held):
            return empty
        held = held.take(pa.array(np.argsort(-held["bound"].to_numpy(), kind="stable")))
        column = lambda t, c: t[c].to_numpy()
        bound, label, row = column(held, "bound"), column(held, "label"), column(held, "_row")
        ids = held["vec_id"].combine_chunks()
        null, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        anchor, first, of = np.unique(column(asks, "_anchor"), return_index=True, return_inverse=True)
        user, own = matrix(asks["q"].take(pa.array(first)), kind), column(asks, "label")
        size, low, high, need = (column(asks, c) for c in ("norm", "low", "high", "need"))
        items = matrix(held["q"], kind)
        best, active = np.full((len(asks), k), LOWEST), np.ones(len(asks), bool)

        def first_k(w, c, score):
            keep = score >= best[w, -1]
            w, c, score = w[keep], c[keep], score[keep]
            order = np.lexsort((row[c], number[c], null[c], -score, w))
            w, c, score = w[order], c[order], score[order]
            keep = np.arange(len(w)) - np.searchsorted(w, w) < k
            return w[keep], c[keep], score[keep]

        out = []
        for start in range(0, len(held), chunk):
            active &= size * bound[start] >= np.maximum(need, best[:, -1])
            walkers = np.flatnonzero(active)
            if not len(walkers):
                break
            users, place = np.unique(of[walkers], return_inverse=True)
            stop = min(start + chunk, len(held))
            score = products(user[users], items[start:stop], exact)[place]
            fits = (label[None, start:stop] == own[walkers, None]) == same
            fits &= (row[None, start:stop] != anchor[of[walkers], None]) & (score >= low[walkers, None]) & (score <= high[walkers, None])
            fits &= score >= best[walkers, -1:]
            w, c = np.nonzero(fits)
            if len(w):
                top = np.concatenate([best[walkers], np.where(fits, score, LOWEST)], axis=1)
                best[walkers] = -np.sort(-np.partition(top, top.shape[1] - k, axis=1)[:, -k:], axis=1)
                out.append(first_k(walkers[w], c + start, score[w, c]))
        if not out:
            return empty
        w, c, score = first_k(*(np.concatenate(x) for x in zip(*out)))
        given = lambda name: asks[name].take(pa.array(w))
        return pa.table({
            "_anchor": given("_anchor"), "_positive": given("_positive"), "low": given("low"), "high": given("high"),
            "_row": pa.array(row[c]), "vec_id": ids.take(pa.array(c)), "score": pa.array(score)})
    return run


def searched(walkers, rows, kind, lists, starts, k, same, exact, segment, blocks):
    """(walker, row, score) of the best ``k`` of each walker: the head of each list, then what may still enter.

    ``walkers``: (_anchor, _positive, label, dim, norm, q, cluster, block, low, high); a walker's answer holds scores from
    ``low`` to ``high`` only.
    """
    order = Window.partitionBy("_anchor", "_positive").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "_row")
    best = lambda d: d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def walked(asking, candidates):
        # every segment of a list meets every block of its cluster's anchors
        count = stored(candidates.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / segment).cast("int").alias("segments")), "segments")
        held = candidates.join(count, ["dim", "cluster"]).join(blocks, ["dim", "cluster"])
        held = held.withColumn("segment", F.pmod(F.xxhash64("_row"), "segments").cast("int"))
        held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("segments", "blocks").withColumn("side", F.lit(0))
        asks = asking.join(count, ["dim", "cluster"]).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
        asks = asks.drop("segments").withColumn("side", F.lit(1))
        both = held.unionByName(asks, allowMissingColumns=True)
        return stored(both.groupBy("dim", "cluster", "block", "segment").applyInArrow(walk(kind, k, same, exact), FOUND), "walked")

    first = best(walked(walkers.withColumn("need", F.col("low")), pairs(rows, kind, lists, starts)))
    reached = first.groupBy("_anchor", "_positive").agg(F.min("score").alias("least"), F.count("*").alias("got")).select(
        F.col("_anchor").alias("_a"), F.col("_positive").alias("_p"), F.when(F.col("got") == k, F.col("least")).alias("least"))
    on = (F.col("_anchor") == F.col("_a")) & F.col("_positive").eqNullSafe(F.col("_p"))
    rest = stored(walkers.join(reached, on, "left").withColumn("need", F.greatest("low", "least")).drop("_a", "_p", "least"), "walkers")
    # what a bound must be for any walker of the list to need it; a walker without a length may need every candidate
    reach = rest.groupBy("dim", "cluster").agg(F.min(
        F.when(F.col("norm") > 0, F.col("need") / F.col("norm")).when(F.col("need") <= 0, F.lit(float("-inf")))).alias("reach")).collect()
    least = {(r.dim, r.cluster): np.inf if r.reach is None else r.reach - SLACK * (abs(r.reach) + 1) for r in reach}
    return best(stored(walked(rest, pairs(rows, kind, lists, least, starts)).unionByName(first.drop("rank")), "merged"))


def mine(vectors, anchors, relabel=None, key="vec_id", label="label", column="embedding", positives=5, negatives=10, window=(30, 90),
         members=256, head=4096, segment=8192, sample=16_384):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``vec_id``; ``relabel`` maps the columns vec_id and label to another label. A negative's
    score is between ``window`` percent of its positive's.
    """
    rows, kind = quantised(vectors, key, label, column)
    rows = stored(rows if relabel is None else rows.withColumn("label", relabel.cast("long")).filter("label IS NOT NULL"), "rows")
    peak = rows.agg(F.max("norm")).first()[0] or 0
    exact = peak ** 2 < 2 ** 53
    asked, middles = clustered(rows.filter(anchors), kind, members, sample)
    # one row for each cluster: about one for ``members`` anchors
    met = asked.groupBy("dim", "cluster").agg(F.max("angle").alias("angle"), F.ceil(F.count("*") / members).cast("int").alias("blocks"))
    met = stored(met, "clusters")
    lists = {}
    for r in met.orderBy("dim", "cluster").collect():
        clusters, middle, wide = lists.setdefault(r.dim, ([], [], []))
        clusters.append(r.cluster)
        middle.append(middles.get(r.dim, np.zeros((1, r.dim)))[r.cluster])
        wide.append(r.angle)
    lists = {d: tuple(map(np.array, x)) for d, x in lists.items()}
    blocks = met.select("dim", "cluster", "blocks")
    asked = asked.join(blocks, ["dim", "cluster"]).select(
        F.col("_row").alias("_anchor"), F.col("vec_id").alias("anchor_id"), "label", "dim", "norm", "q", "cluster",
        F.pmod(F.xxhash64("_row"), "blocks").cast("int").alias("block"))
    asked = stored(asked, "asked")
    starts = heads(rows, kind, lists, head)
    any_score = lambda n: F.lit(n).cast("long")
    walkers = asked.drop("anchor_id").withColumns({"_positive": any_score(None), "low": any_score(1 - 2 ** 63), "high": any_score(2 ** 63 - 1)})
    near = searched(walkers, rows, kind, lists, starts, positives, True, exact, segment, blocks)
    near = near.select(F.col("_anchor").alias("_a"), F.col("_row").alias("_positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = stored(near, "positives")
    # low and high are the first and last whole scores inside the window
    share = lambda percent, toward: toward(F.col("positive_score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(9,0)") / 100).cast("long")
    walkers = asked.drop("anchor_id").join(near, F.col("_anchor") == F.col("_a")).withColumns(
        {"low": share(window[0], F.ceil), "high": share(window[1], F.floor)}).filter("low <= high").drop("_a", "positive_id", "positive_score")
    hard = searched(walkers, rows, kind, lists, starts, negatives, False, exact, segment, blocks)
    hard = hard.select(F.col("_anchor").alias("_h"), F.col("_positive").alias("_p"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(asked.select("_anchor", "anchor_id"), F.col("_a") == F.col("_anchor"))
    return hard.join(named, (F.col("_h") == F.col("_a")) & (F.col("_p") == F.col("_positive"))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
