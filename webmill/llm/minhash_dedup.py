"""MinHash near-duplicates: banded minima bring sets together, bottom-k sketches and full sets decide.

A document's set holds the 64-bit hashes of its word shingles; its sketch is the ``k`` smallest. Equal sets are one
class, so copies never meet each other again.

1. Inverted lists: a band is a hash of the set's minima under several permutations, and every band that two classes hold
   is a list. Sets of similarity ``s`` share one of ``b`` bands of ``r`` minima with a chance of ``1 - (1 - s ** r) ** b``;
   ``banding`` chooses both so that a pair right at the threshold is missed with a chance of at most 1e-6, rapidly less
   above it, whatever the size of the sets. Sets with a few shingles in common hardly ever meet, however common the
   shingles are, so lists grow with the documents that are nearly alike and no list is capped.
2. Classes that lists connect form a unit of work. Where that is more than ``most_sets`` sets or ``most_bytes``, the
   sketches of each list are compared first and units are what estimates connect; what is still larger keeps its lists,
   cut into pairs of blocks, so no task gathers more than that. Each set is recomputed from one text, for classes in a
   unit only, and sent to its unit once.
3. In a unit, a pivot is compared with all other sets not yet linked to it: the union sketch's estimate sorts out
   clearly different pairs, the exact Jaccard similarity of the full sets decides the rest. Pairs already connected
   need no comparison, and no pair is ever written: a unit returns a spanning forest.
4. Connected components over the forests name each document's group.

Cases: a null or empty text, or one of white space only, has an empty set and links with nothing; a text of fewer
words than a shingle is one shingle; repeated rows are members of one class; a null id takes part but names a group
only where there is no other id; an empty table gives no rows; extra columns are ignored. ``docs`` must be a table
that gives the same rows in the same order when read again, as stored tables do; a change is reported as an error.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from webmill.llm.components import components
from webmill.llm.texts import numbered, row_id, sent_whole, slices, stored, whole, words_of

SHIFT = 4.5  # standard deviations
MISSED = 1e-6  # chance that two sets right at the threshold share no band
MOST_BANDS = 48
MOST_ROWS = 8
SENT_WHOLE = 500_000  # rows of at most about 100 bytes that are broadcast to the documents; more are joined by a shuffle


def banding(threshold):
    """(minima in a band, bands): as many minima as ``MOST_BANDS`` allow at a chance of ``MISSED``."""
    best = None
    for r in range(1, MOST_ROWS + 1):
        count = math.ceil(math.log(MISSED) / math.log1p(-min(threshold, 0.999) ** r))
        if best and count > MOST_BANDS:
            break
        best = r, count
    return best


def mixed(x):
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, width):
    """Distinct shingle hashes of each text, ascending, end to end, and the bounds of the texts."""
    words = words_of(pc.ascii_lower(whole(texts)))
    n, size = len(words.bounds) - 1, np.diff(words.bounds)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.vocab.to_pylist()), np.uint64, len(words.vocab))[words.codes]
    rows = words.rows
    start = np.flatnonzero(rows[:len(rows) - width + 1] == rows[width - 1:]) if len(rows) >= width else np.zeros(0, np.int64)
    value, owner = np.full(len(start), width, np.uint64), rows[start]
    for i in range(width):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + hashes[start + i])
    for i in np.flatnonzero((size > 0) & (size < width)).tolist():  # one shingle of fewer words
        short = np.full(1, size[i], np.uint64)
        for h in hashes[words.bounds[i]:words.bounds[i + 1]]:
            short = mixed(short * np.uint64(0x9E3779B97F4A7C15) + h)
        value, owner = np.append(value, short), np.append(owner, i)
    value = value.view(np.int64)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return value, np.searchsorted(owner, np.arange(n + 1))


def ragged(starts, sizes):
    """Indices of consecutive runs, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def band_keys(flat, bounds, rows, count):
    """``count`` band keys of each non-empty set, end to end, from ``rows`` minima each."""
    first = bounds[:-1][np.diff(bounds) > 0]
    factors = np.random.default_rng(7).integers(0, 1 << 31, (count, rows)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    keys = np.empty((len(first), count), np.uint64)
    short = (flat.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for band in range(count if len(first) else 0):
        key = np.full(len(first), band, np.uint64)
        for factor in factors[band]:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(short * factor, first))
        keys[:, band] = key
    return keys.view(np.int64).ravel()


def set_key(values):
    return xxhash.xxh3_128_digest(values.tobytes())


def list_array(flat, bounds):
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


def sketches(docs, width, k, threshold):
    """(_row, id, n, key, sketch, bands) of each document; stored."""
    rows, count = banding(threshold)

    def run(batches):
        for batch in slices(batches):
            flat, bounds = shingle_sets(batch["text"], width)
            n = np.diff(bounds)
            kept = np.minimum(n, k)
            keys = [set_key(flat[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["_row"], batch["id"], pa.array(n), pa.array(keys, pa.binary()),
                 list_array(flat[ragged(bounds[:-1], kept)], np.concatenate([[0], np.cumsum(kept)])),
                 list_array(band_keys(flat, bounds, rows, count), np.concatenate([[0], np.cumsum((n > 0) * count)]))],
                names=["_row", "id", "n", "key", "sketch", "bands"])
    return stored(docs.mapInArrow(run, "_row long, id long, n long, key binary, sketch array<long>, bands array<long>"), "sketches")


def sets_of(docs, wanted, width):
    """The rows (cls, key, spots) of wanted classes with their ``values``, recomputed from one text each."""
    def run(batches):
        for batch in slices(batches):
            flat, bounds = shingle_sets(batch["text"], width)
            for want, a, b in zip(batch["key"].to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                if want != set_key(flat[a:b]):
                    raise ValueError("the documents changed between two reads")
            yield pa.RecordBatch.from_arrays([batch["cls"], batch["spots"], list_array(flat, bounds)], names=["cls", "spots", "values"])
    rows = docs.join(wanted, F.col("_row") == F.col("cls")).select("cls", "key", "spots", "text")
    return rows.mapInArrow(run, rows.select("cls", "spots").withColumn("values", F.array().cast("array<long>")).schema)


def classes(base):
    """(_row, id, n, cls): rows of equal non-empty sets share the class of their smallest row number."""
    many = base.filter("n > 0").groupBy(F.col("key").alias("_key")).agg(F.min("_row").alias("_cls"), F.count("*").alias("_m")).filter("_m > 1")
    return stored(
        base.select("_row", "id", "n", "key").join(many, F.col("key") == F.col("_key"), "left")
        .select("_row", "id", "n", "key", F.coalesce("_cls", "_row").alias("cls")), "classes")


def inverted_lists(base, member):
    """(value, cls, n, low) of lists with two or more classes: of the bands that classes share."""
    copies = member.filter("cls <> _row").select("_row")
    each = base.filter("n > 0").join(copies, "_row", "left_anti").select(F.col("_row").alias("cls"), "n", F.explode("bands").alias("value"))
    # nearly all bands have one class: a window shuffles them once, an aggregate joined back would do so twice
    own = Window.partitionBy("value")
    held = each.select("value", "cls", "n", F.min("cls").over(own).alias("low"), F.max("cls").over(own).alias("high"))
    return stored(held.filter("low < high").drop("high"), "lists")


class Unit:
    """Sets of one unit with their sketches, coded by their order within the unit."""

    def __init__(self, values, k, threshold):
        self.size = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = values.combine_chunks().flatten() if isinstance(values, pa.ChunkedArray) else values.flatten()
        distinct, codes = np.unique(flat.to_numpy(), return_inverse=True)
        self.codes, self.start = codes, np.cumsum(self.size) - self.size
        self.mark = np.zeros(len(distinct), bool)
        self.k, self.threshold = k, threshold

    def similar(self, pivot, others):
        """Those of ``others`` whose similarity to the pivot reaches the threshold."""
        size, own = self.size[others], self.size[pivot]
        limit = self.threshold - 1e-12
        others = others[np.minimum(size, own) >= limit * np.maximum(size, own)]
        mine = self.codes[self.start[pivot]:self.start[pivot] + own]
        self.mark[mine] = True
        others = others[self.estimated(mine[:self.k], others)]
        size = self.size[others]
        hit = self.mark[self.codes[ragged(self.start[others], size)]]
        shared = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64) if len(others) else size
        self.mark[mine] = False
        # in whole numbers where the threshold is a whole number of hundredths
        return others[100 * shared >= round(100 * self.threshold) * (size + own - shared)]

    def estimated(self, sketch, others):
        """Whether the k smallest values of the union leave a similarity at the threshold possible."""
        kept = np.minimum(self.size[others], self.k)
        first = np.cumsum(kept) - kept
        codes = self.codes[ragged(self.start[others], kept)]
        place = np.searchsorted(sketch, codes)
        both = sketch[np.minimum(place, len(sketch) - 1)] == codes
        owner = np.repeat(np.arange(len(others)), kept)
        before = np.cumsum(both) - both
        before -= before[first][owner] if len(first) else 0
        rank = np.arange(len(codes)) - first[owner] + place - before
        shared = np.bincount(owner[both & (rank < self.k)], minlength=len(others))
        union = np.minimum(len(sketch) + kept - np.bincount(owner[both], minlength=len(others)), self.k)
        return shared >= self.threshold * union - SHIFT * np.sqrt(self.threshold * (1 - self.threshold) * union)


class SketchUnit(Unit):
    """Sketches of one list with the sizes of their sets; similar means that the estimate leaves a link possible."""

    def __init__(self, values, sizes, k, threshold):
        super().__init__(values, k, threshold)
        self.whole = sizes

    def similar(self, pivot, others):
        size, own = self.whole[others], self.whole[pivot]
        others = others[np.minimum(size, own) >= (self.threshold - 1e-12) * np.maximum(size, own)]
        return others[self.estimated(self.codes[self.start[pivot]:self.start[pivot] + self.size[pivot]], others)]


def linked(values, k, threshold, sides=None):
    """Smallest member of each set's component among the given sets."""
    return grouped(Unit(values, k, threshold), sides)


def grouped(unit, sides=None):
    """Smallest member of each member's component under ``unit.similar``.

    Pivots first come from the largest group until three in a row link nothing new, then from the smallest, until all
    sets that were no pivot are in one group: each pair of different groups has then been compared. ``sides`` restricts
    comparisons to sets of different sides.
    """
    n = len(unit.size)
    root, todo = np.arange(n), np.ones(n, bool)
    idle = 0
    while True:
        open_ = np.flatnonzero(todo)
        groups, first, count = np.unique(root[open_], return_index=True, return_counts=True)
        if len(groups) < 2:
            return root
        pick = count.argmax() if idle < 3 else count.argmin()
        pivot = open_[first[pick]]
        todo[pivot] = False
        others = open_[(root[open_] != root[pivot])]
        if sides is not None:
            others = others[sides[others] != sides[pivot]]
        near = unit.similar(pivot, others)
        idle = 0 if len(near) else idle + 1
        for r in np.unique(root[near]):
            low, high = sorted((root[pivot], r))
            root[root == high] = low


def unit_links(k, threshold):
    def run(group):
        cls = group["cls"].to_numpy()
        sides = group["side"].to_numpy() if group["pair"][0].as_py() else None
        root = linked(group["values"], k, threshold, sides)
        apart = root != np.arange(len(cls))
        return pa.table({"a": cls[apart], "b": cls[root[apart]]})
    return run


def estimate_links(k, threshold):
    def run(group):
        cls = group["cls"].to_numpy()
        sides = group["side"].to_numpy() if group["pair"][0].as_py() else None
        root = grouped(SketchUnit(group["sketch"], group["n"].to_numpy(), k, threshold), sides)
        apart = root != np.arange(len(cls))
        return pa.table({"a": cls[apart], "b": cls[root[apart]]})
    return run


def sized(rows, unit, most_sets, most_bytes):
    """Into how many blocks a unit must be cut."""
    need = F.greatest(F.count("*") / most_sets, F.sum("n") * 8 / most_bytes)
    return rows.groupBy(F.col(unit).alias("_unit")).agg(F.ceil(need).alias("blocks"))


def in_blocks(lists, blocks):
    """(cls, n, unit, list, i, j, side, pair): members of lists, dealt to pairs of blocks where a list has several."""
    rows = lists.join(blocks, F.col("value") == F.col("_unit")).withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("side", "other"), F.greatest("side", "other")
    return rows.select("cls", "n", F.col("value").alias("unit"), F.lit(1).alias("list"), i.alias("i"), j.alias("j"), "side", (i != j).cast("int").alias("pair"))


def with_roots(nodes, edges):
    """(cls, n, unit): the component of each class under the edges."""
    roots = components(edges).withColumnRenamed("id", "_id")
    return stored(nodes.join(roots, F.col("cls") == F.col("_id"), "left").select("cls", "n", F.coalesce("root", "cls").alias("unit")), "units")


def units(base, lists, k, threshold, most_sets, most_bytes):
    """(cls, unit, list, i, j, side, pair): which unit, and which blocks of it, each class goes to.

    Classes connected by lists are one unit if they fit. In larger ones the sketches of each list are compared first, and
    classes connected by estimates that leave a link possible are one unit if they fit. What is still too large keeps its
    lists as units, cut into pairs of blocks where a list is too large.
    """
    spot = [F.lit(0).cast(t).alias(c) for c, t in (("list", "int"), ("i", "long"), ("j", "long"), ("side", "long"), ("pair", "int"))]

    def split(nodes):
        large = stored(sized(nodes, "unit", most_sets, most_bytes).filter("blocks > 1").select("_unit"), "large-units")
        fit = nodes.join(large, F.col("unit") == F.col("_unit"), "left_anti").select("cls", "unit", *spot)
        return fit, None if large.isEmpty() else nodes.join(large, F.col("unit") == F.col("_unit"), "left_semi").select("cls", "n")

    nodes = with_roots(lists.select("cls", "n").distinct(), lists.select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct())
    fit, inside = split(nodes)
    if inside is None:
        return fit
    rest = lists.join(inside.select(F.col("cls").alias("_cls")), F.col("cls") == F.col("_cls"), "left_semi").select("value", "cls", "n")
    rest = stored(rest, "large-lists")
    # lists with the same members are the same work: one of them is enough
    mark = F.sum(F.xxhash64("cls").cast("decimal(38,0)"))
    one = rest.groupBy("value").agg(F.count("*").alias("m"), mark.alias("s"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x")).groupBy("m", "s", "x").agg(F.min("value").alias("_value"))
    rest = stored(rest.join(one.select("_value"), F.col("value") == F.col("_value"), "left_semi"), "distinct-lists")
    compared = in_blocks(rest, rest.groupBy(F.col("value").alias("_unit")).agg(F.ceil(F.count("*") / most_sets).alias("blocks")))
    compared = compared.join(base.select(F.col("_row").alias("_r"), "sketch"), F.col("cls") == F.col("_r")).drop("_r")
    edges = compared.groupBy("unit", "i", "j").applyInArrow(estimate_links(k, threshold), "a long, b long")
    finer, inside = split(with_roots(inside, edges))
    if inside is None:
        return fit.union(finer)
    rest = stored(rest.join(inside.select(F.col("cls").alias("_cls")), F.col("cls") == F.col("_cls"), "left_semi"), "rest-lists")
    return fit.union(finer).union(in_blocks(rest, sized(rest, "value", most_sets, most_bytes)).drop("n"))


def near_duplicates(docs, key="doc_id", width=5, k=64, threshold=0.8, most_sets=16_384, most_bytes=64 << 20, row=None):
    """(_row, id, n_shingles, component, first) of every document; ``first`` marks one row of each component.

    ``row`` names a column of row numbers; without one, rows are numbered here.
    """
    docs = docs.select((F.col(row) if row else row_id()).alias("_row"), F.col(key).cast("long").alias("id"), "text")
    base = sketches(docs, width, k, threshold)
    member = classes(base)
    lists = inverted_lists(base, member)
    places = stored(units(base, lists, k, threshold, most_sets, most_bytes), "places")
    spots = F.collect_list(F.struct("unit", "list", "i", "j", "side", "pair")).alias("spots")
    wanted = stored(
        places.groupBy("cls").agg(spots).join(member.select("_row", "key"), F.col("cls") == F.col("_row")).select("cls", "key", "spots"), "wanted")
    sets = sets_of(docs.select("_row", "text"), sent_whole(wanted, places.count(), SENT_WHOLE), width)
    work = sets.select("cls", "values", F.explode("spots").alias("s")).select("cls", "values", "s.*")
    links = work.groupBy("unit", "list", "i", "j").applyInArrow(unit_links(k, threshold), "a long, b long")
    roots = components(links)
    out = member.join(roots.withColumnRenamed("id", "_id"), F.col("cls") == F.col("_id"), "left").select(
        "_row", "id", "n", F.coalesce("root", "cls").alias("root"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "_row")
    names = out.groupBy(F.col("root").alias("_root")).agg(F.min(rank).alias("_first"))
    return out.join(names, F.col("root") == F.col("_root")).select(
        "_row", "id", F.col("n").alias("n_shingles"), F.col("_first.id").alias("component"), (F.col("_first._row") == F.col("_row")).alias("first"))


def without_duplicates(docs, key="doc_id", **options):
    """One document of each component, with all its columns.

    The rows are numbered and stored once, so that the rows to drop are the same however often and in whatever splits the
    table is read. These are stored and counted; up to ``SENT_WHOLE`` of them are broadcast, more are joined by a shuffle.
    """
    rows = numbered(docs)
    texts = rows.select("_row", F.col(f"_doc.{key}").alias("_key"), "_doc.text")
    found = near_duplicates(texts, "_key", row="_row", **options)
    drop = stored(found.filter(~F.col("first")).select(F.col("_row").alias("_drop")), "duplicates")
    return rows.join(sent_whole(drop, drop.count(), SENT_WHOLE), F.col("_row") == F.col("_drop"), "left_anti").select("_doc.*")
