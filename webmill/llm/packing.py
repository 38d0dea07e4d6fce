"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Full pieces are sequences of
their own. The others are dealt evenly to partitions of about ``per_partition`` pieces and packed best-fit decreasing.
A partition whose number of bins equals its lower bound is certified and final. The pieces of partitions with gaps
are dealt anew among these partitions and packed again; a round that saves nothing is undone and ends the work. What
is left with a gap is also packed bin by bin with the best-filling sizes, and the better packing of the two stays.

Cases: a null text is an empty one, and an empty document is its end token; repeated rows are packed each; no rows
give no sequences. Rows are told apart by a number, so repeated or null ids are dealt evenly too.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webmill.llm.texts import row_id, slices, stored, whole
from webmill.llm.word_ids import ids_of, library_ids

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs, path, capacity=2048, end=0, with_ids=False):
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and the end id."""
    def cut(batches):
        for batch in slices(batches):
            ids, bounds = ids_of(whole(batch["text"]), library_ids(path), path, (end,))
            total = np.diff(bounds)
            count = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(total[row] - start, capacity)
            first = bounds[row] + start
            raw = ids.astype("<u4")
            crc = np.fromiter((zlib.crc32(raw[a:a + n]) for a, n in zip(first.tolist(), length.tolist())), np.int64, len(row))
            columns = [batch["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(raw.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE + ", ids array<int>" * with_ids)


def lower_bound(sizes, capacity):
    """Fewest bins that any packing needs, as dual feasible functions prove.

    For each threshold up to half a bin: sizes above the rest of a bin count as a whole one, sizes below the threshold
    as nothing. For k = 1 to 32: sizes are rounded to k-ths of a bin, down unless (k + 1) * size is whole.
    """
    n = np.bincount(sizes, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    many, mass = np.cumsum(n), np.cumsum(n * x)
    t = np.arange(0, capacity // 2 + 1)
    below = np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    best = (many[-1] - many[capacity - t]) * capacity + mass[capacity - t] - below
    bound = -(-int(best.max()) // capacity)
    for k in range(1, 33):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        bound = max(bound, -(-int((n * value).sum()) // (k * capacity)))
    return bound


def best_fit(sizes, capacity):
    """Bin and offset of each size, best-fit decreasing, and the number of bins."""
    open_bins, left, count = [[] for _ in range(capacity + 1)], 0, 0  # bit r of left: a bin has r tokens free
    where, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = left >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                left ^= 1 << room
        else:
            room, bin_, count = capacity, count, count + 1
        where[i], at[i], room = bin_, capacity - room, room - size
        if room:
            if not open_bins[room]:
                left |= 1 << room
            open_bins[room].append(bin_)
    return where, at, count


def filled(sizes, capacity):
    """Bin and offset of each size, and the number of bins: the largest size first, then those that fill its bin best.

    The sums that the other sizes can reach are bits of one number, so a bin takes few steps per size.
    """
    stock = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        stock.setdefault(int(sizes[i]), []).append(i)
    where, at, count = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    order = list(stock)
    while order:
        free, steps, reach = capacity - order[0], [], 1
        for size in order:
            for _ in range(min(len(stock[size]) - (size == order[0]), free // size)):
                steps.append((size, reach))
                reach |= reach << size & (2 << free) - 1
                if reach >> free & 1:
                    break
            if reach >> free & 1:
                break
        total, taken = reach.bit_length() - 1, [order[0]]
        for size, before in reversed(steps):
            if not before >> total & 1:
                taken.append(size)
                total -= size
        place = 0
        for size in taken:
            i = stock[size].pop()
            where[i], at[i], place = count, place, place + size
        count += 1
        order = [s for s in order if stock[s]]
    return where, at, count


def packer(capacity, round_, last=False):
    def pack(group):
        sizes = group["length"].to_numpy()
        where, at, bins = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        if last and bins > bound:
            where, at, bins = min((where, at, bins), filled(sizes, capacity), key=lambda p: p[2])
        n, part = len(sizes), np.asarray(group["_part"])
        return group.drop_columns(["_part"]).append_column("_group", pa.array(part if last else part * 64 + round_)).append_column(
            "_bin", pa.array(where)).append_column("offset", pa.array(at)).append_column(
            "_bins", pa.array(np.full(n, bins))).append_column("_bound", pa.array(np.full(n, bound)))
    return pack


def total_bins(packed):
    """(groups, bins) of a packing; one row per group stays on the executors."""
    groups = packed.groupBy("_group").agg(F.max("_bins").alias("bins"))
    return groups.agg(F.count("*"), F.coalesce(F.sum("bins"), F.lit(0))).first()


def pack(cut, capacity=2048, per_partition=20_000, rounds=4):
    """Adds ``sequence_id`` and ``offset`` to pieces; ``certified`` tells whether the bound proves their partition."""
    names = cut.columns
    cut = stored(cut.withColumn("_uid", row_id()), "pieces")
    final = [cut.filter(F.col("length") == capacity).select(*names, (2 * F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    rest = cut.filter(F.col("length") < capacity)
    parts, before = max(1, math.ceil(rest.count() / per_partition)), None
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    spec += ", _group long, _bin long, offset long, _bins long, _bound long"
    done = lambda df: df.select(
        *names, (2 * (F.col("_group") * (1 << 32) + F.col("_bin")) + 1).alias("sequence_id"), "offset", (F.col("_bins") == F.col("_bound")).alias("certified"))
    refined = lambda df: df.select(*names, "_uid", F.col("_group").alias("_part")).groupBy("_part").applyInArrow(packer(capacity, 0, True), spec)
    for round_ in range(rounds):
        dealt = rest.withColumn("_part", F.pmod(F.xxhash64("_uid", F.lit(round_)), F.lit(parts)))
        packed = stored(dealt.groupBy("_part").applyInArrow(packer(capacity, round_), spec), "packed")
        if before is not None and total_bins(packed)[1] >= before[1]:
            final.append(done(refined(gaps)))
            break
        final.append(done(packed.filter("_bins = _bound")))
        gaps = packed.filter("_bins > _bound")
        before = total_bins(gaps)
        if before[0] < 2 or round_ == rounds - 1:  # nothing is left, or no other partition to exchange with
            final.append(done(refined(gaps)))
            break
        rest, parts = gaps.select(*names, "_uid"), before[0]
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out


def sequences(packed):
    """(sequence_id, ids) of packed pieces that carry ids; a sequence holds at most ``capacity`` of them."""
    whole_ = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(whole_, lambda p: p["ids"])).alias("ids"))
