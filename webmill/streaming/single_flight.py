"""Single flight in a stream: one extraction of a key at a time.

The first request of a key sets a marker that lasts until its extraction is done, at most ``pending_s``. Requests that
arrive meanwhile follow it; the first one after that sets the next marker. Rows wait until the watermark has passed them
(see ``replay``), so micro-batches do not change the answer.

What a stretch of time does to the marker is a step function: a marker that ends at m lets the first request at or after m
lead, and the chain of leaders from there ends in one marker. So the requests are laid out by range of key and time, and

1. every piece gives for each of its keys a table of transitions, on its own: few rows, as chains that start apart soon meet;
2. the tables of a key are run through in order, which gives each piece the marker it begins with;
3. every piece is answered from these markers, on its own.

A key with most of the requests lies in many pieces and so in many tasks; only its tables meet in one.
"""

from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webmill.operators.ranking import pieces_of
from webmill.session import cut_lineage
from webmill.streaming import replay

ROWS = "key string, at_us long, id long, done_us long"
OUTPUT = "request_id long, key string, leader_id long"
CARRY = "key string, leader_id long, until_us long"
TABLE = "key string, piece int, upto array<long>, leader_id array<long>, until_us array<long>"
START = "key string, piece int, leader_id long, until_us long"
FIRST = -2 ** 63


def by_key(piece):
    """(key, at, done, id) of each key of a piece, in order of time."""
    keys = piece["key"].combine_chunks().dictionary_encode()
    code, (at, done, number) = keys.indices.to_numpy(), (piece[c].to_numpy() for c in ("at_us", "done_us", "id"))
    order = np.lexsort((done, number, at, code))
    cuts = np.searchsorted(code[order], np.arange(len(keys.dictionary) + 1))
    for key, first, stop in zip(keys.dictionary.to_pylist(), cuts[:-1], cuts[1:]):
        rows = order[first:stop]
        yield key, at[rows], done[rows], number[rows]


def followers(at, done):
    """For each row that leads, the next row that does."""
    return np.maximum(np.searchsorted(at, done, side="left"), np.arange(1, len(at) + 1))


def transitions(at, done, number):
    """(upto, leader, until): a marker that ends at or before ``upto[i]``, but after ``upto[i - 1]``, becomes the i-th one.

    One that ends after the last ``upto`` outlasts the piece.
    """
    last, after = np.arange(len(at)), followers(at, done)
    while (after < len(at)).any():  # chains are followed in steps that double
        on = after < len(at)
        last[on] = last[after[on]]
        after[on] = after[after[on]]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = last[first]
    keep = np.flatnonzero(np.concatenate([end[1:] != end[:-1], [True]]))
    return at[first[keep]], number[end[keep]], done[end[keep]]


def tables_of(piece):
    number = piece["piece"][0].as_py()
    rows = [(key, number, *(v.tolist() for v in transitions(at, done, ids))) for key, at, done, ids in by_key(piece)]
    kinds = (pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "piece", "upto", "leader_id", "until_us"])


def starts_of(share):
    """The marker each piece of a key begins with; the one after the last has no piece."""
    rows = sorted(zip(*(share[c].to_pylist() for c in ("key", "piece", "upto", "leader_id", "until_us"))), key=lambda r: r[:2])
    out = []
    for key, tables in groupby(rows, key=lambda r: r[0]):
        marker = (None, FIRST)
        for _, piece, upto, leader, until in tables:
            if piece < 0:  # carried over
                marker = leader[0], until[0]
                continue
            out.append((key, piece, *marker))
            at = bisect_left(upto, marker[1])
            if at < len(upto):
                marker = leader[at], until[at]
        out.append((key, None, *marker))
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "piece", "leader_id", "until_us"])


def answered(piece, starts):
    """Leaders of a piece's rows, each key from the marker it begins with."""
    first = dict(zip(starts["key"].to_pylist(), zip(starts["leader_id"].to_pylist(), starts["until_us"].to_pylist())))
    out = [(pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.int64()))]
    for key, at, done, number in by_key(piece):
        marker, until = first[key]
        start, after = int(np.searchsorted(at, until, side="left")), followers(at, done)
        leader = np.empty(len(at), np.int64)
        if start:
            leader[:start] = marker
        while start < len(at):
            stop = after[start]
            leader[start:stop] = number[start]
            start = stop
        out.append((pa.array(number), pa.repeat(pa.scalar(key, pa.string()), len(at)), pa.array(leader)))
    return pa.table([pa.concat_arrays(c) for c in zip(*out)], names=["request_id", "key", "leader_id"])


def answer(ready, carry, watermark_us):
    """Leaders of the rows that are ready, and the markers that outlast the watermark."""
    rows = pieces_of(ready, ["key"], ["at_us", "id", "done_us"]).withColumnRenamed("_piece", "piece")
    tables = rows.groupBy("piece").applyInArrow(tables_of, TABLE)
    before = carry.select(
        "key", F.lit(-1).alias("piece"), F.array().cast("array<long>").alias("upto"),
        F.array("leader_id").alias("leader_id"), F.array("until_us").alias("until_us"))
    shares = int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("key"), F.lit(shares)).alias("share")
    starts = cut_lineage(tables.unionByName(before).groupBy(share).applyInArrow(starts_of, START))
    found = rows.groupBy("piece").cogroup(starts.filter("piece IS NOT NULL").groupBy("piece")).applyInArrow(answered, OUTPUT)
    ends = starts.filter("piece IS NULL").select("key", "leader_id", "until_us")
    return found, ends.filter(F.col("until_us") > F.lit(watermark_us))


def flight_rows(req, pending_s=30, key="url_key", ts="ts", request_id="request_id", latency="latency_ms"):
    """Requests with a key in the form that waits for its answer."""
    start = F.unix_micros(ts)
    return req.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), start.alias("at_us"), F.col(request_id).cast("long").alias("id"),
        (start + F.least(F.col(latency) * 1000, F.lit(pending_s * 1000000))).cast("long").alias("done_us"))


def single_flight_sink(req, path, checkpoint, delay_s=30, trigger=None, **names):
    """Answer a stream of requests; ``single_flight_answers`` reads the result."""
    return replay.replay(flight_rows(req, **names), path, checkpoint, answer, CARRY, delay_s=delay_s, trigger=trigger)


def single_flight_answers(spark, path):
    """(request_id, key, leader_id) of each request that the watermark has passed; a request that leads names itself."""
    return replay.answers(spark, path, OUTPUT)
