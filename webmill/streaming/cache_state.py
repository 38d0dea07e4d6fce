"""Per-key cache state in a stream: puts, invalidations and expiry answer each request.

Events wait until the watermark has passed them (see ``replay``), so batches and arrival inside the delay do not change an
answer. A batch is answered by the scan of the batch join, which spreads a hot key over all tasks. What is carried on is the
newest write of each key that is usable and still alive at the watermark: an invalidated, unusable or expired one would only
make requests miss, as no write at all does, so the state of a key ends with its life.
"""

from pyspark.sql import functions as F

from webmill.functions import text
from webmill.operators import cache
from webmill.streaming import replay

PUT, INVALIDATE, REQUEST = 0, 1, 2
EVENTS = "url_key string, at_us long, side int, id long, ttl_s long, usable boolean"
OUTPUT = "request_id long, url_key string, ts timestamp, cache_status string, wid long, age_s long"
CARRY = "wid long, url_key string, kind string, body string, written_at timestamp, ttl_s long"


def cache_events(puts, invalidations, req, ttl_s=None):
    """The three inputs in one narrow shape; bodies are reduced to a flag here."""
    life = F.lit(ttl_s).cast("long") if ttl_s is not None else F.col("ttl_s").cast("long")
    shape = lambda at, side, number, span, usable: [
        F.col("url_key"), F.unix_micros(at).alias("at_us"), F.lit(side).alias("side"),
        number.cast("long").alias("id"), span.cast("long").alias("ttl_s"), usable.alias("usable")]
    out = puts.filter(F.col("kind") == "md").select(
        *shape("written_at", PUT, F.col("wid"), life, ~text.looks_like_html(F.col("body"))))
    out = out.unionByName(req.select(*shape("ts", REQUEST, F.col("request_id"), F.lit(0), F.lit(True))))
    if invalidations is not None:
        # a write of no life that comes after all puts of its instant
        out = out.unionByName(invalidations.select(*shape("received_at", INVALIDATE, F.lit(2 ** 63 - 1), F.lit(0), F.lit(False))))
    return out


def answer(ready, carry, watermark_us):
    """HIT or MISS of the requests that are ready, and the writes that live on."""
    at = F.timestamp_micros("at_us")
    writes = ready.filter(F.col("side") != REQUEST).select(
        F.col("id").alias("wid"), "url_key", F.lit("md").alias("kind"),
        F.when(F.col("usable"), F.lit("")).otherwise(F.lit("<html")).alias("body"), at.alias("written_at"), "ttl_s")
    writes = carry.unionByName(writes)
    asked = ready.filter(F.col("side") == REQUEST).select(F.col("id").alias("request_id"), "url_key", at.alias("ts"))
    newest = writes.groupBy("url_key").agg(F.max(F.struct("written_at", "wid", "ttl_s", "body")).alias("w"))
    alive = F.unix_micros("w.written_at") + F.col("w.ttl_s") * 1000000 > F.lit(watermark_us)
    kept = newest.filter(alive & (F.col("w.body") == "")).select(
        "w.wid", "url_key", F.lit("md").alias("kind"), "w.body", "w.written_at", "w.ttl_s")
    return cache.cache_lookup(asked, writes), kept


def cache_state_sink(puts, invalidations, req, path, checkpoint, ttl_s=None, delay_s=300, trigger=None):
    """Answer a stream of requests; the delay also covers how far the inputs run apart."""
    events = cache_events(puts, invalidations, req, ttl_s)
    return replay.replay(events, path, checkpoint, answer, CARRY, delay_s=delay_s, trigger=trigger)


def cache_state_finish(spark, path):
    """Answer the requests that still wait once no more events will come."""
    replay.finish(spark, path, EVENTS, answer, CARRY)


def cache_state_answers(spark, path):
    return replay.answers(spark, path, OUTPUT)
