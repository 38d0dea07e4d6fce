"""Joins between requests and the content write log.

As-of and interval joins are written as running scans over a union of both sides, so work is linear in the rows and no
pairs are formed. The scans run over short times of a key, cut further where many requests fall into one, hence a key
that receives a third of all requests, or all of them in one minute, is spread over many tasks.
"""

from pyspark.sql import functions as F

from webmill import lists
from webmill.functions import text
from webmill.operators.ranking import carried


def cache_lookup(req, writes, ttl_s=None, key="url_key", ts="ts", request_id="request_id", carry=(), segment_s=300, most=100_000):
    """HIT or MISS of each request against the newest earlier write of its key.

    The newest write hides older ones: if it has expired, or is markup, the
    request misses. ``ttl_s`` overrides the time to live of the rows; ``carry``
    names request columns to keep. A request without a key misses.
    """
    life = F.lit(ttl_s).cast("long") if ttl_s is not None else F.col("ttl_s").cast("long")
    cached = writes.filter((F.col("kind") == "md") & F.col("url_key").isNotNull()).select(
        F.col("url_key").alias("_key"), F.col("written_at").alias("_at"), F.lit(0).alias("_side"),
        F.col("wid").cast("long").alias("_id"), F.lit(None).cast(req.schema[request_id].dataType).alias(request_id),
        F.struct(
            F.col("written_at").alias("at"), F.col("wid").cast("long").alias("wid"), life.alias("ttl"),
            text.looks_like_html(F.col("body")).alias("bad")).alias("_w"))
    asked = req.select(
        F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(1).alias("_side"),
        F.xxhash64(request_id).alias("_id"), request_id, *carry, F.lit(None).cast(cached.schema["_w"].dataType).alias("_w"))
    rows = cached.unionByName(asked, allowMissingColumns=True)
    seen = carried(rows, "_key", ["_at", "_side", "_id"], "_w", "_hit", F.unix_micros("_at"), segment_s, most=most).filter(F.col("_side") == 1)
    age = F.unix_seconds("_at") - F.unix_seconds("_hit.at")
    live = F.coalesce(
        (F.unix_micros("_at") < F.unix_micros("_hit.at") + F.col("_hit.ttl") * 1000000) & ~F.col("_hit.bad"),
        F.lit(False))
    return seen.select(
        request_id, *carry, F.col("_key").alias(key), F.col("_at").alias(ts),
        F.when(live, "HIT").otherwise("MISS").alias("cache_status"),
        F.when(live, F.col("_hit.wid")).alias("wid"),
        F.when(live, age).alias("age_s"))


def content_bundle(writes, as_of):
    """Markdown, HTML and tokens of each key that are live at ``as_of``.

    The newest write of each kind is chosen from narrow rows, then its expiry;
    ``wid`` identifies a write of a key. Token counts fall back to an estimate from
    the Markdown.
    """
    now = F.lit(as_of).cast("timestamp")
    past = writes.filter(F.col("written_at") <= now)
    newest = past.groupBy("url_key", "kind").agg(F.max(F.struct("written_at", "wid", "ttl_s")).alias("_w"))
    until = F.unix_micros("_w.written_at") + F.col("_w.ttl_s") * 1000000
    # the bodies join the chosen rows only; none passes through an aggregate
    chosen = newest.select(F.col("url_key").alias("_k"), F.col("kind").alias("_kind"), F.col("_w.wid").alias("_wid"),
                           (until > F.unix_micros(now)).alias("_live"))
    body = lambda kind: chosen.filter((F.col("_kind") == kind) & F.col("_live")).join(
        writes.filter(F.col("kind") == kind).select("url_key", "wid", F.nullif("body", F.lit("")).alias(kind)),
        (F.col("_k") == F.col("url_key")) & (F.col("_wid") == F.col("wid"))).select("url_key", kind)
    keys = newest.select("url_key").distinct()
    joined = keys.join(body("md"), "url_key", "left").join(body("html"), "url_key", "left").join(body("tokens"), "url_key", "left")
    counts = F.from_json("tokens", "htmlTokens INT, mdTokens INT")
    return (
        joined.select("url_key", F.col("md").alias("markdown"), "html", counts.alias("_t"))
        .select(
            "url_key", "markdown", "html",
            F.col("_t.htmlTokens").alias("html_tokens"),
            F.coalesce(
                F.col("_t.mdTokens"),
                F.when(F.col("markdown").isNotNull(), text.estimate_tokens(F.col("markdown")))).alias("md_tokens"),
            F.col("html").isNotNull().alias("html_cached"),
            F.col("markdown").isNotNull().alias("md_cached")))


def _behind(req, pending_s, key, ts, request_id, segment_s, most, carry=()):
    """Rows that start while an extraction of their key is in flight, with that extraction as ``_lead``."""
    start = F.unix_micros(ts)
    extracts = F.col("outcome").isin("miss", "fallback")
    done = start + F.col("latency_ms") * 1000
    end = F.when(extracts, F.least(done, start + pending_s * 1000000))
    rows = req.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(request_id), F.col(ts), *carry, start.alias("_start"),
        # the longest-running earlier extraction; the id makes ties repeatable, ``found`` is when its content is there
        F.when(end.isNotNull(), F.struct(
            end.alias("end"), F.col(request_id).alias("id"), F.when(F.col("outcome") == "miss", done).alias("found"))).alias("_own"))
    waits = carried(rows, "_key", ["_start", request_id], "_own", "_lead", F.col("_start"), segment_s, largest=True, most=most)
    return waits.filter(F.col("_lead.end") > F.col("_start"))


def in_flight_followers(req, pending_s=lists.TTL_PENDING_S, key="url_key", ts="ts", request_id="request_id", segment_s=300, most=100_000):
    """Requests that arrive while an extraction of the same key is in flight.

    A row with outcome ``miss`` or ``fallback`` extracts during
    ``[ts, min(ts + latency, ts + pending_s))``. A running maximum of the ends
    answers the question without forming pairs.
    """
    return _behind(req, pending_s, key, ts, request_id, segment_s, most).select(
        request_id, F.col("_key").alias(key), F.col(ts),
        F.col("_lead.id").alias("leader_id"),
        F.floor((F.col("_lead.end") - F.col("_start")) / 1000).alias("wait_ms"))


def wait_outcomes(req, pending_s=lists.TTL_PENDING_S, poll_ms=lists.WAIT_POLL_MS, polls=lists.WAIT_POLLS, mode="endpoint",
                  key="url_key", ts="ts", request_id="request_id", segment_s=300, most=100_000):
    """How the wait of each follower ends, by the mode of the request.

    A follower looks for the content every ``poll_ms``, ``polls`` times. The first look after its leader has stored the
    content is a ``hit``; a leader that fell back stores nothing. When all looks fail, ``render`` answers 503
    (``timeout``), while ``internal`` and ``proxy`` extract on their own (``extract``, without a status yet). Requests of
    other modes don't wait and give no row.
    """
    looks = F.greatest(F.lit(1), F.ceil((F.col("_lead.found") - F.col("_start")) / F.lit(poll_ms * 1000)))
    hit = F.col("_lead.found").isNotNull() & (looks <= polls)  # greatest() passes over NULL
    asked = req.filter(F.col(mode).isin("render", "internal", "proxy") | F.col("outcome").isin("miss", "fallback"))
    waits = _behind(asked, pending_s, key, ts, request_id, segment_s, most, carry=[F.col(mode).alias("_mode")])
    return waits.filter(F.col("_mode").isin("render", "internal", "proxy")).select(
        request_id, F.col("_key").alias(key), F.col("_mode").alias(mode), F.col("_lead.id").alias("leader_id"),
        F.when(hit, "hit").when(F.col("_mode") == "render", "timeout").otherwise("extract").alias("wait_outcome"),
        F.when(hit, 200).when(F.col("_mode") == "render", 503).alias("http_status"),
        (F.when(hit, looks).otherwise(F.lit(polls)) * poll_ms).cast("int").alias("waited_ms"))


def apply_invalidations(writes, invalidations, max_age_s=300, kinds=("md",)):
    """Writes that survive: a valid invalidation removes the earlier Markdown of its key, other kinds expire by age.

    ``invalidations(url_key, issued_at, received_at)``; those received more than
    ``max_age_s`` after they were issued are ignored.
    """
    fresh = F.unix_micros("received_at") - F.unix_micros("issued_at") <= max_age_s * 1000000
    cut = invalidations.filter(fresh).groupBy("url_key").agg(F.max("received_at").alias("_cut"))
    return writes.join(cut, "url_key", "left").filter(
        F.col("_cut").isNull() | (F.col("written_at") > F.col("_cut")) | ~F.col("kind").isin(*kinds)).drop("_cut")
