"""Operators over request rows: classification, routing, hygiene, sampling."""

from functools import reduce

from pyspark.sql import functions as F

from webmill import lists
from webmill.functions import text, urls


def flag_ai_agents(req, agents=None, overrides=None, ua="user_agent", out="is_ai"):
    """AI-crawler flag; ``overrides(customer_id, include, exclude)`` is optional.

    Excludes beat includes; an empty include string matches every agent. The
    default list is one alternation, so only override rows need a join.
    """
    base = text.is_ai_agent(F.col(ua), agents)
    if overrides is None:
        return req.withColumn(out, base)
    lower = F.lower(F.col(ua))
    hit = lambda names: F.coalesce(F.exists(F.col(names), lambda w: lower.contains(F.lower(w))), F.lit(False))
    joined = req.join(
        overrides.select("customer_id", F.col("include").alias("_inc"), F.col("exclude").alias("_exc")),
        "customer_id", "left")
    some = F.coalesce(F.col(ua), F.lit("")) != ""
    return joined.withColumn(out, some & ~hit("_exc") & (base | hit("_inc"))).drop("_inc", "_exc")


def bot_family(req, ua="user_agent"):
    return req.withColumn("bot_family", text.bot_family(F.col(ua)))


def route_traffic(req, ua="user_agent", path="path"):
    """``optimise`` for AI crawlers on content paths, else ``passthrough`` and why."""
    reason = (
        F.when(~text.is_ai_agent(F.col(ua)), "not_ai_agent")
        .when(urls.is_asset_path(F.col(path), lists.SERVING_ASSETS), "static_asset")
        .when(text.starts_with_any(F.col(path), lists.BLOCKED_PATHS), "blocked_path"))
    return req.withColumn("reason", reason).withColumn(
        "route", F.when(F.col("reason").isNull(), "optimise").otherwise("passthrough"))


def endpoint_class(req, method="method", path="path", crawl_path="/_service/crawl"):
    """Endpoint of a request; the order of the tests matters."""
    m, p = F.col(method), F.col(path)
    return req.withColumn(
        "endpoint",
        F.when(m == "OPTIONS", "cors")
        .when(p == "/render", "render")
        .when(p == "/render/internal", "internal")
        .when(p == "/render/content", "content")
        .when((p == crawl_path) & (m == "POST"), "crawl_start")
        .when(p.rlike(f"^{crawl_path}/[a-zA-Z0-9-]+$") & (m == "GET"), "crawl_status")
        .otherwise("proxy"))


def scrub_headers(req, col="headers", mode="strip", token_header="x-api-token"):
    """``strip`` removes sensitive headers; ``safe`` keeps only harmless ones."""
    if mode == "strip":
        drop = lists.STRIP_HEADERS + [token_header]
        keep = lambda k, v: ~F.lower(k).isin(drop)
    else:
        keep = lambda k, v: F.lower(k).isin(lists.SAFE_HEADERS)
    return req.withColumn(col, F.map_filter(col, keep))


def normalise_outcome(req, col="status_word", out="outcome"):
    """One vocabulary for all status words; unknown words give NULL."""
    word = F.lower(F.col(col))
    chain = [F.when(word == k, F.lit(v)) for k, v in lists.OUTCOMES.items()]
    return req.withColumn(out, F.coalesce(*chain))


def hash_bucket(col, buckets):
    """Stable bucket of an id, the same on every run and engine."""
    return F.pmod(F.conv(F.left(F.md5(col.cast("string")), F.lit(7)), 16, 10).cast("long"), F.lit(buckets))


def sample_log(log, rate=lists.LOG_SAMPLE_RATE, key="request_id", is_error="is_error"):
    """All errors and a stable share of the rest, with inverse-probability weights."""
    err = F.coalesce(F.col(is_error), F.lit(False))
    kept = log.filter(err | (hash_bucket(F.col(key), 10000) < int(round(rate * 10000))))
    return kept.withColumn("weight", F.when(err, F.lit(1.0)).otherwise(F.lit(1.0 / rate)))


def retain(log, days, as_of, ts="ts", url="url", drop=()):
    """Privacy and retention: the URL becomes a key, bodies go, old rows go.

    The age filter is a plain comparison with a constant, so it prunes files.
    """
    kept = log.filter(F.col(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    d = urls.with_url_parts(kept, url, "_parts")
    d = d.withColumn("url_key", urls.url_key(urls.serialise(F.col("_parts"))))
    return d.drop("_parts", url, *drop)


def classifier_drift(req, agent_lists, ua="user_agent"):
    """Requests on which agent lists disagree, counted for each agent.

    ``agent_lists`` maps a name to its substrings. Flags depend only on the
    agent text, so requests are counted before anything is compared.
    """
    counts = req.groupBy(F.coalesce(F.col(ua), F.lit("")).alias(ua)).agg(F.count(F.lit(1)).alias("requests"))
    flags = {f"by_{name}": text.is_ai_agent(F.col(ua), words) for name, words in agent_lists.items()}
    flagged = counts.withColumns(flags)
    names = list(flags)
    differ = reduce(lambda a, b: a | b, [F.col(names[0]) != F.col(n) for n in names[1:]])
    return flagged.filter(differ)


def list_drift(req, agent_lists, ua="user_agent"):
    """Agents that some of the lists lack, the lists that hold them, and the requests whose agent text names them."""
    named = sorted({a for words in agent_lists.values() for a in words})
    drift = [a for a in named if not all(a in words for words in agent_lists.values())]
    agents = F.array(*[F.lit(a) for a in drift]) if drift else F.array().cast("array<string>")
    counts = req.groupBy(F.lower(F.coalesce(F.col(ua), F.lit(""))).alias("_ua")).agg(F.count(F.lit(1)).alias("_n"))
    hits = counts.select(F.explode(F.filter(agents, lambda a: F.col("_ua").contains(a))).alias("agent"), "_n")
    # one row of no requests for each agent, so that those nobody uses are listed too
    idle = req.sparkSession.range(1).select(F.explode(agents).alias("agent"), F.lit(0).cast("long").alias("_n"))
    found = hits.unionByName(idle).groupBy("agent").agg(F.sum("_n").alias("requests"))
    return found.withColumns({f"in_{name}": F.col("agent").isin(*words) for name, words in agent_lists.items()})


def effective_agents(overrides, agents=None):
    """Default agents plus a customer's includes, minus the excluded ones."""
    default = F.array(*[F.lit(a) for a in (agents or lists.AI_AGENTS)])
    lowered = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    merged = F.array_union(default, lowered("include"))
    left = F.filter(merged, lambda a: ~F.exists(lowered("exclude"), lambda x: a.contains(x)))
    return overrides.select("customer_id", F.explode(left).alias("agent"))
