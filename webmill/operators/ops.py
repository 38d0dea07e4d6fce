"""Usage, quota, cost, request statistics and alerts."""

from functools import reduce

from pyspark.sql import functions as F

from webmill import lists


def usage_by_month(req, customer="customer_id", ts="ts"):
    """Extractions of the render endpoint per customer and UTC month, exact."""
    billed = (F.col("endpoint") == "render") & (F.col("outcome") == "miss")
    return (
        req.filter(billed & F.col(customer).isNotNull())
        .groupBy(customer, F.date_format(ts, "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("renders")))


def quota(usage, accounts, plans=None, overage_micros=lists.OVERAGE_MICROS, soft_factor=10):
    """Remaining renders, overage and its cost, and the soft limit.

    Money is in millionths of a dollar, so it is exact. Usage without an account
    and accounts without a known plan are named in ``problem`` and have no limits;
    only a plan listed without a number is unlimited.
    """
    plans = plans or lists.PLANS
    plan = F.col("plan")
    included = F.coalesce(*[F.when(plan == k, F.lit(v).cast("long")) for k, v in plans.items()])
    known = accounts.select(F.col("id").alias("customer_id"), "plan", F.lit(True).alias("_known"))
    d = usage.join(known, "customer_id", "left").withColumn("included", included).withColumn(
        "problem", F.when(F.col("_known").isNull(), "unknown_customer").when(~F.coalesce(plan.isin(*plans), F.lit(False)), "unknown_plan"))
    ok = F.col("problem").isNull()
    return d.withColumns({
        "remaining": F.when(ok, F.greatest(F.col("included") - F.col("renders"), F.lit(0))),
        "overage": F.when(ok, F.coalesce(F.greatest(F.col("renders") - F.col("included"), F.lit(0)), F.lit(0))),
        "soft_limited": F.when(ok, F.coalesce(F.col("renders") > F.col("included") * soft_factor, F.lit(False))),
    }).withColumn("overage_micros", F.col("overage") * overage_micros).drop("_known")


def cost(usage, rate_micros=lists.EXTRACTION_MICROS):
    """Extraction cost per customer and month, in millionths of a dollar."""
    return usage.withColumn("cost_micros", F.col("renders") * rate_micros)


def request_stats(req, by):
    """Counts by outcome, errors and latency per group, over the full log.

    Rows are first counted per latency value: the exact percentiles are then
    taken over distinct values with frequencies, and a hot group is combined
    before the shuffle.
    """
    outcome = lambda name: F.sum(F.when(F.col("outcome") == name, F.col("_n")).otherwise(0))
    small = req.groupBy(*by, "latency_ms", "outcome", "status").agg(F.count(F.lit(1)).alias("_n"))
    pct = lambda p: F.floor(F.expr(f"percentile(latency_ms, {p}, _n)") * 100 + 0.5).alias(f"p{int(p * 100)}_centims")
    return small.groupBy(*by).agg(
        F.sum("_n").alias("requests"),
        *[outcome(o).alias(f"{o}_count") for o in ("hit", "miss", "fallback", "error")],
        F.sum(F.when(F.col("status") >= 400, F.col("_n")).otherwise(0)).alias("http_errors"),
        # cache statistics count only answered requests: refusals look like misses
        F.sum(F.when((F.col("status") == 200) & (F.col("outcome") == "hit"), F.col("_n")).otherwise(0)).alias("ok_hits"),
        F.sum(F.when(F.col("status") == 200, F.col("_n")).otherwise(0)).alias("ok_requests"),
        F.sum(F.col("latency_ms") * F.col("_n")).alias("latency_sum_ms"),
        pct(0.5), pct(0.95))


def minute_counts(req, ts="ts"):
    """Per-minute counts: all that the sliding alerts need."""
    one = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    return req.groupBy(F.floor(F.unix_seconds(ts) / 60).alias("minute")).agg(
        F.count(F.lit(1)).alias("requests"),
        one(F.col("outcome") == "fallback").alias("fallbacks"),
        F.count("extractor_status").alias("extractor_calls"),
        one(F.col("extractor_status") >= 500).alias("extractor_5xx"))


def _slide(minutes, width):
    """Sliding windows of ``width`` minutes, one per minute, from minute counts."""
    starts = F.explode(F.sequence(F.col("minute") - (width - 1), F.col("minute"))).alias("window_start_min")
    return minutes.select(starts, "*").groupBy("window_start_min").agg(
        *[F.sum(c).alias(c) for c in ("requests", "fallbacks", "extractor_calls", "extractor_5xx")])


def fallback_fires(counts, rule):
    """Whether a fallback rule fires on window counts (all bounds are strict)."""
    return (counts["requests"] > rule["over"]) & (counts["fallbacks"] * rule["den"] > counts["requests"] * rule["num"])


def extractor_fires(counts, rule):
    return counts["extractor_5xx"] * rule["den"] > counts["extractor_calls"] * rule["num"]


def rules_on(windows, rule):
    """Rows of ``windows`` on which a fallback rule fires."""
    return windows.filter(fallback_fires(windows, rule)).select(
        F.lit(rule["rule"]).alias("rule"), F.lit(rule["level"]).alias("level"), "window_start_min",
        "requests", F.col("fallbacks").alias("events"))


def extractor_on(windows, rule):
    return windows.filter(extractor_fires(windows, rule)).select(
        F.lit(rule["rule"]).alias("rule"), F.lit(rule["level"]).alias("level"), "window_start_min",
        F.col("extractor_calls").alias("requests"), F.col("extractor_5xx").alias("events"))


def fallback_alerts(req, rules=None, extractor=None):
    """Sliding alerts, one window per minute.

    The log is reduced to minutes first; only the minutes are copied into the
    overlapping windows.
    """
    rules = lists.ALERT_RULES if rules is None else rules
    extractor = extractor or lists.EXTRACTOR_ALERT
    minutes = minute_counts(req)
    found = [rules_on(_slide(minutes, r["window_min"]), r) for r in rules]
    found.append(extractor_on(_slide(minutes, 15), extractor))
    return reduce(lambda a, b: a.unionByName(b), found)


def non_200_to_crawlers(req, by=("mode",)):
    """Answers to crawlers that were not 200; there should be none."""
    bad = F.col("is_ai") & (F.col("status") != 200)
    return req.filter(bad).groupBy(*by, "status").agg(F.count(F.lit(1)).alias("requests"))
