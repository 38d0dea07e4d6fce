"""Operators over crawl results and their job records."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from webmill import lists
from webmill.functions import urls
from webmill.functions.text import once
from webmill.operators.ranking import first_k
from webmill.schemas import CRAWL_RESULT


def explode_crawl(df, json_col="payload"):
    """One row per page of each completed crawl, with its ordinal."""
    keep = [c for c in df.columns if c != json_col]
    result = df.withColumn("_r", F.from_json(json_col, CRAWL_RESULT)).filter(F.col("_r.status") == "completed")
    return result.select(*keep, F.posexplode("_r.data").alias("ordinal", "_p")).select(
        *keep, "ordinal",
        F.col("_p.metadata.sourceURL").alias("url"),
        F.col("_p.metadata.title").alias("title"),
        F.col("_p.markdown").alias("markdown"))


def crawl_progress(df, json_col="payload"):
    """Counters of crawls that still run; absent counters are 0."""
    r = F.from_json(json_col, CRAWL_RESULT)
    keep = [c for c in df.columns if c != json_col]
    zero = lambda name: F.coalesce(F.col(f"_r.{name}"), F.lit(0))
    return df.withColumn("_r", r).filter(F.col("_r.status") != "completed").select(
        *keep, F.col("_r.status").alias("status"), zero("total").alias("total"),
        zero("completed").alias("completed"), zero("creditsUsed").alias("credits_used"),
        F.col("_r.expiresAt").alias("expires_at"))


def crawl_replies(df, as_of, json_col="payload"):
    """Every reply with its state and counters, none left out, from one parse.

    A reply that is absent, cut off or without a status is ``unreadable``. One that is not completed is ``expired`` from
    its time of expiry on, else ``running``. Absent counters are 0; ``pages`` is null for a reply without results.
    """
    keep = [c for c in df.columns if c != json_col]
    schema = StructType(CRAWL_RESULT.fields + [StructField("_bad", StringType())])
    r = F.from_json(json_col, schema, {"columnNameOfCorruptRecord": "_bad"})
    d = once(df, r, "r")
    unread = F.col("r._bad").isNotNull() | F.col("r.status").isNull()
    over = F.coalesce(F.try_to_timestamp("r.expiresAt") <= F.lit(as_of).cast("timestamp"), F.lit(False))
    state = F.when(unread, "unreadable").when(F.col("r.status") == "completed", "completed").when(over, "expired").otherwise("running")
    count = lambda name: F.when(~unread, F.coalesce(F.col(f"r.{name}"), F.lit(0)))
    return d.select(
        *keep, state.alias("state"), count("total").alias("total"), count("completed").alias("completed"),
        count("creditsUsed").alias("credits_used"), F.when(~unread, F.col("r.expiresAt")).alias("expires_at"),
        F.when(~unread & F.col("r.data").isNotNull(), F.size("r.data")).alias("pages"))


def live_jobs(jobs, as_of, life=lists.TTL_CRAWL_JOB_S):
    """Job records that still exist: ``life`` seconds from the start of the crawl, which a completion renews."""
    written = F.greatest("started_at", "completed_at")
    return jobs.filter(written + F.make_interval(secs=F.lit(life)) > F.lit(as_of).cast("timestamp"))


def filter_crawl(pages, jobs):
    """Verdict of each crawled page against its job record.

    A page is admitted if the requester owns the job, the job caches results,
    the page has text and a URL, and its host is allowed; an empty allowlist
    allows every host. Without a job record nothing is cached.
    """
    j = jobs.select(
        F.col("id").alias("crawl_id"), F.col("customer_id").alias("_owner"), F.col("cache_results").alias("_cache"),
        F.col("allowed_domains").alias("_allow"), F.lit(True).alias("_job"))
    d = urls.with_url_parts(pages, "url", "_u").join(j, "crawl_id", "left")
    host = urls.bare_host(F.col("_u.host"))
    allow = F.coalesce("_allow", F.array().cast("array<string>"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    verdict = (
        F.when(F.col("_job").isNull(), "no_job")
        .when(F.col("_owner") != F.col("customer_id"), "not_owner")
        .when(~F.coalesce("_cache", F.lit(False)), "not_cached")
        .when(blank("markdown") | blank("url"), "no_content")
        .when(~F.col("_u.ok"), "invalid_url")
        .when((F.size(allow) > 0) & ~F.array_contains(allow, host), "off_domain")
        .otherwise("admitted"))
    return d.withColumn("verdict", verdict).withColumn(
        "canonical", urls.serialise(F.col("_u"))).drop("_u", "_owner", "_cache", "_allow", "_job")


def cap_per_crawl(pages, jobs, n=lists.MAX_CRAWL_PAGES):
    """At most ``least(limit, n)`` pages of each crawl, in their order."""
    cap = jobs.select(F.col("id").alias("crawl_id"), F.least(F.col("limit"), F.lit(n)).alias("_cap"))
    d = pages.join(cap, "crawl_id", "left").withColumn("_cap", F.coalesce("_cap", F.lit(n)))
    return first_k(d, ["crawl_id"], ["ordinal"], "_cap").drop("_cap")


def crawl_summary(judged, jobs, n=lists.MAX_CRAWL_PAGES):
    """Totals per crawl: the pages reported as cached (all of them) and those really admitted."""
    verdict = lambda v: F.count_if(F.col("verdict") == v)
    sums = judged.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count(F.lit(1)).alias("reported_cached"),
        verdict("admitted").alias("admitted_pages"),
        verdict("off_domain").alias("off_domain_pages"))
    cap = jobs.select(F.col("id").alias("crawl_id"), F.least(F.col("limit"), F.lit(n)).alias("effective_limit"))
    return sums.join(cap, "crawl_id", "left")
