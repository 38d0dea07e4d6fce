"""Whole jobs, composed from the operators."""

from pyspark.sql import functions as F

from webmill.functions import text, urls
from webmill.operators import access, cache, crawl, pages as page_ops, report, seeds, traffic


def token_savings_by_section(pages):
    """Tokens saved per host and site section, each page counted once.

    Extraction runs where the HTML is read and only token counts are shuffled. Copies of a page meet in a shuffle of
    narrow rows, where the smallest page id wins; host and section follow from
    the key, so the aggregate holds only numbers and stays a hash aggregate.
    """
    c = page_ops.extract_markdown(page_ops.with_url_key(page_ops.canonicalise(pages)))
    good = c.filter(F.col("canonical").isNotNull() & F.col("markdown").isNotNull()).select(
        "url_key", "page_id", "host", urls.section_of(F.col("path")).alias("section"), "html_tokens", "md_tokens")
    one = good.groupBy("url_key", "host", "section").agg(
        F.min_by("html_tokens", "page_id").alias("html_tokens"), F.min_by("md_tokens", "page_id").alias("md_tokens"))
    sums = one.groupBy("host", "section").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.col("html_tokens").cast("long")).alias("html_tokens"),
        F.sum(F.col("md_tokens").cast("long")).alias("md_tokens"))
    return sums.withColumn("saved_tokens", F.col("html_tokens") - F.col("md_tokens")).withColumn(
        "savings_pct", text.savings_pct(F.col("html_tokens"), F.col("md_tokens")))


def serve_requests(req, config, writes, **cache_options):
    """The read path over a log: endpoint, admission, key, cache status and crawler class."""
    r = traffic.endpoint_class(req).filter(F.col("endpoint") == "render")
    judged = page_ops.with_url_key(page_ops.canonicalise(access.admit(r, config, mode="render"), "url"))
    passed = F.col("http_status") == 200
    # refused requests look for nothing; a key of their own keeps them from piling up
    probe = F.when(passed, F.col("url_key")).otherwise(F.concat(F.lit("refused:"), F.col("request_id").cast("string")))
    carry = ["customer_id", "http_status", "error_code", "is_ai"]
    narrow = traffic.flag_ai_agents(judged).select("request_id", "ts", *carry, probe.alias("url_key"))
    found = cache.cache_lookup(narrow, writes, carry=carry, **cache_options)
    return found.select("request_id", *carry, F.when(passed, F.col("cache_status")).alias("cache_status"))


def refresh_starter_lists(site_maps, seed_table):
    """Site maps to ``(candidates, merged seeds)``."""
    candidates = seeds.starter_candidates(site_maps)
    return candidates, seeds.merge_starter(seed_table, candidates)


def overview_rows(site_maps, metrics):
    """The overview report of fresh starter lists, ranked for display."""
    candidates = seeds.starter_candidates(site_maps)
    listed = report.rank_sections(candidates, by=("customer_id", "domain_id"))
    return report.overview(listed, metrics)


def store_crawl(payloads, jobs):
    """Crawl replies to judged pages, all of them, and write-log input with token counts."""
    judged = crawl.filter_crawl(crawl.explode_crawl(payloads), jobs)
    keyed = page_ops.with_url_key(judged.filter(F.col("verdict") == "admitted"))
    return judged, keyed.withColumn("md_tokens", text.estimate_tokens(F.col("markdown")))
