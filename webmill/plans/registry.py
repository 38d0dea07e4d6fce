"""Registered queries: one per operator, over the base tables and tables derived from them."""

from pyspark.sql import functions as F

from webmill import lists, schemas
from webmill.functions import sql as sql_functions
from webmill.functions import urls
from webmill.operators import (
    access, audits, cache, crawl, golden, ops, pages as page_ops, report, seeds, traffic,
)
from webmill.plans import flows
from webmill.plans.derived import AS_OF, CONFIG_TIME, Derived, spread
from webmill.session import use_utc, work_dir
from webmill.sources import readers, sinks
from webmill.streaming import cache_state, jobs, single_flight

QUERIES = {}

# Parameters of single queries, shared with the SQL twins.
SMALL_PLANS = {"free": 2, "pro": 5, "team": 20, "enterprise": None}
RETAIN_AS_OF, RETAIN_DAYS = "2024-01-31 01:00:00", 30
SITE_CAP = 3
PANELS_AS_OF = "2024-01-01 01:03:00"
LATENCY_FACTOR = 100

seconds = lambda c, name: F.unix_seconds(c).alias(name)


def query(fn):
    def run(spark, sf_dir):
        return fn(Derived(use_utc(spark), sf_dir))
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def staged(frame, name):
    """Write a frame to the shared folder, by the tasks that make it, and give its path."""
    path = work_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return path


def as_stream(frame, name):
    """The rows of ``frame`` as a file stream."""
    spark = frame.sparkSession
    return spark.readStream.schema(frame.schema).parquet(staged(frame, name))


def finish(running):
    running.awaitTermination()


@query
def token_savings_by_section(d):
    return flows.token_savings_by_section(spread(d.pages_twice()))


# --- sources and sinks --------------------------------------------------------

@query
def s1_load_pages(d):
    return d.pages().select("page_id", "url", F.octet_length("html").alias("html_bytes"))


@query
def s2_request_log(d):
    """Log lines written as JSON, some of them cut off, and read back with a quarantine."""
    path = work_dir(d.spark, "log")
    line = F.to_json(F.struct("*"))
    cut = F.col("requestId").cast("long") % 101 == 0
    d.request_log().select(F.when(cut, F.left(line, F.lit(40))).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.split_corrupt(readers.load_request_log(d.spark, path))
    rows = readers.tidy_log(good).select(
        F.lit("good").alias("state"), F.col("request_id").alias("ref"), seconds(F.col("ts"), "ts_s"),
        "bot_family", "status", "is_error", F.size("logs").alias("entries"))
    return rows.unionByName(bad.select(F.lit("quarantine").alias("state"), F.col("line").alias("ref")),
                            allowMissingColumns=True)


@query
def s3_explode_site_map(d):
    return seeds.explode_site_map(d.site_maps()).select("customer_id", "domain_id", "ordinal", "url")


@query
def s4_explode_crawl(d):
    return crawl.explode_crawl(d.crawl_payloads()).select(
        "crawl_id", "ordinal", "url", "title", F.length("markdown").alias("md_chars"))


@query
def s4_crawl_replies(d):
    return crawl.crawl_replies(d.crawl_polls(), AS_OF)


@query
def s5_load_accounts(d):
    path = work_dir(d.spark, "accounts")
    for name, frame in d.account_tables().items():
        frame.write.parquet(f"{path}/{name}")
    t = readers.load_accounts(d.spark, path)
    counts = {"domains": "domain_count", "api_tokens": "token_count", "seed_urls": "seed_count",
              "map_snapshots": "snapshot_count", "publish_jobs": "job_count", "url_metrics": "metric_count"}
    joined = t["customers"]
    for name, out in counts.items():
        rows = t[name].groupBy(F.col("customer_id").alias("id")).agg(F.count(F.lit(1)).alias(out))
        joined = joined.join(rows, "id", "left")
    return joined.select("id", "plan", seconds(F.col("created_at"), "created_s"),
                         *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.values()])


@query
def s6_content_store(d):
    """Content appended to the write log and read back; newest row per key and kind."""
    path = work_dir(d.spark, "content")
    c = d.spread_pages()
    c = page_ops.with_url_key(page_ops.canonicalise(c)).withColumn("raw", F.col("html"))
    c = d.spark.read.parquet(staged(page_ops.extract_markdown(c), "extracted"))
    for turn in (0, 1):
        sinks.write_content(c.select(
            (F.col("page_id") * 2 + turn).alias("wid"), "url_key", "markdown",
            F.when(F.col("page_id") % 3 == turn, F.col("raw")).alias("html"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") + turn * 3600).alias("written_at")), path)
    # bodies are measured where they are read; the aggregate holds numbers only
    narrow = readers.read_content(d.spark, path).select("url_key", "kind", "wid", "ttl_s", "written_at", F.length("body").alias("body_chars"))
    return narrow.groupBy("url_key", "kind").agg(*[F.max_by(c, "written_at").alias(c) for c in ("wid", "ttl_s", "body_chars")])


def metric_rows(frame):
    return frame.select("customer_id", "url", "html_tokens", "md_tokens",
                        seconds(F.col("optimized_at"), "optimized_s"),
                        seconds(F.col("created_at"), "created_s"), seconds(F.col("updated_at"), "updated_s"))


@query
def s7_metrics_sink(d):
    """Two batches, the first of them delivered twice."""
    path = work_dir(d.spark, "metrics")
    bodies = d.spark.read.parquet(staged(d.metric_bodies(), "bodies"))
    first = F.col("seq") < d.events().count() // 2
    for batch_id, part in ((0, bodies.filter(first)), (0, bodies.filter(first)), (1, bodies.filter(~first))):
        sinks.append_metrics(part, batch_id, path)
    return metric_rows(sinks.read_metrics(d.spark, path))


@query
def s7_metric_table(d):
    """Three batches: two merged into versions of the table, the first delivered again, the last still a change."""
    log, table = work_dir(d.spark, "metrics"), work_dir(d.spark, "metric-table")
    bodies = d.spark.read.parquet(staged(d.metric_bodies(), "bodies"))
    third = F.floor(F.col("seq") * 3 / d.events().count())
    for batch_id, merge in ((0, True), (0, False), (1, True), (2, False)):
        sinks.append_metrics(bodies.filter(F.least(third, F.lit(2)) == batch_id), batch_id, log)
        if merge:
            sinks.merge_metrics(d.spark, log, table, buckets=8)
    return metric_rows(sinks.read_metric_table(d.spark, log, table))


@query
def s8_publish_config(d):
    path = work_dir(d.spark, "config")
    sinks.publish_config(access.config_diff(d.config(), d.published()), path)
    put = d.spark.read.schema("key STRING, document STRING").json(f"{path}/put")
    gone = d.spark.read.schema("key STRING").json(f"{path}/delete")
    return put.withColumn("action", F.lit("put")).unionByName(
        gone.withColumn("action", F.lit("delete")), allowMissingColumns=True)


@query
def s9_replace_snapshot(d):
    """All snapshots, then those of verified domains again with a later time."""
    path = work_dir(d.spark, "snapshots")
    found = d.spark.read.parquet(staged(seeds.starter_candidates(d.site_maps()), "candidates"))
    sinks.replace_snapshot(d.spark, found, path, "2024-01-01 00:00:00")
    verified = d.domains().filter("verified").select(F.col("id").alias("domain_id"))
    sinks.replace_snapshot(d.spark, found.join(verified, "domain_id"), path, "2024-01-02 00:00:00")
    snap = sinks.read_snapshots(d.spark, path)
    listed = sinks.snapshot_urls(snap)
    return listed.join(
        snap.select("domain_id", seconds(F.col("fetched_at"), "fetched_s"), seconds(F.col("created_at"), "created_s")),
        "domain_id").select("customer_id", "domain_id", "ordinal", "url", "fetched_s", "created_s")


# --- projections and predicates -----------------------------------------------

@query
def p1_canonicalise(d):
    return page_ops.canonicalise(d.pages_twice().select("page_id", "url")).drop("url")


@query
def p2_normalise_seeds(d):
    found = seeds.explode_site_map(d.site_maps())
    return page_ops.normalise_seeds(found).select("domain_id", "ordinal", "url", "seed_url", "host", "path")


@query
def p3_normalise_host(d):
    p = page_ops.canonicalise(d.pages().select("page_id", "url")).select(
        "page_id", F.concat(F.lit("https://WWW."), F.upper("host"), F.lit("/")).alias("typed"),
        F.concat(F.lit("Www."), F.col("host")).alias("stored"))
    p = page_ops.normalise_host(p, "typed", "from_typed", from_input=True)
    return page_ops.normalise_host(p, "stored", "from_stored").select("page_id", "from_typed", "from_stored")


@query
def p4_url_key(d):
    p = page_ops.canonicalise(d.pages_twice().select("page_id", "url"))
    return page_ops.with_url_key(p).select("page_id", "url_key", "canon_version")


@query
def p5_ai_agents(d):
    return traffic.flag_ai_agents(d.requests()).select("request_id", "user_agent", "is_ai")


@query
def p5_agent_overrides(d):
    return traffic.flag_ai_agents(d.requests(), overrides=d.overrides()).select("request_id", "customer_id", "is_ai")


@query
def p6_bot_family(d):
    return traffic.bot_family(d.requests()).select("request_id", "bot_family")


@query
def p7_route_traffic(d):
    return traffic.route_traffic(d.requests()).select("request_id", "route", "reason")


@query
def p8_private_hosts(d):
    r = urls.with_url_parts(d.requests().select("request_id", "url"), "url", "u").select(
        "request_id", F.col("u.host").alias("host"))
    return page_ops.flag_private_hosts(r)


def admitted(d, mode):
    return access.admit(d.requests(), d.config(), mode).select(
        "request_id", "customer_id", "http_status", "error_code")


@query
def p9_admit_render(d):
    return admitted(d, "render")


@query
def p9_admit_internal(d):
    return admitted(d, "internal")


@query
def p9_admit_crawl(d):
    return admitted(d, "crawl")


@query
def p10_reject_html(d):
    return page_ops.reject_html(d.writes().filter(F.col("kind") == "md"), "body").select("wid", "url_key")


@query
def p11_extract_markdown(d):
    return page_ops.extract_markdown(d.spread_pages()).drop("url")


@query
def p12_scrub_headers(d):
    keys = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",")
    h = d.headers().withColumn("safe", F.col("headers"))
    h = traffic.scrub_headers(traffic.scrub_headers(h, "headers", "strip"), "safe", "safe")
    return h.select("request_id", keys(F.col("headers")).alias("kept"), keys(F.col("safe")).alias("safe"),
                    F.col("safe")["Accept-Language"].alias("language"))


@query
def p13_normalise_outcome(d):
    return traffic.normalise_outcome(d.requests().select("request_id", "status_word"))


@query
def p14_preview(d):
    return page_ops.preview(d.content()).select("page_id", "preview", "truncated", "size_label")


@query
def p14_preview_panels(d):
    """Both panels of every page, at a time when some content is live, some has expired and some has not been written again."""
    owner = d.domains().select(F.col("hostname").alias("host"), "customer_id")
    listed = d.content().select("canonical", "host", "url_key").join(owner, "host").select(
        "customer_id", F.col("canonical").alias("url"), "url_key")
    p = page_ops.preview_panels(listed, cache.content_bundle(d.writes(), PANELS_AS_OF), d.metrics())
    return p.withColumn("html_preview", F.md5("html_preview"))


@query
def p15_split_valid_metrics(d):
    return report.split_valid_metrics(d.metric_bodies()).select(
        "seq", "error_code", "customer_id", "url", "html_tokens", "md_tokens",
        seconds(F.col("optimized_at"), "optimized_s"))


@query
def p16_sample_log(d):
    log = d.requests().withColumn("is_error", F.col("status") >= 400)
    return traffic.sample_log(log).select("request_id", "weight")


@query
def p17_retain(d):
    log = d.requests().select("request_id", "ts", "url", "token")
    return traffic.retain(log, RETAIN_DAYS, RETAIN_AS_OF, drop=["token"]).select("request_id", "url_key")


@query
def p18_endpoint_class(d):
    return d.endpoint_requests().select("request_id", "method", "path", "endpoint")


# --- joins --------------------------------------------------------------------

@query
def j1_auth_lookup(d):
    return access.auth_lookup(d.requests(), d.config()).select("request_id", "auth_customer", "auth_found")


@query
def j2_config_by_customer(d):
    return access.config_by_customer(d.requests(), d.config()).select("request_id", "customer_id", "auth_found")


@query
def j3_allowed_domain(d):
    return access.allowed_domain(d.requests(), d.domains(), host="page_host").select("request_id", "customer_id", "page_host")


@query
def j3_denied_domain(d):
    return access.allowed_domain(d.requests(), d.domains(), keep="anti", host="page_host").select(
        "request_id", "customer_id", "page_host")


@query
def j4_cache_lookup(d):
    return cache.cache_lookup(d.keyed_requests(), d.writes()).drop("ts")


@query
def j5_content_bundle(d):
    b = cache.content_bundle(d.writes(), AS_OF)
    return b.withColumn("markdown", F.length("markdown")).withColumn("html", F.length("html"))


@query
def j6_overview(d):
    return report.overview(d.owned_urls(), d.metrics()).select("customer_id", "url", "status", "savings", "last_optimized")


@query
def j7_merge_starter(d):
    return seeds.merge_starter(d.seeds(), seeds.starter_candidates(d.site_maps()))


@query
def j8_filter_crawl(d):
    return crawl.filter_crawl(d.crawl_pages(), d.crawl_jobs()).select("crawl_id", "ordinal", "verdict", "canonical")


@query
def j8_live_crawl_jobs(d):
    """Pages against the job records that have not expired."""
    judged = crawl.filter_crawl(d.crawl_pages(), crawl.live_jobs(d.crawl_jobs(), AS_OF))
    return judged.select("crawl_id", "ordinal", "verdict", "canonical")


@query
def j9_in_flight_followers(d):
    r = d.requests().withColumn("latency_ms", F.col("latency_ms") * LATENCY_FACTOR)
    return cache.in_flight_followers(r, key="page_host").drop("ts")


@query
def j9_wait_outcomes(d):
    r = d.endpoint_requests().withColumn("latency_ms", F.col("latency_ms") * LATENCY_FACTOR)
    return cache.wait_outcomes(r, key="page_host")


@query
def j10_apply_invalidations(d):
    return cache.apply_invalidations(d.writes().drop("body"), d.invalidations()).select("wid", "url_key", "kind")


@query
def j11_config_diff(d):
    return access.config_diff(d.config(), d.published()).select("key", "action")


@query
def j12_golden_diff(d):
    c = d.spark.read.parquet(staged(d.content().select("page_id", "url", "markdown"), "actual"))
    i = F.col("page_id")
    body = (
        F.when(i % 4 == 1, F.replace("markdown", F.lit("\n"), F.lit("\r\n")))
        .when(i % 4 == 2, F.concat("markdown", F.lit(" end")))
        .when(i % 4 == 3, F.replace("markdown", F.lit("the"), F.lit("thE")))
        .otherwise(F.col("markdown")))
    old = c.filter(F.col("url").startswith("https:")).select(i.alias("key"), body.alias("body"))
    extra = c.filter(F.col("url").startswith("http:")).select((i + 1000000000).alias("key"), F.lit("gone").alias("body"))
    return golden.golden_diff(c.select(i.alias("key"), F.col("markdown").alias("body")), old.unionByName(extra))


# --- aggregations -------------------------------------------------------------

@query
def a1_dedupe_urls(d):
    found = page_ops.normalise_seeds(seeds.explode_site_map(d.site_maps())).filter(F.col("seed_url").isNotNull())
    return seeds.dedupe_urls(found, ("customer_id", "seed_url"))


@query
def a2_section_report(d):
    return report.section_report(d.owned_urls().select("customer_id", "url").distinct())


def usage(d):
    return ops.usage_by_month(d.endpoint_requests())


@query
def a3_usage(d):
    return usage(d)


@query
def a4_quota(d):
    return ops.quota(usage(d), d.accounts(), SMALL_PLANS, soft_factor=2)


@query
def a5_request_stats(d):
    r = traffic.normalise_outcome(traffic.bot_family(d.endpoint_requests()))
    return ops.request_stats(r, ["bot_family", "endpoint"])


@query
def a6_token_limits(d):
    return access.token_limits(d.tokens())


@query
def a7_fallback_alerts(d):
    return ops.fallback_alerts(d.requests())


@query
def a8_crawl_summary(d):
    judged = crawl.filter_crawl(d.crawl_pages(), d.crawl_jobs())
    return crawl.crawl_summary(judged, d.crawl_jobs())


@query
def a9_build_config(d):
    return access.build_config(d.accounts(), d.domains(), d.tokens(), CONFIG_TIME)


@query
def a10_cost(d):
    return ops.cost(usage(d))


@query
def a11_token_accounting(d):
    return page_ops.token_accounting(d.content()).select(
        "page_id", "html_tokens", "md_tokens", "saved_tokens", "savings_pct")


@query
def a11_token_rollup(d):
    c = d.content().withColumn("section", urls.section_of(F.col("path")))
    owned = c.join(d.domains().select(F.col("hostname").alias("host"), "customer_id"), "host")
    return page_ops.token_accounting(owned, ["customer_id", "section"])


# --- one row per group, upserts, scales ---------------------------------------

@query
def w1_primary_domain(d):
    return access.primary_domain(d.domains()).select("customer_id", "id", "hostname")


@query
def w2_latest_active_token(d):
    return access.latest_active_token(d.tokens()).select("customer_id", "id", "token_hash")


@query
def w3_upsert(d):
    return metric_rows(report.upsert(d.metrics(), d.metric_changes(), ["customer_id", "url"], "seq", at="received_at"))


@query
def w4_bar_scale(d):
    bars = traffic.bot_family(d.endpoint_requests()).groupBy("bot_family", "endpoint").agg(F.count(F.lit(1)).alias("value"))
    return report.bar_scale(bars, "value", ["bot_family"])


@query
def w5_upsert_keep_known(d):
    return metric_rows(report.upsert_keep_known(
        d.metrics(), d.metric_changes(), ["customer_id", "url"], "seq", at="received_at"))


# --- orders and caps ----------------------------------------------------------

@query
def l1_rank_sections(d):
    listed = seeds.dedupe_urls(d.owned_urls())
    return report.rank_sections(listed).select("customer_id", "section", "url", "section_rank", "url_rank")


@query
def l2_cap_per_site(d):
    return seeds.cap_per_site(d.owned_urls(), SITE_CAP).select("customer_id", "host", "ordinal", "url")


@query
def l3_cap_per_crawl(d):
    return crawl.cap_per_crawl(d.crawl_pages(), d.crawl_jobs()).select("crawl_id", "ordinal", "url")


@query
def l4_first_per_group(d):
    r = d.requests().select("customer_id", "request_id", "ts", "path")
    return access.first_per_group(r, ["customer_id"], ["ts", "request_id"], newest=True).select(
        "customer_id", "request_id", "path")


# --- sets ---------------------------------------------------------------------

@query
def x1_distinct_urls(d):
    return seeds.distinct_urls(seeds.explode_site_map(d.site_maps()))


@query
def x2_new_urls(d):
    return seeds.new_urls(seeds.starter_candidates(d.site_maps()), d.seeds()).select("customer_id", "domain_id", "url")


@query
def x3_classifier_drift(d):
    return traffic.classifier_drift(d.requests(), {"serving": lists.AI_AGENTS, "sample": lists.SAMPLE_AGENTS})


@query
def x3_list_drift(d):
    return traffic.list_drift(d.requests(), {"serving": lists.AI_AGENTS, "sample": lists.SAMPLE_AGENTS})


@query
def x4_effective_agents(d):
    return traffic.effective_agents(d.overrides())


# --- SQL functions ------------------------------------------------------------

@query
def f1_sql_urls(d):
    """URL helpers called from SQL."""
    sql_functions.register(d.spark)
    return d.spark.sql("""
        SELECT page_id, canonical, url_key(canonical) AS url_key, seed, host FROM (
            SELECT page_id, canonical_url(url) AS canonical, seed_url(url) AS seed, bare_host(parse_url(url, 'HOST')) AS host FROM {pages})""",
        pages=d.pages().select("page_id", "url"))


@query
def f2_sql_agents(d):
    """Agent helpers called from SQL, counted for each family."""
    sql_functions.register(d.spark)
    return d.spark.sql("""
        SELECT bot_family(user_agent) AS family, is_ai_agent(user_agent) AS is_ai, count(*) AS requests
        FROM {requests} GROUP BY 1, 2""", requests=d.requests())


@query
def f3_sql_crawl_pages(d):
    """Crawled pages from replies in all states, by a SQL function that gives an array."""
    sql_functions.register(d.spark)
    return d.spark.sql("""
        SELECT crawl_id, poll, ordinal, page.url, page.title, token_estimate(page.markdown) AS md_tokens,
            looks_like_html(page.markdown) AS is_html
        FROM (SELECT crawl_id, poll, crawl_pages(payload) AS found FROM {polls})
        LATERAL VIEW posexplode(found) AS ordinal, page""", polls=d.crawl_polls())


# --- streams ------------------------------------------------------------------

def extractions(d):
    """Requests that need an extraction, keyed by host, with stretched latencies so that they overlap."""
    return d.requests().filter(F.col("outcome").isin("miss", "fallback")).select(
        "request_id", "ts", F.col("page_host").alias("url_key"), (F.col("latency_ms") * LATENCY_FACTOR).alias("latency_ms"))


@query
def t1_single_flight(d):
    path = work_dir(d.spark, "t1")
    finish(single_flight.single_flight_sink(as_stream(extractions(d), "requests"), path, work_dir(d.spark, "check")))
    return single_flight.single_flight_answers(d.spark, path)


@query
def t2_metrics_stream(d):
    events = as_stream(d.metric_bodies(), "bodies")
    path = work_dir(d.spark, "t2")
    finish(jobs.metrics_stream(events, path, work_dir(d.spark, "check")))
    return metric_rows(sinks.read_metrics(d.spark, path))


@query
def t3_usage_stream(d):
    r = as_stream(d.endpoint_requests().select("customer_id", "ts", "endpoint", "outcome"), "requests")
    path = work_dir(d.spark, "t3")
    finish(jobs.usage_sink(r, path, work_dir(d.spark, "check")))
    return jobs.usage_months(d.spark, path)


@query
def t4_alert_stream(d):
    stream = jobs.alert_stream(as_stream(d.requests().select("ts", "outcome", "extractor_status"), "requests"))
    path = work_dir(d.spark, "t4")
    finish(jobs.append_to(stream, path, work_dir(d.spark, "check")))
    return d.spark.read.schema(stream.schema).parquet(path)


@query
def t5_cache_state(d):
    puts = as_stream(d.writes().filter(F.col("kind") == "md"), "puts")
    r = as_stream(d.keyed_requests().select("request_id", "ts", "url_key"), "requests")
    path = work_dir(d.spark, "t5")
    finish(cache_state.cache_state_sink(puts, None, r, path, work_dir(d.spark, "check")))
    cache_state.cache_state_finish(d.spark, path)
    return cache_state.cache_state_answers(d.spark, path).drop("ts")


@query
def t6_stats_stream(d):
    log = traffic.normalise_outcome(traffic.bot_family(d.requests())).select("ts", "bot_family", "outcome", "latency_ms")
    stream = jobs.stats_stream(as_stream(log, "log"))
    path = work_dir(d.spark, "t6")
    finish(jobs.append_to(stream, path, work_dir(d.spark, "check")))
    return d.spark.read.schema(stream.schema).parquet(path)


# --- audits -------------------------------------------------------------------

@query
def q1_unique_violations(d):
    p = page_ops.normalise_seeds(d.pages_twice().select("page_id", "url"))
    return audits.unique_violations(p.withColumnRenamed("seed_url", "seed").filter("seed is not null"), ["host", "seed"])


@query
def q2_orphans(d):
    verified = d.accounts().join(
        d.domains().filter("verified").select(F.col("customer_id").alias("id")).distinct(), "id", "left_semi")
    return audits.orphans(d.domains(), verified, "customer_id").select("id", "customer_id", "hostname")


@query
def q2_cascade_delete(d):
    return audits.cascade_delete(d.account_tables(), d.accounts().filter(F.col("plan") == "pro"))


@query
def q1_account_keys(d):
    return audits.account_keys(d.dirty_tables())


@query
def q2_account_orphans(d):
    return audits.account_orphans(d.dirty_tables())


@query
def q3_account_enums(d):
    return audits.account_enums(d.dirty_tables())


@query
def q3_enum_violations(d):
    k = F.substring_index("id", "_", -1).cast("long")
    dirty = d.accounts().withColumn(
        "plan", F.when(k % 9 == 4, F.lit("gold")).when(k % 31 == 5, F.lit(None)).otherwise(F.col("plan")))
    return audits.enum_violations(dirty, "plan", lists.ENUMS["plan"]).select("id", "plan")


@query
def q4_equivalence_audit(d):
    return page_ops.equivalence_audit(d.spread_pages()).drop("url")


@query
def q4_stored_equivalence(d):
    """Stored Markdown against the marks written with it; some rows were changed after signing, some have no marks."""
    content, marks = work_dir(d.spark, "content"), work_dir(d.spark, "marks")
    i = F.col("page_id")
    c = page_ops.extract_signed(page_ops.with_url_key(page_ops.canonicalise(d.spread_pages())))
    c = d.spark.read.parquet(staged(c.select(
        i.alias("wid"), "url_key", "markdown", "shown_marks", "main_marks", "md_mark",
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("written_at")), "signed"))
    sinks.write_signatures(c.filter(F.col("wid") % 31 != 3), marks)
    extra = F.when(F.col("wid") % 50 == 7, F.lit("\n\nQzsmuggled")).when(F.col("wid") % 50 == 8, F.lit("\n")).otherwise(F.lit(""))
    sinks.write_content(c.select("wid", "url_key", F.concat("markdown", extra).alias("markdown"),
                                 F.lit(None).cast("string").alias("html"), "written_at"), content)
    found = page_ops.stored_equivalence(readers.read_content(d.spark, content), readers.read_signatures(d.spark, marks))
    return found.withColumnRenamed("wid", "page_id")


@query
def q5_non_200_to_crawlers(d):
    r = traffic.flag_ai_agents(d.endpoint_requests()).withColumnRenamed("endpoint", "mode")
    return ops.non_200_to_crawlers(r)


@query
def q6_secrets_audit(d):
    entries = d.request_log().select(F.col("requestId").alias("request_id"), F.explode("logs").alias("e")).select(
        "request_id", "e.msg", "e.err", "e.stack", "e.data")
    return audits.secrets_audit(d.config(), entries)


@query
def q7_metric_key_mismatch(d):
    return report.metric_key_mismatch(d.metrics(), d.owned_urls())


# --- whole flows --------------------------------------------------------------

@query
def flow_serve_requests(d):
    return flows.serve_requests(d.requests(), d.config(), d.writes())


@query
def flow_overview(d):
    return flows.overview_rows(d.site_maps(), d.metrics()).select(
        "customer_id", "domain_id", "url", "section", "section_rank", "url_rank", "status", "savings", "last_optimized")


@query
def flow_store_crawl(d):
    _, stored = flows.store_crawl(d.crawl_payloads(), d.crawl_jobs())
    return stored.select("crawl_id", "ordinal", "url_key", "md_tokens")
