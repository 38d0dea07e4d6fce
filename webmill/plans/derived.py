"""Tables derived from the base tables by fixed integer recipes.

The base data holds pages, events and customers; accounts, request logs, write
logs and the like are computed from all of their rows, so work on them grows
with the base tables. ``oracle.py`` states the same recipes in SQL.
"""

from functools import wraps

from pyspark.sql import functions as F

from webmill import schemas
from webmill.functions import urls
from webmill.operators import access, pages as page_ops, traffic
from webmill.session import work_dir
from webmill.sources.readers import load_pages
from webmill.sources.sinks import content_rows

T0 = 1704067200  # 2024-01-01 00:00:00 UTC
AS_OF = "2024-01-01 00:50:00"
CONFIG_TIME = "2024-01-01T00:00:00.000Z"

USER_AGENTS = [
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Chrome/120.0.0.0",
    "Mozilla/5.0 (compatible; GPTBot/1.1)",
    "Mozilla/5.0 (compatible; ClaudeBot/1.0)",
    "Mozilla/5.0 (compatible; PerplexityBot/1.0)",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "Mozilla/5.0 (compatible; Google-Extended)",
    "Mozilla/5.0 (compatible; bingbot/2.0)",
    "Mozilla/5.0 (compatible) BingPreview/1.0b",
    "Twitterbot/1.0",
    "Mozilla/5.0 (compatible; Bytespider)",
    "CCBot/2.0 (https://commoncrawl.org/faq/)",
    "",
]
STATUS_WORDS = ["hit", "miss", "timeout", "fail", "HIT", "MISS (Rendered)", "FAIL (Fallback)", "fallback", "error"]

at = lambda seconds: F.timestamp_seconds(F.lit(T0) + seconds)
text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
choose = lambda values, index: F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def shared(method):
    """Build a table's plan once per ``Derived``."""
    @wraps(method)
    def get(self):
        if method.__name__ not in self.built:
            self.built[method.__name__] = method(self)
        return self.built[method.__name__]
    return get


def spread(frame):
    """Deal a table out if it is read in fewer splits than there are cores, for extraction is CPU-bound.

    A table of at least as many splits is extracted where it is read; its HTML is never shuffled.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


STORED = {}


def stored(method):
    """Write a table that operators would find in storage, once per application and folder."""
    @wraps(method)
    def get(self):
        place = (self.spark.sparkContext.applicationId, self.dir, method.__name__)
        if place not in STORED:
            frame, path = method(self), work_dir(self.spark, method.__name__)
            frame.write.parquet(path)
            STORED[place] = (path, frame.schema)
        path, schema = STORED[place]
        return self.spark.read.schema(schema).parquet(path)
    return shared(get)


class Derived:
    """Lazy derived tables over the base tables in ``sf_dir``."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir, self.built = spark, sf_dir, {}

    @shared
    def pages(self):
        return load_pages(self.spark, f"{self.dir}/pages.parquet")

    @shared
    def events(self):
        return self.spark.read.parquet(f"{self.dir}/events.parquet")

    @shared
    def spread_pages(self):
        return spread(self.pages())

    @shared
    def page_count(self):
        """From the file footers; no data is read."""
        return self.pages().count()

    # --- accounts ---------------------------------------------------------

    @shared
    def customer_keys(self):
        return self.spark.read.parquet(f"{self.dir}/customer.parquet").select(
            F.col("c_custkey").alias("k"), F.col("c_name"))

    @shared
    def accounts(self):
        k = F.col("k")
        return self.customer_keys().select(
            text("cust_", k).alias("id"), text("login_", k).alias("login_id"), F.col("c_name").alias("company_name"),
            choose(["free", "pro", "team", "enterprise"], k % 4).alias("plan"),
            at(k * 3600).alias("created_at"), at(k * 3600).alias("updated_at"))

    @shared
    def hosts(self):
        """Each host with its number, the smallest page id."""
        p = page_ops.canonicalise(self.pages().select("page_id", "url"))
        return p.groupBy("host").agg(F.min("page_id").alias("r"))

    @stored
    def domains(self):
        r = F.col("r")
        return self.hosts().select(
            text("dom_", r).alias("id"), text("cust_", F.floor(r / 8)).alias("customer_id"),
            F.col("host").alias("hostname"), (r % 2 == 0).alias("verified"),
            at(r * 3600).alias("created_at"), at(r * 3600).alias("updated_at"))

    @stored
    def tokens(self):
        """API tokens with their plaintext, which only this fixture knows."""
        d = self.customer_keys().select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % 8)).alias("j"))
        k, j = F.col("k"), F.col("j")
        day = 86400
        return d.withColumn("token", text("key_test_", k, "_", j)).select(
            text("tok_", k, "_", j).alias("id"), text("cust_", k).alias("customer_id"), "token",
            F.sha2("token", 256).alias("token_hash"), F.left("token", F.lit(8)).alias("token_prefix"),
            F.lit(None).cast("string").alias("label"),
            F.when(j % 3 == 2, at((j + 1) * day)).alias("revoked_at"),
            at(j * day).alias("created_at"), at(j * day).alias("updated_at"))

    @shared
    def legacy_config(self):
        """Plaintext keys of the old scheme for free accounts; some lack an id."""
        free = self.accounts().filter(F.col("plan") == "free").select("id")
        owned = self.domains().select(F.col("customer_id").alias("id"), "hostname")
        grouped = free.join(owned, "id", "left").groupBy("id").agg(
            F.array_sort(F.collect_list("hostname")).alias("domains"))
        k = F.substring_index("id", "_", -1)
        doc = F.struct(F.when(k.cast("long") % 12 != 0, F.col("id")).alias("customerId"), F.col("domains"))
        return grouped.select(text("apikey:legacy_", k).alias("key"), F.to_json(doc).alias("document"))

    @stored
    def config(self):
        built = access.build_config(self.accounts(), self.domains(), self.tokens(), CONFIG_TIME)
        return built.unionByName(self.legacy_config())

    @stored
    def published(self):
        """An older state: some keys missing, some plans changed, revoked tokens present."""
        old = self.accounts().withColumn("plan", F.when(
            F.substring_index("id", "_", -1).cast("long") % 5 == 0, F.lit("free")).otherwise(F.col("plan")))
        tokens = self.tokens().withColumn("revoked_at", F.lit(None).cast("timestamp"))
        return access.build_config(
            old.filter(F.col("plan") != "team"), self.domains(), tokens, "2023-12-31T00:00:00.000Z")

    @shared
    def overrides(self):
        k = F.col("k")
        return self.customer_keys().select(
            text("cust_", k).alias("customer_id"),
            F.when(k % 4 == 0, F.array(F.lit("Twitterbot"))).otherwise(F.array(F.lit("googlebot"), F.lit("ccbot"))).alias("include"),
            F.when(k % 6 == 0, F.array(F.lit("Bytespider"))).otherwise(F.array().cast("array<string>")).alias("exclude"))

    # --- content ----------------------------------------------------------

    @shared
    def pages_twice(self):
        """All pages and, for http pages, a copy under a URL that differs in tracking only."""
        p = self.pages()
        cut = F.substring_index("url", "#", 1)
        tail = F.substr(F.col("url"), F.length(cut) + 1)
        sign = F.when(cut.contains("?"), F.lit("&")).otherwise(F.lit("?"))
        copy = p.filter(F.col("url").startswith("http:")).select(
            (F.col("page_id") + 100000000).alias("page_id"),
            F.concat(cut, sign, F.lit("utm_medium=x"), tail).alias("url"), "html")
        return p.unionByName(copy)

    @stored
    def content(self):
        """Extracted pages with keys and token counts."""
        p = page_ops.with_url_key(page_ops.canonicalise(self.spread_pages()))
        return page_ops.extract_markdown(p)

    @stored
    def writes(self):
        """Two writes per page; the second is markup for some pages."""
        p = page_ops.with_url_key(page_ops.canonicalise(self.spread_pages())).withColumn("raw", F.col("html"))
        c = page_ops.extract_markdown(p)
        i = F.col("page_id")
        turn = F.explode(F.array(
            F.struct((i * 2).alias("wid"), F.lit(False).alias("bad"), at(i % 100).alias("written_at")),
            F.struct((i * 2 + 1).alias("wid"), (i % 29 == 0).alias("bad"), at(3000 + i * 13 % 1000).alias("written_at"))))
        d = c.select("url_key", "markdown", "raw", turn.alias("t")).select(
            "t.wid", "url_key", "t.written_at",
            F.when(F.col("t.bad"), F.col("raw")).otherwise(F.col("markdown")).alias("markdown"),
            F.col("raw").alias("html"))
        return content_rows(d, md_ttl=1200, html_ttl=600, tokens_ttl=1200)

    @shared
    def invalidations(self):
        n = self.page_count()
        e = self.events().filter(F.col("event_type") == "signup").select(
            "event_id", (F.col("event_id") * 7 % n).alias("page_id"))
        p = page_ops.with_url_key(page_ops.canonicalise(self.pages().select("page_id", "url")))
        late = F.when(F.col("event_id") % 7 == 0, 600).otherwise(F.col("event_id") % 200)
        return e.join(p, "page_id").select(
            "url_key", at(F.col("event_id")).alias("issued_at"), at(F.col("event_id") + late).alias("received_at"))

    # --- requests ---------------------------------------------------------

    @stored
    def requests(self):
        n = self.page_count()
        p = page_ops.canonicalise(self.pages().select("page_id", "url"), out="page_canonical").select(
            "page_id", F.col("url").alias("page_url"), "page_canonical", F.col("host").alias("page_host"),
            F.col("path").alias("page_path"))
        owned = p.join(
            self.domains().select(F.col("hostname").alias("page_host"), F.col("customer_id").alias("owner")), "page_host")
        e = self.events().select("event_id", "user_id", "event_type", "value").withColumn(
            "page_id", F.col("event_id") * 7 % n)
        i = F.col("event_id")
        k = F.when(i % 11 == 0, F.col("user_id").cast("string")).otherwise(F.substring_index("owner", "_", -1))
        https = F.regexp_replace("page_url", "^https?://", "https://")
        w = F.floor(i / 1500) % 3
        error = F.col("event_type") == "error"
        signup, purchase = F.col("event_type") == "signup", F.col("event_type") == "purchase"
        fallback = (
            ((w == 0) & error & (i % 10 == 0)) | ((w == 1) & (error | signup)) | ((w == 2) & error & (i % 2 == 0)))
        outcome = F.when(fallback, "fallback").when(signup | purchase, "miss").otherwise("hit")
        path = (
            F.when(i % 10 < 6, F.lit("/render")).when(i % 10 == 6, F.lit("/render/internal"))
            .when(i % 10 == 7, F.lit("/render/content"))
            .when(i % 20 == 8, F.lit("/_service/crawl")).when(i % 20 == 18, text("/_service/crawl/job-", i))
            .when(i % 30 == 19, text("/administrator/", i)).when(i % 30 == 29, F.lit("/static/app.min.JS"))
            .otherwise(F.col("page_path")))
        return e.join(owned, "page_id").select(
            i.alias("request_id"), at(i).alias("ts"),
            F.when(i % 97 == 0, "OPTIONS").when(i % 20 == 8, "POST").otherwise("GET").alias("method"),
            path.alias("path"),
            F.when(i % 23 == 0, F.lit(None)).when(i % 19 == 0, "not a url").when(i % 17 == 0, "https://127.0.0.1/x")
            .when(i % 13 == 0, F.regexp_replace("page_url", "^https?://", "http://")).otherwise(https).alias("url"),
            text("cust_", k).alias("customer_id"),
            F.when(i % 50 == 0, F.lit(None)).when(i % 14 == 1, text("legacy_", k))
            .otherwise(text("key_test_", k, "_", F.floor(i / 7) % 3)).alias("token"),
            (i % 40 != 3).alias("service_ok"),
            choose(USER_AGENTS, i % 12).alias("user_agent"),
            choose(STATUS_WORDS, i % 9).alias("status_word"),
            outcome.alias("outcome"),
            F.when(i % 31 == 0, 401).when(i % 71 == 0, 500).otherwise(200).alias("status"),
            F.floor(F.col("value") * 10).alias("latency_ms"),
            F.when(fallback, F.when(i % 3 == 0, 502).otherwise(200)).when(outcome == "miss", 200).alias("extractor_status"),
            "page_id", "page_canonical", "page_host")

    @shared
    def keyed_requests(self):
        """Requests with the content key of their page."""
        r = self.requests()
        return r.withColumn("url_key", urls.url_key(F.col("page_canonical")))

    @shared
    def endpoint_requests(self):
        return traffic.endpoint_class(self.requests())

    @shared
    def request_log(self):
        """Wire form of the request log."""
        i = F.col("request_id")
        error = F.col("status") >= 400
        entry = lambda level, msg, data: F.struct(
            F.lit(level).alias("level"), F.lit(msg).alias("msg"), F.lit(None).cast("string").alias("err"),
            F.lit(None).cast("string").alias("stack"), data.alias("data"))
        logs = F.when(error, F.array(entry("error", "request failed", F.lit(None).cast("string")))).when(
            i % 25 == 0, F.array(entry("info", "context", F.coalesce(F.col("url"), F.lit("none"))))).otherwise(
            F.array().cast(schemas.REQUEST_LOG["logs"].dataType))
        return traffic.bot_family(self.requests()).select(
            i.cast("string").alias("requestId"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "method", "path",
            F.col("bot_family").alias("botFamily"), F.col("customer_id").alias("tenantId"),
            "status", F.col("status_word").alias("cacheStatus"), F.col("status").alias("originStatus"),
            F.col("latency_ms").alias("latencyMs"), logs.alias("logs"))

    @shared
    def headers(self):
        i = F.col("event_id")
        return self.events().select(i.alias("request_id"), F.create_map(
            F.lit("Authorization"), text("Bearer ", i), F.lit("Accept"), F.lit("text/html"),
            F.lit("X-Real-IP"), text("10.0.0.", i % 250), F.lit("Accept-Language"),
            choose(["en", "de", "fr"], i % 3), F.lit("X-Api-Token"), text("key_", i)).alias("headers"))

    # --- metrics, maps, seeds, crawls -------------------------------------

    @shared
    def metric_bodies(self):
        """Metric events as posted, some of them malformed: ``seq, body, received_at``."""
        n = self.page_count()
        c = self.content().select("page_id", "canonical", "host", "html_tokens", "md_tokens")
        d = self.domains().select(F.col("hostname").alias("host"), F.col("customer_id").alias("customer"))
        i = F.col("event_id")
        e = self.events().select("event_id", (i * 7 % n).alias("page_id")).join(c.join(d, "host"), "page_id")
        number = lambda c, miss: F.when(miss | (i % 37 == 0), F.lit("null")).otherwise(F.col(c).cast("string"))
        stamp = F.date_format(at(i * 7919 % 100000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        body = F.concat(
            F.lit('{"customerId":"'), F.when(i % 43 == 0, F.lit("")).otherwise(F.col("customer")),
            F.lit('","url":'), F.when(i % 47 == 0, F.lit("17")).otherwise(F.concat(F.lit('"'), F.col("canonical"), F.lit('"'))),
            F.lit(',"htmlTokens":'), number("html_tokens", i % 5 == 0),
            F.when(i % 41 == 0, F.lit("")).otherwise(F.concat(F.lit(',"mdTokens":'), number("md_tokens", F.lit(False)))),
            F.when(i % 61 == 0, F.lit("")).otherwise(F.concat(
                F.lit(',"optimizedAt":"'), F.when(i % 67 == 0, F.lit("soon")).otherwise(stamp), F.lit('"'))),
            F.lit("}"))
        body = F.when(i % 53 == 0, F.lit("[1,2]")).when(i % 59 == 0, F.lit("not json")).otherwise(body)
        return e.select(i.alias("seq"), body.alias("body"), at(i).alias("received_at"))

    @shared
    def metric_changes(self):
        """Valid metric events: ``customer_id, url, html_tokens, md_tokens, optimized_at, seq, received_at``."""
        n = self.page_count()
        c = self.content().select("page_id", "canonical", "host", "html_tokens", "md_tokens")
        d = self.domains().select(F.col("hostname").alias("host"), "customer_id")
        i = F.col("event_id")
        e = self.events().select("event_id", (i * 7 % n).alias("page_id")).join(c.join(d, "host"), "page_id")
        return e.select(
            "customer_id", F.col("canonical").alias("url"),
            F.when((i % 5 != 0) & (i % 37 != 0), F.col("html_tokens")).alias("html_tokens"),
            F.when(i % 37 != 0, F.col("md_tokens")).alias("md_tokens"),
            at(i * 7919 % 100000).alias("optimized_at"), i.alias("seq"), at(i).alias("received_at"))

    @shared
    def metrics(self):
        """A metric table of the https pages: ``customer_id, url, tokens, times``."""
        c = self.content().select("page_id", "canonical", "host", "html_tokens", "md_tokens")
        d = self.domains().select(F.col("hostname").alias("host"), "customer_id")
        i = F.col("page_id")
        return c.join(d, "host").filter(F.col("canonical").startswith("https:")).select(
            "customer_id", F.col("canonical").alias("url"), "html_tokens",
            F.when(i % 7 != 0, F.col("md_tokens")).alias("md_tokens"), at(i * 60).alias("optimized_at"),
            at(i).alias("created_at"), at(i * 2).alias("updated_at"))

    @shared
    def site_maps(self):
        """One reply per host, in five shapes, with an asset, a foreign URL and a repetition."""
        p = page_ops.canonicalise(self.pages().select("page_id", "url"))
        p = p.join(self.hosts(), "host")
        grouped = p.groupBy("host", "r").agg(
            F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("items"))
        own = F.transform("items", lambda x: x["url"])
        extra = F.array(
            F.concat(F.lit("https://"), F.col("host"), F.lit("/logo.png")), F.lit("https://elsewhere.example/x"),
            F.get(own, F.lit(0)))
        listed = F.concat(own, extra)
        objects = F.transform(listed, lambda u: F.struct(u.alias("url")))
        shape = F.col("r") % 5
        wrap = lambda name, value: F.to_json(F.struct(value.alias(name)))
        payload = (
            F.when(shape == 0, F.to_json(listed)).when(shape == 1, wrap("urls", listed))
            .when(shape == 2, wrap("links", objects)).when(shape == 3, wrap("data", objects))
            .otherwise(wrap("data", F.struct(listed.alias("urls"), objects.alias("links")))))
        return grouped.select(
            text("cust_", F.floor(F.col("r") / 8)).alias("customer_id"), text("dom_", F.col("r")).alias("domain_id"),
            F.col("host").alias("hostname"), payload.alias("payload"))

    @shared
    def seeds(self):
        """Seeds of the verified domains."""
        p = page_ops.normalise_seeds(self.pages().select("page_id", "url"))
        d = self.domains().filter("verified").select(F.col("hostname").alias("host"), "customer_id")
        i = F.col("page_id")
        return p.join(d, "host").select(
            "customer_id", F.col("seed_url").alias("url"),
            F.when(i % 2 == 0, "manual").otherwise("firecrawl_map").alias("source"), (i % 4 != 0).alias("enabled"))

    @shared
    def owned_urls(self):
        """Seed URLs of every page with their owner and order."""
        p = page_ops.normalise_seeds(self.pages().select("page_id", "url"))
        d = self.domains().select(F.col("hostname").alias("host"), "customer_id")
        return p.join(d, "host").select("customer_id", "host", F.col("seed_url").alias("url"), F.col("page_id").alias("ordinal"))

    @shared
    def account_tables(self):
        """All seven account tables, clean."""
        seeds, domains = self.seeds(), self.domains()
        stamps = (at(F.lit(0)).alias("created_at"), at(F.lit(0)).alias("updated_at"))
        frames = {
            "customers": self.accounts(), "domains": domains, "api_tokens": self.tokens(),
            "seed_urls": seeds.select(F.concat(F.lit("seed:"), "customer_id", F.lit(" "), "url").alias("id"), "*", *stamps),
            "map_snapshots": domains.select(
                F.concat(F.lit("snap_"), "id").alias("id"), "customer_id", F.col("id").alias("domain_id"),
                F.array(F.col("hostname")).alias("urls"), F.col("created_at").alias("fetched_at"), "created_at"),
            "publish_jobs": self.accounts().select(
                F.concat(F.lit("job_"), "id").alias("id"), F.col("id").alias("customer_id"), F.lit("auth_kv_sync").alias("kind"),
                F.lit("success").alias("state"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("payload"),
                F.lit(None).cast("string").alias("last_error"), "created_at", "updated_at"),
            "url_metrics": self.metrics().withColumn("id", F.concat(F.lit("metric:"), "customer_id", F.lit(" "), "url"))}
        return {name: frames[name].select(*schemas.ACCOUNT_TABLES[name].names) for name in schemas.ACCOUNT_TABLES}

    @shared
    def dirty_tables(self):
        """The account tables with repeated keys, lost parents and values outside their sets."""
        t = dict(self.account_tables())
        number = lambda c: F.substring_index(c, "_", -1).cast("long")
        t["customers"] = t["customers"].filter(number("id") % 13 != 5).withColumn(
            "plan", F.when(number("id") % 9 == 4, F.lit("gold")).when(number("id") % 31 == 6, F.lit(None)).otherwise(F.col("plan")))
        t["domains"] = t["domains"].filter(number("id") % 11 != 2)
        t["publish_jobs"] = t["publish_jobs"].withColumns({
            "state": F.when(number("customer_id") % 8 == 1, F.lit("lost")).otherwise(F.col("state")),
            "kind": F.when(number("customer_id") % 12 == 7, F.lit("sync")).otherwise(F.col("kind"))})
        t["seed_urls"] = t["seed_urls"].withColumn("source", F.when(F.col("url").contains("/de/"), F.lit("sitemap")).otherwise(F.col("source")))
        copied = F.conv(F.left(F.md5("id"), F.lit(7)), 16, 10).cast("long") % 10 == 3
        return {name: frame.unionByName(frame.filter(copied).withColumn("id", F.concat("id", F.lit("_copy")))) for name, frame in t.items()}

    @shared
    def crawl_pages(self):
        """Pages as crawl results: page ``i`` belongs to crawl ``i % (n / 10)``."""
        crawls = max(1, self.page_count() // 10)
        i = F.col("page_id")
        c = self.content().select("page_id", "url", "markdown")
        foreign = i < crawls
        return c.select(
            text("crawl_", i % crawls).alias("crawl_id"), F.floor(i / crawls).alias("ordinal"),
            F.when(foreign, F.lit("https://elsewhere.example/x")).otherwise(F.col("url")).alias("url"),
            text("Page ", i).alias("title"),
            F.when(i % 17 == 0, F.lit(None)).otherwise(F.col("markdown")).alias("markdown"),
            text("cust_", i % crawls).alias("customer_id"))

    @shared
    def crawl_payloads(self):
        """The same pages as one reply per crawl."""
        page = F.struct(
            "ordinal", F.struct(F.col("markdown"), F.struct(F.col("url").alias("sourceURL"), "title").alias("metadata")).alias("p"))
        return self.crawl_pages().groupBy("crawl_id", "customer_id").agg(
            F.array_sort(F.collect_list(page)).alias("pages"), F.count(F.lit(1)).cast("int").alias("total")
        ).select("crawl_id", "customer_id", F.to_json(F.struct(
            F.lit("completed").alias("status"), "total", F.col("total").alias("completed"),
            F.transform("pages", lambda x: x["p"]).alias("data"))).alias("payload"))

    @shared
    def crawl_jobs(self):
        """Job records; the last crawl has none, some have another owner or an empty allowlist."""
        crawls = max(1, self.page_count() // 10)
        h = page_ops.canonicalise(self.pages().select("page_id", "url")).select(
            (F.col("page_id") % crawls).alias("c"), "host", "page_id")
        d = h.groupBy("c").agg(F.array_sort(F.collect_set(
            F.when(F.col("page_id") % 3 != 0, F.col("host")))).alias("hosts"))
        c = F.col("c")
        return d.filter(c != crawls - 1).select(
            text("crawl_", c).alias("id"),
            text("cust_", F.when(c % 6 == 5, c + 1).otherwise(c)).alias("customer_id"),
            (F.lit(3) + c % 5 * 2).cast("int").alias("limit"), (c % 9 != 4).alias("cache_results"),
            F.when(c % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("hosts")).alias("allowed_domains"),
            (F.lit(AS_OF).cast("timestamp") - F.make_interval(secs=c % 5 * 1200)).alias("started_at"),
            F.when(c % 10 == 4, F.lit(AS_OF).cast("timestamp")).alias("completed_at"))

    @shared
    def crawl_polls(self):
        """Six replies for each crawl: running, cut off, none, expired, running without a time, completed."""
        reply = lambda status, **more: F.to_json(F.struct(F.lit(status).alias("status"), *(v.alias(k) for k, v in more.items())))
        total = F.get_json_object("payload", "$.total").cast("int")
        at = lambda day: F.lit(f"2024-01-0{day}T00:40:00.000Z")
        polls = F.array(
            reply("scraping", total=total, completed=total - 1, creditsUsed=total - 1, expiresAt=at(2)),
            F.expr("left(payload, length(payload) - 1)"), F.lit(None).cast("string"),
            reply("scraping", total=total, expiresAt=at(1)), reply("scraping"), F.col("payload"))
        return self.crawl_payloads().select("crawl_id", F.posexplode(polls).alias("poll", "payload"))
