"""Operators over account tables and the published access configuration.

The configuration is a key/document table. Joins never carry documents: they use
two narrow indexes derived from it, ``auth_index`` and ``allowed_hosts``.
"""

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from webmill import lists
from webmill.functions import urls

DOCUMENT = StructType([
    StructField("v", IntegerType()),
    StructField("id", StringType()),
    StructField("customerId", StringType()),
    StructField("plan", StringType()),
    StructField("domains", ArrayType(StringType())),
    StructField("updatedAt", StringType()),
])


def build_config(customers, domains, tokens, updated_at):
    """One document per customer and per active token: ``key, document``.

    Domains are distinct and sorted. A document holds the whole list because it
    is the published value; joins use ``allowed_hosts`` instead.
    """
    hosts = (
        domains.select("customer_id", urls.bare_host(F.col("hostname")).alias("host")).distinct()
        .groupBy("customer_id").agg(F.array_sort(F.collect_list("host")).alias("domains")))
    docs = (
        customers.join(hosts, customers.id == hosts.customer_id, "left")
        .select("id", F.to_json(F.struct(
            F.lit(lists.CONFIG_VERSION).alias("v"), F.col("id"), F.col("plan"),
            F.coalesce("domains", F.array().cast("array<string>")).alias("domains"),
            F.lit(updated_at).alias("updatedAt"))).alias("document")))
    active = tokens.filter(F.col("revoked_at").isNull()).select(
        F.col("customer_id").alias("id"), F.concat(F.lit("apikeyhash:"), "token_hash").alias("key"))
    by_customer = docs.select(F.concat(F.lit("customer:"), "id").alias("key"), "document")
    return by_customer.unionByName(active.join(docs, "id").select("key", "document"))


def auth_index(config):
    """``key, customer_id, allowlist``; the id may be stored under either field name."""
    doc = F.from_json("document", DOCUMENT)
    return config.select("key", F.coalesce(
        F.nullif(doc["id"], F.lit("")), F.nullif(doc["customerId"], F.lit(""))).alias("customer_id"),
        F.sha2("document", 256).alias("allowlist"))


def allowed_hosts(config):
    """Distinct ``allowlist, host``: a document counts once, however many tokens share it.

    The documents are keys of a hash aggregate; as values of one they would be sorted, copies and all, where they are read.
    """
    once = config.select("document").distinct().withColumn("allowlist", F.sha2("document", 256))
    doc = F.from_json("document", DOCUMENT)
    return once.select("allowlist", F.explode(F.array_distinct(doc["domains"])).alias("host"))


def spread_nulls(key, df):
    """``key``, or a value of its own that matches nothing: rows without a key must not meet in one task."""
    return spread_by(key, row_hash(df))


def row_hash(df):
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def spread_by(key, number):
    """As ``spread_nulls``, by a hash that was taken before: a later one would carry all columns through the joins before it."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.hex(number)))


def auth_lookup(req, config, token="token"):
    """Customer of a request token: by hash first, then by plaintext key.

    The index is narrow; Spark broadcasts it while its size is below the
    session's threshold and otherwise shuffles with skew handling.
    """
    index = auth_index(config)
    by_hash = index.filter(F.col("key").startswith("apikeyhash:")).select(
        F.substr(F.col("key"), F.lit(12)).alias("_hash"), F.col("customer_id").alias("_id_h"),
        F.col("allowlist").alias("_list_h"), F.lit(True).alias("_ok_h"))
    by_text = index.filter(F.col("key").startswith("apikey:")).select(
        F.substr(F.col("key"), F.lit(8)).alias("_text"), F.col("customer_id").alias("_id_t"),
        F.col("allowlist").alias("_list_t"), F.lit(True).alias("_ok_t"))
    given = F.nullif(F.col(token), F.lit(""))
    d = req.withColumns({"_hash": spread_nulls(F.sha2(given, 256), req), "_given": spread_nulls(given, req)})
    d = d.join(by_hash, "_hash", "left").join(by_text, F.col("_given") == F.col("_text"), "left")
    return d.withColumns({
        "auth_key": F.when(F.col("_ok_h"), F.concat(F.lit("apikeyhash:"), "_hash"))
                     .when(F.col("_ok_t"), F.concat(F.lit("apikey:"), F.col(token))),
        "auth_customer": F.when(F.col("_ok_h"), F.col("_id_h")).otherwise(F.col("_id_t")),
        "auth_allowlist": F.when(F.col("_ok_h"), F.col("_list_h")).otherwise(F.col("_list_t")),
        "auth_found": F.coalesce("_ok_h", "_ok_t", F.lit(False)),
    }).drop("_hash", "_given", "_text", "_id_h", "_id_t", "_list_h", "_list_t", "_ok_h", "_ok_t")


def config_by_customer(req, config, customer="customer_id"):
    """Configuration of the customer named in an internal request."""
    found = auth_index(config).filter(F.col("key").startswith("customer:")).select(
        F.substr(F.col("key"), F.lit(10)).alias("_named"), F.col("allowlist").alias("auth_allowlist"), F.lit(True).alias("_ok"))
    d = req.withColumn("_who", spread_nulls(F.col(customer), req))
    return d.join(found, F.col("_who") == F.col("_named"), "left").withColumns({
        "auth_key": F.when(F.col("_ok"), F.concat(F.lit("customer:"), F.col(customer))),
        "auth_found": F.coalesce("_ok", F.lit(False)),
    }).drop("_who", "_named", "_ok")


def allowed_domain(req, domains, keep="semi", customer="customer_id", host="host"):
    """Requests on a customer's own domains (``semi``), or the violations (``anti``)."""
    owned = domains.select(
        F.col("customer_id").alias("_c"), urls.bare_host(F.col("hostname")).alias("_h")).distinct()
    match = (F.col(customer) == F.col("_c")) & (F.col(host) == F.col("_h"))
    return req.join(owned, match, f"left_{keep}")


def admit(req, config, mode="render", token="token", url="url", customer="customer_id", service_ok="service_ok"):
    """Admission verdict: ``http_status, error_code, customer_id`` for each request.

    ``render``  token, https, allowlist, private host
    ``internal``  service key, customer, https, private host, configuration, allowlist
    ``crawl``  token, allowlist only
    """
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # what a check needs of the row is a flag before the joins: a task sorts the rows of a busy customer, so they must be narrow
    d = urls.with_url_parts(req, url, "_p")
    d = d.select(
        *req.columns, urls.bare_host(F.col("_p.host")).alias("_host"), F.col("_p.error").alias("_error"),
        (F.col("_p.scheme") != "https").alias("_not_https"), urls.is_private_host(F.col("_p.host")).alias("_private"),
        (none(token) if token in req.columns else F.lit(False)).alias("_no_token"), row_hash(req).alias("_row"))
    if mode == "internal":
        d = config_by_customer(d, config, customer).withColumn("auth_customer", F.col(customer))
    else:
        d = auth_lookup(d, config, token)
    allow = allowed_hosts(config).select(
        F.col("allowlist").alias("_list"), F.col("host").alias("_allowed_host"), F.lit(True).alias("_allowed"))
    d = d.withColumn("_own_list", spread_by(F.col("auth_allowlist"), F.col("_row")))
    d = d.join(allow, (F.col("_own_list") == F.col("_list")) & (F.col("_host") == F.col("_allowed_host")), "left")

    checks = {
        "missing_token": (401, F.col("_no_token")),
        "invalid_token": (401, ~F.col("auth_found")),
        "bad_config": (500, F.col("auth_found") & F.col("auth_customer").isNull()),
        "unauthorised": (401, ~F.coalesce(F.col(service_ok), F.lit(False)) if service_ok in req.columns else F.lit(False)),
        "missing_customer": (400, none(customer) if customer in req.columns else F.lit(False)),
        "missing_url": (400, F.col("_error") == "missing"),
        "invalid_url": (400, F.col("_error") == "invalid"),
        "unsupported_url": (400, F.col("_error") == "unsupported"),
        "not_https": (400, F.col("_not_https")),
        "domain_denied": (403, F.col("_allowed").isNull()),
        "private_host": (400, F.col("_private")),
        "unknown_customer": (404, ~F.col("auth_found")),
    }
    url_checks = ["missing_url", "invalid_url", "unsupported_url"]
    order = {
        "render": ["missing_token", "invalid_token", "bad_config", *url_checks, "not_https", "domain_denied", "private_host"],
        "internal": ["unauthorised", "missing_customer", *url_checks, "not_https", "private_host", "unknown_customer", "domain_denied"],
        "crawl": ["missing_token", "invalid_token", "bad_config", *url_checks, "domain_denied"],
    }[mode]
    code = F.coalesce(*[F.when(checks[name][1], F.lit(name)) for name in order])
    status = F.coalesce(*[F.when(F.col("error_code") == name, F.lit(checks[name][0])) for name in order], F.lit(200))
    d = d.withColumn("error_code", code).withColumn("http_status", status)
    keep = [c for c in req.columns if c != customer]
    return d.select(*keep, F.col("auth_customer").alias("customer_id"), "http_status", "error_code")


def token_limits(tokens, max_active=lists.MAX_ACTIVE_TOKENS):
    return (
        tokens.groupBy("customer_id")
        .agg(F.count_if(F.col("revoked_at").isNull()).alias("active_tokens"))
        .withColumn("at_limit", F.col("active_tokens") >= max_active))


def first_per_group(df, by, order, newest=False):
    """The first (or newest) row of each group.

    An aggregate, not a window: it combines before the shuffle, so no group is
    ever gathered in one task.
    """
    pick = F.max_by if newest else F.min_by
    row = F.struct(*[c for c in df.columns if c not in by])
    return df.groupBy(*by).agg(pick(row, F.struct(*order)).alias("_row")).select(*by, "_row.*")


def primary_domain(domains):
    """Earliest domain of each customer; the id breaks ties."""
    return first_per_group(domains, ["customer_id"], ["created_at", "id"])


def latest_active_token(tokens):
    return first_per_group(
        tokens.filter(F.col("revoked_at").isNull()), ["customer_id"], ["created_at", "id"], newest=True)


def config_diff(desired, published):
    """Change set ``key, action, document``: put, delete or unchanged.

    ``updatedAt`` is ignored. Customer keys stay when their tokens are revoked,
    so only keys missing from ``desired`` are deleted.
    """
    def content(c):
        doc = F.from_json(c, DOCUMENT)
        return F.to_json(F.struct(doc["v"], doc["id"], doc["customerId"], doc["plan"], doc["domains"]))

    want = desired.select("key", F.col("document").alias("_want"))
    have = published.select("key", F.col("document").alias("_have"))
    action = (
        F.when(F.col("_want").isNull(), "delete")
        .when(F.col("_have").isNull(), "put")
        .when(content(F.col("_want")).eqNullSafe(content(F.col("_have"))), "unchanged")
        .otherwise("put"))
    return want.join(have, "key", "full_outer").select(
        "key", action.alias("action"), F.coalesce("_want", "_have").alias("document"))
