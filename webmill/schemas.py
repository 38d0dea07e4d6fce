"""Explicit schemas: every reader uses one, nothing is inferred."""

from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)


def _struct(**fields):
    return StructType([StructField(k, v, True) for k, v in fields.items()])


S, TS, I, L, B = StringType(), TimestampType(), IntegerType(), LongType(), BooleanType()

PAGES = _struct(page_id=L, url=S, html=S)

CUSTOMERS = _struct(id=S, login_id=S, company_name=S, plan=S, created_at=TS, updated_at=TS)
DOMAINS = _struct(id=S, customer_id=S, hostname=S, verified=B, created_at=TS, updated_at=TS)
SEED_URLS = _struct(id=S, customer_id=S, url=S, source=S, enabled=B, created_at=TS, updated_at=TS)
MAP_SNAPSHOTS = _struct(
    id=S, customer_id=S, domain_id=S, urls=ArrayType(S), fetched_at=TS, created_at=TS)
API_TOKENS = _struct(
    id=S, customer_id=S, token_hash=S, token_prefix=S, label=S, revoked_at=TS, created_at=TS, updated_at=TS)
PUBLISH_JOBS = _struct(
    id=S, customer_id=S, kind=S, state=S, attempts=I, payload=S, last_error=S, created_at=TS, updated_at=TS)
URL_METRICS = _struct(
    id=S, customer_id=S, url=S, html_tokens=I, md_tokens=I, optimized_at=TS, created_at=TS, updated_at=TS)

ACCOUNT_TABLES = {
    "customers": CUSTOMERS,
    "domains": DOMAINS,
    "seed_urls": SEED_URLS,
    "map_snapshots": MAP_SNAPSHOTS,
    "api_tokens": API_TOKENS,
    "publish_jobs": PUBLISH_JOBS,
    "url_metrics": URL_METRICS,
}

# Unique keys of the account tables.
UNIQUE_KEYS = {
    "customers": ["login_id"],
    "domains": ["customer_id", "hostname"],
    "seed_urls": ["customer_id", "url"],
    "map_snapshots": ["customer_id", "domain_id"],
    "api_tokens": ["token_hash"],
    "url_metrics": ["customer_id", "url"],
}

# Foreign keys: child -> [(column, parent)]; all cascade.
FOREIGN_KEYS = {
    "domains": [("customer_id", "customers")],
    "seed_urls": [("customer_id", "customers")],
    "map_snapshots": [("customer_id", "customers"), ("domain_id", "domains")],
    "api_tokens": [("customer_id", "customers")],
    "publish_jobs": [("customer_id", "customers")],
    "url_metrics": [("customer_id", "customers")],
}

REQUEST_LOG = StructType([
    StructField("requestId", S), StructField("timestamp", S), StructField("method", S),
    StructField("path", S), StructField("botFamily", S), StructField("tenantId", S),
    StructField("status", I), StructField("cacheStatus", S), StructField("originStatus", I),
    StructField("latencyMs", L),
    StructField("logs", ArrayType(_struct(level=S, msg=S, err=S, stack=S, data=S))),
])

CRAWL_RESULT = StructType([
    StructField("status", S), StructField("total", I), StructField("completed", I),
    StructField("creditsUsed", I), StructField("expiresAt", S),
    StructField("data", ArrayType(StructType([
        StructField("markdown", S),
        StructField("metadata", _struct(sourceURL=S, title=S)),
    ]))),
])

CONTENT_WRITES = _struct(wid=L, url_key=S, kind=S, body=S, written_at=TS, ttl_s=L)
#: Word marks of the Markdown of a write: 64-bit hashes of the visible words, of the main text's words, of the Markdown.
SIGNATURES = _struct(wid=L, url_key=S, shown_marks=ArrayType(L), main_marks=ArrayType(L), md_mark=L, written_at=TS)
