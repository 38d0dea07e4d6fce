"""Fixed values.

Every list in this module is data that results depend on. They are small and of
constant size, so they are folded into expressions instead of being joined.
"""

# User-agent substrings of AI crawlers.
AI_AGENTS = [
    "gptbot", "chatgpt-user", "oai-searchbot",
    "claudebot", "claude-web",
    "google-extended", "googleother",
    "bingpreview",
    "perplexitybot",
    "amazonbot",
    "applebot-extended",
    "meta-externalagent",
    "cohere-ai",
    "bytespider",
    "ccbot",
    "diffbot",
]

# The shorter list of agents used by the middleware example.
SAMPLE_AGENTS = ["gptbot", "claudebot", "perplexitybot", "google-extended", "bingbot"]

# Bot families, the first matching substring wins.
BOT_FAMILIES = [
    ("gpt", "gpt"),
    ("claude", "claude"),
    ("google", "google"),
    ("bing", "bing"),
    ("perplexity", "perplexity"),
    ("amazon", "amazon"),
    ("facebook", "meta"),
    ("meta", "meta"),
    ("byte", "bytedance"),
]

# Extensions of static assets common to serving and seeding.
_ASSETS = [
    ".js", ".css", ".xml", ".less", ".png", ".jpg", ".jpeg", ".gif",
    ".pdf", ".doc", ".txt", ".ico", ".rss", ".zip", ".mp3", ".rar",
    ".exe", ".wmv", ".avi", ".ppt", ".mpg", ".mpeg", ".tif",
    ".wav", ".mov", ".psd", ".ai", ".xls", ".mp4", ".m4a", ".swf",
    ".dmg", ".iso", ".flv", ".m4v", ".torrent", ".woff", ".woff2",
    ".ttf", ".svg", ".webmanifest", ".webp",
]
SERVING_ASSETS = _ASSETS + [".dat"]
SEED_ASSETS = _ASSETS + [".xlsx"]

# Path prefixes that are never optimised.
BLOCKED_PATHS = ["/admin", "/api", "/private", "/auth"]

# Query parameters that do not identify content.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "ref", "mc_cid", "mc_eid", "_ga", "_gl",
]

# Private and internal address patterns.
PRIVATE_HOSTS = [
    r"^127\.",
    r"^10\.",
    r"^172\.(1[6-9]|2[0-9]|3[0-1])\.",
    r"^192\.168\.",
    r"^169\.254\.",
    r"^0\.",
    r"^::1$",
    r"^(?i:fc00:)",
    r"^(?i:fe80:)",
]
PRIVATE_SUFFIXES = [".local", ".internal"]

# Request headers. The service's own token header is a parameter.
STRIP_HEADERS = [
    "authorization", "cf-connecting-ip", "cf-ray", "cf-ipcountry", "cf-visitor",
    "cf-worker", "true-client-ip", "x-real-ip", "x-forwarded-for",
]
SAFE_HEADERS = ["accept", "accept-language", "accept-encoding"]

# Times to live in seconds.
TTL_MARKDOWN_S = 604800
TTL_HTML_S = 7200
TTL_TOKENS_S = TTL_MARKDOWN_S
TTL_PENDING_S = 30
WAIT_POLL_MS, WAIT_POLLS = 500, 6
TTL_CRAWL_JOB_S = 3600
TTL_USAGE_S = 90 * 86400

# Caps and versions.
CANON_VERSION = "v1"
MAX_MAP_URLS = 5000
MAX_CRAWL_PAGES = 100
MAX_ACTIVE_TOKENS = 5
PREVIEW_CHARS = 150000
LOG_SAMPLE_RATE = 0.01
CONFIG_VERSION = 2
MAP_SOURCE = "firecrawl_map"

# Plan -> included renders per month (None is unlimited).
PLANS = {"free": 1000, "pro": 50000, "team": 250000, "enterprise": None}
OVERAGE_MICROS = 1000  # 0.001 dollars per render
EXTRACTION_MICROS = 700  # 0.0007 dollars per page

# Allowed values of enumerated columns.
ENUMS = {
    "plan": ["free", "pro", "team", "enterprise"],
    "job_state": ["pending", "success", "failed"],
    "job_kind": ["auth_kv_sync"],
    "seed_source": ["firecrawl_map", "manual"],
}

# Status words on the wire -> outcome.
OUTCOMES = {
    "hit": "hit",
    "miss": "miss",
    "miss (rendered)": "miss",
    "fail (fallback)": "fallback",
    "fallback": "fallback",
    "timeout": "error",
    "fail": "error",
    "error": "error",
}

# Fallback alerts (window, slide, minimum volume, ratio, level);
# volume and ratio must both be exceeded.
ALERT_RULES = [
    {"rule": "fallback_15m", "window_min": 15, "over": 100, "num": 5, "den": 100, "level": "warning"},
    {"rule": "fallback_5m", "window_min": 5, "over": 50, "num": 25, "den": 100, "level": "critical"},
]
EXTRACTOR_ALERT = {"rule": "extractor_5xx", "num": 10, "den": 100, "level": "critical"}
