"""SQL twins of the registered queries, for an independent engine.

Every twin starts from the base tables. Common steps are named CTEs in ``STEPS``;
``sql`` collects the ones a query needs.
"""

import re

from webmill import lists
from webmill.plans import registry
from webmill.plans.derived import AS_OF, STATUS_WORDS, USER_AGENTS

ORACLES = {}
STEPS = {}


def quote(value):
    return "'" + str(value).replace("'", "''") + "'"


def at(seconds):
    return f"(TIMESTAMP '2024-01-01' + to_seconds({seconds}))"


def epoch(ts):
    return f"epoch({ts})::BIGINT"


def pick(values, index):
    return f"([{', '.join(quote(v) for v in values)}])[({index}) + 1]"


def step(name, body):
    STEPS[name] = body


def sql(body):
    """Prefix ``body`` with the CTEs it mentions, directly or not, in order of definition."""
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(STEPS[name])
    ctes = ",\n".join(f"{n} AS ({STEPS[n]})" for n in STEPS if n in needed)
    return f"WITH {'RECURSIVE ' if 'c_lead' in needed else ''}{ctes}\n{body}" if ctes else body


def oracle(name, body):
    ORACLES[name] = sql(body)


# --- URLs ---------------------------------------------------------------------

def encode(x):
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"


def parsed(source, key, url="url"):
    """Parts of web URLs; ``scheme`` is NULL for anything else."""
    return f"""SELECT {key}, {url} AS url, m.s AS scheme, lower(m.h) AS full_host,
        regexp_replace(lower(m.h), '^www\\.', '') AS host,
        CASE WHEN m.p = '' THEN '/' ELSE m.p END AS path, substr(m.q, 2) AS query
      FROM (SELECT *, CASE WHEN regexp_matches({url}, '^https?://') THEN
        regexp_extract({url}, '^(https?)://([^/?#]*)([^?#]*)(\\?[^#]*)?', ['s', 'h', 'p', 'q']) END AS m FROM {source})"""


TRACKING = ", ".join(quote(p) for p in lists.TRACKING_PARAMS)


def canonical(host):
    """Canonical URL text from the columns of ``parsed``."""
    decoded = "url_decode(replace({}, '+', ' '))"
    pairs = f"""list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p, i:
        {{'n': {decoded.format("string_split(p, '=')[1]")}, 'i': i,
          'v': {decoded.format("CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END")}}})"""
    kept = f"list_sort(list_filter({pairs}, lambda s: s.n NOT IN ({TRACKING})))"
    text = f"array_to_string(list_transform({kept}, lambda s: {encode('s.n')} || '=' || {encode('s.v')}), '&')"
    tail = f"CASE WHEN coalesce(query, '') = '' THEN '' ELSE {text} END"
    return f"scheme || '://' || {host} || path || coalesce('?' || nullif({tail}, ''), '')"


KEY = "sha256('v1:' || canonical)"

step("c_parts", parsed("pages", "page_id"))
step("c_pages", f"SELECT page_id, url, host, path, canonical, {KEY} AS url_key FROM (SELECT *, {canonical('full_host')} AS canonical FROM c_parts)")
step("c_seedurls", f"SELECT page_id, host, path, {canonical('host')} AS url FROM c_parts")

# --- Markdown -----------------------------------------------------------------


# The twin's own reading of the test pages, which are flat: plain patterns, nothing shared with the extraction.
INVISIBLE = (
    r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>"
    r"|template\b.*?</template\s*>|svg\b.*?</svg\s*>|iframe\b.*?</iframe\s*>|head\b.*?</head\s*>)")
BOILERPLATE = r"(?is)<(?:nav\b.*?</nav\s*>|footer\b.*?</footer\s*>|aside\b.*?</aside\s*>)"
REGIONS = [
    r"(?is)<main\b[^>]*>(.*)</main\s*>",
    r"(?is)<article\b[^>]*>(.*)</article\s*>",
    r"(?is)<body\b[^>]*>(.*)</body\s*>",
]

# (guard, pattern, replacement); a step runs only on texts that hold the guard.
INLINE = [
    ("<img", r"""(?is)<img\b[^>]*\balt="([^"]*)"[^>]*\bsrc="([^"]*)"[^>]*>""", "![$1]($2)"),
    ("<img", r"""(?is)<img\b[^>]*\bsrc="([^"]*)"[^>]*\balt="([^"]*)"[^>]*>""", "![$2]($1)"),
    ("<a ", r"""(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a\s*>""", "[$2]($1)"),
    ("<a ", r"""(?is)<a\b[^>]*\bhref='([^']*)'[^>]*>(.*?)</a\s*>""", "[$2]($1)"),
    ("<code", r"(?is)<code\b[^>]*>([^<]*)</code\s*>", "`$1`"),
    (None, r"(?is)<(?:strong|b)(?: [^>]*)?> *([^< ](?:[^<]*[^< ])?) *</(?:strong|b)\s*>", "**$1**"),
    (None, r"(?is)<(?:em|i)(?: [^>]*)?> *([^< ](?:[^<]*[^< ])?) *</(?:em|i)\s*>", "_$1_"),
]
HEADINGS = [(f"<h{n}", rf"(?is)<h{n}\b[^>]*> *", "\n\n" + "#" * n + " ") for n in range(1, 7)]
BLOCKS = [
    ("<li", r"(?is)<li\b[^>]*> *", "\n-   "),
    ("<blockquote", r"(?is)<blockquote\b[^>]*>(?: *<p\b[^>]*>)? *", "\n\n> "),
    ("<hr", r"(?is)<hr\b[^>]*>", "\n\n* * *\n\n"),
    ("<br", r"(?is)<br\b[^>]*> *", "\n"),
    (None, r"(?is)</?(?:p|div|section|article|header|main|figure|figcaption|address|form|fieldset|details"
           r"|summary|dl|dt|dd|ul|ol|blockquote|h[1-6])\b[^>]*>", "\n\n"),
    (None, r"(?is)<(?:/?[a-z]|!)[^>]*>", ""),
]
TIDY = [
    (None, r" *\n *", "\n"),
    (None, r"\n{3,}", "\n\n"),
]



def java_to_re2(replacement):
    return re.sub(r"\$(\d)", r"\\\1", replacement)


def chain(text, steps):
    for _, pattern, replacement in steps:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(java_to_re2(replacement))}, 'g')"
    return text


# references that the test pages may hold; the ampersand is decoded last
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"),
    ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&times;", "×"), ("&euro;", "€"), ("&pound;", "£"), ("&deg;", "°"), ("&amp;", "&"),
]


def plain_entities(text):
    for name, char in ENTITIES:
        text = f"replace({text}, {quote(name)}, {quote(char)})"
    return text


UTF16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def tokens(x):
    return f"CAST((coalesce({UTF16.format(x)}, 0) + 3) // 4 AS INTEGER)"


def is_html(x):
    lead = "^[\\s\\x{FEFF}\\p{Z}]*"
    return f"""coalesce(regexp_matches({x}, '{lead}(?i:<!doctype|<html|<\\?xml)')
        OR (regexp_matches({x}, '{lead}<!--') AND contains(lower({x}), '<html')), false)"""


step("c_shown", f"SELECT page_id, html, {chain('html', [(None, INVISIBLE, ''), (None, BOILERPLATE, '')])} AS t FROM pages")
step("c_region", "SELECT page_id, html, coalesce(" + ", ".join(
    f"nullif(regexp_extract(t, {quote(r)}, 1), '')" for r in REGIONS) + ", t) AS t FROM c_shown")
step("c_inline", f"SELECT page_id, html, {chain('t', [(None, '[ ' + chr(9) + chr(10) + chr(12) + chr(13) + ']+', ' ')] + INLINE)} AS t FROM c_region")
step("c_blocks", f"SELECT page_id, html, {chain('t', HEADINGS + BLOCKS)} AS t FROM c_inline")
step("c_tidy", f"SELECT page_id, html, trim({chain(plain_entities('t'), TIDY)}, ' ' || chr(10)) AS t FROM c_blocks")
step("c_md", f"""SELECT page_id, {tokens('html')} AS html_tokens, html,
    CASE WHEN t <> '' AND NOT {is_html('t')} THEN t END AS markdown, t = '' AS needs_render FROM c_tidy""")
step("c_content", f"""SELECT p.page_id, p.url, p.host, p.path, p.canonical, p.url_key, m.html, m.html_tokens, m.markdown,
    {tokens('m.markdown')} AS md_tokens, m.needs_render FROM c_pages p JOIN c_md m USING (page_id)""")

SECTION = "'/' || coalesce(list_filter(string_split({}, '/'), lambda s: s <> '')[1], '')"


def savings(h, m):
    return f"""CASE WHEN {h} <> 0 AND {m} <> 0 THEN
        CAST(floor((200 * ({h}::BIGINT - {m}) + {h}) / (2 * {h}::BIGINT)) AS INTEGER) END"""


def url_path(u):
    return f"regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


# --- accounts -----------------------------------------------------------------

step("c_accounts", f"""SELECT c_custkey AS k, 'cust_' || c_custkey AS id, c_name,
    {pick(['free', 'pro', 'team', 'enterprise'], 'c_custkey % 4')} AS plan, {at('c_custkey * 3600')} AS created_at FROM customer""")
step("c_hosts", "SELECT host, min(page_id) AS r FROM c_pages GROUP BY host")
step("c_domains", f"""SELECT r, 'dom_' || r AS id, 'cust_' || (r // 8) AS customer_id, host AS hostname,
    r % 2 = 0 AS verified, {at('r * 3600')} AS created_at FROM c_hosts""")
step("c_tokens", f"""SELECT 'tok_' || k || '_' || j AS id, 'cust_' || k AS customer_id, 'key_test_' || k || '_' || j AS token,
    sha256('key_test_' || k || '_' || j) AS token_hash, j % 3 = 2 AS revoked, {at('j * 86400')} AS created_at
    FROM (SELECT c_custkey AS k, unnest(range(0, c_custkey % 8 + 1)) AS j FROM customer)""")
step("c_lists", "SELECT customer_id, list_sort(list(DISTINCT hostname)) AS hosts FROM c_domains GROUP BY customer_id")


def hosts_json(hosts):
    return f"""('[' || coalesce(array_to_string(list_transform({hosts}, lambda h: '"' || h || '"'), ','), '') || ']')"""


def document(plan, updated):
    return f"""'{{"v":2,"id":"' || a.id || '","plan":"' || {plan} || '","domains":' || {hosts_json('l.hosts')} || ',"updatedAt":"{updated}"}}'"""


step("c_docs", f"""SELECT a.id, l.hosts, {document('a.plan', '2024-01-01T00:00:00.000Z')} AS document
    FROM c_accounts a LEFT JOIN c_lists l ON l.customer_id = a.id""")
step("c_built", """SELECT 'customer:' || id AS key, id AS customer_id, document FROM c_docs
    UNION ALL SELECT 'apikeyhash:' || t.token_hash, d.id, d.document FROM c_tokens t JOIN c_docs d ON d.id = t.customer_id WHERE NOT t.revoked""")
step("c_legacy", f"""SELECT 'apikey:legacy_' || a.k AS key, CASE WHEN a.k % 12 <> 0 THEN a.id END AS customer_id,
    '{{' || CASE WHEN a.k % 12 <> 0 THEN '"customerId":"' || a.id || '",' ELSE '' END || '"domains":' || {hosts_json('l.hosts')} || '}}' AS document,
    a.id AS owner FROM c_accounts a LEFT JOIN c_lists l ON l.customer_id = a.id WHERE a.plan = 'free'""")
step("c_config", "SELECT key, customer_id, customer_id AS owner, document FROM c_built UNION ALL SELECT key, customer_id, owner, document FROM c_legacy")
step("c_allow", "SELECT DISTINCT c.key, d.hostname AS host FROM c_config c JOIN c_domains d ON d.customer_id = c.owner")
step("c_old", """SELECT a.id, CASE WHEN a.k % 5 = 0 THEN 'free' ELSE a.plan END AS old_plan, a.plan
    FROM c_accounts a WHERE a.plan <> 'team' OR a.k % 5 = 0""")
step("c_published", """SELECT 'customer:' || id AS key, id, old_plan, plan FROM c_old
    UNION ALL SELECT 'apikeyhash:' || t.token_hash, o.id, o.old_plan, o.plan FROM c_tokens t JOIN c_old o ON o.id = t.customer_id""")
step("c_change", """SELECT coalesce(c.key, p.key) AS key, c.document,
    CASE WHEN c.key IS NULL THEN 'delete' WHEN p.key IS NULL THEN 'put' WHEN p.old_plan = p.plan THEN 'unchanged' ELSE 'put' END AS action
    FROM c_config c FULL JOIN c_published p ON p.key = c.key""")

# --- requests -----------------------------------------------------------------

step("c_events", "SELECT *, event_id * 7 % (SELECT count(*) FROM pages) AS page_id FROM events")
step("c_raw", """SELECT e.event_id AS i, e.user_id, e.event_type, e.value, e.page_id, p.url AS page_url, p.canonical AS page_canonical,
    p.url_key, p.host AS page_host, p.path AS page_path, d.r // 8 AS owner_k,
    CASE WHEN e.event_id % 11 = 0 THEN e.user_id ELSE d.r // 8 END AS k, e.event_id // 1500 % 3 AS w
    FROM c_events e JOIN c_pages p ON p.page_id = e.page_id JOIN c_domains d ON d.hostname = p.host""")
step("c_req0", f"""SELECT *, i AS request_id, {at('i')} AS ts,
    CASE WHEN i % 97 = 0 THEN 'OPTIONS' WHEN i % 20 = 8 THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN i % 10 < 6 THEN '/render' WHEN i % 10 = 6 THEN '/render/internal' WHEN i % 10 = 7 THEN '/render/content'
         WHEN i % 20 = 8 THEN '/_service/crawl' WHEN i % 20 = 18 THEN '/_service/crawl/job-' || i
         WHEN i % 30 = 19 THEN '/administrator/' || i WHEN i % 30 = 29 THEN '/static/app.min.JS' ELSE page_path END AS path,
    CASE WHEN i % 23 = 0 THEN NULL WHEN i % 19 = 0 THEN 'not a url' WHEN i % 17 = 0 THEN 'https://127.0.0.1/x'
         WHEN i % 13 = 0 THEN regexp_replace(page_url, '^https?://', 'http://')
         ELSE regexp_replace(page_url, '^https?://', 'https://') END AS url,
    'cust_' || k AS customer_id,
    CASE WHEN i % 50 = 0 THEN NULL WHEN i % 14 = 1 THEN 'legacy_' || k ELSE 'key_test_' || k || '_' || (i // 7 % 3) END AS token,
    i % 40 <> 3 AS service_ok, {pick(USER_AGENTS, 'i % 12')} AS user_agent, {pick(STATUS_WORDS, 'i % 9')} AS status_word,
    CASE WHEN (w = 0 AND event_type = 'error' AND i % 10 = 0) OR (w = 1 AND event_type IN ('error', 'signup'))
           OR (w = 2 AND event_type = 'error' AND i % 2 = 0) THEN 'fallback'
         WHEN event_type IN ('signup', 'purchase') THEN 'miss' ELSE 'hit' END AS outcome,
    CASE WHEN i % 31 = 0 THEN 401 WHEN i % 71 = 0 THEN 500 ELSE 200 END AS status,
    CAST(floor(value * 10) AS BIGINT) AS latency_ms FROM c_raw""")
AGENTS = "|".join(re.escape(a) for a in lists.AI_AGENTS)
FAMILY = "CASE " + " ".join(f"WHEN contains(lower(user_agent), '{p}') THEN '{f}'" for p, f in lists.BOT_FAMILIES) + " ELSE 'unknown' END"
WORDS = "CASE lower(status_word) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lists.OUTCOMES.items()) + " END"
step("c_req", f"""SELECT *, CASE WHEN outcome = 'fallback' THEN CASE WHEN i % 3 = 0 THEN 502 ELSE 200 END
         WHEN outcome = 'miss' THEN 200 END AS extractor_status,
    regexp_matches(lower(user_agent), '{AGENTS}') AS is_ai, {FAMILY} AS bot_family, {WORDS} AS word_outcome,
    CASE WHEN method = 'OPTIONS' THEN 'cors' WHEN path = '/render' THEN 'render' WHEN path = '/render/internal' THEN 'internal'
         WHEN path = '/render/content' THEN 'content' WHEN path = '/_service/crawl' AND method = 'POST' THEN 'crawl_start'
         WHEN regexp_matches(path, '^/_service/crawl/[a-zA-Z0-9-]+$') AND method = 'GET' THEN 'crawl_status'
         ELSE 'proxy' END AS endpoint FROM c_req0""")
step("c_requrl", parsed("c_req", "request_id"))
step("c_reqkeys", f"SELECT request_id, {canonical('full_host')} AS canonical FROM c_requrl")
step("c_auth", """SELECT r.*, coalesce(h.key, t.key) AS auth_key,
    CASE WHEN h.key IS NOT NULL THEN h.customer_id ELSE t.customer_id END AS auth_customer,
    coalesce(h.key, t.key) IS NOT NULL AS auth_found
    FROM c_req r LEFT JOIN c_config h ON h.key = 'apikeyhash:' || sha256(r.token) LEFT JOIN c_config t ON t.key = 'apikey:' || r.token""")

PRIVATE = """coalesce(u.full_host = 'localhost' OR regexp_matches(u.full_host, '\\.(local|internal)$')
    OR regexp_matches(u.full_host, '^(127\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|169\\.254\\.|0\\.)'), false)"""
URL_CHECKS = """WHEN coalesce(r.url, '') = '' THEN 'missing_url' WHEN u.scheme IS NULL THEN 'invalid_url'"""
STATUS = """CASE error_code WHEN 'missing_token' THEN 401 WHEN 'invalid_token' THEN 401 WHEN 'unauthorised' THEN 401
    WHEN 'bad_config' THEN 500 WHEN 'domain_denied' THEN 403 WHEN 'unknown_customer' THEN 404 ELSE 400 END"""


def verdict(checks, source="c_auth", customer="r.auth_customer"):
    return f"""SELECT request_id, customer_id, CASE WHEN error_code IS NULL THEN 200 ELSE {STATUS} END AS http_status, error_code
      FROM (SELECT r.request_id, {customer} AS customer_id, CASE {checks} END AS error_code
        FROM {source} r JOIN c_requrl u USING (request_id) LEFT JOIN c_allow a ON a.key = r.auth_key AND a.host = u.host)"""


TOKEN_CHECKS = """WHEN coalesce(r.token, '') = '' THEN 'missing_token' WHEN NOT r.auth_found THEN 'invalid_token'
    WHEN r.auth_customer IS NULL THEN 'bad_config'"""
NOT_HTTPS, DENIED = "WHEN u.scheme <> 'https' THEN 'not_https'", "WHEN a.key IS NULL THEN 'domain_denied'"
IS_PRIVATE = f"WHEN {PRIVATE} THEN 'private_host'"
step("c_named", """SELECT r.*, c.key AS auth_key, c.key IS NOT NULL AS auth_found
    FROM c_req r LEFT JOIN c_config c ON c.key = 'customer:' || r.customer_id""")
step("c_render", verdict(f"{TOKEN_CHECKS} {URL_CHECKS} {NOT_HTTPS} {DENIED} {IS_PRIVATE}"))

# --- write log ----------------------------------------------------------------

step("c_turns", f"""SELECT page_id, url_key, html, page_id * 2 + n AS wid, n = 1 AND page_id % 29 = 0 AS bad,
    CASE WHEN n = 0 THEN {at('page_id % 100')} ELSE {at('3000 + page_id * 13 % 1000')} END AS written_at,
    CASE WHEN n = 1 AND page_id % 29 = 0 THEN html ELSE markdown END AS markdown
    FROM c_content, (VALUES (0), (1)) AS t(n)""")
step("c_writes", f"""SELECT wid, url_key, 'md' AS kind, markdown AS body, written_at, 1200 AS ttl_s, page_id FROM c_turns WHERE markdown <> ''
    UNION ALL SELECT wid, url_key, 'html', html, written_at, 600, page_id FROM c_turns WHERE markdown <> '' AND html <> ''
    UNION ALL SELECT wid, url_key, 'tokens', '{{"htmlTokens":' || {tokens('html')} || ',"mdTokens":' || {tokens('markdown')} || ',"ts":' || epoch_ms(written_at) || '}}',
      written_at, 1200, page_id FROM c_turns WHERE markdown <> ''""")


def lookup(requests):
    """As-of join with the newest earlier write, then its time to live."""
    return f"""SELECT r.request_id, r.url_key,
        CASE WHEN w.written_at + to_seconds(w.ttl_s) > r.ts AND NOT w.bad THEN 'HIT' ELSE 'MISS' END AS cache_status,
        CASE WHEN w.written_at + to_seconds(w.ttl_s) > r.ts AND NOT w.bad THEN w.wid END AS wid,
        CASE WHEN w.written_at + to_seconds(w.ttl_s) > r.ts AND NOT w.bad THEN {epoch('r.ts')} - {epoch('w.written_at')} END AS age_s
      FROM {requests} r ASOF LEFT JOIN (SELECT *, {is_html('body')} AS bad FROM c_writes WHERE kind = 'md') w
        ON w.url_key = r.url_key AND w.written_at <= r.ts"""


# --- site maps, seeds, crawls, metrics ----------------------------------------

step("c_maplist", """SELECT h.host, h.r, list(p.url ORDER BY p.page_id) AS own
    FROM c_pages p JOIN c_hosts h ON h.host = p.host GROUP BY ALL""")
# the fourth shape repeats the list: once as strings, once as objects
step("c_maplist2", """SELECT *, own || ['https://' || host || '/logo.png', 'https://elsewhere.example/x', own[1]] AS listed FROM c_maplist""")
step("c_maps", """SELECT host, 'cust_' || (r // 8) AS customer_id, 'dom_' || r AS domain_id,
    CASE WHEN r % 5 = 4 THEN listed || listed ELSE listed END AS urls FROM c_maplist2""")
step("c_mapurls", """SELECT customer_id, domain_id, host AS hostname, unnest(urls) AS url,
    CAST(generate_subscripts(urls, 1) - 1 AS INTEGER) AS ordinal FROM c_maps""")
ASSETS = "|".join(re.escape(x) for x in lists.SEED_ASSETS)
step("c_mapparts", parsed("c_mapurls", "customer_id, domain_id, hostname, ordinal"))
step("c_mapseeds", f"""SELECT customer_id, domain_id, hostname, ordinal, url,
    CASE WHEN NOT asset THEN {canonical('host')} END AS seed_url, CASE WHEN NOT asset THEN host END AS host,
    CASE WHEN NOT asset THEN path END AS path
    FROM (SELECT *, regexp_matches(lower(path), '({ASSETS})$') AS asset FROM c_mapparts)""")
step("c_candidates", """SELECT customer_id, domain_id, seed_url AS url, min(ordinal) AS ordinal FROM c_mapseeds
    WHERE host = hostname GROUP BY ALL""")
step("c_seeds", """SELECT d.customer_id, s.url, CASE WHEN s.page_id % 2 = 0 THEN 'manual' ELSE 'firecrawl_map' END AS source,
    s.page_id % 4 <> 0 AS enabled FROM c_seedurls s JOIN c_domains d ON d.hostname = s.host WHERE d.verified""")
step("c_owned", """SELECT d.customer_id, s.host, s.url, s.page_id AS ordinal FROM c_seedurls s JOIN c_domains d ON d.hostname = s.host""")
step("c_metrics", f"""SELECT d.customer_id, c.canonical AS url, c.html_tokens, CASE WHEN c.page_id % 7 <> 0 THEN c.md_tokens END AS md_tokens,
    {at('c.page_id * 60')} AS optimized_at, {at('c.page_id')} AS created_at, {at('c.page_id * 2')} AS updated_at
    FROM c_content c JOIN c_domains d ON d.hostname = c.host WHERE c.canonical LIKE 'https:%'""")
step("c_changes", f"""SELECT d.customer_id, c.canonical AS url, CASE WHEN i % 5 <> 0 AND i % 37 <> 0 THEN html_tokens END AS html_tokens,
    CASE WHEN i % 37 <> 0 THEN md_tokens END AS md_tokens, {at('i * 7919 % 100000')} AS optimized_at, i AS seq, {at('i')} AS received_at
    FROM (SELECT event_id AS i, page_id FROM c_events) e JOIN c_content c USING (page_id) JOIN c_domains d ON d.hostname = c.host""")
step("c_posted", """SELECT *, CASE WHEN seq % 53 = 0 THEN 'invalid_body' WHEN seq % 59 = 0 THEN 'invalid_json'
    WHEN seq % 43 = 0 OR seq % 47 = 0 OR seq % 41 = 0 THEN 'missing_fields'
    WHEN seq % 61 <> 0 AND seq % 67 = 0 THEN 'invalid_time' END AS error_code,
    CASE WHEN seq % 61 = 0 THEN received_at ELSE optimized_at END AS stamp FROM c_changes""")
step("c_crawled", """SELECT 'crawl_' || (page_id % n) AS crawl_id, page_id // n AS ordinal,
    CASE WHEN page_id < n THEN 'https://elsewhere.example/x' ELSE url END AS url, 'Page ' || page_id AS title,
    CASE WHEN page_id % 17 <> 0 THEN markdown END AS markdown, 'cust_' || (page_id % n) AS customer_id
    FROM (SELECT *, greatest(1, (SELECT count(*) FROM pages) // 10) AS n FROM c_content)""")
step("c_jobs", """SELECT c, 'crawl_' || c AS id, 'cust_' || (CASE WHEN c % 6 = 5 THEN c + 1 ELSE c END) AS customer_id,
    3 + c % 5 * 2 AS lim, c % 9 <> 4 AS cache_results,
    CASE WHEN c % 7 = 0 THEN [] ELSE coalesce(list(DISTINCT host) FILTER (page_id % 3 <> 0), []) END AS allowed
    FROM (SELECT *, page_id % n AS c FROM (SELECT *, greatest(1, (SELECT count(*) FROM pages) // 10) AS n FROM c_pages)) WHERE c <> n - 1 GROUP BY c""")
step("c_crawlparts", parsed("c_crawled", "crawl_id, ordinal, customer_id, markdown, title"))
step("c_judged", f"""SELECT p.crawl_id, p.ordinal, p.markdown, {canonical('full_host')} AS canonical,
    CASE WHEN j.id IS NULL THEN 'no_job' WHEN j.customer_id <> p.customer_id THEN 'not_owner' WHEN NOT j.cache_results THEN 'not_cached'
         WHEN coalesce(p.markdown, '') = '' THEN 'no_content'
         WHEN len(j.allowed) > 0 AND NOT list_contains(j.allowed, p.host) THEN 'off_domain' ELSE 'admitted' END AS verdict
    FROM c_crawlparts p LEFT JOIN c_jobs j ON j.id = p.crawl_id""")
step("c_livejudged", f"""SELECT p.crawl_id, p.ordinal, {canonical('full_host')} AS canonical,
    CASE WHEN j.id IS NULL THEN 'no_job' WHEN j.customer_id <> p.customer_id THEN 'not_owner' WHEN NOT j.cache_results THEN 'not_cached'
         WHEN coalesce(p.markdown, '') = '' THEN 'no_content'
         WHEN len(j.allowed) > 0 AND NOT list_contains(j.allowed, p.host) THEN 'off_domain' ELSE 'admitted' END AS verdict
    FROM c_crawlparts p LEFT JOIN (SELECT * FROM c_jobs WHERE c % 5 * 1200 < 3600 OR c % 10 = 4) j ON j.id = p.crawl_id""")
step("c_usage", f"""SELECT customer_id, strftime(ts, '%Y-%m') AS month, count(*) AS renders FROM c_req
    WHERE endpoint = 'render' AND outcome = 'miss' GROUP BY ALL""")


def keep_last(rows, known):
    """Upsert by arrival; ``known`` keeps the last known value instead of the last one."""
    last = lambda c: f"max_by({c}, seq) FILTER ({c} IS NOT NULL) AS {c}" if known else f"arg_max_null({c}, seq) AS {c}"
    return f"""SELECT customer_id, url, {last('html_tokens')}, {last('md_tokens')}, {epoch('max_by(optimized_at, seq)')} AS optimized_s,
        {epoch('coalesce(min(made), min_by(received_at, seq))')} AS created_s, {epoch('max_by(received_at, seq)')} AS updated_s
        FROM {rows} GROUP BY customer_id, url"""


step("c_merged", """SELECT customer_id, url, html_tokens, md_tokens, optimized_at, seq, received_at, NULL::TIMESTAMP AS made FROM c_changes
    UNION ALL SELECT customer_id, url, html_tokens, md_tokens, optimized_at, -1, updated_at, created_at FROM c_metrics""")
step("c_arrived", """SELECT customer_id, url, html_tokens, md_tokens, stamp AS optimized_at, seq, received_at, NULL::TIMESTAMP AS made
    FROM c_posted WHERE error_code IS NULL""")


# --- the queries --------------------------------------------------------------

step("c_both", """SELECT page_id, url, html FROM pages UNION ALL
    SELECT page_id + 100000000, regexp_extract(url, '^[^#]*') || CASE WHEN contains(regexp_extract(url, '^[^#]*'), '?') THEN '&' ELSE '?' END
      || 'utm_medium=x' || substr(url, length(regexp_extract(url, '^[^#]*')) + 1), html FROM pages WHERE starts_with(url, 'http:')""")
step("c_bothparts", parsed("c_both", "page_id"))
step("c_bothkeys", f"SELECT page_id, host, path, canonical, {KEY} AS url_key FROM (SELECT *, {canonical('full_host')} AS canonical FROM c_bothparts)")

# copies hold the same HTML, so their content is that of the original page
oracle("token_savings_by_section", f"""
  SELECT host, section, count(*) AS pages, sum(html_tokens)::BIGINT AS html_tokens, sum(md_tokens)::BIGINT AS md_tokens,
    (sum(html_tokens) - sum(md_tokens))::BIGINT AS saved_tokens, {savings('sum(html_tokens)', 'sum(md_tokens)')} AS savings_pct
  FROM (SELECT b.url_key, min_by(b.host, b.page_id) AS host, min_by({SECTION.format('b.path')}, b.page_id) AS section,
      min_by(c.html_tokens, b.page_id) AS html_tokens, min_by(c.md_tokens, b.page_id) AS md_tokens
    FROM c_bothkeys b JOIN c_content c ON c.page_id = b.page_id % 100000000 WHERE c.markdown IS NOT NULL GROUP BY b.url_key)
  GROUP BY host, section""")

oracle("s1_load_pages", "SELECT page_id, url, strlen(html)::INTEGER AS html_bytes FROM pages")
oracle("s2_request_log", f"""
  SELECT 'good' AS state, i::VARCHAR AS ref, {epoch('ts')} AS ts_s, bot_family, status, status >= 400 AS is_error,
    CASE WHEN status >= 400 OR i % 25 = 0 THEN 1 ELSE 0 END AS entries FROM c_req WHERE i % 101 <> 0
  UNION ALL SELECT 'quarantine', left('{{"requestId":"' || i || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z'), 40),
    NULL, NULL, NULL, NULL, NULL FROM c_req WHERE i % 101 = 0""")
oracle("s3_explode_site_map", "SELECT customer_id, domain_id, ordinal, url FROM c_mapurls")
oracle("s4_explode_crawl", "SELECT crawl_id, ordinal::INTEGER AS ordinal, url, title, length(markdown)::INTEGER AS md_chars FROM c_crawled")
step("t_customers", "SELECT k, id, 'login_' || k AS login_id, plan FROM c_accounts")
step("t_domains", "SELECT id, customer_id, hostname FROM c_domains")
step("t_tokens", "SELECT id, customer_id, token_hash FROM c_tokens")
step("t_seeds", "SELECT 'seed:' || customer_id || ' ' || url AS id, customer_id, url, source FROM c_seeds")
step("t_snaps", "SELECT 'snap_' || id AS id, customer_id, id AS domain_id FROM c_domains")
step("t_jobs", "SELECT 'job_' || id AS id, id AS customer_id, 'auth_kv_sync' AS kind, 'success' AS state FROM c_accounts")
step("t_metrics", "SELECT 'metric:' || customer_id || ' ' || url AS id, customer_id, url FROM c_metrics")
CHILDREN = {"domain_count": "t_domains", "token_count": "t_tokens", "seed_count": "t_seeds", "snapshot_count": "t_snaps",
            "job_count": "t_jobs", "metric_count": "t_metrics"}
oracle("s5_load_accounts", f"""
  SELECT a.id, a.plan, {epoch('created_at')} AS created_s, {', '.join(f'coalesce({n}, 0) AS {n}' for n in CHILDREN)} FROM c_accounts a
  {' '.join(f'LEFT JOIN (SELECT customer_id, count(*) AS {n} FROM {t} GROUP BY 1) j_{n} ON j_{n}.customer_id = a.id' for n, t in CHILDREN.items())}""")
step("c_stored", f"""SELECT page_id, url_key, markdown, html, html_tokens, md_tokens, n, page_id * 2 + n AS wid, {at('page_id + n * 3600')} AS written_at,
    page_id % 3 = n AS has_html FROM c_content, (VALUES (0), (1)) AS t(n) WHERE markdown <> ''""")
oracle("s6_content_store", """
  SELECT url_key, kind, max(wid) AS wid, max_by(ttl_s, written_at)::BIGINT AS ttl_s, max_by(chars, written_at)::INTEGER AS body_chars FROM (
    SELECT url_key, 'md' AS kind, wid, 604800 AS ttl_s, length(markdown) AS chars, written_at FROM c_stored
    UNION ALL SELECT url_key, 'html', wid, 7200, length(html), written_at FROM c_stored WHERE has_html
    UNION ALL SELECT url_key, 'tokens', wid, 604800, length('{"htmlTokens":' || CASE WHEN has_html THEN html_tokens::VARCHAR ELSE 'null' END
      || ',"mdTokens":' || md_tokens || ',"ts":' || epoch_ms(written_at) || '}'), written_at FROM c_stored)
  GROUP BY url_key, kind""")
oracle("s7_metrics_sink", keep_last("c_arrived", False))
oracle("s7_metric_table", keep_last("c_arrived", False))
oracle("s8_publish_config", """
  SELECT key, CASE WHEN action = 'put' THEN document END AS document, action FROM c_change WHERE action <> 'unchanged'""")
oracle("s9_replace_snapshot", """
  SELECT c.customer_id, c.domain_id, (row_number() OVER (PARTITION BY c.domain_id ORDER BY c.ordinal) - 1)::INTEGER AS ordinal, c.url,
    CASE WHEN d.verified THEN 1704153600 ELSE 1704067200 END::BIGINT AS fetched_s, 1704067200::BIGINT AS created_s
  FROM c_candidates c JOIN c_domains d ON d.id = c.domain_id""")

oracle("p1_canonicalise", "SELECT page_id, canonical, NULL::VARCHAR AS url_error, host, path FROM c_bothkeys")
oracle("p2_normalise_seeds", "SELECT domain_id, ordinal, url, seed_url, host, path FROM c_mapseeds")
oracle("p3_normalise_host", "SELECT page_id, host AS from_typed, host AS from_stored FROM c_pages")
oracle("p4_url_key", "SELECT page_id, url_key, 'v1' AS canon_version FROM c_bothkeys")
oracle("p5_ai_agents", "SELECT request_id, user_agent, is_ai FROM c_req")
oracle("p5_agent_overrides", """
  SELECT request_id, customer_id, user_agent <> '' AND NOT (k % 6 = 0 AND contains(lower(user_agent), 'bytespider'))
    AND (is_ai OR (k % 4 = 0 AND contains(lower(user_agent), 'twitterbot'))
      OR (k % 4 <> 0 AND regexp_matches(lower(user_agent), 'googlebot|ccbot'))) AS is_ai FROM c_req""")
oracle("p6_bot_family", "SELECT request_id, bot_family FROM c_req")
SERVING = "|".join(re.escape(x) for x in lists.SERVING_ASSETS)
BLOCKED = "|".join(re.escape(x) for x in lists.BLOCKED_PATHS)
oracle("p7_route_traffic", f"""
  SELECT request_id, CASE WHEN reason IS NULL THEN 'optimise' ELSE 'passthrough' END AS route, reason FROM (
    SELECT request_id, CASE WHEN NOT is_ai THEN 'not_ai_agent' WHEN regexp_matches(lower(path), '({SERVING})$') THEN 'static_asset'
      WHEN regexp_matches(path, '^({BLOCKED})') THEN 'blocked_path' END AS reason FROM c_req)""")
oracle("p8_private_hosts", f"SELECT request_id, full_host AS host, {PRIVATE} AS is_private FROM c_requrl u")
oracle("p9_admit_render", "SELECT * FROM c_render")
oracle("p9_admit_internal", verdict(f"""WHEN NOT r.service_ok THEN 'unauthorised' {URL_CHECKS} {NOT_HTTPS} {IS_PRIVATE}
    WHEN NOT r.auth_found THEN 'unknown_customer' {DENIED}""", "c_named", "r.customer_id"))
oracle("p9_admit_crawl", verdict(f"{TOKEN_CHECKS} {URL_CHECKS} {DENIED}"))
oracle("p10_reject_html", f"SELECT wid, url_key FROM c_writes WHERE kind = 'md' AND NOT {is_html('body')}")
oracle("p11_extract_markdown", f"""SELECT page_id, html_tokens, markdown, {tokens('markdown')} AS md_tokens, needs_render FROM c_md""")
oracle("p12_scrub_headers", f"""
  SELECT event_id AS request_id, 'Accept,Accept-Language' AS kept, 'Accept,Accept-Language' AS safe,
    {pick(['en', 'de', 'fr'], 'event_id % 3')} AS language FROM events""")
oracle("p13_normalise_outcome", "SELECT request_id, status_word, word_outcome AS outcome FROM c_req")
LABEL = """CASE WHEN coalesce(md_tokens, 0) = 0 THEN '— B' WHEN b < 1024 THEN b || ' B'
    ELSE (tenths // 10) || CASE WHEN tenths % 10 = 0 THEN '' ELSE '.' || (tenths % 10) END || CASE WHEN b < 1048576 THEN ' KB' ELSE ' MB' END END"""
oracle("p14_preview", f"""
  SELECT page_id, substr(regexp_replace(markdown, '\\n{{3,}}', chr(10) || chr(10), 'g'), 1, 150000) AS preview,
    coalesce({UTF16.format('markdown')} > 150000, false) AS truncated, {LABEL} AS size_label
  FROM (SELECT *, (20 * b + unit) // (2 * unit) AS tenths FROM (
    SELECT *, md_tokens * 4 AS b, CASE WHEN md_tokens * 4 < 1048576 THEN 1024 ELSE 1048576 END AS unit FROM c_content))""")


def size_label(t):
    b, unit = f"({t} * 4)", f"(CASE WHEN {t} * 4 < 1048576 THEN 1024 ELSE 1048576 END)"
    tenths = f"((20 * {b} + {unit}) // (2 * {unit}))"
    return f"""CASE WHEN {t} = 0 THEN '— B' WHEN {b} < 1024 THEN {b} || ' B'
      ELSE ({tenths} // 10) || CASE WHEN {tenths} % 10 = 0 THEN '' ELSE '.' || ({tenths} % 10) END || CASE WHEN {b} < 1048576 THEN ' KB' ELSE ' MB' END END"""


PANEL_TIME = f"TIMESTAMP '{registry.PANELS_AS_OF}'"
step("c_panelkinds", f"""SELECT url_key, kind, max_by(CASE WHEN written_at + to_seconds(ttl_s) > {PANEL_TIME} THEN body END, wid) FILTER (
      written_at + to_seconds(ttl_s) > {PANEL_TIME}) AS body, max(wid) AS newest,
      max(wid) FILTER (written_at + to_seconds(ttl_s) > {PANEL_TIME}) AS live FROM c_writes WHERE written_at <= {PANEL_TIME} GROUP BY url_key, kind""")
step("c_panelbodies", """SELECT url_key, max(body) FILTER (kind = 'md') AS md, max(body) FILTER (kind = 'html') AS html,
    max(body) FILTER (kind = 'tokens') AS tok FROM c_panelkinds WHERE newest = live GROUP BY url_key""")
step("c_panels", f"""SELECT d.customer_id, c.canonical AS url, c.url_key, b.md, b.html, m.url IS NOT NULL OR b.md IS NOT NULL AS analysed,
      coalesce((tok->>'$.htmlTokens')::INTEGER, m.html_tokens, 0) AS ht,
      coalesce((tok->>'$.mdTokens')::INTEGER, CASE WHEN md IS NOT NULL THEN {tokens('md')} END, m.md_tokens, 0) AS mt
    FROM c_content c JOIN c_domains d ON d.hostname = c.host LEFT JOIN c_panelbodies b ON b.url_key = c.url_key
    LEFT JOIN c_metrics m ON m.customer_id = d.customer_id AND m.url = c.canonical""")
oracle("p14_preview_panels", f"""
  SELECT customer_id, url, url_key,
    CASE WHEN html IS NOT NULL THEN 'shown' WHEN analysed THEN 'expired' ELSE 'not_analysed' END AS html_state,
    md5(substr(html, 1, 150000)) AS html_preview, {UTF16.format('html')}::INTEGER AS html_chars,
    coalesce({UTF16.format('html')} > 150000, false) AS html_truncated, ht AS html_tokens, {size_label('ht')} AS html_size,
    CASE WHEN md IS NOT NULL THEN 'shown' WHEN analysed THEN 'expired' ELSE 'not_analysed' END AS md_state,
    substr(regexp_replace(md, '\\n{{3,}}', chr(10) || chr(10), 'g'), 1, 150000) AS md_preview,
    coalesce({UTF16.format('md')} > 150000, false) AS md_truncated, mt AS md_tokens, {size_label('mt')} AS md_size,
    {savings('ht', 'mt')} AS savings_pct FROM c_panels""")
oracle("p15_split_valid_metrics", f"""
  SELECT seq, error_code, CASE WHEN error_code IS NULL THEN customer_id END AS customer_id, CASE WHEN error_code IS NULL THEN url END AS url,
    CASE WHEN error_code IS NULL THEN html_tokens END AS html_tokens, CASE WHEN error_code IS NULL THEN md_tokens END AS md_tokens,
    CASE WHEN error_code IS NULL THEN {epoch('stamp')} END AS optimized_s FROM c_posted""")


def sampled(rate):
    return f"(status >= 400 OR ('0x' || left(md5(request_id::VARCHAR), 7))::BIGINT % 10000 < {int(rate * 10000)})"


oracle("p16_sample_log", f"""
  SELECT request_id, CASE WHEN status >= 400 THEN 1.0::DOUBLE ELSE {1 / lists.LOG_SAMPLE_RATE}::DOUBLE END AS weight
  FROM c_req WHERE {sampled(lists.LOG_SAMPLE_RATE)}""")
oracle("p17_retain", f"""
  SELECT request_id, CASE WHEN canonical IS NOT NULL THEN {KEY} END AS url_key FROM c_reqkeys JOIN c_req USING (request_id)
  WHERE ts >= TIMESTAMP '{registry.RETAIN_AS_OF}' - INTERVAL {registry.RETAIN_DAYS} DAY""")
oracle("p18_endpoint_class", "SELECT request_id, method, path, endpoint FROM c_req")

oracle("j1_auth_lookup", "SELECT request_id, auth_customer, auth_found FROM c_auth")
oracle("j2_config_by_customer", "SELECT request_id, customer_id, auth_found FROM c_named")
oracle("j3_allowed_domain", """
  SELECT request_id, customer_id, page_host FROM c_req r
  WHERE EXISTS (SELECT 1 FROM c_domains d WHERE d.customer_id = r.customer_id AND d.hostname = r.page_host)""")
oracle("j3_denied_domain", """
  SELECT request_id, customer_id, page_host FROM c_req r
  WHERE NOT EXISTS (SELECT 1 FROM c_domains d WHERE d.customer_id = r.customer_id AND d.hostname = r.page_host)""")
oracle("j4_cache_lookup", lookup("c_req"))
LIVE = f"written_at + to_seconds(ttl_s) > TIMESTAMP '{AS_OF}'"
step("c_newest", f"""SELECT url_key, kind, max_by(CASE WHEN {LIVE} THEN body END, wid) FILTER ({LIVE}) AS body,
    max(wid) AS newest, max(wid) FILTER ({LIVE}) AS live_wid FROM c_writes WHERE written_at <= TIMESTAMP '{AS_OF}' GROUP BY url_key, kind""")
step("c_bundle", """SELECT url_key, max(body) FILTER (kind = 'md' AND newest = live_wid) AS md,
    max(body) FILTER (kind = 'html' AND newest = live_wid) AS html, max(body) FILTER (kind = 'tokens' AND newest = live_wid) AS tok
    FROM c_newest GROUP BY url_key""")
oracle("j5_content_bundle", f"""
  SELECT url_key, length(md)::INTEGER AS markdown, length(html)::INTEGER AS html, (tok->>'$.htmlTokens')::INTEGER AS html_tokens,
    coalesce((tok->>'$.mdTokens')::INTEGER, CASE WHEN md IS NOT NULL THEN {tokens('md')} END) AS md_tokens,
    html IS NOT NULL AS html_cached, md IS NOT NULL AS md_cached FROM c_bundle""")


def overview(listed, columns):
    return f"""SELECT {columns}, CASE WHEN m.url IS NULL THEN 'Not checked' ELSE 'Optimized' END AS status,
        coalesce({savings('m.html_tokens', 'm.md_tokens')} || '%', '—') AS savings,
        coalesce(strftime(m.optimized_at, '%Y-%m-%d'), 'Never') AS last_optimized
      FROM {listed} o LEFT JOIN c_metrics m ON m.customer_id = o.customer_id AND m.url = o.url"""


oracle("j6_overview", overview("c_owned", "o.customer_id, o.url"))
oracle("j7_merge_starter", """
  SELECT coalesce(s.customer_id, c.customer_id) AS customer_id, coalesce(s.url, c.url) AS url, coalesce(s.source, 'firecrawl_map') AS source,
    c.url IS NOT NULL OR s.enabled AS enabled,
    CASE WHEN s.url IS NULL THEN 'insert' WHEN c.url IS NULL OR s.enabled THEN 'keep' ELSE 'enable' END AS action
  FROM c_seeds s FULL JOIN (SELECT DISTINCT customer_id, url FROM c_candidates) c ON c.customer_id = s.customer_id AND c.url = s.url""")
oracle("s4_crawl_replies", """
  SELECT crawl_id, poll::INTEGER AS poll, CASE poll WHEN 0 THEN 'running' WHEN 3 THEN 'expired' WHEN 4 THEN 'running' WHEN 5 THEN 'completed' ELSE 'unreadable' END AS state,
    CASE WHEN poll IN (0, 3, 5) THEN n WHEN poll = 4 THEN 0 END::INTEGER AS total,
    CASE WHEN poll = 0 THEN n - 1 WHEN poll = 5 THEN n WHEN poll IN (3, 4) THEN 0 END::INTEGER AS completed,
    CASE WHEN poll = 0 THEN n - 1 WHEN poll IN (3, 4, 5) THEN 0 END::INTEGER AS credits_used,
    CASE poll WHEN 0 THEN '2024-01-02T00:40:00.000Z' WHEN 3 THEN '2024-01-01T00:40:00.000Z' END AS expires_at,
    CASE WHEN poll = 5 THEN n END::INTEGER AS pages
  FROM (SELECT crawl_id, count(*) AS n FROM c_crawled GROUP BY crawl_id), range(6) r(poll)""")
oracle("f3_sql_crawl_pages", f"""
  SELECT crawl_id, 5 AS poll, ordinal::INTEGER AS ordinal, url, title, {tokens('markdown')} AS md_tokens, {is_html('markdown')} AS is_html FROM c_crawled""")
oracle("j8_live_crawl_jobs", "SELECT crawl_id, ordinal, verdict, canonical FROM c_livejudged")
oracle("j8_filter_crawl", "SELECT crawl_id, ordinal, verdict, canonical FROM c_judged")
step("c_flight", f"""SELECT request_id, page_host, i * 1000 AS start_ms, CASE WHEN outcome IN ('miss', 'fallback')
    THEN i * 1000 + least(latency_ms * {registry.LATENCY_FACTOR}, 30000) END AS end_ms FROM c_req""")
oracle("j9_in_flight_followers", """
  SELECT f.request_id, f.page_host, max(struct_pack(e := l.end_ms, i := l.request_id)).i AS leader_id,
    max(l.end_ms) - f.start_ms AS wait_ms
  FROM c_flight f JOIN c_flight l ON l.page_host = f.page_host AND l.start_ms < f.start_ms AND l.end_ms > f.start_ms
  GROUP BY f.request_id, f.page_host, f.start_ms""")
step("c_waits", f"""SELECT f.request_id, max(struct_pack(e := l.end_ms, i := l.request_id)).i AS leader_id, f.start_ms
  FROM c_flight f JOIN c_flight l ON l.page_host = f.page_host AND l.start_ms < f.start_ms AND l.end_ms > f.start_ms
  GROUP BY f.request_id, f.start_ms""")
step("c_polled", f"""SELECT r.request_id, r.page_host, r.endpoint, w.leader_id,
    list_filter(range(1, 7), lambda k: l.outcome = 'miss' AND l.i * 1000 + l.latency_ms * {registry.LATENCY_FACTOR} <= w.start_ms + k * 500)[1] AS look
  FROM c_waits w JOIN c_req r USING (request_id) JOIN c_req l ON l.request_id = w.leader_id WHERE r.endpoint IN ('render', 'internal', 'proxy')""")
oracle("j9_wait_outcomes", """
  SELECT request_id, page_host, endpoint, leader_id,
    CASE WHEN look IS NOT NULL THEN 'hit' WHEN endpoint = 'render' THEN 'timeout' ELSE 'extract' END AS wait_outcome,
    CASE WHEN look IS NOT NULL THEN 200 WHEN endpoint = 'render' THEN 503 END AS http_status, (coalesce(look, 6) * 500)::INTEGER AS waited_ms
  FROM c_polled""")
oracle("j10_apply_invalidations", f"""
  SELECT wid, url_key, kind FROM c_writes w WHERE kind <> 'md' OR NOT EXISTS (
    SELECT 1 FROM c_raw e WHERE e.event_type = 'signup' AND e.i % 7 <> 0 AND e.url_key = w.url_key AND w.written_at <= {at('e.i + e.i % 200')})""")
oracle("j11_config_diff", "SELECT key, action FROM c_change")
step("c_golden", """SELECT page_id AS key, CASE page_id % 4 WHEN 2 THEN markdown || ' end' WHEN 3 THEN replace(markdown, 'the', 'thE') ELSE markdown END AS g
    FROM c_content WHERE url LIKE 'https:%' UNION ALL SELECT page_id + 1000000000, 'gone' FROM c_content WHERE url LIKE 'http:%'""")
step("c_pairs", """SELECT coalesce(c.page_id, g.key) AS key, c.markdown AS a, g.g,
    CASE WHEN c.page_id IS NULL THEN 'missing_actual' WHEN g.key IS NULL THEN 'missing_golden' WHEN c.markdown = g.g THEN 'equal' ELSE 'differs' END AS status
    FROM c_content c FULL JOIN c_golden g ON g.key = c.page_id""")
step("c_marks", """SELECT *, CASE WHEN status = 'differs' THEN coalesce(list_position(list_transform(
      list_zip(string_split(a, ''), string_split(g, ''))[:length(a)], lambda p: p[1] IS DISTINCT FROM p[2]), true), 0) - 1 END AS pos FROM c_pairs""")
oracle("j12_golden_diff", """
  SELECT key, status, pos::INTEGER AS pos, CASE WHEN status = 'differs' THEN
    substr(a, greatest(0, pos - 20) + 1, pos + 20 - greatest(0, pos - 20)) END AS snippet FROM c_marks""")

oracle("a1_dedupe_urls", "SELECT customer_id, seed_url, min(ordinal) AS ordinal FROM c_mapseeds WHERE seed_url IS NOT NULL GROUP BY ALL")
oracle("a2_section_report", f"""
  SELECT customer_id, section, count(*) AS url_count, count(*) > 1 AS is_folder, CASE WHEN section = '/' THEN 'root' ELSE substr(section, 2) END AS label
  FROM (SELECT DISTINCT customer_id, url, {SECTION.format(url_path('url'))} AS section FROM c_owned) GROUP BY customer_id, section""")
oracle("a3_usage", "SELECT customer_id, month, renders FROM c_usage")
INCLUDED = "CASE plan " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in registry.SMALL_PLANS.items() if v) + " END"
oracle("a4_quota", f"""
  SELECT customer_id, month, renders, plan, included, problem,
    CASE WHEN problem IS NULL THEN CASE WHEN included IS NOT NULL THEN greatest(included - renders, 0) ELSE 0 END END AS remaining,
    CASE WHEN problem IS NULL THEN coalesce(greatest(renders - included, 0), 0) END AS overage,
    CASE WHEN problem IS NULL THEN coalesce(renders > included * 2, false) END AS soft_limited,
    CASE WHEN problem IS NULL THEN coalesce(greatest(renders - included, 0), 0) * {lists.OVERAGE_MICROS} END AS overage_micros
  FROM (SELECT u.*, a.plan, ({INCLUDED})::BIGINT AS included, CASE WHEN a.id IS NULL THEN 'unknown_customer'
      WHEN a.plan IS NULL OR a.plan NOT IN ({', '.join(quote(k) for k in registry.SMALL_PLANS)}) THEN 'unknown_plan' END AS problem
    FROM c_usage u LEFT JOIN c_accounts a ON a.id = u.customer_id)""")
oracle("a5_request_stats", f"""
  SELECT bot_family, endpoint, count(*) AS requests,
    {', '.join(f"count(*) FILTER (word_outcome = '{o}') AS {o}_count" for o in ('hit', 'miss', 'fallback', 'error'))},
    count(*) FILTER (status >= 400) AS http_errors, count(*) FILTER (status = 200 AND word_outcome = 'hit') AS ok_hits,
    count(*) FILTER (status = 200) AS ok_requests, sum(latency_ms)::BIGINT AS latency_sum_ms,
    floor(quantile_cont(latency_ms, 0.5) * 100 + 0.5)::BIGINT AS p50_centims, floor(quantile_cont(latency_ms, 0.95) * 100 + 0.5)::BIGINT AS p95_centims
  FROM c_req GROUP BY bot_family, endpoint""")
oracle("a6_token_limits", """
  SELECT customer_id, count(*) FILTER (NOT revoked) AS active_tokens, count(*) FILTER (NOT revoked) >= 5 AS at_limit FROM c_tokens GROUP BY customer_id""")
step("c_minutes", f"SELECT {epoch('ts')} // 60 AS minute, outcome, extractor_status FROM c_req")


def windows(width, closed=""):
    return f"""SELECT s AS window_start_min, count(*) AS requests, count(*) FILTER (outcome = 'fallback') AS fallbacks,
        count(extractor_status) AS calls, count(*) FILTER (extractor_status >= 500) AS failures
      FROM (SELECT *, unnest(range(minute - {width - 1}, minute + 1)) AS s FROM c_minutes) {closed} GROUP BY s"""


def rule_sql(rule, closed=""):
    return f"""SELECT '{rule['rule']}' AS rule, '{rule['level']}' AS level, window_start_min, requests, fallbacks AS events
      FROM ({windows(rule['window_min'], closed)}) WHERE requests > {rule['over']} AND fallbacks * {rule['den']} > requests * {rule['num']}"""


EXTRACTOR = lists.EXTRACTOR_ALERT
oracle("a7_fallback_alerts", " UNION ALL ".join(rule_sql(r) for r in lists.ALERT_RULES) + f"""
  UNION ALL SELECT '{EXTRACTOR['rule']}', '{EXTRACTOR['level']}', window_start_min, calls, failures FROM ({windows(15)})
  WHERE failures * {EXTRACTOR['den']} > calls * {EXTRACTOR['num']}""")
oracle("a8_crawl_summary", """
  SELECT g.crawl_id, total_pages, total_pages AS reported_cached, admitted_pages, off_domain_pages, CASE WHEN j.id IS NOT NULL THEN least(j.lim, 100)::INTEGER END AS effective_limit
  FROM (SELECT crawl_id, count(*) AS total_pages, count(*) FILTER (verdict = 'admitted') AS admitted_pages,
    count(*) FILTER (verdict = 'off_domain') AS off_domain_pages FROM c_judged GROUP BY crawl_id) g LEFT JOIN c_jobs j ON j.id = g.crawl_id""")
oracle("a9_build_config", "SELECT key, document FROM c_built")
oracle("a10_cost", f"SELECT customer_id, month, renders, renders * {lists.EXTRACTION_MICROS} AS cost_micros FROM c_usage")
oracle("a11_token_accounting", f"""
  SELECT page_id, html_tokens, md_tokens, (html_tokens - md_tokens)::BIGINT AS saved_tokens, {savings('html_tokens', 'md_tokens')} AS savings_pct FROM c_content""")
oracle("a11_token_rollup", f"""
  SELECT customer_id, section, count(*) AS pages, sum(html_tokens)::BIGINT AS html_tokens, sum(md_tokens)::BIGINT AS md_tokens,
    (sum(html_tokens) - sum(md_tokens))::BIGINT AS saved_tokens, {savings('sum(html_tokens)', 'sum(md_tokens)')} AS savings_pct
  FROM (SELECT c.*, d.customer_id, {SECTION.format('c.path')} AS section FROM c_content c JOIN c_domains d ON d.hostname = c.host)
  GROUP BY ROLLUP (customer_id, section)""")

oracle("w1_primary_domain", """
  SELECT customer_id, id, hostname FROM c_domains QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at, id) = 1""")
oracle("w2_latest_active_token", """
  SELECT customer_id, id, token_hash FROM c_tokens WHERE NOT revoked
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) = 1""")
oracle("w3_upsert", keep_last("c_merged", False))
oracle("w4_bar_scale", """
  SELECT bot_family, endpoint, value, floor(value / greatest(1, max(value) OVER (PARTITION BY bot_family)) * 100 + 0.5)::INTEGER AS pct
  FROM (SELECT bot_family, endpoint, count(*) AS value FROM c_req GROUP BY ALL)""")
oracle("w5_upsert_keep_known", keep_last("c_merged", True))

step("c_ranked", f"""SELECT customer_id, url, min(ordinal) AS ordinal, {SECTION.format(url_path('url'))} AS section FROM c_owned GROUP BY customer_id, url""")


def ranks(by):
    return f"""dense_rank() OVER (PARTITION BY {by} ORDER BY CASE WHEN section = '/' THEN '' ELSE lower(section) END, section) AS section_rank,
        row_number() OVER (PARTITION BY {by}, section ORDER BY CASE WHEN section = '/' THEN ordinal ELSE 0 END, url) AS url_rank"""


oracle("l1_rank_sections", f"SELECT customer_id, section, url, {ranks('customer_id')} FROM c_ranked")
oracle("l2_cap_per_site", f"""
  SELECT customer_id, host, ordinal, url FROM c_owned
  QUALIFY row_number() OVER (PARTITION BY customer_id, host ORDER BY ordinal) <= {registry.SITE_CAP}""")
step("c_capped", """SELECT c.* FROM c_crawled c LEFT JOIN c_jobs j ON j.id = c.crawl_id
    QUALIFY row_number() OVER (PARTITION BY c.crawl_id ORDER BY c.ordinal) <= least(coalesce(j.lim, 100), 100)""")
oracle("l3_cap_per_crawl", "SELECT crawl_id, ordinal, url FROM c_capped")
oracle("l4_first_per_group", """
  SELECT customer_id, max(request_id) AS request_id, max_by(path, request_id) AS path FROM c_req GROUP BY customer_id""")

oracle("x1_distinct_urls", "SELECT DISTINCT url FROM c_mapurls")
oracle("x2_new_urls", """
  SELECT customer_id, domain_id, url FROM c_candidates c
  WHERE NOT EXISTS (SELECT 1 FROM c_seeds s WHERE s.customer_id = c.customer_id AND s.url = c.url)""")
SAMPLE = "|".join(re.escape(a) for a in lists.SAMPLE_AGENTS)
oracle("x3_classifier_drift", f"""
  SELECT user_agent, count(*) AS requests, any_value(is_ai) AS by_serving, any_value(regexp_matches(lower(user_agent), '{SAMPLE}')) AS by_sample
  FROM c_req WHERE is_ai <> regexp_matches(lower(user_agent), '{SAMPLE}') GROUP BY user_agent""")
DRIFT = ", ".join(f"({quote(a)}, {a in lists.AI_AGENTS}, {a in lists.SAMPLE_AGENTS})" for a in sorted(set(lists.AI_AGENTS) ^ set(lists.SAMPLE_AGENTS)))
oracle("x3_list_drift", f"""
  SELECT agent, in_serving, in_sample, count(r.request_id) AS requests FROM (VALUES {DRIFT}) AS t(agent, in_serving, in_sample)
  LEFT JOIN c_req r ON contains(lower(r.user_agent), agent) GROUP BY ALL""")
oracle("f1_sql_urls", "SELECT page_id, p.canonical, p.url_key, s.url AS seed, p.host FROM c_pages p JOIN c_seedurls s USING (page_id)")
oracle("f2_sql_agents", "SELECT bot_family AS family, is_ai, count(*) AS requests FROM c_req GROUP BY ALL")
ALL_AGENTS = ", ".join(f"({quote(a)})" for a in lists.AI_AGENTS + ["twitterbot", "googlebot"])
oracle("x4_effective_agents", f"""
  SELECT 'cust_' || c_custkey AS customer_id, agent FROM customer, (VALUES {ALL_AGENTS}) AS t(agent)
  WHERE (agent <> 'twitterbot' OR c_custkey % 4 = 0) AND (agent <> 'googlebot' OR c_custkey % 4 <> 0)
    AND NOT (c_custkey % 6 = 0 AND agent = 'bytespider')""")

# each leader is followed by the first request after its marker has gone; rows behind the last watermark are decided
step("c_extract", f"""SELECT request_id AS id, page_host AS k, i * 1000 AS start_ms, i * 1000 + least(latency_ms * {registry.LATENCY_FACTOR}, 30000) AS done
    FROM c_req WHERE outcome IN ('miss', 'fallback') AND page_host IS NOT NULL""")
step("c_after", """SELECT a.id, a.k, a.done, min(b.id) AS next FROM c_extract a LEFT JOIN c_extract b ON b.k = a.k AND b.start_ms >= a.done AND b.id > a.id
    GROUP BY ALL""")
step("c_lead", """SELECT id, k, next FROM c_after WHERE id IN (SELECT min(id) FROM c_extract GROUP BY k)
    UNION ALL SELECT a.id, a.k, a.next FROM c_lead l JOIN c_after a ON a.id = l.next""")
oracle("t1_single_flight", f"""
  SELECT e.id AS request_id, e.k AS key, max(l.id) AS leader_id FROM c_extract e JOIN c_lead l ON l.k = e.k AND l.id <= e.id
  WHERE e.start_ms < (SELECT max(start_ms) FROM c_extract) - 30000 GROUP BY e.id, e.k""")
oracle("t2_metrics_stream", keep_last("c_arrived", False))
oracle("t3_usage_stream", "SELECT customer_id, month, renders FROM c_usage")
# a stream emits the windows that end before its watermark, five minutes behind the last event
MARK = f"(SELECT max({epoch('ts')}) - 300 FROM c_req)"
oracle("t4_alert_stream", " UNION ALL ".join(
    rule_sql(r, f"WHERE (s + {r['window_min']}) * 60 <= {MARK}") for r in lists.ALERT_RULES) + f"""
  UNION ALL SELECT '{EXTRACTOR['rule']}', '{EXTRACTOR['level']}', window_start_min, calls, failures FROM ({windows(15, f'WHERE (s + 15) * 60 <= {MARK}')})
  WHERE failures * {EXTRACTOR['den']} > calls * {EXTRACTOR['num']}""")
oracle("t5_cache_state", lookup("c_req"))
oracle("t6_stats_stream", f"""
  SELECT {epoch('ts')} // 300 * 300 AS window_start_s, bot_family, count(*) AS requests,
    {', '.join(f"count(*) FILTER (word_outcome = '{o}') AS {o}_count" for o in ('hit', 'miss', 'fallback', 'error'))},
    sum(latency_ms)::BIGINT AS latency_sum_ms
  FROM c_req WHERE {epoch('ts')} // 300 * 300 + 300 <= {MARK} GROUP BY 1, 2""")

step("c_bothseeds", f"SELECT host, {canonical('host')} AS seed FROM c_bothparts")
oracle("q1_unique_violations", "SELECT host, seed, count(*) AS copies FROM c_bothseeds GROUP BY host, seed HAVING count(*) > 1")
oracle("q2_orphans", """
  SELECT id, customer_id, hostname FROM c_domains WHERE customer_id NOT IN (
    SELECT a.id FROM c_accounts a JOIN c_domains v ON v.customer_id = a.id WHERE v.verified)""")
step("c_gone", "SELECT id FROM c_accounts WHERE plan = 'pro'")
oracle("q2_cascade_delete", """
  SELECT 'customers' AS table_name, id AS row_id FROM c_gone
""" + "".join(f"  UNION ALL SELECT '{name}', id FROM {t} WHERE customer_id IN (SELECT id FROM c_gone)\n" for name, t in (
    ("domains", "t_domains"), ("map_snapshots", "t_snaps"), ("api_tokens", "t_tokens"), ("seed_urls", "t_seeds"),
    ("publish_jobs", "t_jobs"), ("url_metrics", "t_metrics"))))
oracle("q3_enum_violations", """
  SELECT id, CASE WHEN k % 9 = 4 THEN 'gold' END AS plan FROM c_accounts WHERE k % 9 = 4 OR k % 31 = 5""")


def with_copies(rows):
    return f"""SELECT * FROM ({rows}) UNION ALL SELECT * REPLACE (id || '_copy' AS id) FROM ({rows})
        WHERE ('0x' || left(md5(id), 7))::BIGINT % 10 = 3"""


step("d_customers", with_copies("""SELECT id, login_id, CASE WHEN k % 9 = 4 THEN 'gold' WHEN k % 31 = 6 THEN NULL ELSE plan END AS plan
    FROM t_customers WHERE k % 13 <> 5"""))
step("d_domains", with_copies("SELECT * FROM t_domains WHERE replace(id, 'dom_', '')::BIGINT % 11 <> 2"))
step("d_tokens", with_copies("SELECT * FROM t_tokens"))
step("d_seeds", with_copies("SELECT id, customer_id, url, CASE WHEN contains(url, '/de/') THEN 'sitemap' ELSE source END AS source FROM t_seeds"))
step("d_snaps", with_copies("SELECT * FROM t_snaps"))
OWNER = "replace(customer_id, 'cust_', '')::BIGINT"
step("d_jobs", with_copies(f"""SELECT id, customer_id, CASE WHEN {OWNER} % 12 = 7 THEN 'sync' ELSE kind END AS kind,
    CASE WHEN {OWNER} % 8 = 1 THEN 'lost' ELSE state END AS state FROM t_jobs"""))
step("d_metrics", with_copies("SELECT * FROM t_metrics"))
DIRTY = {"customers": "d_customers", "domains": "d_domains", "api_tokens": "d_tokens", "seed_urls": "d_seeds", "map_snapshots": "d_snaps",
         "publish_jobs": "d_jobs", "url_metrics": "d_metrics"}
oracle("q1_account_keys", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, to_json([{', '.join(keys)}])::VARCHAR AS key, count(*) AS copies FROM {DIRTY[name]} GROUP BY 2 HAVING count(*) > 1"
    for name, keys in (("customers", ["login_id"]), ("domains", ["customer_id", "hostname"]), ("seed_urls", ["customer_id", "url"]),
                       ("map_snapshots", ["customer_id", "domain_id"]), ("api_tokens", ["token_hash"]), ("url_metrics", ["customer_id", "url"]))))
oracle("q2_account_orphans", " UNION ALL ".join(
    f"SELECT '{child}' AS table_name, '{fk}' AS column_name, id AS row_id FROM {DIRTY[child]} WHERE {fk} NOT IN (SELECT id FROM {DIRTY[parent]})"
    for child, fk, parent in [(c, "customer_id", "customers") for c in DIRTY if c != "customers"] + [("map_snapshots", "domain_id", "domains")]))
oracle("q3_account_enums", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{col}' AS column_name, id AS row_id, {col} AS value FROM {DIRTY[name]} WHERE {col} IS NULL OR {col} NOT IN ({good})"
    for name, col, good in (
        ("customers", "plan", "'free', 'pro', 'team', 'enterprise'"), ("publish_jobs", "state", "'pending', 'success', 'failed'"),
        ("publish_jobs", "kind", "'auth_kv_sync'"), ("seed_urls", "source", "'firecrawl_map', 'manual'"))))
INLINE_TAGS = ("a|b|strong|em|i|code|img|br|hr|p|div|section|article|header|footer|nav|aside|main|figure|figcaption|address|form|fieldset"
               "|details|summary|dl|dt|dd|ul|ol|li|pre|table|thead|tbody|tfoot|tr|td|th|blockquote|h[1-6]")


def shown_words(text):
    t = chain(text, [(None, INVISIBLE, ""), (None, rf"(?is)</?(?:{INLINE_TAGS})\b[^>]*>", " "), (None, r"(?is)<(?:/?[a-z]|!)[^>]*>", "")])
    return plain_words(plain_entities(t))


def plain_words(text):
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


step("c_words", f"""SELECT r.page_id, {shown_words('r.html')} AS shown, list_distinct({shown_words('r.t')}) AS main_list,
    list_distinct({plain_words(chain("coalesce(m.markdown, '')", [(None, '[]][(][^)]*[)]', ']'), (None, '(?m)^[0-9]+[.]  ', '')]))}) AS said
    FROM c_region r JOIN c_md m USING (page_id)""")
oracle("q4_equivalence_audit", """
  SELECT page_id, len(list_filter(said, lambda w: NOT list_contains(shown, w)))::INTEGER AS invented_words, len(main_list)::INTEGER AS main_words,
    len(list_intersect(main_list, said))::INTEGER AS kept_words FROM c_words""")
oracle("q4_stored_equivalence", """
  SELECT page_id, url_key, CASE WHEN page_id % 31 = 3 THEN 'unsigned' WHEN invented > 0 THEN 'invented'
      WHEN page_id % 50 = 8 THEN 'altered' ELSE 'equal' END AS state,
    CASE WHEN page_id % 31 <> 3 THEN invented END AS invented_words, CASE WHEN page_id % 31 <> 3 THEN len(main_list)::INTEGER END AS main_words,
    CASE WHEN page_id % 31 <> 3 THEN len(list_intersect(main_list, said))::INTEGER END AS kept_words
  FROM (SELECT w.*, c.url_key, (len(list_filter(said, lambda w: NOT list_contains(shown, w))) + (page_id % 50 = 7)::INTEGER)::INTEGER AS invented
    FROM c_words w JOIN c_content c USING (page_id) WHERE c.markdown <> '')""")
oracle("q5_non_200_to_crawlers", """
  SELECT endpoint AS mode, status, count(*) AS requests FROM c_req WHERE is_ai AND status <> 200 GROUP BY ALL""")
oracle("q6_secrets_audit", """
  SELECT 'plaintext_key' AS finding, sha256(key) AS ref FROM c_legacy
  UNION ALL SELECT 'url_in_log', i::VARCHAR FROM c_req WHERE status < 400 AND i % 25 = 0 AND regexp_matches(url, 'https?://[^ ]')""")
oracle("q7_metric_key_mismatch", """
  SELECT DISTINCT m.customer_id, m.url, o.url AS seed_url FROM c_metrics m
  JOIN c_owned o ON o.customer_id = m.customer_id AND o.url = regexp_replace(m.url, '^(https?://)www\\.', '\\1')
  WHERE NOT EXISTS (SELECT 1 FROM c_owned s WHERE s.customer_id = m.customer_id AND s.url = m.url)""")

step("c_served", f"""SELECT v.request_id, v.customer_id, v.http_status, v.error_code, r.is_ai, r.ts, {KEY} AS url_key
    FROM c_render v JOIN c_req r USING (request_id) JOIN c_reqkeys u USING (request_id) WHERE r.endpoint = 'render'""")
step("c_found", lookup("c_served"))
oracle("flow_serve_requests", """
  SELECT s.request_id, s.customer_id, s.http_status, s.error_code, CASE WHEN s.http_status = 200 THEN f.cache_status END AS cache_status, s.is_ai
  FROM c_served s JOIN c_found f USING (request_id)""")
step("c_display", f"""SELECT customer_id, domain_id, url, section, {ranks('customer_id, domain_id')}
    FROM (SELECT *, {SECTION.format(url_path('url'))} AS section FROM c_candidates)""")
oracle("flow_overview", overview("c_display", "o.customer_id, o.domain_id, o.url, o.section, o.section_rank, o.url_rank"))
oracle("flow_store_crawl", f"""
  SELECT j.crawl_id, j.ordinal::INTEGER AS ordinal, sha256('v1:' || j.canonical) AS url_key, {tokens('j.markdown')} AS md_tokens
  FROM c_judged j WHERE j.verdict = 'admitted'""")
