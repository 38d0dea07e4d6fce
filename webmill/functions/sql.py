"""The scalar helpers as temporary SQL functions.

They are SQL expressions that Spark inlines into the calling query, so SQL users
pay no Python cost.
"""

from webmill import lists
from webmill.functions import urls
from webmill.schemas import CRAWL_RESULT


def _let(name, value, body):
    """``body`` with ``value`` bound to ``name``, so that the text does not repeat it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _canonical(host, wrap=lambda text: text):
    steps, parts = urls.part_steps("u")
    body = wrap(f"""CASE WHEN p.ok AND p.path IS NOT NULL THEN concat(p.scheme, '://', p.userinfo, {host},
        CASE WHEN p.port <> '' THEN concat(':', p.port) ELSE '' END, p.path,
        CASE WHEN p.query <> '' THEN concat('?', p.query) ELSE '' END) END""")
    body = _let("p", parts, body)
    for step in reversed(steps):
        for name, value in step.items():
            body = _let(f"__{name}", value, body)
    return body


def _family():
    tests = " ".join(f"WHEN contains(lower(ua), '{part}') THEN '{family}'" for part, family in lists.BOT_FAMILIES)
    return f"CASE {tests} ELSE 'unknown' END"


def _one_of(words):
    return "|".join(w.replace(".", "\\\\.") for w in words)


#: Columns of a crawled page in SQL.
CRAWL_PAGES = "ARRAY<STRUCT<url: STRING, title: STRING, markdown: STRING>>"


def _crawl_pages():
    parsed = f"from_json(payload, '{CRAWL_RESULT.simpleString()}')"
    return _let("r", parsed, f"""CASE WHEN r.status = 'completed' THEN transform(r.data, x -> named_struct(
        'url', x.metadata.sourceURL, 'title', x.metadata.title, 'markdown', x.markdown)) END""")


def definitions():
    """Name and signature -> return type and body."""
    private = "|".join(lists.PRIVATE_HOSTS)
    assets = "|".join("[.]" + x[1:] for x in lists.SEED_ASSETS)
    web = "p.scheme IN ('http', 'https')"
    seed = _canonical("regexp_replace(p.host, '^www[.]', '')", lambda text:
                      f"CASE WHEN {web} AND NOT lower(p.path) RLIKE '({assets})$' THEN {text} END")
    return {
        "canonical_url(u STRING)": ("STRING", _canonical("p.host")),
        "seed_url(u STRING)": ("STRING", seed),
        "crawl_pages(payload STRING)": (CRAWL_PAGES, _crawl_pages()),
        "bare_host(h STRING)": ("STRING", "regexp_replace(lower(h), '^www[.]', '')"),
        "url_key(canonical STRING)": ("STRING", f"sha2(concat('{lists.CANON_VERSION}:', canonical), 256)"),
        "is_ai_agent(ua STRING)": ("BOOLEAN", f"coalesce(lower(ua) RLIKE '{_one_of(lists.AI_AGENTS)}', false)"),
        "bot_family(ua STRING)": ("STRING", _family()),
        "is_private_host(h STRING)": ("BOOLEAN", f"""coalesce(lower(h) = 'localhost' OR endswith(lower(h), '.local')
            OR endswith(lower(h), '.internal') OR h RLIKE r'{private}', false)"""),
        "looks_like_html(t STRING)": ("BOOLEAN", r"""coalesce(t RLIKE r'^[\s\x{FEFF}\p{Z}]*(?i:<!doctype|<html|<\?xml)'
            OR (t RLIKE r'^[\s\x{FEFF}\p{Z}]*<!--' AND contains(lower(t), '<html')), false)"""),
        "token_estimate(t STRING)": ("INT", "CAST(ceil(coalesce(octet_length(encode(t, 'UTF-16BE')), 0) / 8) AS INT)"),
        "savings_pct(html INT, md INT)": ("INT", """CASE WHEN html <> 0 AND md <> 0
            THEN CAST(floor((200 * (CAST(html AS BIGINT) - md) + html) / (2 * CAST(html AS BIGINT))) AS INT) END"""),
    }


def register(spark):
    """Create the functions in the session."""
    for signature, (kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
