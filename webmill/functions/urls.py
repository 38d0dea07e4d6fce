"""URL parsing and serialisation as Column expressions.

``with_url_parts`` works in a few narrow projections so that each step is
evaluated once per row, whatever is filtered or joined later.
"""

from pyspark.sql import functions as F

from webmill import lists
from webmill.functions.text import ends_with_any, once

# Default ports of the schemes that have a host.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

_WEB = ", ".join(f"'{s}'" for s in DEFAULT_PORTS)
_PORTS = ", ".join(f"'{s}', '{p}'" for s, p in DEFAULT_PORTS.items())
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
# Any character but those a path may hold literally.
_TO_ENCODE = r"[^\x21\x23-\x3B\x3D\x3F-\x5D\x5F\x61-\x7A\x7C\x7E]"


def _form_decode(x):
    """A percent sign without two hex digits stays as it is."""
    return f"url_decode(regexp_replace({x}, r'%(?![0-9A-Fa-f]{{2}})', '%25'))"


def canonical_query_sql(query, drop=None):
    """Decode, drop tracking parameters, sort by name (stable), encode again."""
    drop = lists.TRACKING_PARAMS if drop is None else drop
    dropped = ", ".join(f"'{d}'" for d in drop)
    name = "substring_index(p, '=', 1)"
    return rf"""
        CASE WHEN coalesce({query}, '') = '' THEN '' ELSE
          array_join(transform(
            array_sort(filter(
              transform(
                filter(split({query}, '&'), p -> p <> ''),
                (p, i) -> named_struct(
                  'name', {_form_decode(name)}, 'pos', i,
                  'value', {_form_decode(f"substring(p, length({name}) + 2)")})),
              p -> p.name NOT IN ({dropped}))),
            p -> concat(url_encode(p.name), '=', url_encode(p.value))), '&') END"""


def _encoded(path):
    """Percent-encode by UTF-8 bytes the characters a path may not hold."""
    return rf"""
        CASE WHEN {path} RLIKE r'{_TO_ENCODE}' THEN array_join(transform(split({path}, ''), c ->
          CASE WHEN c RLIKE r'{_TO_ENCODE}' THEN replace(url_encode(c), '+', '%20') ELSE c END), '')
        ELSE {path} END"""


_DOT, _UP = "('.', '%2e')", "('..', '.%2e', '%2e.', '%2e%2e')"


def _resolved(path):
    """Remove ``.`` and ``..`` segments of an absolute path."""
    parts = f"split(substring({path}, 2), '/')"
    return rf"""
        CASE WHEN {path} = '' THEN '/'
        WHEN {path} RLIKE r'(?i)/(?:\.|%2e){{1,2}}(?:/|$)' THEN concat('/', array_join(concat(
          aggregate({parts}, cast(array() AS array<string>), (kept, s) ->
            CASE WHEN lower(s) IN {_UP} THEN slice(kept, 1, greatest(size(kept) - 1, 0))
                 WHEN lower(s) IN {_DOT} THEN kept
                 ELSE concat(kept, array(s)) END),
          CASE WHEN lower(element_at({parts}, -1)) IN ('.', '%2e', '..', '.%2e', '%2e.', '%2e%2e')
               THEN array('') ELSE cast(array() AS array<string>) END), '/'))
        ELSE {path} END"""


# Parts of a numeric host: decimal, octal or hexadecimal; NULL if malformed.
_NUMBERS = r"""
    transform(split(regexp_replace({host}, r'\.$', ''), r'\.'), x -> try_cast(
      CASE WHEN x RLIKE '^0[xX]0*[0-9A-Fa-f]{{0,8}}$' THEN coalesce(conv(nullif(substring(x, 3), ''), 16, 10), '0')
           WHEN x RLIKE '^00*[0-7]{{0,11}}$' THEN conv(x, 8, 10)
           WHEN x RLIKE '^[1-9][0-9]{{0,9}}$' THEN x END AS bigint))"""


def _dotted(nums):
    """Dotted form: each number fills its own byte, the last one all that are left."""
    n = f"size({nums})"
    value = rf"""(element_at({nums}, -1) + aggregate(
        transform(slice({nums}, 1, {n} - 1), (x, i) -> shiftleft(x, 8 * (3 - i))), 0L, (a, b) -> a + b))"""
    octets = ", ".join(f"shiftright({value}, {8 * k}) & 255" for k in (3, 2, 1, 0))
    return rf"""
        CASE WHEN {n} <= 4 AND NOT exists({nums}, x -> x IS NULL)
              AND NOT exists(slice({nums}, 1, {n} - 1), x -> x > 255)
              AND element_at({nums}, -1) < shiftleft(1L, 8 * (5 - {n})) THEN concat_ws('.', {octets}) END"""


def part_steps(url):
    """SQL of the parsing steps over column ``url``, and of the resulting struct.

    Each step is a dict of new columns (prefixed ``__``) and may use the columns
    of the steps before it.
    """
    # guards such as contains() spare most URLs the regular expression behind them
    steps = []
    steps.append(dict(flat=rf"""substring_index(CASE WHEN {url} RLIKE r'[\x00-\x20]' THEN regexp_replace(regexp_replace(
        {url}, r'^[\x00-\x20]+|[\x00-\x20]+$', ''), r'[\t\n\r]', '') ELSE {url} END, '#', 1)"""))
    steps.append(dict(base="substring_index(__flat, '?', 1)"))
    steps.append(dict(
        query="CASE WHEN length(__flat) > length(__base) THEN substring(__flat, length(__base) + 2) END",
        scheme=f"lower(regexp_extract(__base, r'({_SCHEME[:-1]}):', 1))",
        rest=rf"replace(regexp_replace(__base, r'{_SCHEME}[/\\]*', ''), r'\', '/')"))
    steps.append(dict(web=f"__scheme IN ({_WEB})", auth="substring_index(__rest, '/', 1)"))
    steps.append(dict(hostport="substring_index(__auth, '@', -1)"))
    steps.append(dict(
        typed="lower(CASE WHEN contains(__hostport, ':') THEN regexp_replace(__hostport, ':[0-9]*$', '') ELSE __hostport END)",
        given="""CASE WHEN contains(__hostport, ':')
                 THEN regexp_replace(regexp_extract(__hostport, ':([0-9]+)$', 1), '^0+(?=.)', '') ELSE '' END""",
        user="CASE WHEN contains(__auth, '@') THEN left(__auth, length(__auth) - length(__hostport)) ELSE '' END",
        tail=_resolved("substring(__rest, length(__auth) + 1)")))
    steps.append(dict(nums=rf"""CASE WHEN right(__typed, 1) RLIKE '[0-9a-fx.]' AND __typed RLIKE r'(?:^|\.)(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?$'
                          THEN {_NUMBERS.format(host='__typed')} END"""))
    # internationalised names become ASCII by IDNA 2003, which differs from UTS 46 for a few letters such as the sharp s
    steps.append(dict(name=rf"""CASE WHEN __nums IS NOT NULL THEN {_dotted('__nums')}
        WHEN __typed RLIKE r'[^\x00-\x7F]' THEN lower(try_reflect('java.net.IDN', 'toASCII', __typed)) ELSE __typed END"""))
    steps.append(dict(error=rf"""
        CASE WHEN coalesce({url}, '') = '' THEN 'missing'
             WHEN __scheme = '' THEN 'invalid'
             WHEN NOT __web THEN NULL
             WHEN __given = '' AND __name RLIKE '^[a-z0-9._-]+$' THEN NULL
             WHEN __typed RLIKE r'[^\x00-\x7F]' AND __name IS NULL THEN 'unsupported'
             WHEN coalesce(__name, '') = '' THEN 'invalid'
             WHEN NOT __name RLIKE r'^\[[0-9a-f:.]+\]$' AND __name RLIKE r'[\x00-\x20#/:<>?@\[\\\]^|\x7F]' THEN 'invalid'
             WHEN length(__given) > 5 OR try_cast(__given AS int) > 65535 THEN 'invalid'
             WHEN __name RLIKE r'[^\x00-\x7F]|%' THEN 'unsupported' END"""))
    ok = "__error IS NULL"
    parts = rf"""named_struct(
        'ok', {ok},
        'error', __error,
        'scheme', CASE WHEN {ok} THEN __scheme END,
        'userinfo', CASE WHEN __web THEN __user ELSE '' END,
        'host', CASE WHEN {ok} THEN CASE WHEN __web THEN __name ELSE '' END END,
        'port', CASE WHEN __web AND __given <> map({_PORTS})[__scheme] THEN __given ELSE '' END,
        'path', CASE WHEN {ok} AND __web THEN {_encoded('__tail')} END,
        'query', CASE WHEN {ok} AND __web THEN {canonical_query_sql('__query')} END)"""
    return steps, parts


def with_url_parts(df, url, out):
    """Add struct ``out`` with ``ok, error, scheme, userinfo, host, port, path, query``.

    ``error`` is ``missing`` (NULL or empty), ``invalid`` (not a URL) or
    ``unsupported`` (a host with escapes, or a name that has no ASCII form). Opaque schemes such as
    ``mailto:`` are valid URLs with an empty host.
    """
    steps, parts = part_steps(f"`{url}`")
    d = df
    for step in steps:
        d = d.selectExpr("*", *[f"{sql} AS `__{name}`" for name, sql in step.items()])
    return once(d, F.expr(parts), out).select(*df.columns, out)


def serialise(parts, strip_www=False):
    """URL text of a parts struct; NULL for invalid and non-web URLs."""
    host = F.regexp_replace(parts["host"], r"^www\.", "") if strip_www else parts["host"]
    return F.when(parts["ok"] & parts["path"].isNotNull(), F.concat(
        parts["scheme"], F.lit("://"), parts["userinfo"], host,
        F.when(parts["port"] != "", F.concat(F.lit(":"), parts["port"])).otherwise(""),
        parts["path"],
        F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise("")))


def bare_host(host):
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def host_from_input(text):
    """Host typed into a form: scheme and one trailing slash are removed first."""
    return bare_host(F.regexp_replace(F.regexp_replace(text, "^https?://", ""), "/$", ""))


def url_key(canonical, version=lists.CANON_VERSION):
    return F.sha2(F.concat(F.lit(f"{version}:"), canonical), 256)


def is_private_host(host, strict=False):
    """Literal private or internal hosts.

    The IPv6 patterns never match a parsed host because of its brackets;
    ``strict`` removes the brackets first.
    """
    lower = F.lower(host)
    probe = F.regexp_replace(host, r"^\[|\]$", "") if strict else host
    named = lower == "localhost"
    for suffix in lists.PRIVATE_SUFFIXES:
        named = named | lower.endswith(suffix)
    return F.coalesce(named | probe.rlike("|".join(lists.PRIVATE_HOSTS)), F.lit(False))


def is_asset_path(path, extensions):
    return ends_with_any(F.lower(path), extensions)


def path_segments(path):
    return F.filter(F.split(path, "/"), lambda s: s != "")


def section_of(path):
    """``/first-segment``, or ``/`` for the root."""
    return F.concat(F.lit("/"), F.coalesce(F.get(path_segments(path), F.lit(0)), F.lit("")))


def path_text(url):
    """Path part of an already canonical URL."""
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
