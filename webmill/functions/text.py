"""Column helpers over text: lengths, token estimates, guards, labels."""

import re

from pyspark.sql import functions as F

from webmill import lists

# White space as browsers trim it, with the byte-order mark.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff")


def once(df, col, name):
    """Add ``col`` behind a one-row generator, so that it is evaluated once.

    A filter on a plain column is pushed below the projection and repeats the
    column's expression there; filters stay above a generator.
    """
    return df.select("*", F.explode(F.array(col)).alias(name))


def utf16_length(col):
    """Number of UTF-16 code units (an emoji counts twice); plain ASCII is not encoded."""
    wide = F.floor(F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(col) == F.length(col), F.length(col)).otherwise(wide)


def cut_utf16(col, limit):
    """The first ``limit`` UTF-16 code units; a character that would be cut in half is left out."""
    raw = F.encode(col, "UTF-16BE")
    half = F.hex(F.substring(raw, 2 * limit - 1, 1)).between("D8", "DB")
    wide = F.when(half, F.substring(raw, 1, 2 * limit - 2)).otherwise(F.substring(raw, 1, 2 * limit))
    return F.when(F.octet_length(col) == F.length(col), F.substring(col, 1, limit)).otherwise(F.decode(wide, "UTF-16BE"))


def estimate_tokens(col):
    """One token for each four UTF-16 code units, rounded up; empty and NULL give 0."""
    return F.floor((F.coalesce(utf16_length(col), F.lit(0)) + 3) / 4).cast("int")


def half_up(col):
    """Round half toward +infinity."""
    return F.floor(col + F.lit(0.5))


def savings_pct(html_tokens, md_tokens):
    """Whole-percent savings; undefined if either side is NULL or 0."""
    html, md = html_tokens.cast("long"), md_tokens.cast("long")
    # floor(100 * (h - m) / h + 1/2) in integers
    pct = F.floor((F.lit(200) * (html - md) + html) / (F.lit(2) * html))
    return F.when((html != 0) & (md != 0), pct).cast("int")


def trim_wide(col):
    return F.btrim(col, F.lit(WHITE_SPACE))


def looks_like_html(col):
    """True for documents that are markup rather than Markdown.

    Only the start of the text is examined; the search for a late ``<html`` runs
    just for texts that open with a comment.
    """
    body = F.ltrim(col, F.lit(WHITE_SPACE))
    head = F.lower(F.left(body, F.lit(9)))
    found = (
        head.startswith("<!doctype")
        | head.startswith("<html")
        | head.startswith("<?xml")
        | (head.startswith("<!--") & F.lower(body).contains("<html"))
    )
    return F.coalesce(found, F.lit(False))


def collapse_newlines(col):
    return F.regexp_replace(col, r"\n{3,}", "\n\n")


def byte_label(tokens):
    """Size estimate of four bytes per token, e.g. ``1.5 KB``.

    There is no unit beyond MB: larger sizes come out with the unit
    ``undefined``, as consumers of the label already expect.
    """
    size = tokens.cast("long") * 4

    def label(unit, name):
        tenths = F.floor((size * 20 + unit) / F.lit(2 * unit))
        whole, rest = F.floor(tenths / 10), tenths % 10
        return F.concat(
            whole.cast("string"),
            F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), rest.cast("string"))),
            F.lit(" " + name))

    return (
        F.when(F.coalesce(tokens, F.lit(0)) == 0, F.lit("— B"))
        .when(size < 1 << 10, label(1, "B"))
        .when(size < 1 << 20, label(1 << 10, "KB"))
        .when(size < 1 << 30, label(1 << 20, "MB"))
        .otherwise(label(1 << 30, "undefined")))


def any_of(col, words):
    """True if ``col`` contains one of the constant ``words``: one regex pass."""
    return col.rlike("|".join(re.escape(w) for w in words))


def ends_with_any(col, suffixes):
    return col.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


def starts_with_any(col, prefixes):
    return col.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")


def is_ai_agent(ua, agents=None):
    """AI crawler by User-Agent substring; NULL and empty are not."""
    return F.coalesce(any_of(F.lower(ua), agents or lists.AI_AGENTS), F.lit(False))


def bot_family(ua):
    lower = F.lower(F.coalesce(ua, F.lit("")))
    return F.coalesce(
        *[F.when(lower.contains(part), F.lit(family)) for part, family in lists.BOT_FAMILIES],
        F.lit("unknown"))
