"""Operators over page and URL tables. All of them are map-only: no shuffle."""

from pyspark.sql import functions as F

from webmill import lists
from webmill.functions import markdown as md
from webmill.functions import text, urls


def canonicalise(df, url_col="url", out="canonical"):
    """Cache identity of a URL: ``www.`` is kept; invalid URLs give NULL and an error."""
    d = urls.with_url_parts(df, url_col, "_parts")
    return d.select(
        *df.columns,
        urls.serialise(F.col("_parts")).alias(out),
        F.coalesce(
            F.col("_parts.error"),
            F.when(F.col("_parts.path").isNull(), F.lit("unsupported"))).alias("url_error"),
        urls.bare_host(F.col("_parts.host")).alias("host"),
        F.col("_parts.path").alias("path"))


def normalise_seeds(df, url_col="url", out="seed_url"):
    """Seed form of a URL: ``www.`` removed, web schemes only, no static assets; else NULL."""
    d = urls.with_url_parts(df, url_col, "_parts")
    p = F.col("_parts")
    keep = p["scheme"].isin("http", "https") & ~urls.is_asset_path(p["path"], lists.SEED_ASSETS)
    return d.select(
        *df.columns,
        F.when(keep, urls.serialise(p, strip_www=True)).alias(out),
        F.when(keep, urls.bare_host(p["host"])).alias("host"),
        F.when(keep, p["path"]).alias("path"))


def normalise_host(df, col, out="hostname", from_input=False):
    fn = urls.host_from_input if from_input else urls.bare_host
    return df.withColumn(out, fn(F.col(col)))


def with_url_key(df, canonical="canonical", version=lists.CANON_VERSION, out="url_key"):
    """Versioned content key: a new version leaves all old rows unreachable."""
    return df.withColumn(out, urls.url_key(F.col(canonical), version)).withColumn(
        "canon_version", F.lit(version))


def flag_private_hosts(df, host="host", strict=False, out="is_private"):
    return df.withColumn(out, urls.is_private_host(F.col(host), strict))


def reject_html(df, col="markdown"):
    """Keep the rows whose text is not markup."""
    return df.filter(~text.looks_like_html(F.col(col)))


def extract_markdown(pages, html="html"):
    """Main content as Markdown, guarded; pages without static content are flagged.

    The raw HTML is measured and dropped here, before any later shuffle.
    """
    d = pages.withColumn(
        "html_tokens",
        F.when(F.coalesce(F.col(html), F.lit("")) != "", text.estimate_tokens(F.col(html))))
    d = md.with_markdown(d, html, "_md")
    good = F.when(~text.looks_like_html(F.col("_md")), F.col("_md"))
    return (
        d.withColumn("markdown", good)
        .withColumn("md_tokens", text.estimate_tokens(F.col("markdown")))
        .withColumn("needs_render", F.col("_md").isNull())
        .drop("_md", html))


def preview(content, markdown="markdown", tokens="md_tokens", limit=lists.PREVIEW_CHARS):
    """Display form: newlines collapsed, long texts cut and flagged, size label."""
    body = F.col(markdown)
    return (
        content
        .withColumn("preview", text.cut_utf16(text.collapse_newlines(body), limit))
        .withColumn("truncated", F.coalesce(text.utf16_length(body) > limit, F.lit(False)))
        .withColumn("size_label", text.byte_label(F.col(tokens))))


def preview_panels(listed, bundle, metrics, limit=lists.PREVIEW_CHARS):
    """The page and Markdown panels of each listed URL (customer_id, url, url_key), with their states.

    ``shown``: the content is live in the store. ``expired``: the URL was analysed (it has metrics, or live Markdown), but
    this content's time to live is over. ``not_analysed``: nothing is known. Only live content has a preview, cut before
    any join with the list; token counts come from the stored ones, else from the metrics, else they are 0.
    """
    body, page = F.col("markdown"), F.col("html")
    cut = bundle.select(
        F.col("url_key").alias("_key"), F.col("html_tokens").alias("_html"), F.col("md_tokens").alias("_md"),
        text.cut_utf16(page, limit).alias("html_preview"), text.utf16_length(page).alias("html_chars"),
        text.cut_utf16(text.collapse_newlines(body), limit).alias("md_preview"), text.utf16_length(body).alias("_chars"))
    known = metrics.select(
        F.col("customer_id").alias("_customer"), F.col("url").alias("_url"),
        F.col("html_tokens").alias("_html_known"), F.col("md_tokens").alias("_md_known"))
    d = listed.join(known, (F.col("customer_id") == F.col("_customer")) & (F.col("url") == F.col("_url")), "left").join(
        cut, F.col("url_key") == F.col("_key"), "left")
    analysed = F.col("_url").isNotNull() | F.col("md_preview").isNotNull()
    state = lambda c: F.when(F.col(c).isNotNull(), "shown").when(analysed, "expired").otherwise("not_analysed")
    html, mdt = F.coalesce("_html", "_html_known", F.lit(0)), F.coalesce("_md", "_md_known", F.lit(0))
    longer = lambda c: F.coalesce(F.col(c) > limit, F.lit(False))
    return d.select(
        *listed.columns,
        state("html_preview").alias("html_state"), "html_preview", "html_chars", longer("html_chars").alias("html_truncated"),
        html.alias("html_tokens"), text.byte_label(html).alias("html_size"),
        state("md_preview").alias("md_state"), "md_preview", longer("_chars").alias("md_truncated"),
        mdt.alias("md_tokens"), text.byte_label(mdt).alias("md_size"),
        text.savings_pct(html, mdt).alias("savings_pct"))


def token_accounting(content, by=None):
    """Tokens saved for each row, or rolled up over ``by`` (subtotals included)."""
    html, mdt = F.col("html_tokens").cast("long"), F.col("md_tokens").cast("long")
    if by is None:
        return content.withColumn("saved_tokens", html - mdt).withColumn(
            "savings_pct", text.savings_pct(html, mdt))
    sums = content.rollup(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(html).alias("html_tokens"),
        F.sum(F.when(html.isNotNull(), mdt)).alias("md_tokens"))
    return sums.withColumn("saved_tokens", F.col("html_tokens") - F.col("md_tokens")).withColumn(
        "savings_pct", text.savings_pct(F.col("html_tokens"), F.col("md_tokens")))


def equivalence_audit(pages, html="html"):
    """Words of the Markdown that the page does not show (must be none), and coverage.

    One pass over the page yields the Markdown and both visible texts; nothing is shuffled.
    """
    d = md.with_views(pages, html, "_v").select(*[c for c in pages.columns if c != html], "_v.*")
    d = (
        d.withColumn("_shown", md.words(F.col("shown")))
        .withColumn("_main", F.array_distinct(md.words(F.col("main"))))
        .withColumn("_words", F.array_distinct(md.markdown_words(F.coalesce("markdown", F.lit(""))))))
    return d.select(
        *[c for c in pages.columns if c != html],
        F.size(F.array_except("_words", "_shown")).alias("invented_words"),
        F.size("_main").alias("main_words"),
        F.size(F.array_intersect("_main", "_words")).alias("kept_words"))


# --- equivalence of stored content ---------------------------------------------

def word_marks(words):
    """Sorted 64-bit hashes of the distinct words: eight bytes for each, whatever its length."""
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def extract_signed(pages, html="html"):
    """``extract_markdown`` with the marks of what the page shows, from the same reading of the page.

    ``shown_marks`` and ``main_marks`` are the words of the visible page and of its main text, ``md_mark`` is the hash of
    the Markdown. Written with the content they let ``stored_equivalence`` judge it later without the page.
    """
    tokens = F.when(F.coalesce(F.col(html), F.lit("")) != "", text.estimate_tokens(F.col(html)))
    d = md.with_views(pages.withColumn("html_tokens", tokens), html, "_v")
    good = F.when(~text.looks_like_html(F.col("_v.markdown")), F.col("_v.markdown"))
    return (
        d.withColumn("markdown", good)
        .withColumn("md_tokens", text.estimate_tokens(F.col("markdown")))
        .withColumn("needs_render", F.col("_v.markdown").isNull())
        .withColumn("shown_marks", word_marks(md.words(F.col("_v.shown"))))
        .withColumn("main_marks", word_marks(md.words(F.col("_v.main"))))
        .withColumn("md_mark", F.when(F.col("markdown").isNotNull(), F.xxhash64("markdown")))
        .drop("_v", html))


def stored_equivalence(writes, signatures):
    """Stored Markdown against the marks that were written with it, one row per write (url_key, wid).

    State: ``unsigned`` without marks, ``invented`` if it holds words that the page did not show, ``altered`` if it is not
    the text that was signed, else ``equal``. The texts become word hashes where they are read; only those are shuffled.
    """
    said = word_marks(md.markdown_words(F.col("body")))
    rows = text.once(
        writes.filter((F.col("kind") == "md") & F.col("url_key").isNotNull()),
        F.struct(said.alias("said"), F.xxhash64("body").alias("mark")), "_t").select("url_key", "wid", "_t")
    d = rows.join(signatures.select("url_key", "wid", "shown_marks", "main_marks", "md_mark"), ["url_key", "wid"], "left")
    signed = F.col("shown_marks").isNotNull()
    count = lambda c: F.when(signed, F.size(c))
    invented = count(F.array_except("_t.said", "shown_marks"))
    return d.select(
        "url_key", "wid",
        F.when(~signed, "unsigned").when(invented > 0, "invented").when(F.col("_t.mark") != F.col("md_mark"), "altered")
        .otherwise("equal").alias("state"),
        invented.alias("invented_words"), count(F.col("main_marks")).alias("main_words"),
        count(F.array_intersect("main_marks", "_t.said")).alias("kept_words"))
