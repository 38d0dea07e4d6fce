"""The overview report, its metrics table and its ordering."""

from pyspark.sql import functions as F

from webmill.functions import text, urls
from webmill.functions.text import once
from webmill.operators.ranking import rank_within

STAMPS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX")


def overview(snapshot_urls, metrics):
    """Status of each listed URL; the join is on the exact URL text."""
    keys = ["customer_id", "url"]
    m = metrics.select(*keys, "html_tokens", "md_tokens", "optimized_at", F.lit(True).alias("_known"))
    joined = snapshot_urls.join(m, keys, "left")
    pct = text.savings_pct(F.col("html_tokens"), F.col("md_tokens"))
    return joined.withColumns({
        "status": F.when(F.col("_known"), "Optimized").otherwise("Not checked"),
        "savings": F.coalesce(F.concat(pct.cast("string"), F.lit("%")), F.lit("—")),
        "last_optimized": F.coalesce(F.date_format("optimized_at", "yyyy-MM-dd"), F.lit("Never")),
    }).drop("_known", "optimized_at")


def with_section(df, url="url"):
    return df.withColumn("section", urls.section_of(urls.path_text(F.col(url))))


def section_report(df, by=("customer_id",), url="url"):
    """URLs per first path segment; a section of one URL is not a folder."""
    return (
        with_section(df, url).groupBy(*by, "section")
        .agg(F.count(F.lit(1)).alias("url_count"))
        .withColumn("is_folder", F.col("url_count") > 1)
        .withColumn("label", F.when(F.col("section") == "/", "root").otherwise(F.substr(F.col("section"), F.lit(2)))))


def rank_sections(df, by=("customer_id",), url="url", ordinal="ordinal"):
    """URL rows with ``section_rank`` and ``url_rank``.

    The root comes first and keeps its listed order; the other sections follow
    by name in the order of the root locale, their URLs by code unit. Both ranks are exact for groups of any size.
    """
    by = list(by)
    rows = with_section(df, url)
    is_root = F.col("section") == "/"
    sections = rows.select(*by, "section").distinct().withColumn(
        "_order", F.collate(F.when(is_root, F.lit("")).otherwise(F.col("section")), "UNICODE"))
    sections = rank_within(sections, by, ["_order", "section"], "section_rank")
    rows = rows.withColumns({
        "_listed": F.when(is_root, F.col(ordinal)).otherwise(F.lit(0)), "_url": F.col(url)})
    ranked = rank_within(rows, [*by, "section"], ["_listed", "_url"], "url_rank").drop("_listed", "_url")
    return ranked.join(sections.select(*by, "section", "section_rank"), [*by, "section"])


def upsert(target, changes, keys, seq, created="created_at", at="at"):
    """Last write wins by arrival: values of the last change, creation of the first.

    ``changes`` has a sequence ``seq`` and an arrival time ``at``. The target's
    rows count as older than every change. One aggregate over the union serves
    any number of changes per key, with partial results before the shuffle.
    """
    return _merge(target, changes, keys, seq, created, at, lambda v: F.col("_seq"))


def _merge(target, changes, keys, seq, created, at, order):
    """Column-wise ``max_by``: for numbers and times this is a hash aggregate, without a sort."""
    values = [c for c in changes.columns if c not in [*keys, seq, at]]
    rows = changes.select(
        *keys, *values, F.col(seq).cast("long").alias("_seq"), F.col(at).alias("_at"),
        F.lit(None).cast("timestamp").alias("_made"))
    if target is not None:
        rows = target.select(
            *keys, *[F.col(v).cast(changes.schema[v].dataType).alias(v) for v in values],
            F.lit(-1).cast("long").alias("_seq"), F.col("updated_at").alias("_at"),
            F.col(created).alias("_made")).unionByName(rows)
    return rows.groupBy(*keys).agg(
        *[F.max_by(v, order(v)).alias(v) for v in values],
        F.coalesce(F.min("_made"), F.min_by("_at", "_seq")).alias(created),
        F.max_by("_at", "_seq").alias("updated_at"))


def upsert_keep_known(target, changes, keys, seq, created="created_at", at="at"):
    """Like ``upsert``, but a NULL never replaces a known value."""
    return _merge(target, changes, keys, seq, created, at, lambda v: F.when(F.col(v).isNotNull(), F.col("_seq")))


def split_valid_metrics(df, body="body", received="received_at", keep_body=False):
    """Parse metric payloads: ``error_code`` is NULL for valid rows.

    Both ids must be non-empty strings; both counts must be present, as a whole
    number of 32 bits or as an explicit null. A missing time becomes the time of
    receipt. Each field is taken from the payload once; ``keep_body`` keeps it.
    """
    field = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    fields = {"customerId": "customer", "url": "url", "htmlTokens": "html", "mdTokens": "md", "optimizedAt": "stamp"}
    d = once(df, F.try_parse_json(body), "_v")
    d = once(d, F.struct(
        F.col("_v").isNotNull().alias("json"), F.schema_of_variant("_v").startswith("OBJECT").alias("object"),
        *[field(name).alias(short) for name, short in fields.items()]), "_f").drop("_v")
    kind = lambda short: F.schema_of_variant(F.col(f"_f.{short}"))
    text_of = lambda short: F.when(kind(short) == "STRING", F.try_variant_get(F.col(f"_f.{short}"), "$", "string"))
    is_number = lambda short: kind(short).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    exact = lambda short: F.try_variant_get(F.col(f"_f.{short}"), "$", "decimal(38,9)")
    whole = lambda short: F.coalesce(
        (exact(short) == F.floor(exact(short))) & exact(short).between(-(1 << 31), (1 << 31) - 1), F.lit(False))
    count = lambda short: F.struct(
        F.coalesce(is_number(short) | (kind(short) == "VOID"), F.lit(False)).alias("present"),
        (F.coalesce(is_number(short), F.lit(False)) & ~whole(short)).alias("bad"),
        F.when(is_number(short) & whole(short), exact(short).cast("int")).alias("value"))
    d = once(d, F.struct(
        F.col("_f.json").alias("json"), F.col("_f.object").alias("object"), text_of("customer").alias("customer"),
        text_of("url").alias("url"), count("html").alias("html"), count("md").alias("md"), text_of("stamp").alias("stamp"),
        F.coalesce(*[F.try_to_timestamp(text_of("stamp"), F.lit(f)) for f in STAMPS]).alias("at")), "_p").drop("_f")
    p = lambda name: F.col(f"_p.{name}")
    empty = lambda name: F.coalesce(p(name), F.lit("")) == ""
    error = (
        F.when(~p("json"), "invalid_json")
        .when(~p("object"), "invalid_body")
        .when(empty("customer") | empty("url") | ~p("html.present") | ~p("md.present"), "missing_fields")
        .when(p("html.bad") | p("md.bad"), "invalid_number")
        .when(p("stamp").isNotNull() & p("at").isNull(), "invalid_time"))
    ok = error.isNull()
    keep = [c for c in df.columns if keep_body or c != body]
    return d.select(
        *keep, error.alias("error_code"),
        F.when(ok, p("customer")).alias("customer_id"), F.when(ok, p("url")).alias("url"),
        F.when(ok, p("html.value")).alias("html_tokens"), F.when(ok, p("md.value")).alias("md_tokens"),
        F.when(ok, F.coalesce(p("at"), F.col(received))).alias("optimized_at"))


def bar_scale(df, value, by):
    """Bar width in percent of the largest value of the chart (at least 1)."""
    top = df.groupBy(*by).agg(F.greatest(F.lit(1), F.max(value)).alias("_top"))
    return df.join(top, list(by)).withColumn(
        "pct", text.half_up(F.col(value) / F.col("_top") * 100).cast("int")).drop("_top")


def metric_key_mismatch(metrics, seeds):
    """Metric URLs that no seed has, but one would once ``www.`` is removed."""
    keys = ["customer_id", "url"]
    m = metrics.select(*keys).distinct()
    s = seeds.select(*keys).distinct()
    lost = m.join(s, keys, "left_anti").withColumn(
        "seed_url", F.regexp_replace("url", r"^(https?://)www\.", "$1"))
    return lost.join(s.withColumnRenamed("url", "seed_url"), ["customer_id", "seed_url"]).select(
        "customer_id", "url", "seed_url")
