"""From site maps to curated seed tables."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from webmill import lists
from webmill.functions.text import once
from webmill.operators.pages import normalise_seeds
from webmill.operators.ranking import first_k


def explode_site_map(df, json_col="payload"):
    """One row per URL of a polymorphic site map, with its ordinal.

    Accepted shapes: an array; or an object with ``urls``, ``links`` and
    ``data`` (an array, or an object with ``urls`` and ``links``). Items are
    strings or ``{url}`` objects, except that ``urls`` holds only strings and a
    ``data`` array only objects. A reply that names a job is not a result.
    """
    v = F.col("_v")
    items = lambda path: F.coalesce(
        F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    text = lambda x: F.try_variant_get(x, "$", "string")
    field = lambda x: F.try_variant_get(x, "$.url", "variant")

    def strings(path):
        return F.transform(items(path), lambda x: F.when(is_text(x), text(x)))

    def objects(path):
        return F.transform(items(path), lambda x: F.when(is_text(field(x)), text(field(x))))

    def either(path):
        return F.transform(items(path), lambda x: F.coalesce(
            F.when(is_text(x), text(x)), F.when(is_text(field(x)), text(field(x)))))

    nested = F.concat(strings("$.urls"), either("$.links"), objects("$.data"),
                      strings("$.data.urls"), either("$.data.links"))
    is_array = F.schema_of_variant(v).startswith("ARRAY")
    job = ~is_array & reduce(or_, [_truthy(v, name) for name in ("jobId", "job_id", "id")])
    urls = F.filter(F.when(is_array, either("$")).otherwise(nested), lambda x: x.isNotNull())
    keep = [c for c in df.columns if c != json_col]
    return (
        once(df, F.try_parse_json(json_col), "_v")
        .filter(~F.coalesce(job, F.lit(False)))
        .select(*keep, F.posexplode(urls).alias("ordinal", "url")))


def _truthy(v, name):
    """Whether a JSON field counts as a job name: anything but null, false, 0 and the empty string."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    text = F.try_variant_get(v, f"$.{name}", "string")
    return F.coalesce(
        F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(kind == "VOID", False)
        .when(kind.rlike("^(OBJECT|ARRAY)"), True).otherwise(F.try_variant_get(v, f"$.{name}", "double") != 0), F.lit(False))


def rejected_site_maps(df, json_col="payload"):
    """Payloads that give no URLs by their form, with the reason: ``invalid_json`` or ``job_reply``."""
    v = F.col("_v")
    job = ~F.schema_of_variant(v).startswith("ARRAY") & reduce(or_, [_truthy(v, n) for n in ("jobId", "job_id", "id")])
    reason = F.when(v.isNull(), "invalid_json").when(job, "job_reply")
    return once(once(df, F.try_parse_json(json_col), "_v"), reason, "reason").filter("reason IS NOT NULL").drop("_v")


def dedupe_urls(df, keys=("customer_id", "url"), ordinal="ordinal"):
    """Distinct URLs; the first occurrence gives the order."""
    return df.groupBy(*keys).agg(F.min(ordinal).alias(ordinal))


def distinct_urls(df, url="url"):
    return df.select(url).distinct()


def cap_per_site(df, n=lists.MAX_MAP_URLS, site=("customer_id", "host"), ordinal="ordinal"):
    return first_k(df, list(site), [ordinal, "url"], n)


def starter_candidates(site_maps, json_col="payload", cap=None):
    """Site maps of ``(customer_id, domain_id, hostname)`` to distinct own URLs in order, all unless ``cap`` is given."""
    found = explode_site_map(site_maps, json_col)
    seeds = normalise_seeds(found, "url").filter(F.col("host") == F.col("hostname"))
    keys = ["customer_id", "domain_id", "hostname", "seed_url"]
    distinct = dedupe_urls(seeds, keys).withColumnRenamed("seed_url", "url")
    return first_k(distinct, ["customer_id", "domain_id"], ["ordinal", "url"], cap) if cap else distinct


def new_urls(candidates, seeds, keys=("customer_id", "url")):
    return candidates.join(seeds.select(*keys), list(keys), "left_anti")


def merge_starter(seeds, candidates, source=lists.MAP_SOURCE):
    """Seeds after a starter list: new URLs enter enabled, known ones are enabled again.

    Known rows keep their source, and rows not on the list keep everything.
    """
    keys = ["customer_id", "url"]
    old = seeds.select(*keys, "source", "enabled", F.lit(True).alias("_old"))
    new = candidates.select(*keys).distinct().withColumn("_new", F.lit(True))
    action = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "keep")
        .when(F.col("enabled"), "keep")
        .otherwise("enable"))
    return old.join(new, keys, "full_outer").select(
        *keys,
        F.coalesce("source", F.lit(source)).alias("source"),
        F.coalesce("_new", "enabled").alias("enabled"),
        action.alias("action"))
