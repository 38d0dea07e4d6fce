"""Sinks: append logs, keyed replacement and versioned change sets."""

from pyspark.sql import functions as F

from webmill import lists, schemas
from webmill.functions import text
from webmill.operators.report import split_valid_metrics, upsert
from webmill.session import cut_lineage
from webmill.sources import versions


def content_rows(df, md_ttl=lists.TTL_MARKDOWN_S, html_ttl=lists.TTL_HTML_S, tokens_ttl=lists.TTL_TOKENS_S):
    """Write-log rows of extracted content: Markdown, HTML only if present, token counts.

    Input: ``wid, url_key, markdown, html, written_at``.
    """
    base = df.filter(F.coalesce("markdown", F.lit("")) != "")
    has_html = F.coalesce("html", F.lit("")) != ""
    counts = F.to_json(
        F.struct(
            F.when(has_html, text.estimate_tokens(F.col("html"))).alias("htmlTokens"),
            text.estimate_tokens(F.col("markdown")).alias("mdTokens"),
            F.unix_millis("written_at").alias("ts")),
        {"ignoreNullFields": "false"})
    entry = lambda kind, body, ttl: F.struct(
        F.lit(kind).alias("kind"), body.alias("body"), F.lit(ttl).cast("long").alias("ttl_s"))
    entries = F.filter(
        F.array(
            entry("md", F.col("markdown"), md_ttl),
            entry("html", F.when(has_html, F.col("html")), html_ttl),
            entry("tokens", counts, tokens_ttl)),
        lambda e: e["body"].isNotNull())
    return base.select("wid", "url_key", "written_at", F.explode(entries).alias("_e")).select(
        "wid", "url_key", "_e.kind", "_e.body", "written_at", "_e.ttl_s")


def write_content(df, path, **ttl):
    """Append to the content write log; the newest row of a key wins on reading."""
    content_rows(df, **ttl).withColumn("write_date", F.date_format("written_at", "yyyy-MM-dd")).write.mode(
        "append").partitionBy("kind", "write_date").parquet(path)


def write_signatures(df, path):
    """Append the word marks of written Markdown, beside the content log: one row per write (url_key, wid)."""
    df.filter(F.coalesce("markdown", F.lit("")) != "").select(
        *schemas.SIGNATURES.names, F.date_format("written_at", "yyyy-MM-dd").alias("write_date")).write.mode(
        "append").partitionBy("write_date").parquet(path)


# --- metric table: an append log of changes, merged when read ------------------

def metric_changes(events):
    """Valid metric events as change rows."""
    good = split_valid_metrics(events).filter(F.col("error_code").isNull())
    return good.select("customer_id", "url", "html_tokens", "md_tokens", "optimized_at", "seq", "received_at")


def append_metrics(batch, batch_id, path):
    """Write one micro-batch in one pass. The folder is named after the batch, so a retry replaces it.

    Valid rows go below ``state=changes`` without their payload, refused ones below ``state=quarantine`` with it.
    """
    judged = split_valid_metrics(batch, keep_body=True)
    bad = F.col("error_code").isNotNull()
    judged.withColumns({
        "body": F.when(bad, F.col("body")), "state": F.when(bad, F.lit("quarantine")).otherwise("changes"),
    }).write.mode("overwrite").partitionBy("state").parquet(f"{path}/batch_id={batch_id}")


CHANGES = "seq LONG, received_at TIMESTAMP, customer_id STRING, url STRING, html_tokens INT, md_tokens INT, optimized_at TIMESTAMP"
METRIC_LOG = f"{CHANGES}, body STRING, error_code STRING, batch_id STRING, state STRING"


def read_quarantine(spark, path):
    """Refused metric events with their payload and the reason."""
    log = spark.read.schema(METRIC_LOG).parquet(path)
    return log.filter("state = 'quarantine'").select("seq", "received_at", "body", "error_code")


def read_metrics(spark, path, base=None):
    """Current metric table: the optional base version and all later changes, merged."""
    changes = spark.read.schema(METRIC_LOG).parquet(path).filter("state = 'changes'").select(
        *[c.split()[0] for c in CHANGES.split(", ")])
    target = spark.read.schema(schemas.URL_METRICS).parquet(base) if base else None
    return upsert(target, changes, ["customer_id", "url"], "seq", at="received_at")


def compact_metrics(spark, path, new_base, base=None):
    """Write the merged table as a new base version; the change folders may then be retired."""
    merged = read_metrics(spark, path, base)
    merged.select(
        F.sha2(F.concat_ws("|", "customer_id", "url"), 256).alias("id"), "*"
    ).select(*schemas.URL_METRICS.names).write.mode("overwrite").parquet(new_base)


# --- metric table in buckets: a base version and the batches since it --------------

KEYS = ["customer_id", "url"]


def finished_batches(spark, log, after=-1):
    """Numbers of the batches above ``after``, up to the first one that is still being written."""
    where, files = versions.located(spark, log)
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    numbers = sorted(int(n[9:]) for n in names if n.startswith("batch_id=") and n[9:].isdecimal())
    done = []
    for n in numbers:
        if n > after:
            mark, _ = versions.located(spark, f"{log}/batch_id={n}/_SUCCESS")
            if not files.exists(mark):
                break
            done.append(n)
    return done


def batch_changes(spark, log, batches, buckets):
    """Valid changes of the given batches with the bucket of their key; other folders are not opened."""
    names = [c.split()[0] for c in CHANGES.split(", ")]
    paths = [f"{log}/batch_id={n}" for n in batches]
    rows = spark.read.schema(METRIC_LOG).option("basePath", log).parquet(*paths) if paths else spark.createDataFrame([], METRIC_LOG)
    return rows.filter("state = 'changes'").select(*names, metric_bucket(buckets).alias("bucket"))


def metric_bucket(buckets):
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


def merge_metrics(spark, log, table, buckets=64):
    """Fold the finished batches that ``table`` lacks into it, as a new version; gives the number of the newest version.

    The base lies in buckets of (customer, url), and its manifest holds the last batch that it contains. Only buckets
    with new changes are read and written anew, the new version lists the old folders of all others. A batch that is
    delivered again after it was merged is not read again. Without new batches there is no new version. ``buckets`` holds
    for the first version; later ones keep its number. A row of a hot key is one partial sum per task before the shuffle.
    """
    number, parts, facts = versions.manifest(spark, table)
    buckets = facts.get("buckets", buckets)
    batches = finished_batches(spark, log, facts.get("batch", -1))
    if not batches:
        return number
    changes = batch_changes(spark, log, batches, buckets)
    touched = {str(r.bucket) for r in changes.select("bucket").distinct().collect()}  # at most ``buckets``
    folder = versions.new_folder()
    if touched:
        base = versions.opened(spark, table, schemas.URL_METRICS, parts, only=touched)
        merged = upsert(base, changes.drop("bucket"), KEYS, "seq", at="received_at").select(
            F.sha2(F.concat_ws("|", *KEYS), 256).alias("id"), "*").select(*schemas.URL_METRICS.names)
        merged.withColumn("bucket", metric_bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{table}/{folder}")
    parts = {**parts, **{b: f"{folder}/bucket={b}" for b in touched}}
    versions.commit(spark, table, parts, number + 1, {"batch": batches[-1], "buckets": buckets})
    return number + 1


def read_metric_table(spark, log, table):
    """The metric table now: the newest base version and the batches since it.

    Buckets without later changes are read as they are; only the others are merged.
    """
    _, parts, facts = versions.manifest(spark, table)
    names = [c for c in schemas.URL_METRICS.names if c != "id"]
    buckets = facts.get("buckets", 1)
    batches = finished_batches(spark, log, facts.get("batch", -1))
    changes = batch_changes(spark, log, batches, buckets)
    touched = {str(r.bucket) for r in changes.select("bucket").distinct().collect()} if batches else set()
    still = versions.opened(spark, table, schemas.URL_METRICS, parts, only=parts.keys() - touched).select(*names)
    if not touched:
        return still
    base = versions.opened(spark, table, schemas.URL_METRICS, parts, only=touched)
    return still.unionByName(upsert(base, changes.drop("bucket"), KEYS, "seq", at="received_at"))


def retire_metrics(spark, log, table, keep=2):
    """Drop old versions, and the changes of batches that every kept version contains; refused events stay."""
    versions.retire(spark, table, keep)
    kept = versions.versions(spark, table)
    mark = versions.manifest(spark, table, kept[0])[2]["batch"] if kept else -1
    for n in finished_batches(spark, log):
        if n <= mark:
            where, files = versions.located(spark, f"{log}/batch_id={n}/state=changes")
            files.delete(where, True)


# --- configuration ------------------------------------------------------------

def publish_config(diff, path):
    """Write the change set as JSON lines: documents to put and keys to delete."""
    diff.filter(F.col("action") == "put").select("key", "document").write.mode("overwrite").json(f"{path}/put")
    diff.filter(F.col("action") == "delete").select("key").write.mode("overwrite").json(f"{path}/delete")


# --- map snapshots ------------------------------------------------------------

def snapshot_rows(candidates, fetched_at):
    """One row per (customer, domain): the list of a site is the value that is published."""
    urls = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "url"))), lambda x: x["url"])
    return candidates.groupBy("customer_id", "domain_id").agg(urls.alias("urls")).select(
        F.concat_ws("/", "customer_id", "domain_id").alias("id"), "customer_id", "domain_id", "urls",
        F.lit(fetched_at).cast("timestamp").alias("fetched_at"),
        F.lit(fetched_at).cast("timestamp").alias("created_at"))


def replace_snapshot(spark, candidates, path, fetched_at, buckets=64):
    """Replace the snapshots of the given (customer, domain) pairs, keep all others, as a new version of the table.

    Only the buckets of the new rows are read and written anew; what fails before the commit leaves the old version. A site
    without any URL has no candidate rows, so its old snapshot stays.
    """
    keys = ["customer_id", "domain_id"]
    before = versions.versions(spark, path)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = cut_lineage(snapshot_rows(candidates, fetched_at).withColumn("bucket", bucket))
    touched = {str(r.bucket) for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
    old = versions.read(spark, path, schemas.MAP_SNAPSHOTS, only=touched).withColumn("bucket", bucket)
    made = old.select(*keys, F.col("created_at").alias("_made"))
    dated = new.join(made, keys, "left").withColumn("created_at", F.coalesce("_made", "created_at")).drop("_made")
    folder = versions.new_folder()
    kept = old.join(new.select(*keys), keys, "left_anti")
    kept.unionByName(dated).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    parts = {**versions.folders(spark, path), **{b: f"{folder}/bucket={b}" for b in touched}}
    versions.commit(spark, path, parts, before[-1] + 1 if before else 1)


def read_snapshots(spark, path, version=None):
    """The newest version of the snapshots, or an older one that is not retired."""
    return versions.read(spark, path, schemas.MAP_SNAPSHOTS, version)


def snapshot_urls(snapshots):
    """One row per listed URL, with its ordinal."""
    return snapshots.select("customer_id", "domain_id", F.posexplode("urls").alias("ordinal", "url"))


