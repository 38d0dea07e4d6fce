"""Data-quality audits over account, configuration and log tables."""

from functools import reduce

from pyspark.sql import functions as F

from webmill import lists
from webmill.schemas import FOREIGN_KEYS, UNIQUE_KEYS

# Columns with a fixed set of values: (table, column) -> name of the set.
ENUM_COLUMNS = {
    ("customers", "plan"): "plan", ("publish_jobs", "state"): "job_state", ("publish_jobs", "kind"): "job_kind",
    ("seed_urls", "source"): "seed_source"}


def unique_violations(df, keys):
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def orphans(child, parent, fk, pk="id"):
    """Child rows whose parent is missing; a NULL key is not an orphan."""
    return child.filter(F.col(fk).isNotNull()).join(
        parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def account_keys(tables):
    """Every unique key that occurs more than once: ``table_name, key, copies``."""
    return _union([
        unique_violations(tables[name], keys).select(
            F.lit(name).alias("table_name"), F.to_json(F.array(*keys)).alias("key"), "copies")
        for name, keys in UNIQUE_KEYS.items()])


def account_orphans(tables):
    """Every row whose parent is missing, over all foreign keys: ``table_name, column_name, row_id``."""
    return _union([
        orphans(tables[child], tables[parent], fk).select(
            F.lit(child).alias("table_name"), F.lit(fk).alias("column_name"), F.col("id").alias("row_id"))
        for child, refs in FOREIGN_KEYS.items() for fk, parent in refs])


def account_enums(tables):
    """Every value outside its fixed set: ``table_name, column_name, row_id, value``."""
    return _union([
        enum_violations(tables[name], col, lists.ENUMS[allowed]).select(
            F.lit(name).alias("table_name"), F.lit(col).alias("column_name"), F.col("id").alias("row_id"), F.col(col).alias("value"))
        for (name, col), allowed in ENUM_COLUMNS.items()])


def cascade_delete(tables, ids):
    """All rows that go with the customers in ``ids(id)``: ``table_name, row_id``.

    Keys are at most two levels deep, so one pass over the declared order will do.
    ``tables`` must hold all account tables, or rows would stay behind.
    """
    if missing := {"customers", *FOREIGN_KEYS} - set(tables):
        raise ValueError(f"account tables are missing: {sorted(missing)}")
    gone = {"customers": tables["customers"].select("id").join(ids.select("id"), "id", "left_semi")}
    for child, refs in FOREIGN_KEYS.items():
        hits = [
            tables[child].join(gone[parent].select(F.col("id").alias(fk)), fk, "left_semi").select("id")
            for fk, parent in refs if parent in gone]
        gone[child] = reduce(lambda a, b: a.union(b), hits).distinct()
    named = [df.select(F.lit(name).alias("table_name"), F.col("id").alias("row_id")) for name, df in gone.items()]
    return reduce(lambda a, b: a.union(b), named)


def enum_violations(df, col, allowed):
    """Rows whose value is not one of ``allowed``; NULL is a violation."""
    return df.filter(~F.coalesce(F.col(col).isin(allowed), F.lit(False)))


def secrets_audit(config, logs, key="key", text_cols=("msg", "err", "stack", "data"), log_id="request_id"):
    """Plaintext keys in the configuration and full URLs in log messages."""
    plain = config.filter(F.col(key).startswith("apikey:")).select(
        F.lit("plaintext_key").alias("finding"), F.sha2(key, 256).alias("ref"))
    leak = reduce(lambda a, b: a | b, [
        F.coalesce(F.col(c).rlike(r"https?://[^\s]"), F.lit(False)) for c in text_cols])
    urls = logs.filter(leak).select(
        F.lit("url_in_log").alias("finding"), F.col(log_id).cast("string").alias("ref"))
    return plain.union(urls)
