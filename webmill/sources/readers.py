"""Readers. All of them use explicit schemas and stay lazy."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from webmill import schemas

CORRUPT = "_corrupt_record"


def load_pages(spark, path):
    """Raw HTML corpus, one row per URL."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def load_request_log(spark, path, stream=False):
    """JSON lines of the request log, as a batch or as a stream.

    Lines that do not parse keep their text in ``_corrupt_record``; see
    ``split_corrupt``.
    """
    schema = StructType(schemas.REQUEST_LOG.fields + [StructField(CORRUPT, StringType())])
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(
        F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")


def split_corrupt(log):
    """``(good, quarantine)`` rows of a log read."""
    good = log.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = log.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))
    return good, bad


def tidy_log(log):
    """Column names and types used by the operators; ``is_error`` from the nested entries."""
    return log.select(
        F.col("requestId").alias("request_id"),
        F.to_timestamp("timestamp").alias("ts"),
        "method", "path",
        F.col("botFamily").alias("bot_family"),
        F.col("tenantId").alias("customer_id"),
        "status",
        F.col("cacheStatus").alias("status_word"),
        F.col("originStatus").alias("origin_status"),
        F.col("latencyMs").alias("latency_ms"),
        F.coalesce(F.exists("logs", lambda e: e["level"] == "error"), F.lit(False)).alias("is_error"),
        "logs")


def load_accounts(spark, path, tables=None):
    """Account tables below ``path`` as a dict of DataFrames."""
    names = tables or list(schemas.ACCOUNT_TABLES)
    return {n: spark.read.schema(schemas.ACCOUNT_TABLES[n]).parquet(f"{path}/{n}") for n in names}


def load_accounts_jdbc(spark, url, tables=None, **options):
    """The same tables over JDBC, for a relational source of truth."""
    names = tables or list(schemas.ACCOUNT_TABLES)
    return {
        n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load()
        .select(*[F.col(f.name).cast(f.dataType) for f in schemas.ACCOUNT_TABLES[n].fields])
        for n in names}


def read_content(spark, path):
    """The content write log; filters on ``kind`` and ``write_date`` prune folders."""
    return spark.read.schema(
        StructType(schemas.CONTENT_WRITES.fields + [StructField("write_date", schemas.S)])).parquet(path)


def read_signatures(spark, path):
    """The word marks written with the content; filters on ``write_date`` prune folders."""
    return spark.read.schema(
        StructType(schemas.SIGNATURES.fields + [StructField("write_date", schemas.S)])).parquet(path)
