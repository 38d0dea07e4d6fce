"""Structured Streaming forms of the continuous behaviours.

Each function takes a streaming DataFrame. Every aggregate has a watermark, so
its state is bounded by time and not by the length of the stream.
"""

from pyspark.sql import functions as F

from webmill import lists
from webmill.operators import ops
from webmill.sources.sinks import append_metrics


def metrics_stream(events, path, checkpoint, trigger=None):
    """Validate metric events and append them to the metric table, idempotent by batch."""
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: append_metrics(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def usage_days(req, ts="ts"):
    """Billed extractions per customer and day, of the rows of one batch."""
    billed = (F.col("endpoint") == "render") & (F.col("outcome") == "miss") & F.col("customer_id").isNotNull()
    return req.filter(billed).groupBy("customer_id", F.date_trunc("day", ts).alias("day")).agg(F.count(F.lit(1)).alias("renders"))


def usage_sink(req, path, checkpoint, ts="ts", trigger=None):
    """Count what each batch adds to every day, one folder per batch; a batch that runs again replaces its own.

    Counts add up, so no state and no watermark are needed and a row may come as late as it likes.
    """
    def write(batch, batch_id):
        usage_days(batch, ts).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return (
        req.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def usage_months(spark, path):
    """Months: the sum of what the batches added."""
    days = spark.read.schema("customer_id STRING, day TIMESTAMP, renders LONG").parquet(path)
    return days.groupBy("customer_id", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("renders").alias("renders"))


def alert_stream(req, rules=None, extractor=None, ts="ts", late="5 minutes"):
    """Sliding alerts of all rules in one stream; closed windows only.

    Events are counted per minute first; only the minutes are copied into the windows of the widest rule. The window of
    a narrower rule is the end of such a window, so one aggregate holds the sums of every width and no stateful branches
    are joined or united. Each closed window then gives a row for every rule that fires on it.
    """
    rules = lists.ALERT_RULES if rules is None else rules
    extractor = {"window_min": 15, **(extractor or lists.EXTRACTOR_ALERT)}
    widths = sorted({r["window_min"] for r in (*rules, extractor)})
    one = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    minutes = req.withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("m")).agg(
        F.count(F.lit(1)).alias("requests"), one(F.col("outcome") == "fallback").alias("fallbacks"),
        F.count("extractor_status").alias("extractor_calls"), one(F.col("extractor_status") >= 500).alias("extractor_5xx"))
    counts = ("requests", "fallbacks", "extractor_calls", "extractor_5xx")
    end, start = F.unix_seconds("w.end"), F.unix_seconds("m.start")
    within = lambda c, width: F.sum(F.when(start >= end - 60 * width, F.col(c)).otherwise(0)).alias(c)
    copies = minutes.withColumn("w", F.window(F.window_time("m"), f"{widths[-1]} minutes", "1 minute"))
    sums = [F.struct(*[within(c, width) for c in counts]).alias(f"s{width}") for width in widths]
    windows = copies.groupBy("w").agg(*sums)

    def fired(rule, fires, requests, events):
        width = rule["window_min"]
        c = {name: F.col(f"s{width}.{name}") for name in counts}
        return F.when(fires(c, rule), F.struct(
            F.lit(rule["rule"]).alias("rule"), F.lit(rule["level"]).alias("level"),
            F.floor(F.unix_seconds("w.end") / 60 - width).alias("window_start_min"), c[requests].alias("requests"), c[events].alias("events")))

    found = [fired(r, ops.fallback_fires, "requests", "fallbacks") for r in rules]
    found.append(fired(extractor, ops.extractor_fires, "extractor_calls", "extractor_5xx"))
    return windows.select(F.inline(F.array_compact(F.array(*found))))


def stats_stream(log, window="5 minutes", ts="ts", late="5 minutes"):
    """Tumbling outcome statistics; closed windows only."""
    outcome = lambda name: F.count_if(F.col("outcome") == name).alias(f"{name}_count")
    return (
        log.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "bot_family")
        .agg(F.count(F.lit(1)).alias("requests"),
             *[outcome(o) for o in ("hit", "miss", "fallback", "error")],
             F.sum("latency_ms").alias("latency_sum_ms"))
        .select(F.unix_seconds("w.start").alias("window_start_s"), "bot_family", "requests",
                "hit_count", "miss_count", "fallback_count", "error_count", "latency_sum_ms"))


def append_to(stream, path, checkpoint, trigger=None):
    """Exactly-once file sink."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())
