"""Contiguous shards of near equal size, cut from global byte prefix sums.

Rows are range-partitioned by their order, each partition gives its total, and a running sum over the totals (one row
per partition) gives every partition its offset. A row's shard is the equal slice of the total that holds its middle
byte, so shard sizes differ from the target by less than the largest document.

Cases: a null text has no bytes; null ids come first; equal rows are told apart by a row number, so a frequent id
is spread over partitions; an empty table gives no rows; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from webmill.llm.texts import row_id
from webmill.session import cut_lineage


def sized(docs, key="doc_id"):
    """(doc_id, size, text_crc32): size and checksum of each text."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(F.col(key).cast("long").alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def running(batches):
    """Adds to each row its number and the bytes before it within the partition."""
    count = total = 0
    for batch in batches:
        size = batch["size"].to_numpy()
        ends = total + np.cumsum(size, dtype=np.int64)
        yield (
            batch.append_column("_nth", pa.array(count + np.arange(len(size), dtype=np.int64)))
            .append_column("_from", pa.array(ends - size))
            .append_column("_piece", pa.array(np.full(len(size), TaskContext.get().partitionId(), np.int32))))
        count, total = count + len(size), int(ends[-1]) if len(size) else total


def shards(sizes, n):
    """Adds ``shard`` (0 to n - 1) and ``slot`` (gapless from 0 in a shard) to the rows of ``sized``."""
    columns = order = ["doc_id", "text_crc32", "size"]
    laid = sizes.select(*columns, row_id().alias("_row"))
    laid = cut_lineage(laid.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row"))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
    numbered = laid.mapInArrow(running, f"{spec}, _nth long, _from long, _piece int")
    totals = numbered.groupBy("_piece").agg(F.count("*").alias("_rows"), F.sum("size").alias("_bytes"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        F.col("_piece").alias("_p"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"), F.sum("_bytes").over(everything).alias("_all"))
    offsets = cut_lineage(offsets)
    place = 2 * (F.col("_byte0") + F.col("_from")) + F.col("size")
    cut = (
        numbered.join(offsets, F.col("_piece") == F.col("_p"))
        .withColumn("shard", F.least(F.lit(n - 1), F.floor(place.cast("decimal(38,0)") * n / (2 * F.col("_all").cast("decimal(38,0)")))).cast("int"))
        .withColumn("_nth", F.col("_row0") + F.col("_nth")))
    first = cut.groupBy("shard").agg(F.min("_nth").alias("_first")).withColumnRenamed("shard", "_s")
    return (
        cut.join(first, F.col("shard") == F.col("_s"))
        .select(*columns, "shard", (F.col("_nth") - F.col("_first")).cast("long").alias("slot")))
