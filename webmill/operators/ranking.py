"""Ranks and caps that never put a whole group into one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from webmill.session import cut_lineage


def rank_within(df, group, order, out):
    """Exact row numbers 1, 2, .. of each group in ``order``.

    Rows are range-partitioned by group and order, so a large group lies in
    several partitions. The layout is made reliable first; then each piece is
    numbered on its own and shifted by the sizes of the pieces before it.
    ``order`` must not leave ties across different rows.
    """
    laid = df.repartitionByRange(*group, *order).withColumn("_piece", F.spark_partition_id())
    laid = cut_lineage(laid.withColumn("_key", F.struct(*group, "_piece")))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        laid.groupBy("_key", *group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
        .select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
    inside = Window.partitionBy("_key").orderBy(*order)
    return laid.join(shift, "_key").select(
        *df.columns, (F.row_number().over(inside) + F.col("_shift")).cast("long").alias(out))


def pieces_of(df, key, order, pieces=None):
    """Rows laid out by range of key and order, reliably, with the number of their partition in ``_piece``.

    A key with many rows lies in several partitions, one after the other.
    """
    laid = df.repartitionByRange(*([pieces] if pieces else []), *key, *order)
    return cut_lineage(laid.withColumn("_piece", F.spark_partition_id()))


CUTS = 256


def lanes_of(df, key, at_us, segment_s, most):
    """``df`` with ``_seg`` and ``_sub``: segments of time of a key; those above ``most`` rows are cut at quantiles of their times.

    Tables without such segments are only counted.
    """
    d = df.withColumns({"_us": at_us, "_seg": F.floor(at_us / (segment_s * 1000000))})
    sizes = cut_lineage(d.groupBy(key, "_seg").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most))
    if sizes.isEmpty():
        return d.withColumn("_sub", F.lit(0))
    large = sizes.select(F.col(key).alias("_k"), F.col("_seg").alias("_s"))
    same = (F.col(key) == F.col("_k")) & (F.col("_seg") == F.col("_s"))
    marks = F.array([F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = cut_lineage(d.join(large, same, "left_semi").groupBy(F.col(key).alias("_k"), F.col("_seg").alias("_s")).agg(
        F.percentile_approx("_us", marks, F.lit(10 * CUTS)).alias("_cuts")))
    sub = F.size(F.filter("_cuts", lambda c: c < F.col("_us")))
    return d.join(cuts, same, "left").withColumn("_sub", F.when(F.col("_cuts").isNull(), 0).otherwise(sub)).drop("_k", "_s", "_cuts")


def carried(df, key, order, value, out, at_us, segment_s=300, largest=False, most=100_000):
    """The last non-null ``value`` (or the largest) among the rows of the same key before each row in ``order``.

    A scan in three steps: every lane (a short time of a key, see ``lanes_of``) hands over one value, a window over lanes,
    not rows, brings to each what came before it, and a window inside the lane starts from there. A key with all rows of
    the table is spread over all tasks, also if they fall into one segment. ``order`` begins with the time ``at_us`` counts.
    Rows without a key are nobody's followers and get no value.
    """
    df = cut_lineage(df)  # read once to be counted, once for the totals and once for the answer
    laid = lanes_of(df.filter(F.col(key).isNotNull()), key, at_us, segment_s, most)
    lane, known = [key, "_seg", "_sub"], F.col(value).isNotNull()
    total = F.max(value) if largest else F.max_by(F.when(known, F.col(value)), F.when(known, F.struct(*order)))
    pick = F.max if largest else lambda c: F.last(c, ignorenulls=True)
    before = Window.partitionBy(key).orderBy("_seg", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    handed = laid.groupBy(*lane).agg(total.alias("_total")).withColumn(value, pick("_total").over(before)).filter(known)
    rows = laid.withColumn("_first", F.lit(1)).unionByName(
        handed.select(*lane, value, F.lit(0).alias("_first")), allowMissingColumns=True)
    inside = Window.partitionBy(*lane).orderBy("_first", *order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn(out, pick(value).over(inside)).filter("_first = 1").select(*df.columns, out)
    return found.unionByName(df.filter(F.col(key).isNull()), allowMissingColumns=True)


def first_k(df, group, order, k, salts=256):
    """The first ``k`` rows of each group in ``order``; ``k`` may be a column.

    Each group is cut in two steps: ``k`` per salted share, then ``k`` overall,
    so the last step sees at most ``k * salts`` rows of a group.
    """
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for keys in ([*group, "_salt"], group):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= limit)
    return salted.drop("_salt", "_rank")
