"""Regression of extracted content against golden documents."""

from pyspark.sql import functions as F


def golden_diff(actual, golden, key="key", body="body"):
    """``key, status, pos, snippet``; line ends are normalised first.

    ``pos`` is the first character (from 0) of the actual text that differs; it
    is -1 if the actual text is a proper prefix. Characters are only compared
    one by one in rows that differ.
    """
    unix = lambda c: F.replace(c, F.lit("\r\n"), F.lit("\n"))
    digest = lambda df, out: df.select(key, F.sha2(unix(F.col(body)), 256).alias(out), F.lit(True).alias(f"{out}_there"))
    status = (
        F.when(F.col("_a_there").isNull(), "missing_actual")
        .when(F.col("_g_there").isNull(), "missing_golden")
        .when(F.col("_a") == F.col("_g"), "equal")
        .otherwise("differs"))
    judged = digest(actual, "_a").join(digest(golden, "_g"), key, "full_outer").select(key, status.alias("status"))
    # only documents that differ are fetched; the others are known by their digests
    apart = judged.filter(F.col("status") == "differs")
    texts = apart.join(actual.select(key, unix(F.col(body)).alias("_a")), key).join(golden.select(key, unix(F.col(body)).alias("_g")), key)
    chars = lambda c: F.split(c, "")
    differs = F.slice(
        F.zip_with(chars(F.col("_a")), chars(F.col("_g")), lambda x, y: ~x.eqNullSafe(y)),
        F.lit(1), F.length("_a"))
    texts = texts.withColumn("pos", F.array_position(differs, F.lit(True)).cast("int") - 1)
    start = F.greatest(F.lit(0), F.col("pos") - 20)
    found = texts.select(key, "status", "pos", F.substr(F.col("_a"), start + 1, F.col("pos") + 20 - start).alias("snippet"))
    rest = judged.filter(F.col("status") != "differs")
    return rest.unionByName(found, allowMissingColumns=True)
