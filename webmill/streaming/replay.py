"""Streams whose rows must be answered in order of event time, whatever batches bring them.

Rows wait until the watermark, ``delay_s`` behind the newest row, has passed them. Every micro-batch is then one job over all
rows that are ready, with what earlier batches carry over; the answers of a batch are a folder of its own, so a batch that
runs again replaces its answers and its state and reads the state before it. Rows that come behind the watermark are
kept in a side table, not lost. State is tables in the shared folder: waiting rows, carried rows, the watermark; the state
of the batch before the last is removed.
"""

from pyspark.sql import functions as F

MARK = "watermark_us long"


def _table(spark, path, schema):
    """A state table; empty before the first batch."""
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _remove(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _states(spark, path):
    """Numbers of the batches whose state is complete."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n) for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/{n}/mark/_SUCCESS")))


def step(batch, batch_id, path, answer, carry_schema, at_us, delay_s, last=False):
    """Answer what one batch makes ready; ``last`` ends the stream and answers all that waits."""
    spark = batch.sparkSession
    before = [n for n in _states(spark, path) if n < batch_id]
    old, new = (f"{path}/state/{before[-1]}" if before else None), f"{path}/state/{batch_id}"
    batch.write.mode("overwrite").parquet(f"{new}/rows")
    rows = spark.read.schema(batch.schema).parquet(f"{new}/rows")
    passed = _table(spark, old and f"{old}/mark", MARK).first()
    passed = passed[0] if passed else None
    newest = rows.agg(F.max(at_us)).first()[0]
    mark = max((m for m in (passed, None if newest is None else newest - delay_s * 1000000) if m is not None), default=None)
    if passed is not None:
        rows.filter(F.col(at_us) < passed).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        rows = rows.filter(F.col(at_us) >= passed)
    rows = _table(spark, old and f"{old}/waiting", batch.schema).unionByName(rows)
    carry = _table(spark, old and f"{old}/carry", carry_schema)
    is_ready = F.lit(True) if last else F.lit(False) if mark is None else F.col(at_us) < mark
    answers, carried = answer(rows.filter(is_ready), carry, mark)
    answers.write.mode("overwrite").parquet(f"{path}/answers/batch_id={batch_id}")
    carried.write.mode("overwrite").parquet(f"{new}/carry")
    rows.filter(~is_ready).write.mode("overwrite").parquet(f"{new}/waiting")
    spark.createDataFrame([] if mark is None else [(mark,)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{new}/mark")
    _remove(spark, f"{new}/rows")
    for n in before[:-1]:
        _remove(spark, f"{path}/state/{n}")


def replay(stream, path, checkpoint, answer, carry_schema, at_us="at_us", delay_s=30, trigger=None):
    """Start the stream. ``answer(ready, carry, watermark_us)`` gives (answers, what to carry on)."""
    return (
        stream.writeStream.foreachBatch(lambda batch, n: step(batch, n, path, answer, carry_schema, at_us, delay_s))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def finish(spark, path, schema, answer, carry_schema, at_us="at_us"):
    """Answer the rows that still wait once no more will come."""
    done = _states(spark, path)
    if done:
        step(spark.createDataFrame([], schema), done[-1] + 1, path, answer, carry_schema, at_us, 0, last=True)


def answers(spark, path, schema):
    return spark.read.schema(schema).parquet(f"{path}/answers").drop("batch_id")


def late(spark, path, schema):
    """Rows that came behind the watermark and have no answer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/late")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return _table(spark, f"{path}/late" if found else None, schema).drop("batch_id")
