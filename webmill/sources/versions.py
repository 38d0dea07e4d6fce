"""Tables in versions: data folders that are never changed, and one small manifest per version that lists them.

A manifest also keeps a few facts about its version, for instance up to where its source has been read.

A writer puts new data folders beside the old ones and commits them by renaming a finished manifest to the next number,
which succeeds for one writer only. Readers take the newest manifest, or an older one by number, so a job that fails
before its commit leaves the table as it was. Folders that no kept version lists are retired later.
"""

import json
import uuid

TAKEN = "another writer committed version"


def _hadoop(spark):
    return spark._jvm.org.apache.hadoop.fs


def located(spark, path):
    """The Hadoop path and the file system it lies in."""
    where = _hadoop(spark).Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark, path):
    """Numbers of the committed versions, oldest first."""
    where, files = located(spark, f"{path}/manifest")
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n) for n in names if n.isdecimal())


def manifest(spark, path, version=None):
    """(number, {part: data folder}, facts) of a version, the newest by default; number 0 for a table without one."""
    known = versions(spark, path)
    if not known:
        return 0, {}, {}
    number = known[-1] if version is None else version
    held = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest/{number}").collect()))
    return number, held["parts"], held["facts"]


def folders(spark, path, version=None):
    """{part: data folder} of a version, the newest by default."""
    return manifest(spark, path, version)[1]


def new_folder():
    return f"data/{uuid.uuid4().hex}"


def commit(spark, path, parts, version, facts=None):
    """Make ``parts`` version ``version`` of the table, all or nothing; raises if that version exists."""
    where, files = located(spark, f"{path}/manifest/{version}")
    draft, _ = located(spark, f"{path}/manifest/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(json.dumps({"parts": parts, "facts": facts or {}}).encode())
    stream.close()
    context = _hadoop(spark).FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = getattr(spark._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        context.rename(draft, where, none)
    except Exception as error:
        files.delete(draft, False)
        if files.exists(where):
            raise ValueError(f"{TAKEN} {version}") from error
        raise


def read(spark, path, schema, version=None, only=None):
    """The rows of a version; ``only`` names the parts to open."""
    return opened(spark, path, schema, folders(spark, path, version), only)


def opened(spark, path, schema, parts, only=None):
    """The rows of a manifest's ``parts``."""
    wanted = [f"{path}/{f}" for p, f in parts.items() if only is None or p in only]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def retire(spark, path, keep=2):
    """Drop all but the ``keep`` newest versions, and the data folders that none of those lists."""
    known = versions(spark, path)
    used = {f for v in known[-keep:] for f in folders(spark, path, v).values()}
    for v in known[:-keep]:
        old = folders(spark, path, v)
        where, files = located(spark, f"{path}/manifest/{v}")
        files.delete(where, False)
        for folder in old.values():
            if folder not in used:
                data, _ = located(spark, f"{path}/{folder}")
                files.delete(data, True)
