"""Arrow helpers that the operators of this package share."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from webmill.functions.arrow import cuts, give_back
from webmill.session import work_dir

SLICE_BYTES = 4 << 20


class Parts(NamedTuple):
    """Parts of texts: ``vocab[codes]`` in order; text ``i`` owns ``bounds[i]:bounds[i + 1]``."""
    codes: np.ndarray
    bounds: np.ndarray
    vocab: pa.Array

    @property
    def rows(self):
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(batches, column="text", limit=SLICE_BYTES):
    """Cut batches where their texts reach ``limit`` bytes; a longer text stays whole in a slice of its own."""
    for batch in batches:
        for start, stop in cuts(batch[column], limit):
            yield batch.slice(start, stop - start)
    give_back()


def whole(texts):
    """Texts as large strings, null as empty, in buffers of their own.

    Some Arrow kernels misread an array that starts inside its buffer, so a slice is always copied.
    """
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    return filled.take(pa.array(np.arange(len(filled))))


def parts(lists, keep_empty=False):
    """The parts of split texts, coded by their distinct values."""
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if not keep_empty:
        keep = pc.greater(pc.binary_length(flat), 0)
        before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
        flat, bounds = flat.filter(keep), before[bounds].astype(np.int64)
    coded = flat.dictionary_encode()
    return Parts(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, coded.dictionary)


def words_of(texts):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    return parts(pc.ascii_split_whitespace(whole(texts)))


def per_row(rows, n, weights=None):
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)


def repeated(rows, codes):
    """For each entry: is the same code found more than once in the row, and is it a later one."""
    order = np.lexsort((codes, rows))
    r, c = rows[order], codes[order]
    same = np.concatenate([[False], (r[1:] == r[:-1]) & (c[1:] == c[:-1])])
    any_, later = np.empty(len(rows), bool), np.empty(len(rows), bool)
    later[order] = same
    any_[order] = same | np.concatenate([same[1:], [False]])
    return any_, later


def stored(df, name):
    """Write ``df`` to the shared folder and read it back: lost executors cost no more than their task."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_whole(df, rows, most):
    """A stored table with a broadcast hint if it holds at most ``most`` rows by count, else as it is, to be shuffled."""
    return F.broadcast(df) if rows <= most else df


def numbered(docs):
    """(_row, _doc): every row as a struct with a number, stored once.

    The numbers are data then: whoever reads the table again, with other splits or after an executor is lost, finds the
    same ones. No column of ``docs`` can clash inside the struct.
    """
    return stored(docs.select(row_id().alias("_row"), F.struct("*").alias("_doc")), "numbered")


def row_id():
    """A number for each row, fixed once the table is stored; doc_id may be null or repeated."""
    return F.monotonically_increasing_id()
