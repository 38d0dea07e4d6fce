"""Helpers of Arrow functions: bounded pieces of their input, and memory given back."""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def cuts(texts, limit):
    """(start, stop) of the runs of ``texts`` that stay below ``limit`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def pieces(arrays, limit=SLICE_BYTES):
    """The texts of ``arrays`` as Python lists of at most about ``limit`` bytes: a worker holds one of them, not a whole batch."""
    for array in arrays:
        for start, stop in cuts(array, limit):
            yield array.slice(start, stop - start).to_pylist()
    give_back()


def give_back():
    """Return freed memory to the system: the worker lives on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # NumPy's arrays; only in glibc
    if trim:
        trim(0)
