"""Texts of Arrow batches as words or bytes, a few megabytes at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HELD = 4_000_000


def parts(batch: pa.RecordBatch, text: int, limit: int = HELD) -> Iterator[pa.RecordBatch]:
    """batch in slices whose texts (column number `text`) have about limit bytes, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    ends, k = np.cumsum(sizes, dtype=np.int64), 0
    while k < len(sizes):
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + limit, "right")))
        yield batch.slice(k, end - k)
        k = end


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which the worker, which waits for its next task, gives back the memory that it no longer needs."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return runs


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of each word, distinct words, each word's number among them); words are runs of other than ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    rows = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    flat = lists.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return rows[full], coded.dictionary, np.asarray(coded.indices, dtype=np.int64)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers start, start + 1, ..., size of them for each, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
