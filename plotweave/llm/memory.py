"""Memory of Python workers, which Spark uses again for task after task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def returns_memory(run: Callable) -> Callable:
    """For functions over Arrow batches: what a task has freed goes back to the system at its end, so that it does
    not add up beside what later tasks of other kinds hold."""

    @wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                # another C library keeps its own rules
                pass

    return lean
