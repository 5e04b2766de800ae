"""Python workers give memory back when a kernel ends.

Spark keeps workers for later tasks, beside a JVM that may by then need the
memory: what a kernel allocated and freed would otherwise stay with them.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable

import pyarrow as pa

from . import arrays

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not this C library
    _trim = None


def release() -> None:
    """Free cached tables and hand unused pages back to the system."""
    arrays.forget()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(kernel: Callable) -> Callable:
    """A kernel of ``mapInArrow`` (a generator) or ``applyInArrow`` (a function) that releases memory when it ends."""
    if inspect.isgeneratorfunction(kernel):

        def over_batches(batches):
            try:
                yield from kernel(batches)
            finally:
                release()

        return over_batches

    if len(inspect.signature(kernel).parameters) == 1:  # Spark looks at the number of parameters

        def over_group(table: pa.Table) -> pa.Table:
            try:
                return kernel(table)
            finally:
                release()

        return over_group

    def over_pair(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return kernel(left, right)
        finally:
            release()

    return over_pair
