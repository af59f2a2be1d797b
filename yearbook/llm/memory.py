"""Memory that Python workers give back after a task.

Spark keeps workers for the next tasks, several beside each executor's JVM. What
their arrays, texts and tokenizers have freed would stay theirs meanwhile: the C
library and Arrow keep free pages for later."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # only glibc has it
    _trim = None


def freed(result=None):
    """The argument, after what is free has gone back to the system. Called as freed(f(x)), so that f's own arrays are free by then."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
    return result


def freeing(f: Callable) -> Callable:
    """f, a function of batches for mapInArrow, that ends with freed()."""

    def batches(rows):
        yield from f(rows)
        freed()

    return batches
