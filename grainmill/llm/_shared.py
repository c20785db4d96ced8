"""What the operators of this subpackage share, beside the written tables of the library."""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa

from ..tables import collected, delete, new_path, released, shared_dir, shuffle_partitions, spread, written

__all__ = ["collected", "delete", "give_back", "lean", "new_path", "power_of_two", "released", "shared_dir", "shuffle_partitions", "spread", "written"]


def power_of_two(x: float) -> int:
    """The smallest power of two that is at least ``x``."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))


def give_back() -> None:
    """Free memory goes back to the system: Python workers live on between tasks, beside an executor's JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches that gives back at its end what it has used."""

    @functools.wraps(run)
    def iterate(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return iterate
