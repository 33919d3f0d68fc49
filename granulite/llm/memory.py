"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import os
from functools import lru_cache

import pyarrow as pa


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another system
        return None


def resident() -> int:
    """Bytes of this process in memory; 0 where the system doesn't say."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError):
        return 0


def trim(above: int = 0) -> None:
    """Gives back what a task has freed, from so many resident bytes on: a worker that waits for its next task holds little."""
    if above and resident() < above:
        return
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
