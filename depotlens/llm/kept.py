"""What a Python worker remembers between tasks, for one operator at a time.

Spark hands the tasks of all operators to the same workers, so after a few stages each would hold the words
of every operator that remembers some.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_FORGET: dict[str, Callable[[], bool]] = {}


def remembered(name: str, forget: Callable[[], bool]) -> None:
    """Something is kept under ``name``; ``forget`` drops it and says if there was any."""
    _FORGET[name] = forget


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows: what Python makes of whole texts is held for one piece at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def only(name: str | None) -> None:
    """A task that needs what is kept under ``name`` begins; all else goes back to the system."""
    if not any([forget() for other, forget in _FORGET.items() if other != name]):
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc; elsewhere memory is only free for new objects
    if trim:
        trim(0)
