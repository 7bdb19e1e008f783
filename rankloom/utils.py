"""Small helpers of jobs: elapsed time and memory."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager


@contextmanager
def stopwatch(into: dict[str, float], name: str) -> Iterator[Callable[[], float]]:
    """Adds the seconds of a block to ``into[name]``; what it yields gives those so far."""
    began = time.perf_counter()
    try:
        yield lambda: time.perf_counter() - began
    finally:
        into[name] = into.get(name, 0.0) + time.perf_counter() - began


def peak_memory_mb() -> float:
    """The largest resident size of this process so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
