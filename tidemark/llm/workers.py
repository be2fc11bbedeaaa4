"""What Python workers hold between tasks: one large thing at a time.

Spark uses a worker again for later stages and other operators. A dictionary that one of them made would stay beside what
the next one needs, so every operator says at the start of a task what it holds, and anything else goes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

_holding: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """The thing of this name that the worker holds, made at its first use; things of other names go."""
    if name not in _holding:
        _holding.clear()
        _holding[name] = make()
    return _holding[name]


def let_go() -> None:
    """Nothing is held, and memory that is free goes back to the system."""
    _holding.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that begins and ends with ``let_go``; for operators that hold nothing between tasks."""

    @functools.wraps(each)
    def run(batches: Iterator) -> Iterator:
        let_go()
        yield from each(batches)
        let_go()

    return run
