"""What a Python worker process keeps from one task to the next.

Functions of this package travel to the executors by value, so a global of a module would be made
anew in every task.  What should outlive a task is kept in a module of its own that the worker
process holds.  Whatever is kept must be bounded by its maker; a worker that starts anew makes it again.
"""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from itertools import filterfalse
from typing import Any

PLACE = "_llm_worker_memory"


def kept(key: Hashable, make: Callable[[], Any], version: Hashable = None) -> Any:
    """The worker's object with this key, made at its first use and anew for another version."""
    memory = sys.modules.setdefault(PLACE, types.ModuleType(PLACE)).__dict__.setdefault("objects", {})
    if key not in memory or memory[key][0] != version:
        memory.pop(key, None)  # the old one goes before the new one is made
        memory[key] = version, make()
    return memory[key][1]


@contextmanager
def collector_off() -> Iterator[None]:
    """No search for cycles meanwhile: lists of millions of strings hold none, and would be walked through each time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Recent(dict):
    """A dictionary of at most ``most`` entries, besides those of one batch, that keeps what is in use.

    Entries fill one generation up to half of ``most``; it then becomes the older one, whose entries
    come back when they are asked for, and what nobody asked for goes with the next change.
    """

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key: Hashable) -> Any:
        value = self[key] = self.older[key]
        return value

    def unknown(self, keys: set) -> set:
        """The keys to be worked out; afterwards there is room for them."""
        # key by key: a difference of sets would walk through all that is kept
        fresh = set(filterfalse(self.__contains__, keys))
        new = set(filterfalse(self.older.__contains__, fresh))
        if len(self) + len(fresh) <= self.most // 2:
            return new
        self.older = dict(self)
        self.clear()
        return fresh
