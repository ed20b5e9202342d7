"""Results that several reports share, computed once by whichever report asks first."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Generic, TypeVar

R = TypeVar("R")


class part(Generic[R]):
    """A property that is computed once, also when reports run side by side; a failure is remembered as well.

    Who asks while another thread computes it waits for the result. Parts that ask for one another form a graph
    without cycles, so no two of them can wait for each other.
    """

    def __init__(self, run: Callable[..., R]):
        self.run, self.name, self.__doc__ = run, run.__name__, run.__doc__

    def __get__(self, owner, kind=None) -> R:
        if owner is None:
            return self
        memory = owner.__dict__
        lock = memory.setdefault("_locks", {}).setdefault(self.name, threading.Lock())  # atomic: both are single dict calls
        with lock:
            found = memory.setdefault("_parts", {})
            if self.name not in found:
                try:
                    found[self.name] = self.run(owner), None
                except Exception as e:
                    found[self.name] = None, e
            value, failure = found[self.name]
        if failure is not None:
            raise failure
        return value


def computed(owner, name: str):
    """The value of a part if it was computed, else None."""
    return owner.__dict__.get("_parts", {}).get(name, (None, None))[0]
