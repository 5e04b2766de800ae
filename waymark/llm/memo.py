"""A bounded memo for work on distinct words inside a Python worker."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Memo(dict):
    """``memo[key]`` is ``work(key)``; at most twice ``limit`` results are kept, none of keys over ``longest``.

    Results fill a young generation.  When it is full it becomes the old one,
    from which keys in use move over, and the former old one is let go.
    """

    def __init__(self, work: Callable[[Any], Any], limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.work, self.limit, self.longest, self.old = work, limit, longest, {}

    def __missing__(self, key: Any) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
