"""A bounded memo: repeated strings are judged once per task."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` computes ``fn(key)`` on a miss; emptied when it holds ``limit`` entries."""

    def __init__(self, fn: Callable, limit: int = 200_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        v = self[key] = self.fn(key)
        return v
