"""Timers and counters of a run, added up by name, and their averages for each query."""

from __future__ import annotations

import time
from contextlib import contextmanager


class Profile:
    def __init__(self) -> None:
        self.values: dict[str, float] = {}

    def add(self, name: str, value: float) -> None:
        self.values[name] = self.values.get(name, 0.0) + float(value)

    def count(self, name: str, n: int = 1) -> None:
        self.add(name, n)

    @contextmanager
    def timed(self, name: str):
        """Adds the seconds that the block takes, also if it fails."""
        start = time.perf_counter()
        try:
            yield
        finally:
            self.add(name, time.perf_counter() - start)

    def per_query(self, n: int) -> dict[str, float]:
        """Each value over the number of queries; without queries, as it is."""
        return {k: v / n if n else v for k, v in sorted(self.values.items())}
