"""Answers of services, kept in the process that asked: least recently used go first, old ones expire, one caller at a time computes a key."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any


class Answers:
    def __init__(self, entries: int = 512, seconds: float = 3600) -> None:
        self.entries, self.seconds = entries, seconds
        self.kept: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()
        self.running: dict[Hashable, Future] = {}
        self.lock = threading.Lock()

    def get(self, key: Hashable, compute: Callable[[], Any], keep: Callable[[Any], bool] = lambda _: True, timeout: float | None = None) -> Any:
        """The answer to key; what keep refuses is returned but not kept."""
        with self.lock:
            found = self.kept.get(key)
            if found and found[0] > time.monotonic():
                self.kept.move_to_end(key)
                return found[1]
            waiting = self.running.get(key)
            if waiting is None:
                mine = self.running[key] = Future()
        if waiting is not None:
            return waiting.result(timeout)
        try:
            value = compute()
        except BaseException as error:
            with self.lock:
                self.running.pop(key)
            mine.set_exception(error)
            raise
        with self.lock:
            self.running.pop(key)
            if keep(value):
                self.kept[key] = (time.monotonic() + self.seconds, value)
                self.kept.move_to_end(key)
                while len(self.kept) > self.entries:
                    self.kept.popitem(last=False)
        mine.set_result(value)
        return value

    def batch(self, rows: Sequence[Any], key_of: Callable[[Any], Hashable], compute: Callable[[Any], Any], workers: int = 32, timeout: float | None = None) -> list[Any]:
        """Answers for rows, each different key computed once, in threads."""
        first = {key_of(r): r for r in reversed(rows)}
        with ThreadPoolExecutor(min(workers, max(1, len(first)))) as pool:
            jobs = {k: pool.submit(self.get, k, lambda r=r: compute(r)) for k, r in first.items()}
            return [jobs[key_of(r)].result(timeout) for r in rows]
