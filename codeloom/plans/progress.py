"""Progress of syncs, for any number of subscribers in other threads."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

DEPTH = 64  # statuses that a subscriber may be behind; then the oldest go
ENDS = ("done", "error")


class Subscription:
    """An iterator over statuses: the one at the time of subscribing first, then each that follows.
    It ends after one that ends a run, and when nothing has come for ``idle`` seconds while no run is
    under way.  ``close``, or leaving a ``with``, ends it from any thread."""

    def __init__(self, owner: Progress, first: dict, running: Callable[[], bool], idle: float):
        self._owner, self._running, self._idle = owner, running, idle
        self._first: dict | None = first
        self.waiting: deque[dict] = deque(maxlen=DEPTH)
        self.closed = False

    def __iter__(self) -> Subscription:
        return self

    def __next__(self) -> dict:
        if self._first is not None:
            first, self._first = self._first, None
            return first
        last = time.monotonic()
        with self._owner.news:
            while not self.waiting:
                if self._running():
                    last = time.monotonic()
                left = self._idle - (time.monotonic() - last)
                if self.closed or left <= 0:
                    self.close()
                    raise StopIteration
                self._owner.news.wait(left)
            status = self.waiting.popleft()
        if status["state"] in ENDS:
            self.close()
            self.waiting.clear()
        return status

    def close(self) -> None:
        self.closed = True
        self._owner.leave(self)

    def __enter__(self) -> Subscription:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Progress:
    """Hands each status to all subscribers, and never waits for one that is slow."""

    def __init__(self) -> None:
        self.news = threading.Condition(threading.RLock())
        self._subscribers: list[Subscription] = []

    def publish(self, status: dict) -> None:
        with self.news:
            for s in self._subscribers:
                s.waiting.append(status)
            self.news.notify_all()

    def subscribe(self, now: Callable[[], dict], running: Callable[[], bool], idle: float = 1.5) -> Subscription:
        with self.news:
            s = Subscription(self, now(), running, idle)
            self._subscribers.append(s)
            return s

    def leave(self, s: Subscription) -> None:
        with self.news:
            if s in self._subscribers:
                self._subscribers.remove(s)
            self.news.notify_all()

    def __len__(self) -> int:
        return len(self._subscribers)
