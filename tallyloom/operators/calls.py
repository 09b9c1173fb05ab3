"""Calls of a user's function, several in flight at a time and each with a deadline."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa

#: Rows of an Arrow batch that are Python objects at a time.
SLAB = 128


def slabs(columns: Sequence[pa.Array], rows: int = SLAB) -> Iterator[list[tuple]]:
    """The rows of a batch, some at a time, so that the others stay in Arrow's compact form."""
    for start in range(0, len(columns[0]), rows):
        yield list(zip(*(c.slice(start, rows).to_pylist() for c in columns), strict=True))


class Call:
    """One call and what became of it."""

    __slots__ = ("args", "started", "value", "error", "over")

    def __init__(self, args: tuple | None) -> None:
        self.args, self.started, self.value, self.error = args, 0.0, None, None
        self.over = args is None

    def make(self, function: Callable) -> tuple[object, str | None]:
        try:
            return function(*self.args), None
        except BaseException as raised:  # noqa: BLE001 - recorded in the row
            return None, str(raised) or type(raised).__name__


class CallWindow:
    """Calls ``function`` from at most ``in_flight`` threads; outcomes come in the order asked.

    A call that takes longer than ``timeout`` seconds is given up: its outcome is an error, and
    another thread takes over its place. Python cannot end a thread, so what was given up may
    run on by itself, unheard; it doesn't keep the process from ending.
    """

    def __init__(self, function: Callable, in_flight: int = 1, timeout: float | None = None) -> None:
        if in_flight < 1 or (timeout is not None and timeout <= 0):
            raise ValueError("calls in flight and timeout must be positive")
        self._function, self._most, self._timeout = function, in_flight, timeout
        self._changed = threading.Condition()
        self._todo: deque[Call] = deque()
        self._running: set[Call] = set()
        self._threads, self._open, self._closed = 0, 0, False

    def _work(self) -> None:
        while True:
            with self._changed:
                while not self._todo:
                    if self._closed:
                        return
                    self._changed.wait()
                call = self._todo.popleft()
                call.started = time.monotonic()
                self._running.add(call)
                # The one who waits may have to wait less long for this call's deadline.
                self._changed.notify_all()
            value, error = call.make(self._function)
            with self._changed:
                if call.over:
                    return
                call.value, call.error = value, error
                self._finish(call)

    def _finish(self, call: Call) -> None:
        call.over = True
        self._running.discard(call)
        self._open -= 1
        self._changed.notify_all()

    def _start(self) -> None:
        self._threads += 1
        threading.Thread(target=self._work, daemon=True).start()

    def run(self, batch: Iterable[tuple | None]) -> list[Call]:
        """Outcomes of a batch of argument tuples; None stands for no call."""
        calls = [Call(args) for args in batch]
        with self._changed:
            fresh = [c for c in calls if not c.over]
            self._todo.extend(fresh)
            self._open += len(fresh)
            while self._threads < min(self._most, len(self._todo)):
                self._start()
            self._changed.notify_all()
            while self._open:
                wait = None
                if self._timeout is not None:
                    now = time.monotonic()
                    for call in [c for c in self._running if now - c.started >= self._timeout]:
                        call.error = f"Flow execution timed out after {self._timeout:g} seconds"
                        self._finish(call)
                        self._start()
                    if self._running:
                        wait = min(c.started for c in self._running) + self._timeout - now
                if self._open:
                    self._changed.wait(None if wait is None else max(wait, 0))
        return calls

    def close(self) -> None:
        with self._changed:
            self._closed = True
            self._changed.notify_all()
