"""Peak memory of a run, driver, JVM and workers together."""

from __future__ import annotations

import os
import threading
from pathlib import Path


def tree(root: int) -> list[int]:
    """A process and all below it."""
    found, queue = [], [root]
    while queue:
        pid = queue.pop()
        found.append(pid)
        for task in Path(f"/proc/{pid}/task").glob("*/children"):
            try:
                queue += map(int, task.read_text().split())
            except OSError:  # it has ended
                pass
    return found


def resident(pids: list[int]) -> int:
    """Bytes that the processes hold of their own; shared pages count once."""
    total = 0
    for pid in pids:
        try:
            fields = dict(x.split(":", 1) for x in Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines()[1:])
            total += int(fields["Pss"].split()[0]) * 1024
        except (OSError, KeyError):
            pass
    return total


class PeakMemory:
    """``with PeakMemory() as m: ...``; then ``m.samples`` are bytes over time and ``m.peak`` is their largest."""

    def __init__(self, every: float = 0.25, pid: int | None = None):
        self.every, self.pid, self.samples = every, pid or os.getpid(), []
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def _watch(self) -> None:
        while True:
            self.samples.append(resident(tree(self.pid)))
            if self._stop.wait(self.every):
                return

    @property
    def peak(self) -> int:
        return max(self.samples, default=0)

    def __enter__(self) -> PeakMemory:
        self._thread.start()
        return self

    def __exit__(self, *error) -> None:
        self._stop.set()
        self._thread.join()
