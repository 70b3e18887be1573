"""Stage timing and counters as key=value lines on stderr."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("siltstone")


def line(event: str, **fields) -> str:
    text = " ".join([f"event={event}", *(f"{k}={v}" for k, v in fields.items())])
    log.info(text)
    return text


@contextmanager
def stage(name: str):
    """Log a stage's start, and its duration in seconds when it ends."""
    began = time.perf_counter()
    line("stage_start", stage=name)
    try:
        yield
    finally:
        line("stage_end", stage=name, duration_s=round(time.perf_counter() - began, 3))


class Progress(StreamingQueryListener):
    """A running stream's counters: a line for each batch that had rows, with the total and the rate, and one at its end.
    Observed metrics of the query are fields of the line."""

    def __init__(self, name: str) -> None:
        self.name, self.total, self.ids = name, 0, set()

    def watch(self, query) -> None:
        self.ids.add(str(query.id))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.id) not in self.ids or not p.numInputRows:
            return
        self.total += p.numInputRows
        seen = {f"{name}_{k}": v for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        line("progress", counter=self.name, batch=p.batchId, rows=p.numInputRows, total=self.total, rate_per_s=round(p.processedRowsPerSecond, 1), **seen)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.ids:
            line("done", counter=self.name, total=self.total)


class Counter:
    """Counts items; logs the total and the rate every so many."""

    def __init__(self, name: str, every: int) -> None:
        self.name, self.every, self.total, self.began = name, every, 0, time.perf_counter()

    def update(self, n: int = 1) -> None:
        before, self.total = self.total, self.total + n
        if before // self.every != self.total // self.every:
            self.report("progress")

    def report(self, event: str) -> None:
        line(event, counter=self.name, total=self.total, rate_per_s=round(self.total / max(1e-9, time.perf_counter() - self.began), 1))

    def close(self) -> None:
        self.report("done")
