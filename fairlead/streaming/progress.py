"""Progress of streams and jobs: message rates, an estimate of the end, a periodic dump of counters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql.streaming import StreamingQueryListener


def estimated_end(begun: datetime, now: datetime, done: float) -> datetime | None:
    """When a job that is ``done`` (0 to 1) so far will end at its pace; None before there is a pace."""
    if done <= 0:
        return None
    return begun + timedelta(seconds=(now - begun).total_seconds() / min(done, 1.0))


class Counters(StreamingQueryListener):
    """Adds up rows and late rows of all streams, and reports them every ``seconds`` of progress time."""

    def __init__(self, report: Callable[[dict], None], seconds: int = 3600):
        self._report, self._seconds = report, seconds
        self._last: datetime | None = None
        self._since = self.rows = self.late = 0

    def onQueryStarted(self, event) -> None:
        self._last = None

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators)
        self.add(datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")), int(p.numInputRows), late)

    def add(self, now: datetime, rows: int, late: int) -> None:
        self.rows += rows
        self.late += late
        self._since += rows
        if self._last is None:
            self._last = now
        passed = (now - self._last).total_seconds()
        if passed >= self._seconds:
            self._report({"messages": self.rows, "late": self.late, "rate": self._since / passed})
            self._last, self._since = now, 0

    def onQueryTerminated(self, event) -> None:
        self._report({"messages": self.rows, "late": self.late, "rate": None})
