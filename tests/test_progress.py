"""Progress estimates, counters and the report."""

from datetime import datetime, timedelta

from fairlead.sources import report, sample
from fairlead.streaming.progress import Counters, estimated_end

NOON = datetime(2024, 1, 1, 12)


def test_estimate():
    assert estimated_end(NOON, NOON + timedelta(minutes=10), 0.25) == NOON + timedelta(minutes=40)
    assert estimated_end(NOON, NOON, 0.0) is None


def test_counters():
    seen = []
    counters = Counters(seen.append, 60)
    for k in range(4):
        counters.add(NOON + timedelta(seconds=30 * k), 300, k == 1)
    assert seen == [{"messages": 900, "late": 1, "rate": 15.0}]


def test_report(spark, sf_dir):
    stored = sample.event_store(spark, sf_dir)
    first, last = report.span(datetime(2024, 1, 6), None)
    assert last - first == timedelta(hours=24)
    text = report.html(*stored, first, last)
    assert text.count("BEGIN") == 6 and "VESSEL" in text and "<h2>DriftEvent</h2>" in text
