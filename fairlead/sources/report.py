"""The recent events report as HTML: a job's text output; sending it is left to the scheduler that runs the job."""

from __future__ import annotations

from datetime import datetime, timedelta
from html import escape

from pyspark.sql import DataFrame

from fairlead.operators.search import report_lines

# Headings of the report's columns, as wide as its lines.
HEADINGS = "%-8s %-16s %-16s %-9s %-20s %-3s %-9s %-7s %-7s %-4s %-5s %-3s" % ("#", "BEGIN", "END", "MMSI", "NAME", "LOA", "TYPE", "LAT", "LON", "SOG", "COG", "HDG")


def span(now: datetime, last_run: datetime | None) -> tuple[datetime, datetime]:
    """Since the last run; the first one looks back a day."""
    return last_run or now - timedelta(hours=24), now


def html(events: DataFrame, behaviours: DataFrame, points: DataFrame, begin: datetime, end: datetime) -> str:
    """Events of a span by type. A mail is read by people: its lines come to the driver one partition at a time."""
    lines = report_lines(events, behaviours, points, begin, end).orderBy("event_type", "event_id")
    groups: dict[str, list[str]] = {}
    for row in lines.toLocalIterator():
        groups.setdefault(row["event_type"], []).append(row["line"])
    totals = "".join(f"<tr><td>{escape(kind)}</td><td>{len(found)}</td></tr>" for kind, found in groups.items())
    parts = "".join(f"<section><h2>{escape(kind)}</h2><pre>" + "\n".join([HEADINGS, *map(escape, found)]) + "</pre></section>" for kind, found in groups.items())
    title = f"Events from {begin:%Y-%m-%d %H:%M} to {end:%Y-%m-%d %H:%M}"
    return f"<!doctype html><html><head><title>{title}</title></head><body><h1>{title}</h1><table>{totals}</table>{parts}</body></html>"
