"""The event store as files that searches prune: Parquet by day, by last day and state, and by coarse cell.

Events lie by the day they start, whether they are open, and their last day (that of
the start while there is no end); their behaviours and tracking points lie by the same
day, points also by the cell of ``CELL_DEGREES`` where they are.  A search for a span
opens the days that can hold its events, for an area the cells that meet it.

A save writes only the days of its events: stored rows of these days that it does not
replace are written beside the new ones, below a version of its own, and the version
of each day is named by a manifest that is written last.  So readers see a save whole
or not at all, a job that failed leaves the store as it was, and cost follows the days
that changed.  Of two writers at once the second is refused.  Two manifests are kept,
with what they name; :func:`vacuum` deletes the rest.

Defined results: an event without id or start, one that ends before it starts, and an
id that would stand for two events are refused; behaviours and points of events that
the save does not bring are left out; points without position lie in no cell and are
found by no area; repeated rows stay; an empty save changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators import search as searches
from fairlead.operators.event_tables import Tables
from fairlead.sources.scratch import scratch_path

EVENTS = "event_id long, event_type string, state string, start_time timestamp_ntz, end_time timestamp_ntz, suppressed boolean, title string, description string"
BEHAVIOURS = "event_id long, mmsi int, is_primary boolean, imo int, name string, callsign string, ship_type int, length int"
POINTS = "event_id long, mmsi int, ts timestamp_ntz, lat double, lon double, sog float, cog float, hdg float, interpolated boolean, certainty int"
#: Columns of each table, what its folders are made of below day and version, and what makes a row of an event one of its own.
TABLES = {
    "events": (EVENTS, "open boolean, last date", ()),
    "behaviours": (BEHAVIOURS, "", ("mmsi",)),
    "points": (POINTS, "cell int", ("mmsi", "ts")),
}
CELL_DEGREES = 10
FILE_ROWS = 2_000_000


@dataclass(frozen=True)
class Day:
    """A day's current version, its events' last day, and the tables that have rows."""

    version: str
    last: str
    tables: tuple[str, ...]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _hadoop(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> list[int]:
    make, fs = _hadoop(spark, path)
    folder = make(f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _days(spark: SparkSession, path: str, number: int) -> dict[str, Day]:
    make, fs = _hadoop(spark, path)
    stream = fs.open(make(f"{path}/manifests/{number}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {day: Day(v, last, tuple(tables)) for day, (v, last, tables) in json.loads(text).items()}


def days(spark: SparkSession, path: str) -> dict[str, Day]:
    """The current days; their number is that of a calendar."""
    found = _manifests(spark, path)
    return _days(spark, path, found[-1]) if found else {}


def _publish(spark: SparkSession, path: str, number: int, found: dict[str, Day]) -> None:
    make, fs = _hadoop(spark, path)
    draft = make(f"{path}/manifests/{number}-{uuid.uuid4().hex[:8]}.tmp")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({d: [x.version, x.last, x.tables] for d, x in sorted(found.items())}).encode()))
    stream.close()
    final = make(f"{path}/manifests/{number}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError("another writer has saved meanwhile; nothing was stored")


def _table(spark: SparkSession, path: str, table: str, some: dict[str, Day]) -> DataFrame:
    schema, folders, _ = TABLES[table]
    full = ", ".join(x for x in (schema, "day date, version string", folders) if x)
    paths = [f"{path}/{table}/day={d}/version={x.version}" for d, x in sorted(some.items()) if table in x.tables]
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/{table}").parquet(*paths)


def _of(spark: SparkSession, path: str, some: dict[str, Day]) -> Tables:
    return Tables(*[_table(spark, path, table, some) for table in TABLES])


def read(spark: SparkSession, path: str) -> Tables:
    """All stored rows."""
    return Tables(*[_table(spark, path, t, days(spark, path)).select(*_names(TABLES[t][0])) for t in TABLES])


def cell(lat: Column, lon: Column) -> Column:
    """The coarse cell of a position."""
    return (F.floor((lat + 90) / CELL_DEGREES) * (360 // CELL_DEGREES) + F.floor((lon + 180) / CELL_DEGREES)).cast("int")


def _cells(area: searches.Area) -> list[int]:
    """The cells that meet an area: a world has some hundred."""
    north, east, south, west = area
    rows = range(max(int((south + 90) // CELL_DEGREES), 0), min(int((north + 90) // CELL_DEGREES), 180 // CELL_DEGREES) + 1)
    columns = range(max(int((west + 180) // CELL_DEGREES), 0), min(int((east + 180) // CELL_DEGREES), 360 // CELL_DEGREES) + 1)
    return [r * (360 // CELL_DEGREES) + c for r in rows for c in columns]


def _check(new: DataFrame, stored: DataFrame) -> None:
    bad = new.agg(
        F.count_if(F.col("event_id").isNull() | F.col("start_time").isNull()).alias("unnamed"),
        F.count_if(F.col("end_time") < F.col("start_time")).alias("backward"),
    ).first()
    if bad["unnamed"] or bad["backward"]:
        raise ValueError(f"{bad['unnamed']} events have no id or start, {bad['backward']} end before they start; nothing was stored")
    both = new.select("event_id", "event_type", "start_time").unionByName(stored.select("event_id", "event_type", "start_time"))
    clash = both.groupBy("event_id").agg(F.count_distinct("event_type", "start_time").alias("n")).where("n > 1")
    if clash.take(1):
        raise ValueError("one event id stands for different events; nothing was stored")


def save(tables: Tables, path: str, merge: bool = False) -> None:
    """Put events with their behaviours and points into the store; what it has of the same events is replaced.

    With ``merge``, behaviours and points of these events that are not written again stay.
    """
    spark = tables.events.sparkSession
    number, current = next(reversed(_manifests(spark, path)), 0), days(spark, path)
    version, brought = uuid.uuid4().hex[:12], scratch_path(spark, "events")
    day = F.to_date("start_time").alias("day")
    tables.events.select(*_names(EVENTS)).write.parquet(brought)  # what the tables are made of is not made again for each of them
    new = spark.read.schema(EVENTS).parquet(brought)
    changed = [str(r["day"]) for r in new.where("start_time is not null").select(day).distinct().collect()]
    stored = _of(spark, path, {d: current[d] for d in changed if d in current})
    _check(new, stored.events)
    if not changed:
        return
    own_day = new.groupBy("event_id").agg(F.min(F.to_date("start_time")).alias("day"))  # an id has one start; what is grouped by it need not be dealt again to be joined
    rows = {
        "events": (new.withColumn("day", day), stored.events),
        "behaviours": (tables.behaviours.select(*_names(BEHAVIOURS)).join(own_day, "event_id"), stored.behaviours),
        "points": (tables.points.select(*_names(POINTS)).join(own_day, "event_id"), stored.points),
    }
    for table, (found, before) in rows.items():
        schema, folders, own = TABLES[table]
        replaced = found.select("event_id", *own) if merge and own else own_day.select("event_id")
        kept = before.select(*_names(schema), "day").join(replaced, ["event_id", *(own if merge else ())], "left_anti")
        all_ = kept.select(*_names(schema), "day").unionByName(found.select(*_names(schema), "day")).withColumn("version", F.lit(version))
        if table == "events":
            all_ = all_.withColumn("open", F.col("end_time").isNull()).withColumn("last", F.to_date(F.coalesce("end_time", "start_time")))
        if table == "points":
            all_ = all_.withColumn("cell", cell(F.col("lat"), F.col("lon")))
        by = ["day", "version", *(_names(folders) if folders else ())]
        # few files for each folder, and large folders in several tasks
        dealt = all_.hint("rebalance", *[F.col(c) for c in by]).sortWithinPartitions(*by, "event_id")
        dealt.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).parquet(f"{path}/{table}")
    make, fs = _hadoop(spark, path)
    has = {d: tuple(t for t in TABLES if fs.exists(make(f"{path}/{t}/day={d}/version={version}"))) for d in changed}
    written = _table(spark, path, "events", {d: Day(version, d, has[d]) for d in changed})
    ends = {str(r["day"]): str(r["last"]) for r in written.groupBy("day").agg(F.max("last").alias("last")).collect()}
    _publish(spark, path, number + 1, current | {d: Day(version, ends[d], has[d]) for d in changed})
    make, fs = _hadoop(spark, brought)
    fs.delete(make(brought), True)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete versions that the last two manifests do not name, and older manifests; returns how many folders went.

    Not to be run beside a save, whose version no manifest names yet.
    """
    make, fs = _hadoop(spark, path)
    found = _manifests(spark, path)
    named = {(d, x.version) for n in found[-2:] for d, x in _days(spark, path, n).items()}
    gone = 0
    for table in TABLES:
        for folder in fs.listStatus(make(f"{path}/{table}")) if fs.exists(make(f"{path}/{table}")) else ():
            if not folder.isDirectory():
                continue
            for version in fs.listStatus(folder.getPath()):
                key = (folder.getPath().getName().removeprefix("day="), version.getPath().getName().removeprefix("version="))
                if key not in named:
                    fs.delete(version.getPath(), True)
                    gone += 1
    for n in found[:-2]:
        fs.delete(make(f"{path}/manifests/{n}.json"), False)
    return gone


def _date(value: datetime | str) -> date:
    return value.date() if isinstance(value, datetime) else datetime.fromisoformat(value).date()


def spanned(spark: SparkSession, path: str, begin: datetime | str | None = None, end: datetime | str | None = None, area: searches.Area | None = None) -> Tables:
    """The stored rows that a search for a span and an area has to see, of the days and cells that can hold them."""
    some = {d: x for d, x in days(spark, path).items() if (end is None or d <= str(_date(end))) and (begin is None or x.last >= str(_date(begin)))}
    found = _of(spark, path, some)
    if begin is not None:
        found.events = found.events.where(F.col("last") >= F.lit(_date(begin)))
    if area is not None:
        found.points = found.points.where(F.col("cell").isin(_cells(area)))
    return Tables(*[x.select(*_names(schema)) for x, (schema, _, _) in zip((found.events, found.behaviours, found.points), TABLES.values(), strict=True)])


def search(spark: SparkSession, path: str, begin: datetime | str | None = None, end: datetime | str | None = None, event_type: str | None = None, vessel: str | None = None, area: searches.Area | None = None) -> DataFrame:
    """:func:`fairlead.operators.search.search` over the rows that can meet it."""
    found = spanned(spark, path, begin, end, area)
    return searches.search(found.events, found.behaviours, found.points, begin, end, event_type, vessel, area)


def between(spark: SparkSession, path: str, begin: datetime | str, end: datetime | str) -> DataFrame:
    """:func:`fairlead.operators.search.events_between` over the days that can hold its events."""
    return searches.events_between(spanned(spark, path, begin, end).events, begin, end)


def ongoing(spark: SparkSession, path: str, mmsi: int, event_type: str) -> DataFrame:
    """:func:`fairlead.operators.search.ongoing_event` over the folders of open events."""
    found = _of(spark, path, days(spark, path))
    opened = found.events.where("open").select(*_names(EVENTS))
    return searches.ongoing_event(opened, found.behaviours, mmsi, event_type)


def recent(spark: SparkSession, path: str, count: int) -> DataFrame:
    """:func:`fairlead.operators.search.recent_events` over the newest days that hold so many events not suppressed."""
    current = days(spark, path)
    some: dict[str, Day] = {}
    wanted = 1
    while True:
        some = {d: current[d] for d in sorted(current)[-wanted:]}
        rows = _table(spark, path, "events", some).select(*_names(EVENTS))
        if len(some) == len(current) or len(rows.where("not suppressed").take(count)) >= count:
            return searches.recent_events(rows, count)
        wanted *= 4


def delete(spark: SparkSession, path: str, gone: Iterable[str]) -> None:
    """Take whole days out of the store, as a retention rule names them; their files go with :func:`vacuum`."""
    number, current, names = next(reversed(_manifests(spark, path)), 0), days(spark, path), set(gone)
    left = {d: x for d, x in current.items() if d not in names}
    if len(left) < len(current):
        _publish(spark, path, number + 1, left)
