"""Searches over the event store and the statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import formats
from fairlead.functions.categories import label, ship_type_bucket
from fairlead.functions.geo import Grid
from fairlead.operators.statistics import TYPE_SIZE

Area = tuple[float, float, float, float]  # north, east, south, west


def event_types(events: DataFrame) -> DataFrame:
    return events.where("not suppressed").select("event_type").distinct().orderBy("event_type")


def event_by_id(events: DataFrame, event_id: int) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def _at(value: datetime | str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def _vessel(text: str) -> Column:
    """Part of a call sign or name; a number also is a whole mmsi or imo. ``*`` (the first) is any text."""
    pattern = f"%{text.replace('*', '%', 1)}%"
    found = F.col("callsign").like(pattern) | F.col("name").like(pattern)
    if text.isdigit():
        found = found | (F.col("mmsi") == int(text)) | (F.col("imo") == int(text))
    return F.coalesce(found, F.lit(False))


def search(events: DataFrame, behaviours: DataFrame, points: DataFrame, begin: datetime | str | None = None, end: datetime | str | None = None, event_type: str | None = None, vessel: str | None = None, area: Area | None = None) -> DataFrame:
    """Events not suppressed that meet all conditions given; vessel and area are semi-joins on behaviours and points."""
    rows = events.where("not suppressed")
    if begin is not None:
        rows = rows.where((F.col("start_time") >= _at(begin)) | F.coalesce(F.col("end_time") >= _at(begin), F.lit(False)))
    if end is not None:
        rows = rows.where((F.col("start_time") <= _at(end)) | F.coalesce(F.col("end_time") <= _at(end), F.lit(False)))
    if event_type:
        rows = rows.where(F.col("event_type") == event_type)
    if vessel:
        rows = rows.join(behaviours.where(_vessel(vessel)).select("event_id"), "event_id", "left_semi")
    if area:
        north, east, south, west = area
        inside = (F.col("lat") < north) & (F.col("lat") > south) & (F.col("lon") < east) & (F.col("lon") > west)
        rows = rows.join(points.where(inside).select("event_id"), "event_id", "left_semi")
    return rows


def check_parameters(recent: int | None = None, area: tuple | None = None, **others) -> None:
    """The rules of a search request: a box needs all four sides, a count of recent events stands alone."""
    if area is not None and (len(area) != 4 or any(x is None for x in area)):
        raise ValueError("an area needs north, east, south and west")
    if recent is not None and (area is not None or any(v is not None for v in others.values())):
        raise ValueError("a number of recent events excludes other parameters")


def worth_searching(vessel: str | None = None, begin: str | None = None, end: str | None = None) -> bool:
    """Whether a form is filled in enough to be sent: a vessel, or both dates in full."""
    return bool(vessel and vessel.strip()) or all(len((x or "").strip()) >= 10 for x in (begin, end))


def as_json(events: DataFrame, behaviours: DataFrame, points: DataFrame) -> DataFrame:
    """One JSON document for each event: its fields, its vessels and each vessel's points in the order of time."""
    tracked = points.groupBy("event_id", "mmsi").agg(F.sort_array(F.collect_list(F.struct("ts", *[c for c in points.columns if c not in ("event_id", "mmsi", "ts")]))).alias("points"))
    sides = behaviours.join(tracked, ["event_id", "mmsi"], "left")
    sides = sides.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(F.expr("not is_primary").alias("secondary"), "mmsi", *[c for c in sides.columns if c not in ("event_id", "mmsi", "is_primary")]))).alias("behaviours"))
    rows = events.join(sides, "event_id", "left")
    return rows.select("event_id", F.to_json(F.struct(*events.columns, "behaviours"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}).alias("json"))


def events_between(events: DataFrame, begin: datetime | str, end: datetime | str) -> DataFrame:
    """Events that start or end in the span, by start; one that spans it all is not among them."""
    span = F.col("start_time").between(_at(begin), _at(end)) | F.coalesce(F.col("end_time").between(_at(begin), _at(end)), F.lit(False))
    return events.where(span).orderBy("start_time", "event_id")


def recent_events(events: DataFrame, count: int) -> DataFrame:
    return events.where("not suppressed").orderBy(F.desc("start_time"), F.desc("event_id")).limit(count)


def ongoing_event(events: DataFrame, behaviours: DataFrame, mmsi: int, event_type: str) -> DataFrame:
    """The first ongoing event of a type with this vessel in any role."""
    own = behaviours.where(F.col("mmsi") == mmsi).select("event_id")
    return events.where((F.col("state") == "ONGOING") & (F.col("event_type") == event_type)).join(own, "event_id", "left_semi").orderBy("start_time", "event_id").limit(1)


def cells_in_area(stats: DataFrame, grid: Grid, north: float, east: float, south: float, west: float) -> DataFrame:
    """Statistics of the cells whose box touches the area: a range of rows and of columns, no list of cells."""
    if not (north > south and east > west):
        raise ValueError("north must be above south and east above west")
    half = grid.columns // 2
    column = F.pmod(F.col("cell_id") + half, F.lit(grid.columns)) - half
    row = ((F.col("cell_id") - column) / grid.columns).cast("long")
    lit = lambda x: int(x // grid.resolution)
    inside = row.between(lit(south), lit(north)) & column.between(lit(west), lit(east))
    reach = F.col("cell_id").between(lit(south) * grid.columns + lit(west), lit(north) * grid.columns + lit(east))
    return stats.where(reach & inside)


def cell_ids(stats: DataFrame, statistic: str) -> DataFrame:
    return stats.where(F.col("statistic") == statistic).select("cell_id").distinct()


def cell_statistic(stats: DataFrame, statistic: str, cell_id: int) -> DataFrame:
    if cell_id <= 0:
        raise ValueError("a cell id is positive")
    return stats.where((F.col("statistic") == statistic) & (F.col("cell_id") == cell_id))


def statistic_names(stats: DataFrame) -> DataFrame:
    return stats.select("statistic").distinct().orderBy("statistic")


def first_cell(stats: DataFrame, statistic: str) -> DataFrame:
    return cell_ids(stats, statistic).orderBy("cell_id").limit(1)


def counts(stats: DataFrame) -> DataFrame:
    return stats.groupBy("statistic").agg(F.count_distinct("cell_id").alias("cells"))


def missing_statistics(stats: DataFrame, required: tuple[str, ...] = (TYPE_SIZE,)) -> DataFrame:
    """Required statistics that a store does not have; a usable store has none."""
    needed = stats.sparkSession.createDataFrame([(x,) for x in required], "statistic string")
    return needed.join(stats.select("statistic").distinct(), "statistic", "left_anti")


def types_with_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def report_lines(events: DataFrame, behaviours: DataFrame, points: DataFrame, begin: datetime | str, end: datetime | str) -> DataFrame:
    """One fixed-width line for each event of a span, by type: the recent events report."""
    from fairlead.operators.events import most_recent_points

    found = events_between(events, begin, end)
    rows = found.join(behaviours.where("is_primary"), "event_id").join(most_recent_points(points), ["event_id", "mmsi"])
    kind = F.coalesce(label("type", ship_type_bucket(F.col("ship_type"))), F.lit(""))
    closing = F.when(F.col("end_time").isNull(), " ").otherwise(formats.stamp(F.col("end_time")))
    line = F.format_string(
        "%8d %16s %16s %9d %-20s %3d %-9s %7.4f %7.4f %4.1f %5.1f %3.0f",
        "event_id", formats.stamp(F.col("start_time")), closing, "mmsi", F.coalesce("name", F.lit("")), F.coalesce("length", F.lit(-1)), kind, "lat", "lon",
        F.col("sog").cast("double"), F.col("cog").cast("double"), F.col("hdg").cast("double"),
    )
    return rows.select("event_type", "event_id", line.alias("line"))
