"""The event store's three tables (events, behaviours, tracking points) from what the analyses found.

Every part is keyed by (event_type, primary, start_ms), which one event has alone and
from which its id is made, so tables need no ranking and no join for ids.  The few
rows of an analysis that events are made of are written once, and so are the events
made of them; the three tables are derived from these: an analysis runs once.  A point's certainty is that of its
verdict for statistical events; for the others it is RAISED where the event
began, and UNDEFINED later and before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.config import Statistical
from fairlead.functions import formats, vessel
from fairlead.operators import analyses, events
from fairlead.operators.hysteresis import with_state
from fairlead.sources.scratch import at_once, written

KEY = ("event_type", "primary", "start_ms")
EVENTS = (*KEY, "end_ms", "state", "title", "description")
BEHAVIOURS = (*KEY, "mmsi", "is_primary", "imo", "name", "callsign", "ship_type", "length")
POINTS = (*KEY, "mmsi", "ts_ms", "lat", "lon", "sog", "cog", "hdg", "interpolated", "certainty")
#: Tracking points reach back so far before an event.
HISTORY_MS = 30 * 60_000
RAISED, UNDEFINED = 3, 0


@dataclass
class Tables:
    events: DataFrame
    behaviours: DataFrame
    points: DataFrame


def _interpolated(rows: DataFrame) -> Column:
    return F.col("interpolated") if "interpolated" in rows.columns else F.lit(False)


def history(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reports of ``wanted(event_type, primary, start_ms, mmsi, before_ms)`` in the history before ``before_ms``.

    One equi-join by vessel and half hour: a wanted row asks for the two halves that its history can lie in.
    """
    half = lambda ms: F.floor(ms / HISTORY_MS)
    asked = wanted.withColumn("_half", F.explode(F.sequence(half(F.col("before_ms") - HISTORY_MS), half(F.col("before_ms") - 1))))
    seen = reports.withColumn("_half", half(F.col("ts_ms")))
    span = (F.col("ts_ms") < F.col("before_ms")) & (F.col("ts_ms") >= F.col("before_ms") - HISTORY_MS)
    return seen.join(asked, ["mmsi", "_half"]).where(span)


def _behaviours(found: DataFrame) -> DataFrame:
    """The primary's vessel, as it was when the event was raised."""
    at = lambda c: F.col("at")[c]
    return found.select(
        *KEY, F.col("primary").alias("mmsi"), F.lit(True).alias("is_primary"), at("imo").alias("imo"), vessel.name_or_mmsi(at("name"), F.col("primary")).alias("name"), at("callsign").alias("callsign"),
        at("ship_type").alias("ship_type"), vessel.vessel_length(at("to_bow"), at("to_stern")).alias("length"),
    )


def eventful(states: DataFrame, also: Column | None = None) -> DataFrame:
    """The rows that events are made of: raised ones, those that lower, and those shortly before a statistical event."""
    keep = F.col("raised") | F.coalesce(F.col("transition") == "LOWER", F.lit(False))
    keep = keep if also is None else keep | also
    if "certainty" not in states.columns:
        return states.where(keep)
    # the next raising row of the track, seen from its end
    later = Window.partitionBy("mmsi", "epoch").orderBy(F.desc("ts_ms"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(F.when(F.col("transition") == "RAISE", F.col("ts_ms")), ignorenulls=True).over(later)
    rows = states.withColumn("_ahead", ahead)
    return rows.where(keep | F.coalesce(F.col("_ahead") - F.col("ts_ms") <= HISTORY_MS, F.lit(False))).drop("_ahead")


def of_states(states: DataFrame, event_type: str) -> Tables:
    """Events of the statistical analyses and of drifting, from rows with their state.

    Undecided reports before a statistical event are its history; drifting, which has no certainty, has none.
    """
    states = written(eventful(states), event_type)
    found = written(events.described(events.intervals(states, event_type)).withColumn("primary", F.col("mmsi")), f"{event_type}-found")
    rows = events.numbered(states)
    certain = "certainty" in states.columns
    sure = F.col("certainty") if certain else F.when(F.col("transition") == "RAISE", RAISED).otherwise(UNDEFINED)
    starts = found.select("mmsi", "epoch", "interval", *KEY)
    inside = rows.where("interval > 0 and transition in ('RAISE', 'MAINTAIN')").join(starts, ["mmsi", "epoch", "interval"])
    points = inside.select(*KEY, "mmsi", "ts_ms", "lat", "lon", "sog", "cog", "hdg", _interpolated(rows).alias("interpolated"), sure.cast("int").alias("certainty"))
    if certain:
        before = history(states.drop("event_type", "start_ms"), found.select(*KEY, "mmsi", "epoch", F.col("start_ms").alias("before_ms")).withColumnRenamed("epoch", "_epoch")).where("epoch = _epoch")
        points = points.unionByName(before.select(*KEY, "mmsi", "ts_ms", "lat", "lon", "sog", "cog", "hdg", _interpolated(states).alias("interpolated"), "certainty"))
    return Tables(found.select(*EVENTS), _behaviours(found), points)


def of_statistics(changes: DataFrame, stats: DataFrame, which: dict[str, tuple[Statistical, str]]) -> list[Tables]:
    """Events of the statistical analyses of ``which`` (statistic: parameters and event type), side by side."""
    part = lambda statistic, params, kind: lambda: of_states(with_state(analyses.verdicts(changes, stats, statistic, params)), kind)
    return at_once(*[part(statistic, *how) for statistic, how in which.items()])


def of_speed_changes(found: DataFrame) -> Tables:
    """Sudden speed changes: past events with the two reports between which the speed dropped."""
    first = F.min_by(F.struct(*found.columns), F.struct("fired_ms", "end_ms")).alias("first")  # what slowed down from one report is one event
    found = written(found.groupBy("mmsi", "start_ms").agg(first).select("first.*"), events.SPEED_CHANGE)
    rows = events.described_speed_changes(found).withColumn("event_type", F.lit(events.SPEED_CHANGE)).withColumn("primary", F.col("mmsi")).withColumn("state", F.lit("PAST"))
    behaviours = rows.select(*KEY, "mmsi", F.lit(True).alias("is_primary"), "imo", vessel.name_or_mmsi(F.col("name"), F.col("mmsi")).alias("name"), "callsign", "ship_type", vessel.vessel_length(F.col("to_bow"), F.col("to_stern")).alias("length"))
    end = lambda ms, k: F.struct(F.col(ms).alias("ts_ms"), *[F.col(f"{c}{k}").alias(c) for c in ("lat", "lon", "sog", "cog", "hdg")])
    named = rows.withColumnsRenamed({"lat": "lat1", "lon": "lon1"})
    both = named.select(*KEY, "mmsi", F.explode(F.array(end("start_ms", 1), end("end_ms", 2))).alias("p"))
    return Tables(rows.select(*EVENTS), behaviours, both.select(*KEY, "mmsi", "p.*", F.lit(False).alias("interpolated"), F.lit(RAISED).alias("certainty")))


def of_encounters(runs: DataFrame, reports: DataFrame) -> Tables:
    """Close encounters: two vessels, their reports when it was raised, the first one's later ones, and both histories."""
    return of_encounter_states(with_state(events.encounter_states(runs), 1, 1), reports)


def of_encounter_states(states: DataFrame, reports: DataFrame) -> Tables:
    """The same from runs with their state."""
    states = written(states.where("transition is not null"), events.ENCOUNTER)
    found = written(events.encounters_of(states).withColumn("primary", F.col("mmsi")), f"{events.ENCOUNTER}-found")
    sides = F.array(*[F.struct(F.lit(s == "a").alias("is_primary"), *[F.col(f"pair.{s}_{c}").alias(c) for c in SIDE]) for s in ("a", "b")])
    parts = found.select(*KEY, F.explode(sides).alias("s")).select(*KEY, "s.*")
    behaviours = parts.select(*KEY, "mmsi", "is_primary", "imo", vessel.name_or_mmsi(F.col("name"), F.col("mmsi")).alias("name"), "callsign", "ship_type", vessel.vessel_length(F.col("to_bow"), F.col("to_stern")).alias("length"))
    point = ["mmsi", "ts_ms", "lat", "lon", "sog", "cog", "hdg"]
    raised = parts.select(*KEY, *point, F.lit(False).alias("interpolated"), F.lit(RAISED).alias("certainty"))
    later = events.numbered(states).where("transition = 'MAINTAIN' and interval > 0").join(found.select("mmsi", "epoch", "interval", *KEY), ["mmsi", "epoch", "interval"])
    later = later.select(*KEY, *[F.col(f"with.a_{c}").alias(c) for c in point], F.lit(False).alias("interpolated"), F.lit(UNDEFINED).alias("certainty"))
    before = history(reports.drop("event_type", "start_ms"), parts.select(*KEY, "mmsi", F.col("ts_ms").alias("before_ms")))
    before = before.select(*KEY, *point, _interpolated(reports).alias("interpolated"), F.lit(UNDEFINED).alias("certainty"))
    every = raised.union(later).union(before)
    # a report seen in several runs is one point; where the event was raised it is a certain one
    points = every.groupBy(*KEY, "mmsi", "ts_ms").agg(F.max_by(F.struct("lat", "lon", "sog", "cog", "hdg", "interpolated", "certainty"), "certainty").alias("p")).select(*KEY, "mmsi", "ts_ms", "p.*")
    return Tables(found.select(*EVENTS, "safety_zone", "secondary_extent"), behaviours, points)


#: What a run keeps of each vessel of its nearest pair.
SIDE = ("mmsi", "ts_ms", "name", "callsign", "imo", "ship_type", "to_bow", "to_stern", "lat", "lon", "sog", "cog", "hdg")


def combined(parts: list[Tables]) -> Tables:
    """All types together, with ids and times: the tables that searches and sinks read."""

    def all_of(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame, allowMissingColumns=True)
        return out

    number = events.event_id(F.col("event_type"), F.col("primary"), F.col("start_ms")).alias("event_id")
    time = lambda ms: formats.from_millis(F.col(ms))
    rows = all_of([p.events for p in parts])
    zones = [c for c in ("safety_zone", "secondary_extent") if c in rows.columns]
    table = rows.select(number, "event_type", "state", time("start_ms").alias("start_time"), time("end_ms").alias("end_time"), F.lit(False).alias("suppressed"), "title", "description", *zones)
    behaviours = all_of([p.behaviours for p in parts]).select(number, *BEHAVIOURS[3:])
    points = all_of([p.points for p in parts]).select(number, "mmsi", time("ts_ms").alias("ts"), *POINTS[5:])
    return Tables(table, behaviours, points)
