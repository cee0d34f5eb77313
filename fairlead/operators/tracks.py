"""Tracks as rows: epochs between silences, cell changes, as-of static data and trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.geo import Grid

ORDER = ("ts_ms", "seq")


def vessel_window() -> WindowSpec:
    return Window.partitionBy("mmsi").orderBy(*ORDER)


def track_window() -> WindowSpec:
    return Window.partitionBy("mmsi", "epoch").orderBy(*ORDER)


def with_epochs(reports: DataFrame, stale_minutes: int = 30) -> DataFrame:
    """``epoch`` counts a vessel's silences longer than ``stale_minutes``: each epoch is a track of its own."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(vessel_window())
    fresh = F.coalesce((gap > stale_minutes * 60_000).cast("int"), F.lit(0))
    return reports.withColumn("_new", fresh).withColumn("epoch", F.sum("_new").over(vessel_window()).cast("int")).drop("_new")


def with_cells(reports: DataFrame, grid: Grid | None = None) -> DataFrame:
    return reports.withColumn("cell_id", (grid or Grid()).cell(F.col("lat"), F.col("lon")))


def cell_changes(reports: DataFrame) -> DataFrame:
    """Rows where the track's cell differs from the one before; a track's first row counts."""
    old = F.lag("cell_id").over(track_window())
    return reports.withColumn("old_cell_id", old).where(F.col("cell_id").isNotNull() & (F.col("old_cell_id").isNull() | (F.col("old_cell_id") != F.col("cell_id"))))


STATIC = ("name", "callsign", "imo", "ship_type", "to_bow", "to_stern", "to_port", "to_starboard")


def as_of_static(positions: DataFrame, statics: DataFrame) -> DataFrame:
    """Each position with the vessel's latest static report at or before it (ties: the static one first)."""
    moving = [c for c in positions.columns if c not in STATIC]
    left = positions.select(*moving, *[F.lit(None).cast(statics.schema[c].dataType).alias(c) for c in STATIC], F.lit(None).cast("long").alias("_static"), F.lit(1).alias("_kind"))
    keyed = ("mmsi", "ts_ms", "seq")
    right = statics.select(*[F.col(c) if c in keyed else F.lit(None).cast(positions.schema[c].dataType).alias(c) for c in moving], *STATIC, F.col("ts_ms").alias("_static"), F.lit(0).alias("_kind"))
    past = Window.partitionBy("mmsi").orderBy("ts_ms", "_kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.struct(*STATIC)
    latest = F.last(F.when(F.col("_static").isNotNull(), whole), ignorenulls=True).over(past)
    rows = left.unionByName(right).withColumn("_latest", latest).where("_kind = 1")
    return rows.select(*moving, *[F.col("_latest")[c].alias(c) for c in STATIC])


def interpolated(reports: DataFrame, step_seconds: int = 10, most_seconds: int = 1800) -> DataFrame:
    """Reports and, in the gaps up to ``most_seconds``, dead-reckoned ones every ``step_seconds``."""
    step = step_seconds * 1000
    reports = reports.withColumn("_next", F.lead("ts_ms").over(track_window()))
    stop = F.least(F.col("_next") - 1, F.col("ts_ms") + most_seconds * 1000)
    room = F.col("_next").isNotNull() & (stop >= F.col("ts_ms") + step)
    times = F.when(room, F.sequence(F.col("ts_ms") + step, stop, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    reports = reports.withColumn("_times", times)
    base = reports.withColumn("interpolated", F.lit(False)).withColumn("last_ais_ms", F.col("ts_ms"))
    filled = base.withColumn("_at", F.explode("_times"))
    lat, lon = geo.predicted(F.col("lat"), F.col("lon"), F.col("sog"), F.col("cog"), F.col("_at") - F.col("ts_ms"))
    guessed = filled.withColumn("_lat", lat).withColumn("_lon", lon).withColumn("lat", F.col("_lat")).withColumn("lon", F.col("_lon"))
    guessed = guessed.withColumn("ts_ms", F.col("_at")).withColumn("interpolated", F.lit(True)).drop("_at", "_lat", "_lon")
    return base.unionByName(guessed).drop("_next", "_times")


def trailing(milliseconds: int) -> WindowSpec:
    return Window.partitionBy("mmsi", "epoch").orderBy("ts_ms").rangeBetween(-milliseconds, 0)


def until(milliseconds: int) -> WindowSpec:
    """All of a track's rows that are at least so old: a frame that only grows, where a trailing one is gone through anew for each row."""
    return Window.partitionBy("mmsi", "epoch").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -milliseconds)


def is_drifting(low: float = 1.0, high: float = 5.0, angle: float = 45.0) -> Column:
    """Slow, and moving neither ahead nor astern; false where a component is missing."""
    cog, hdg = F.col("cog"), F.col("hdg")
    across = (geo.direction_difference(cog, hdg) > angle) & (geo.direction_difference(cog + F.lit(180.0), hdg) > angle)
    return F.coalesce(F.col("sog").between(low, high) & across, F.lit(False))


def with_drift(reports: DataFrame, period_minutes: int = 10, metres: float = 500, history_minutes: int = 30, **limits: float) -> DataFrame:
    """drifting, and the three parts of a sustained drift: period, tracked long enough, distance of the run.

    Rows of an earlier run have ``held`` with what was found there; ``from_lat``, ``from_lon`` are where a run began.
    """
    held = (lambda c, other: F.coalesce(F.col("held")[c], other)) if "held" in reports.columns else (lambda c, other: other)
    period = period_minutes * 60_000
    rows = reports.withColumn("drifting", is_drifting(**limits))
    # a run of drifting reports begins where the report before does not drift; any other report is a run of its own
    begins = ~F.col("drifting") | ~F.coalesce(F.lag("drifting").over(track_window()), F.lit(False))
    place = F.when(F.col("_begins"), F.struct(held("lat", F.col("lat")).alias("lat"), held("lon", F.col("lon")).alias("lon")))
    rows = rows.withColumn("_begins", begins).withColumn("_from", F.last(place, ignorenulls=True).over(track_window().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("from_lat", F.col("_from.lat")).withColumn("from_lon", F.col("_from.lon"))
    # the latest report that does not drift is older than the period, and one older than the period is in the history
    other = F.max(F.when(~F.col("drifting"), F.col("ts_ms"))).over(until(0))
    rows = rows.withColumn("drift_period", F.coalesce(other < F.col("ts_ms") - period, F.lit(True)))
    past = F.max("ts_ms").over(until(period + 1))
    rows = rows.withColumn("tracked_long", F.coalesce(past >= F.col("ts_ms") - max(history_minutes * 60_000, period + 1), F.lit(False)))
    far = F.when(F.col("drifting"), geo.rhumb_distance(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon")))
    rows = rows.withColumn("drift_metres", far).withColumn("drift_far", F.coalesce(F.col("drift_metres") > metres, F.lit(False)))
    return rows.withColumn("sustained_drift", held("sustained", F.col("drift_period") & F.col("tracked_long") & F.col("drift_far"))).drop("_begins", "_from")


def with_speed_drops(reports: DataFrame, high: float = 7.0, low: float = 1.0, decay_seconds: int = 30, sustain_seconds: int = 60) -> DataFrame:
    """sudden (low now, high at most ``decay_seconds`` ago), and sustained low speed, reported and calculated.

    ``high`` is the last report at high speed; rows of an earlier run have theirs in ``held``.
    """
    top = F.lit(102.2).cast("float")
    rows = reports.withColumn("is_low", F.coalesce(F.col("sog") <= low, F.lit(False)))
    now = F.struct("ts_ms", "lat", "lon", "sog", "cog", "hdg", *[c for c in STATIC if c in reports.columns])
    was_high = F.when(F.col("sog").between(high, top), now)
    was_high = F.coalesce(F.col("held.high"), was_high) if "held" in reports.columns else was_high
    rows = rows.withColumn("high", F.last(was_high, ignorenulls=True).over(track_window().rowsBetween(Window.unboundedPreceding, 0))).withColumn("last_high_ms", F.col("high.ts_ms"))
    rows = rows.withColumn("sudden", F.coalesce(F.col("is_low") & (F.col("ts_ms") - F.col("last_high_ms") <= decay_seconds * 1000), F.lit(False)))
    span = sustain_seconds * 1000
    w = track_window()
    way = geo.rhumb_distance(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    time = F.lead("ts_ms").over(w) - F.col("ts_ms")
    knots = F.when(time == 0, F.when(way > 0, F.lit(float("inf")))).otherwise(way / (time / 1000.0) * geo.KNOTS)
    rows = rows.withColumn("_next_knots", knots)
    # no report since then was faster
    faster = F.max(F.when(F.col("sog") > low, F.col("ts_ms"))).over(until(0))
    rows = rows.withColumn("low_reported", F.coalesce(faster < F.col("ts_ms") - span, F.lit(True)))
    inside = Window.partitionBy("mmsi", "epoch").orderBy("ts_ms").rangeBetween(-span, -1)
    rows = rows.withColumn("calculated_knots", F.max("_next_knots").over(inside))
    return rows.withColumn("low_calculated", F.coalesce(F.col("calculated_knots") <= low, F.lit(True))).drop("_next_knots")
