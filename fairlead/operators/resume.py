"""Detection that goes on where an earlier run ended: two runs over two spans of time give what one over both gives.

A run leaves a :class:`Carry` of small tables: each vessel's last reports (half an
hour of its own time; one, if it has been silent since) with what the analyses hold
there; the last verdicts of each analysis, the reports that raised events which are
still open; and when each pair of vessels was last reported.  They are joined in by
union: carried rows keep their stored outcome, and windows over both give the new
rows theirs.  Events have ids by content, so an event that goes on is the same event.

Pairs of vessels meet in runs of the clock, which are closed up to a time (``until``):
a run is judged once, when all its reports are there.  Reports behind a vessel's last
carried one are left out.  An empty carry begins; a run without reports changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.config import Settings
from fairlead.functions.geo import Grid
from fairlead.operators import analyses, event_tables, events, filters, hysteresis, pairs, tracks
from fairlead.operators.event_tables import HISTORY_MS
from fairlead.operators.pairs import NEAR_MS
from fairlead.operators.statistics import COURSE, SPEED, TYPE_SIZE
from fairlead.sources.scratch import written

_PLACE = "ts_ms:bigint,lat:double,lon:double,sog:float,cog:float,hdg:float"
_SHIP = "name:string,callsign:string,imo:int,ship_type:int,to_bow:int,to_stern:int,to_port:int,to_starboard:int"
#: What a carried report holds of drifting (the first five) and of sudden speed changes.
HELD = f"struct<sustained:boolean,raised:boolean,transition:string,lat:double,lon:double,high:struct<{_PLACE},{_SHIP}>,kept:boolean,observed:bigint,stop:struct<{_PLACE}>,fired_ms:bigint>"
KINDS = {COURSE: events.COURSE, SPEED: events.SPEED, TYPE_SIZE: events.TYPE_SIZE}


@dataclass
class Carry:
    """Tables of an earlier run; None where there is none yet."""

    reports: DataFrame | None = None
    statics: DataFrame | None = None
    course: DataFrame | None = None
    speed: DataFrame | None = None
    size: DataFrame | None = None
    drift: DataFrame | None = None
    meetings: DataFrame | None = None
    flow: DataFrame | None = None
    closed: DataFrame | None = None  # one row: the clock's run that was closed last


_STATES = {COURSE: "course", SPEED: "speed", TYPE_SIZE: "size"}


@dataclass
class Found:
    tables: event_tables.Tables | None
    flow: DataFrame | None
    carry: Carry


def _last(column: str = "mmsi") -> Column:
    return F.max("ts_ms").over(Window.partitionBy(column))


def continued(positions: DataFrame, statics: DataFrame, carry: Carry, settings: Settings) -> DataFrame:
    """New reports after all filters, with the epochs that they continue, and the carried ones (``carried``)."""
    rows = filters.within_box(positions, *(settings.bounds or (None,) * 4))
    if settings.mask:
        rows = filters.outside_mask(rows, positions.sparkSession.createDataFrame(list(settings.mask), "south double, north double, west double, east double"))
    rows = filters.without_vessels(rows, settings.black_list).withColumn("carried", F.lit(False))
    known = statics
    if carry.reports is not None:
        raw = [c for c in rows.columns if c != "carried"]
        newest = carry.reports.where("not interpolated").withColumn("_last", _last()).where("ts_ms = _last")
        ends = newest.groupBy("mmsi").agg(F.max("ts_ms").alias("_end"))
        rows = rows.join(ends, "mmsi", "left").where(F.col("_end").isNull() | (F.col("ts_ms") > F.col("_end"))).select(*raw, "carried")
        seeds = newest.select(*[F.col(c) if c in newest.columns else F.lit(None).cast(positions.schema[c].dataType).alias(c) for c in raw], F.lit(True).alias("carried"))
        rows = rows.unionByName(seeds)
        known = statics.unionByName(carry.statics.select(*statics.columns))
    rows = filters.down_sample(rows, settings.down_sample_seconds).where("not carried")
    rows = tracks.as_of_static(rows, known)
    rows = filters.where(filters.without_names(rows, settings.skip_names), settings.expression)
    rows = tracks.with_cells(rows, Grid(settings.grid_metres))
    return with_epochs(rows, carry.reports, settings.stale_minutes)


def with_epochs(rows: DataFrame, carried: DataFrame | None, stale_minutes: int = 30) -> DataFrame:
    """New rows with their epochs and carried ones with theirs; ``interpolated``, ``last_ais_ms`` and ``held`` on all."""
    fresh = rows.withColumn("carried", F.lit(False)).withColumn("interpolated", F.lit(False)).withColumn("last_ais_ms", F.col("ts_ms"))
    fresh = fresh.withColumn("held", F.lit(None).cast(HELD))
    if carried is None:
        return tracks.with_epochs(fresh, stale_minutes)
    real = carried.where("not interpolated").withColumn("carried", F.lit(True))
    both = fresh.withColumn("epoch", F.lit(None).cast("int")).unionByName(real.select(*fresh.columns, "epoch"))
    w = tracks.vessel_window()
    gap = F.col("ts_ms") - F.lag("ts_ms").over(w)
    both = both.withColumn("_new", F.when(~F.col("carried") & (gap > stale_minutes * 60_000), 1).otherwise(0))
    base = F.coalesce(F.max("epoch").over(Window.partitionBy("mmsi")), F.lit(0))
    both = both.withColumn("epoch", F.coalesce("epoch", base + F.sum("_new").over(w)).cast("int")).drop("_new")
    guessed = carried.where("interpolated").withColumn("carried", F.lit(True))
    return both.unionByName(guessed.select(*both.columns))


def dense(rows: DataFrame, settings: Settings) -> DataFrame:
    """Reports with dead-reckoned ones in the new gaps; carried rows stay as they are."""
    if settings.interpolation_seconds <= 0:
        return rows
    real = rows.where("not interpolated")
    end = F.max(F.when(F.col("carried"), F.col("ts_ms"))).over(Window.partitionBy("mmsi"))
    base = real.withColumn("_end", end).where(~F.col("carried") | (F.col("ts_ms") == F.col("_end"))).drop("_end")
    made = tracks.interpolated(base.drop("interpolated", "last_ais_ms"), settings.interpolation_seconds, settings.stale_minutes * 60).where("interpolated")
    made = made.withColumn("carried", F.lit(False)).withColumn("held", F.lit(None).cast(rows.schema["held"].dataType))
    return rows.unionByName(tracks.with_cells(made, Grid(settings.grid_metres)).select(*rows.columns))


def statistical(rows: DataFrame, stats: DataFrame, statistic: str, params, before: DataFrame | None) -> DataFrame:
    """States of one statistical analysis: the carried ones and those of the new cell changes."""
    old = F.lag("cell_id").over(tracks.track_window())
    moved = rows.withColumn("old_cell_id", old).where("not carried").where(F.col("cell_id").isNotNull() & (F.col("old_cell_id").isNull() | (F.col("old_cell_id") != F.col("cell_id"))))
    verdicts = analyses.verdicts(moved.drop("held", "carried"), stats, statistic, params)
    return resumed_states(verdicts, before)


def resumed_states(verdicts: DataFrame, before: DataFrame | None, raise_after: int = hysteresis.RAISE_AFTER, lower_after: int = hysteresis.LOWER_AFTER) -> DataFrame:
    """``hysteresis.with_state`` that goes on from each track's last carried row; carried rows come first, as stored."""
    if before is None:
        return hysteresis.with_state(verdicts, raise_after, lower_after).drop("held_run", "held_raised")
    newest = before.withColumn("_epoch", F.max("epoch").over(Window.partitionBy("mmsi"))).where("epoch = _epoch")
    newest = newest.withColumn("_k", F.row_number().over(Window.partitionBy("mmsi").orderBy(F.desc("ts_ms"), F.desc("seq")))).where("_k = 1").drop("_epoch", "_k")
    seeds = newest.withColumnsRenamed({"run": "held_run", "raised": "held_raised"}).drop("transition", "certainty")
    none = {"held_run": F.lit(None).cast("int"), "held_raised": F.lit(None).cast("boolean")}
    new = hysteresis.with_state(verdicts.withColumns(none).unionByName(seeds), raise_after, lower_after).where("held_run is null").drop(*none)
    return before.unionByName(new.select(*before.columns))


def decisive(states: DataFrame) -> DataFrame:
    """The rows of states that events are made of, or that a later run may need: each vessel's last half hour."""
    recent = states.withColumn("_recent", F.col("ts_ms") >= _last() - HISTORY_MS)
    return event_tables.eventful(recent, F.col("_recent")).drop("_recent")


def kept_states(states: DataFrame, event_type: str) -> DataFrame:
    """What the next run needs of states: each vessel's last half hour, and the ends of its open events."""
    open_ = events.intervals(states, event_type).where("end_ms is null").select("mmsi", "epoch", "interval", F.lit(True).alias("_open"))
    rows = events.numbered(states).join(open_, ["mmsi", "epoch", "interval"], "left")
    last_raised = F.max(F.when(F.col("raised"), F.col("ts_ms"))).over(Window.partitionBy("mmsi", "epoch", "interval"))
    edge = F.col("_open") & F.col("raised") & ((F.col("transition") == "RAISE") | (F.col("ts_ms") == last_raised))
    rows = rows.withColumn("_recent", F.col("ts_ms") >= _last() - HISTORY_MS).withColumn("_edge", F.coalesce(edge, F.lit(False)))
    return rows.where("_recent or _edge").select(*states.columns)


def kept_reports(rows: DataFrame, stale_minutes: int, now: int) -> DataFrame:
    """Each vessel's last half hour of its last epoch, or its last report if it has been silent too long by ``now``.

    The last reports that the kinematic analyses looked at stay in any case.
    """
    w = Window.partitionBy("mmsi")
    rows = rows.withColumn("_real", F.max(F.when(~F.col("interpolated"), F.col("ts_ms"))).over(w)).withColumn("_epoch", F.max("epoch").over(w)).where("epoch = _epoch")
    silent = F.lit(now) - F.col("_real") > (stale_minutes + 1) * 60_000
    recent = F.when(silent, F.col("ts_ms") >= F.col("_real")).otherwise(F.col("ts_ms") >= F.col("_real") - HISTORY_MS - NEAR_MS)
    looked = lambda c: F.coalesce(F.col("ts_ms") == F.max(F.when(c, F.col("ts_ms"))).over(w), F.lit(False))
    rows = rows.withColumn("_recent", recent).withColumn("_drift", looked(F.col("held.raised").isNotNull())).withColumn("_speed", looked(F.col("held.kept")))
    return rows.where("_recent or _drift or _speed").drop("_real", "_epoch", "_recent", "_drift", "_speed", "carried")


def detect(positions: DataFrame, statics: DataFrame, stats: DataFrame | None, settings: Settings, carry: Carry | None = None, until: int | None = None) -> Found:
    """Detect over new positions after what ``carry`` holds; runs of the clock are closed up to ``until`` (default: the last report)."""
    carry = carry or Carry()
    spark = positions.sparkSession
    rows = written(continued(positions, statics, carry, settings), "reports")
    now = rows.agg(F.max("ts_ms")).first()[0] or 0
    begun = carry.closed.first()[0] if carry.closed is not None else -1
    end = max(begun, now if until is None else until)
    after = Carry(statics=_latest(statics, carry.statics), closed=spark.createDataFrame([(end,)], "run_ms long"))
    found = []
    full = written(dense(rows, settings), "dense") if settings.interpolation_seconds > 0 else rows
    for statistic, params in ((COURSE, settings.course), (SPEED, settings.speed), (TYPE_SIZE, settings.type_size)):
        if params.enabled:
            name = _STATES[statistic]
            states = written(decisive(statistical(full, stats, statistic, params, getattr(carry, name))), name)
            found.append(event_tables.of_states(states, KINDS[statistic]))
            setattr(after, name, kept_states(states, KINDS[statistic]))
    held = full
    if settings.drift.enabled:
        drifting = analyses.drift_rows(full, settings.drift)
        held = _hold_drift(drifting, full.columns)
        new = drifting.where("kept and not carried").drop("kept", "held", "carried")
        states = written(decisive(new if carry.drift is None else carry.drift.unionByName(new.select(*carry.drift.columns))), "drift")
        found.append(event_tables.of_states(states, events.DRIFT))
        after.drift = kept_states(states, events.DRIFT)
    if settings.speed_change.enabled:
        found.append(event_tables.of_speed_changes(analyses.sudden_speed_changes(rows.where("not interpolated"), settings.speed_change)))
        seen = analyses.speed_change_rows(held.where("not interpolated"), settings.speed_change)
        held = _hold_speed(seen, full.columns).unionByName(held.where("interpolated"))
    real = rows.where("not interpolated").drop("held", "carried")
    shut = lambda df: df.where((F.col("run_ms") <= F.lit(end)) & (F.col("run_ms") > F.lit(begun)))
    if settings.encounter.enabled:
        snaps = shut(pairs.snapshots(real, settings.encounter.run_seconds * 1000))
        runs = events.encounter_states(analyses.encounter_runs(snaps, settings.encounter))
        states = written(decisive(resumed_states(runs, carry.meetings, 1, 1)), "meetings")
        found.append(event_tables.of_encounter_states(states, real))
        after.meetings = kept_states(states, events.ENCOUNTER)
    flow = None
    if settings.free_flow.enabled:
        snaps = shut(pairs.snapshots(real.where(analyses.free_flow_guard(settings.free_flow)), settings.free_flow.run_seconds * 1000))
        flow, after.flow = _throttled(analyses.free_flow(snaps, settings.free_flow), carry.flow, settings.free_flow.report_minutes * 60_000, end)
    after.reports = kept_reports(held, settings.stale_minutes, now)
    return Found(event_tables.combined(found) if found else None, flow, after)


def _latest(statics: DataFrame, before: DataFrame | None) -> DataFrame:
    every = statics if before is None else statics.unionByName(before.select(*statics.columns))
    newest = F.max_by(F.struct(*statics.columns), F.struct("ts_ms", "seq")).alias("s")
    return every.groupBy("mmsi").agg(newest).select("s.*")


def _throttled(every: DataFrame, before: DataFrame | None, period_ms: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that are reported now, and when each pair was reported last, as long as that holds another report back."""
    rows = every.withColumn("carried", F.lit(False))
    if before is not None:
        seeds = before.select(*[F.col(c) if c in before.columns else F.lit(None).cast(every.schema[c].dataType).alias(c) for c in every.columns], F.lit(True).alias("carried"))
        rows = rows.unionByName(seeds)
    thinned = written(pairs.throttled(rows, period_ms), "flow")
    last = thinned.groupBy("a_mmsi", "b_mmsi").agg(F.max("a_ts_ms").alias("a_ts_ms")).withColumn("run_ms", F.col("a_ts_ms"))
    return thinned.where("not carried").drop("carried"), last.where(F.col("a_ts_ms") > F.lit(end - period_ms - NEAR_MS))


_DRIFT_PART, _SPEED_PART = ("sustained", "raised", "transition", "lat", "lon"), ("high", "kept", "observed", "stop", "fired_ms")


def _old(names: tuple[str, ...]) -> list[Column]:
    return [F.col("held")[c].alias(c) for c in names]


def _hold_drift(drifting: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that hold what drifting found at them; rows that the analysis leaves out hold where their run began."""
    own = lambda c: F.when(F.col("kept"), F.col(c)).alias(c)
    held = F.struct(F.col("sustained_drift").alias("sustained"), own("raised"), own("transition"), F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon"), *_old(_SPEED_PART))
    return drifting.withColumn("held", held).select(*columns)


def _hold_speed(seen: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that hold their last report at high speed and, if the analysis looks at them, their slow run."""
    own = lambda c: F.when(F.col("kept"), F.col(c)).alias(c)
    low = lambda c: F.when(F.col("kept") & F.col("is_low"), F.col(c)).alias(c)
    held = F.struct(*_old(_DRIFT_PART), F.col("high"), own("kept"), low("observed"), low("stop"), low("fired_ms"))
    return seen.withColumn("held", held).select(*columns)


def save(carry: Carry, path: str) -> None:
    """The carry as tables below ``path``; its last table completes it."""
    for f in fields(Carry):
        table = getattr(carry, f.name)
        if table is not None and f.name != "closed":
            table.write.mode("overwrite").parquet(f"{path}/{f.name}")
    carry.closed.coalesce(1).write.mode("overwrite").parquet(f"{path}/closed")


def load(spark: SparkSession, path: str) -> Carry:
    """The carry below ``path``; an empty one if none was completed."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(make(f"{path}/closed/_SUCCESS")):
        return Carry()
    return Carry(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Carry) if fs.exists(make(f"{path}/{f.name}/_SUCCESS"))})
