"""The analyses: three held against learned statistics, two kinematic, two of pairs of vessels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.config import CloseEncounter, Drift, FreeFlow, Statistical, SuddenSpeedChange
from fairlead.functions import geo, vessel
from fairlead.operators import flows, meetings, pairs, statistics, tracks
from fairlead.operators.statistics import COURSE, SPEED, TYPE_SIZE
from fairlead.sources.scratch import written


def _length() -> Column:
    return vessel.vessel_length(F.col("to_bow"), F.col("to_stern"))


def _last_real(df: DataFrame) -> Column:
    return F.col("last_ais_ms") if "last_ais_ms" in df.columns else F.col("ts_ms")


def _ordinary(df: DataFrame, minutes: int) -> Column:
    """What every analysis leaves out: class B, unknown, special craft, towing, predicted too long."""
    t = F.col("ship_type")
    out = vessel.is_class_b(t) | vessel.is_unknown_type_or_size(t, _length()) | vessel.is_special_craft(t) | vessel.is_engaged_in_towing(t)
    return ~(out | vessel.predicted_too_long(F.col("ts_ms"), _last_real(df), minutes))


def _analysed(rows: DataFrame, statistic: str, params: Statistical) -> Column:
    """Which cell changes (with buckets) a statistical analysis looks at."""
    t = F.col("ship_type")
    keep = _ordinary(rows, params.prediction_minutes) & ~vessel.is_fishing(t) & ~vessel.is_engaged_in_fishing(t) & ~vessel.is_small(_length())
    keep = keep & F.col("cell_id").isNotNull() & F.col("type_bucket").isNotNull() & F.col("size_bucket").isNotNull() & F.coalesce(_length() >= params.least_length, F.lit(False))
    if statistic == COURSE:
        keep = keep & ~vessel.is_slow(F.col("sog")) & F.col("course_bucket").isNotNull()
    if statistic == SPEED:
        keep = keep & F.col("speed_bucket").isNotNull()
    return keep


def judged(rows: DataFrame, stats: DataFrame, statistic: str, params: Statistical) -> DataFrame:
    """Every row with ``analysed``, its cell's total, the count of its own buckets and ``abnormal``.

    One equi-join by cell: a cell's statistic is one row, its counts a map of at most 480 entries.
    """
    rows = statistics.with_buckets(rows)
    rows = rows.withColumn("analysed", _analysed(rows, statistic, params))
    cells = statistics.by_cell(stats.where(F.col("statistic") == statistic))
    third = {TYPE_SIZE: F.lit(1), COURSE: F.col("course_bucket"), SPEED: F.col("speed_bucket")}[statistic] - 1
    key = lambda k1: (k1 * 5 + F.col("size_bucket") - 1) * 12 + third
    count = lambda k1: F.coalesce(F.try_element_at(F.col("counts"), key(k1)), F.lit(0))
    if params.over_all_types and statistic != TYPE_SIZE:
        own = sum((count(F.lit(k)) for k in range(1, statistics.TOP["k1"])), count(F.lit(0)))  # the last type is not in this sum
    else:
        own = count(F.col("type_bucket") - 1)
    out = rows.join(cells, "cell_id", "left").withColumn("own", F.when(F.col("total").isNotNull(), own))
    share = F.when(F.col("total") > params.least_count, (F.col("own").cast("float") / F.col("total").cast("float")).cast("float"))
    out = out.withColumn("pd", F.coalesce(share, F.lit(1.0).cast("float"))).drop("counts")
    return out.withColumn("abnormal", F.col("pd") < F.lit(params.pd).cast("float"))


def verdicts(changes: DataFrame, stats: DataFrame, statistic: str, params: Statistical) -> DataFrame:
    """The analysed cell changes with their verdicts."""
    return judged(changes, stats, statistic, params).where("analysed").drop("analysed")


def drift_guard(reports: DataFrame, params: Drift) -> Column:
    """Which reports the analysis looks at."""
    t = F.col("ship_type")
    known = vessel.sog_available(F.col("sog")) & vessel.cog_available(F.col("cog")) & vessel.heading_available(F.col("hdg"))
    large = vessel.is_very_long(_length()) | vessel.is_cargo(t) | vessel.is_tanker(t) | vessel.is_passenger(t)
    return ~F.coalesce(_length() < params.least_length, F.lit(False)) & known & _ordinary(reports, params.prediction_minutes) & large


def drift_rows(reports: DataFrame, params: Drift) -> DataFrame:
    """All reports with ``kept`` (the analysis looks at them), the parts of a drift, ``raised`` and ``transition``.

    Length below the minimum is left out while an unknown one passes that guard and falls to the next.
    Reports that are not kept have windows of their own, which say nothing.
    """
    # the guard is a column before the windows: beside the distances it would make code too long to be compiled by the JVM
    rows = reports.withColumn("kept", F.coalesce(drift_guard(reports, params), F.lit(False)))
    rows = tracks.with_drift(rows, params.period_minutes, params.metres, low=params.least_sog, high=params.most_sog, angle=params.angle)
    held = (lambda c, other: F.coalesce(F.col("held")[c], other)) if "held" in reports.columns else (lambda c, other: other)
    w = Window.partitionBy("mmsi", "epoch", "kept").orderBy("ts_ms", "seq")
    # an event lasts from the first sustained row of a drifting run to the first row that drifts no more
    rows = rows.withColumn("_k", F.row_number().over(w))
    latest = lambda which: F.coalesce(F.max(F.when(which, F.col("_k"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("_ends", latest(~F.col("drifting"))).withColumn("_sustained", latest(held("raised", F.col("sustained_drift"))))
    rows = rows.withColumn("raised", held("raised", F.col("drifting") & (F.col("_sustained") > 0) & (F.col("_sustained") >= F.col("_ends"))))
    rows = rows.withColumn("_before", F.coalesce(F.lag("raised").over(w), F.lit(False)))
    step = F.when(F.col("raised") & ~F.col("_before"), "RAISE").when(F.col("raised") & F.col("sustained_drift"), "MAINTAIN").when(~F.col("raised") & F.col("_before"), "LOWER")
    if "carried" in reports.columns:
        step = F.when(F.col("carried"), F.col("held.transition")).otherwise(step)
    return rows.withColumn("transition", step).drop("_k", "_ends", "_sustained", "_before")


def drift(reports: DataFrame, params: Drift) -> DataFrame:
    """Analysed reports with the parts of a drift, ``sustained_drift``, ``raised`` and ``transition``."""
    return drift_rows(reports, params).where("kept").drop("kept")


def speed_change_guard(reports: DataFrame, params: SuddenSpeedChange) -> Column:
    """Which reports the analysis looks at."""
    t = F.col("ship_type")
    keep = ~F.coalesce(_length() < params.least_length, F.lit(False)) & vessel.sog_available(F.col("sog")) & _ordinary(reports, params.prediction_minutes)
    return keep & ~vessel.is_fishing(t) & ~vessel.is_engaged_in_fishing(t)


def speed_change_rows(reports: DataFrame, params: SuddenSpeedChange) -> DataFrame:
    """All reports with ``kept`` and, for those, what is known of the slow run that they are in.

    An observation starts at a vessel's first low report that is sudden after its last report above
    the low mark; the event fires at the first later low report with sustained low speed.
    """
    rows = reports.withColumn("kept", F.coalesce(speed_change_guard(reports, params), F.lit(False)))
    rows = tracks.with_speed_drops(rows, params.high, params.low, params.decay_seconds, params.sustain_seconds)
    held = (lambda c, other: F.coalesce(F.col("held")[c], other)) if "held" in reports.columns else (lambda c, other: other)
    w = Window.partitionBy("mmsi", "epoch", "kept").orderBy("ts_ms", "seq")
    rows = rows.withColumn("island", F.sum((~F.col("is_low")).cast("int")).over(w))
    run = Window.partitionBy("mmsi", "epoch", "kept", "island", "is_low").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("observed", F.min(held("observed", F.when(F.col("sudden"), F.col("ts_ms")))).over(run))
    rows = rows.withColumn("stop", F.first(held("stop", F.struct("ts_ms", "lat", "lon", "sog", "cog", "hdg"))).over(run))
    fires = F.col("is_low") & (F.col("observed") < F.col("ts_ms")) & F.col("low_reported") & F.col("low_calculated")
    fires = fires & ~F.col("carried") if "carried" in reports.columns else fires
    return rows.withColumn("fired_ms", F.min(held("fired_ms", F.when(fires, F.col("ts_ms")))).over(run))


def sudden_speed_changes(reports: DataFrame, params: SuddenSpeedChange) -> DataFrame:
    """One row for each event: mmsi, epoch, and the reports at its two ends."""
    low = speed_change_rows(reports, params).where("kept and is_low and fired_ms is not null")
    ends = low.groupBy("mmsi", "epoch", "island").agg(F.min("fired_ms").alias("fired_ms"), F.min("stop").alias("stop"), F.max("high").alias("go"))
    return ends.select(
        "mmsi", "epoch", F.col("go.ts_ms").alias("start_ms"), F.col("stop.ts_ms").alias("end_ms"), "fired_ms",
        F.col("go.lat").alias("lat"), F.col("go.lon").alias("lon"), F.col("go.sog").alias("sog1"), F.col("stop.sog").alias("sog2"),
        F.col("go.cog").alias("cog1"), F.col("go.hdg").alias("hdg1"), F.col("stop.lat").alias("lat2"), F.col("stop.lon").alias("lon2"), F.col("stop.cog").alias("cog2"), F.col("stop.hdg").alias("hdg2"), *[F.col("go")[c].alias(c) for c in tracks.STATIC if c in reports.columns],
    )


def _encountering(params: CloseEncounter) -> tuple[Column, Column, Column]:
    """Which reports may be the first and the second of a close encounter, and the bits of what no two may have in common."""
    t, sog, length = F.col("ship_type"), F.col("sog"), _length()
    either = ~vessel.is_support(t) & ~vessel.is_engaged_in_towing(t)
    first = either & ~vessel.is_speed_invalid(sog) & F.coalesce(sog > params.least_sog, F.lit(True))
    second = either & ~vessel.is_slow(sog) & F.coalesce(sog >= params.least_sog, F.lit(False))
    bits = [vessel.is_small(length), vessel.is_fishing(t), vessel.is_engaged_in_fishing(t), vessel.is_undefined(t)]
    return first, second, sum((bit.cast("int") * (1 << k) for k, bit in enumerate(bits)), F.lit(0))


def encounter_candidates(reports: DataFrame, params: CloseEncounter, columns: tuple[str, ...] = pairs.COLUMNS) -> DataFrame:
    """Ordered pairs of near vessels in each run that may be in a close encounter."""
    first, second, kinds = _encountering(params)
    return pairs.nearby(reports, params.run_seconds * 1000, first=first, second=second, kinds=kinds, columns=columns)


def close_encounters(reports: DataFrame, params: CloseEncounter) -> DataFrame:
    """Candidates with ``meets``: the first's safety zone (by course) touches the second's extent (by heading).

    Both are predicted to the later of their reports, on a plane around the first.
    """
    rows = encounter_candidates(reports, params)
    parts = [F.col(f"{s}_{c}").isNotNull() for s in ("a", "b") for c in ("to_bow", "to_stern", "to_port", "to_starboard")]
    known = F.col("a_cog").isNotNull() & ~F.isnan("a_cog") & F.col("b_hdg").isNotNull() & ~F.isnan("b_hdg") & F.col("a_sog").isNotNull() & F.col("b_cog").isNotNull()
    for part in parts:
        known = known & part
    rows = ovals(rows.where(known), params)
    return rows.withColumn("meets", geo.intersects(F.col("zone"), F.col("extent")))


def ovals(rows: DataFrame, params: CloseEncounter) -> DataFrame:
    """Pairs with the first's ``zone`` and the second's ``extent``, and where both are at the later of their reports."""
    now = F.greatest("a_ts_ms", "b_ts_ms")
    a_lat, a_lon = geo.predicted(F.col("a_lat"), F.col("a_lon"), F.col("a_sog"), F.col("a_cog"), now - F.col("a_ts_ms"))
    b_lat, b_lon = geo.predicted(F.col("b_lat"), F.col("b_lon"), F.col("b_sog"), F.col("b_cog"), now - F.col("b_ts_ms"))
    rows = rows.select("*", a_lat.alias("pa_lat"), a_lon.alias("pa_lon"), b_lat.alias("pb_lat"), b_lon.alias("pb_lon"))
    size = lambda s: (F.col(f"{s}_to_bow") + F.col(f"{s}_to_stern"), F.col(f"{s}_to_port") + F.col(f"{s}_to_starboard"), F.col(f"{s}_to_stern"), F.col(f"{s}_to_starboard"))
    zone = geo.safety_zone(F.col("a_cog"), *size("a"), length=params.length, breadth=params.breadth, behind=params.behind)
    x, y = geo.local_x(F.col("pb_lon"), F.col("pa_lat"), F.col("pa_lon")), geo.local_y(F.col("pb_lat"), F.col("pa_lat"))
    return rows.select("*", zone.alias("zone"), geo.vessel_extent(F.col("b_hdg"), *size("b"), x=x, y=y).alias("extent"))


_OVAL = ("to_bow", "to_stern", "to_port", "to_starboard", "sog", "cog")


def _known(*also: str) -> Column:
    known = F.lit(True)
    for c in (*_OVAL, *also):
        known = known & F.col(c).isNotNull()
    return known


def encounter_verdicts(reports: DataFrame, params: CloseEncounter) -> DataFrame:
    """Each vessel and run with a candidate: ``meets``, the candidates (``near``), and the nearest that meets it with its distance.

    The same as groups of ``close_encounters``, from blocks of vessels at one place in place of their pairs.
    """
    snaps = reports if "run_ms" in reports.columns else pairs.snapshots(reports, params.run_seconds * 1000)
    first, second, kinds = _encountering(params)
    by = (*pairs.PLACE, "kinds")
    side = lambda keep, *also: pairs.blocked(snaps.where(keep).withColumn("kinds", kinds).select(*by, "mmsi", *_OVAL, *also), by)
    blocks = pairs.near_blocks(side(first & _known() & ~F.isnan("cog")), side(second & _known("hdg") & ~F.isnan("hdg"), "hdg"))
    blocks = blocks.where(F.col("a_kinds").bitwiseAND(F.col("b_kinds")) == 0).select("run_ms", "near_metres", *[f"{s}_{c}" for s in "ab" for c in ("ts_ms", "lat", "lon", "members")])
    nearest = F.min(F.when(F.col("b_mmsi").isNotNull(), F.struct("near_metres", "b_mmsi"))).alias("nearest")
    found = blocks.mapInArrow(meetings.met(params), meetings.SCHEMA).groupBy("run_ms", "a_mmsi").agg(F.sum("near").alias("near"), nearest)
    return found.select("run_ms", "a_mmsi", F.col("nearest").isNotNull().alias("meets"), "near", "nearest.near_metres", "nearest.b_mmsi")


def encounter_runs(reports: DataFrame, params: CloseEncounter) -> DataFrame:
    """Each vessel and run with a candidate: whether any neighbour meets its zone, and of those that do the nearest.

    Snapshots (read as first, as second and for the columns of both) and verdicts (read for meetings and for none) are written once.
    """
    snaps = reports if "run_ms" in reports.columns else pairs.snapshots(reports, params.run_seconds * 1000)
    kept = [c for c in pairs.COLUMNS if c in snaps.columns]
    snaps = written(snaps.select("run_ms", *kept), "snapshots")
    found = written(encounter_verdicts(snaps, params), "verdicts")
    named = lambda s: snaps.select("run_ms", *[F.col(c).alias(f"{s}_{c}") for c in kept])
    rows = found.where("meets").join(named("a"), ["run_ms", "a_mmsi"]).join(named("b"), ["run_ms", "b_mmsi"])
    rows = ovals(rows, params)
    zone = geo.ellipse_position(F.col("zone"), F.col("pa_lat"), F.col("pa_lon"))
    extent = geo.ellipse_position(F.col("extent"), F.col("pa_lat"), F.col("pa_lon"))
    known = [f"{s}_{c}" for s in ("a", "b") for c in kept if (s, c) != ("b", "mmsi")]
    met = rows.select("run_ms", F.col("a_mmsi").alias("mmsi"), F.lit(True).alias("abnormal"), F.struct("near_metres", "b_mmsi", *known, zone.alias("zone"), extent.alias("extent")).alias("with"))
    return met.unionByName(found.where("not meets").select("run_ms", F.col("a_mmsi").alias("mmsi"), F.lit(False).alias("abnormal"), F.lit(None).cast(met.schema["with"].dataType).alias("with")))


def reason_counters(changes: DataFrame, statistic: str, params: Statistical) -> DataFrame:
    """How many cell changes an analysis looks at, and the first reason why it leaves out the others."""
    t = F.col("ship_type")
    rows = statistics.with_buckets(changes)
    reason = F.when(vessel.is_class_b(t), "class b").when(vessel.is_unknown_type_or_size(t, _length()), "unknown type or size")
    reason = reason.when(vessel.is_fishing(t) | vessel.is_engaged_in_fishing(t), "fishing")
    if statistic == COURSE:
        reason = reason.when(vessel.is_slow(F.col("sog")), "slow")
    reason = reason.when(vessel.is_small(_length()), "small").when(vessel.is_special_craft(t), "special craft").when(vessel.is_engaged_in_towing(t), "towing")
    reason = reason.when(vessel.predicted_too_long(F.col("ts_ms"), _last_real(changes), params.prediction_minutes), "predicted too long")
    reason = reason.when(_analysed(rows, statistic, params), "analysed").otherwise("other")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def free_flow_guard(params: FreeFlow) -> Column:
    """Which reports the analysis looks at; none without a box."""
    if params.box is None:
        return F.lit(False)
    t = F.col("ship_type")
    north, east, south, west = params.box
    keep = vessel.is_very_long(_length()) & vessel.is_tanker_or_cargo(t) & F.col("lat").between(south, north) & F.col("lon").between(west, east) & F.coalesce(F.col("sog") >= 1.0, F.lit(True))
    return keep & F.col("cog").isNotNull() & F.col("hdg").isNotNull()


def _flowing(reports: DataFrame, params: FreeFlow) -> DataFrame:
    """Snapshots of the vessels that the analysis looks at, with what depends on one vessel alone: its centre and its ellipse."""
    seen = reports.where(free_flow_guard(params))
    seen = seen if "run_ms" in reports.columns else pairs.snapshots(seen, params.run_seconds * 1000)
    beam = F.col("to_port") + F.col("to_starboard")
    shape = geo.ellipse(F.col("cog"), F.col("to_bow") + F.col("to_stern"), beam, F.col("to_stern"), F.col("to_starboard"), params.along, params.across, 1.0)
    lat, lon = geo.vessel_centre(F.col("lat"), F.col("lon"), F.col("hdg"), *[F.col(f"to_{d}") for d in ("stern", "bow", "port", "starboard")])
    seen = seen.withColumns({"_lat": lat, "_lon": lon, "_shape": shape})
    return seen.withColumns({"_shrink": F.cos(F.radians("_lat")), "_cos": F.cos(F.radians("_shape.theta")), "_sin": F.sin(F.radians("_shape.theta"))})


def free_flow(reports: DataFrame, params: FreeFlow, columns: tuple[str, ...] = pairs.COLUMNS, said: dict[str, Column] | None = None) -> DataFrame:
    """Pairs of large tankers and cargo vessels that sail the same way, the second in the first's ellipse, before throttling.

    What depends on one vessel alone (its centre, its ellipse, and ``said``, of its report and its centre ``_lat``, ``_lon``)
    is worked out before it meets others; ``columns`` and what is said are kept of each.
    """
    seen = _flowing(reports, params)
    seen = seen.withColumns(said or {})
    kept = tuple(dict.fromkeys(("mmsi", "cog", *columns, *(said or {}))))
    own = ("_lat", "_lon", "_shape", "_shrink", "_cos", "_sin")
    near = pairs.nearby(seen, params.run_seconds * 1000, columns=(*kept, *own))
    rows = near.where(geo.direction_difference(F.col("a_cog"), F.col("b_cog")) < params.course_degrees)
    x, y = geo.local_x(F.col("b__lon"), F.col("a__lat"), F.col("a__lon"), F.col("a__shrink")), geo.local_y(F.col("b__lat"), F.col("a__lat"))
    rows = rows.where(geo.contains(F.col("a__shape"), x, y, (F.col("a__cos"), F.col("a__sin"))))
    rows = rows.withColumnsRenamed({f"{s}__{c}": f"c{s}_{c}" for s in "ab" for c in ("lat", "lon")}).drop(*[f"{s}_{c}" for s in "ab" for c in own[2:]])
    return rows.select(
        *[c for c in rows.columns if c not in ("ca_lat", "ca_lon", "cb_lat", "cb_lon")], "ca_lat", "ca_lon", "cb_lat", "cb_lon",
        geo.rhumb_bearing(F.col("ca_lat"), F.col("ca_lon"), F.col("cb_lat"), F.col("cb_lon")).alias("bearing"),
        geo.cartesian_distance(F.col("ca_lat"), F.col("ca_lon"), F.col("cb_lat"), F.col("cb_lon")).alias("distance"),
    )


def free_flow_reports(reports: DataFrame, params: FreeFlow, period_ms: int) -> DataFrame:
    """Pairs of ``free_flow`` (run, numbers and the first's time), reported again ``period_ms`` later only, as by ``pairs.throttled``.

    No pair crosses a shuffle or is a row before that: blocks of vessels give lists of numbers for each first vessel.
    """
    seen = _flowing(reports, params).where("mmsi is not null")
    own = {"lat": "_lat", "lon": "_lon", "shrink": "_shrink", "cos": "_cos", "sin": "_sin"} | {c: f"_shape.{c}" for c in ("x", "y", "alpha", "beta")}
    at = [F.col(c).alias(f"at_{c}") for c in ("lat", "lon")]
    seen = seen.select("run_ms", "ts_ms", *at, "mmsi", "cog", *[F.col(column).alias(c) for c, column in own.items()])
    side = lambda *also: pairs.blocked(seen.select("run_ms", "ts_ms", "at_lat", "at_lon", "mmsi", "cog", "lat", "lon", *also), ("run_ms", "ts_ms", "at_lat", "at_lon")).withColumnsRenamed({"at_lat": "lat", "at_lon": "lon"})
    blocks = pairs.near_blocks(side(*flows.OWN), side())
    lists = blocks.select("run_ms", "a_ts_ms", "a_members", "b_members").mapInArrow(flows.sailing(params), flows.LISTS)
    return pairs.throttled_lists(lists, period_ms)
