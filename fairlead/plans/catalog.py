"""Registered queries: each applies operators to whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.config import CloseEncounter, Drift, FreeFlow, Statistical, SuddenSpeedChange
from fairlead.functions import categories, formats, geo, vessel
from fairlead.functions.geo import Grid
from fairlead.operators import analyses, event_tables, events, filters, hysteresis, pairs, search, statistics, tracks
from fairlead.operators.statistics import COURSE, SPEED, TYPE_SIZE
from fairlead.sources import event_files, event_store, sample, scratch, statistics_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Thresholds at which the small tables raise events.
LEARNED = Statistical(least_count=4, pd=0.25, least_length=50, prediction_minutes=10)
LEARNED_ALL = Statistical(least_count=4, pd=0.25, least_length=50, prediction_minutes=10, over_all_types=True)
ENCOUNTER = CloseEncounter(run_seconds=30)
FLOW = FreeFlow(run_seconds=60, along=20.0, across=60.0, box=(58.0, 16.0, 54.0, 7.0))
BOXES = [(55.001, 55.004, 11.0, 11.003), (55.01, 55.02, 11.005, 11.007)]
SPAN = ("2024-01-05T00:00:00", "2024-01-12T00:00:00")
AREA = (55.2, 11.1, 55.1, 11.02)  # north, east, south, west


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_cells(tracks.with_epochs(sample.position_reports(spark, sf_dir)))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.cell_changes(reports(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.train(changes(spark, sf_dir))


# --- categories, names, keys -------------------------------------------------


def _bucket(kind: str, column) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sample.position_reports(spark, sf_dir).select("mmsi", "ts_ms", column().alias("bucket"))
        return rows.withColumn("label", categories.label(kind, F.col("bucket")))

    return run


QUERIES["categorize_ship_type"] = _bucket("type", lambda: categories.ship_type_bucket(F.col("ship_type")))
QUERIES["categorize_length"] = _bucket("size", lambda: categories.length_bucket(F.col("to_bow") + F.col("to_stern")))
QUERIES["categorize_course"] = _bucket("course", lambda: categories.course_bucket(F.col("cog")))
QUERIES["categorize_speed"] = _bucket("speed", lambda: categories.speed_bucket(F.col("sog")))


@query
def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's labels of the categories that the reports hold, with the reports of each."""
    rows = statistics.with_buckets(sample.position_reports(spark, sf_dir))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_bucket").alias("bucket")) for k in categories.LABELS])).alias("c")
    held = rows.select(kinds).select("c.*").groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))
    names = None
    for kind in categories.LABELS:
        own = categories.dictionary(spark, kind).select(F.lit(kind).alias("kind"), "bucket", "label")
        names = own if names is None else names.union(own)
    return held.join(names, ["kind", "bucket"])


@query
def vessel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("mmsi") % 3 == 0, F.lit("@@@")).otherwise(F.col("name"))
    rows = sample.position_reports(spark, sf_dir).withColumn("name", name)
    return rows.select("mmsi", "ts_ms", vessel.trim_name(F.col("name")).alias("trimmed"), vessel.name_or_mmsi(F.col("name"), F.col("mmsi")).alias("shown"), vessel.name_and_mmsi(F.col("name"), F.col("mmsi")).alias("full"))


@query
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats(spark, sf_dir).where("k3 is not null").withColumn("key", formats.checked_key(F.col("k1"), F.col("k2"), F.col("k3"), 7, 4, 11))
    a, b, c = formats.unpack_key(F.col("key"), 5, 12)
    return rows.select("statistic", "cell_id", "key", a.alias("k1"), b.alias("k2"), c.alias("k3"))


# --- filters -----------------------------------------------------------------


@query
def flt_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.within_box(sample.position_reports(spark, sf_dir), 55.01, 55.002, 11.001, 11.005).select("mmsi", "ts_ms", "lat", "lon")


@query
def flt_geomask(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame(BOXES, "south double, north double, west double, east double")
    return filters.outside_mask(sample.position_reports(spark, sf_dir), boxes).select("mmsi", "ts_ms", "lat", "lon")


@query
def flt_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.where(sample.position_reports(spark, sf_dir), "sog > 12 and ship_type between 70 and 89").select("mmsi", "ts_ms", "sog", "ship_type")


@query
def flt_name_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_names(sample.position_reports(spark, sf_dir), ["vessel 1*", "*7", "VESSEL 2?"]).select("mmsi", "ts_ms", "name")


@query
def flt_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_vessels(sample.position_reports(spark, sf_dir), [219000003, 219000008, -1, 2_000_000_000]).select("mmsi", "ts_ms")


@query
def flt_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.position_reports(spark, sf_dir)
    t, sog, length = F.when(F.col("ship_type") == 90, None).otherwise(F.col("ship_type")), F.when(F.col("seq") % 10 == 0, None).otherwise(F.col("sog")), F.col("to_bow") + F.col("to_stern")
    kinds = {
        "tanker": vessel.is_tanker(t), "cargo": vessel.is_cargo(t), "passenger": vessel.is_passenger(t), "support": vessel.is_support(t), "fishing": vessel.is_fishing(t),
        "class_b": vessel.is_class_b(t), "undefined": vessel.is_undefined(t), "special": vessel.is_special_craft(t), "towing": vessel.is_engaged_in_towing(t),
        "engaged_in_fishing": vessel.is_engaged_in_fishing(t), "unknown": vessel.is_unknown_type_or_size(t, length), "slow": vessel.is_slow(sog), "bad_speed": vessel.is_speed_invalid(sog),
        "is_long": vessel.is_long(length), "very_long": vessel.is_very_long(length), "small": vessel.is_small(length),
    }
    return rows.select("mmsi", "ts_ms", *[c.alias(k) for k, c in kinds.items()])


@query
def flt_prediction_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.position_reports(spark, sf_dir)
    last = F.when(F.col("seq") % 11 == 0, F.lit(-1)).otherwise(F.col("ts_ms") - F.col("seq") * 20_000)
    return rows.select("mmsi", "ts_ms", vessel.predicted_too_long(F.col("ts_ms"), last, 10).alias("too_old"), vessel.predicted_too_long(F.col("ts_ms"), last, -1).alias("off"))


@query
def flt_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.position_reports(spark, sf_dir)
    missing = F.col("seq") % 9 == 0
    sog = F.when(missing, F.lit(102.3).cast("float")).otherwise(F.col("sog"))
    cog = F.when(missing, F.lit(360).cast("float")).otherwise(F.col("cog"))
    hdg = F.when(F.col("seq") % 8 == 0, F.lit(None).cast("float")).when(F.col("seq") % 7 == 0, F.lit(511).cast("float")).otherwise(F.col("hdg"))
    return rows.select("mmsi", "ts_ms", vessel.sog_available(sog).alias("sog_ok"), vessel.cog_available(cog).alias("cog_ok"), vessel.heading_available(hdg).alias("hdg_ok"))


@query
def flt_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.down_sample(sample.position_reports(spark, sf_dir), 25).select("mmsi", "ts_ms")


@query
def flt_downsample_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.down_sample_buckets(sample.position_reports(spark, sf_dir), 60).select("mmsi", "ts_ms")


# --- tracks and statistics ---------------------------------------------------


@query
def cell_of_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.with_cells(sample.position_reports(spark, sf_dir))
    box = Grid().box(F.col("cell_id"))
    return rows.select("mmsi", "ts_ms", "cell_id", *[F.round(c, 6).alias(k) for k, c in box.items()])


@query
def cell_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("mmsi", "epoch", "ts_ms", "cell_id", "old_cell_id")


@query
def track_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir)
    return rows.groupBy("mmsi", "epoch").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))


@query
def asof_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.position_reports(spark, sf_dir)
    statics = rows.where("seq % 6 = 2").select("mmsi", (F.col("ts_ms") - 3000).alias("ts_ms"), "seq", *[c for c in tracks.STATIC if c not in ("callsign", "to_bow")], F.concat(F.lit("C"), F.col("seq").cast("string")).alias("callsign"), F.col("seq").cast("int").alias("to_bow"))
    found = tracks.as_of_static(rows.drop(*tracks.STATIC).select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in tracks.STATIC]), statics)
    return found.select("mmsi", "ts_ms", "callsign", "to_bow", "ship_type")


@query
def interpolated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks.interpolated(tracks.with_epochs(sample.position_reports(spark, sf_dir)), 4)
    return out.select("mmsi", "ts_ms", "interpolated", "last_ais_ms", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _histogram(statistic: str) -> Query:
    return lambda spark, sf_dir: statistics.histogram(changes(spark, sf_dir), statistic)


QUERIES["stat_type_size"] = _histogram(TYPE_SIZE)
QUERIES["stat_course"] = _histogram(COURSE)
QUERIES["stat_speed"] = _histogram(SPEED)


@query
def stat_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir)


@query
def stat_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    return statistics.merged(statistics.train(rows.where("mmsi % 2 = 0")), statistics.train(rows.where("mmsi % 2 = 1")))


@query
def stat_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.totals(stats(spark, sf_dir))


@query
def stat_sum_over_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sums_over_type(stats(spark, sf_dir))


@query
def stat_probability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.probability_table(spark, stats(spark, sf_dir), SPEED)


@query
def stat_cell_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.cell_display(stats(spark, sf_dir), show=10, strong=30)
    return rows.withColumn("mean", F.round("mean", 6)).withColumn("opacity", F.round("opacity", 6))


@query
def stat_reason_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = changes(spark, sf_dir).withColumn("sog", F.when(F.col("seq") % 7 == 0, None).when(F.col("seq") % 5 == 0, F.lit(1.0).cast("float")).otherwise(F.col("sog")))
    return statistics.reason_counters(odd.withColumn("ship_type", F.when(F.col("seq") % 11 == 0, None).otherwise(F.col("ship_type"))))


@query
def stat_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.nested(stats(spark, sf_dir))
    flat = rows.select("statistic", "cell_id", F.explode("data").alias("k1", "sizes")).select("statistic", "cell_id", "k1", F.explode("sizes").alias("k2", "thirds"))
    return flat.select("statistic", "cell_id", "k1", "k2", F.explode("thirds").alias("k3", "ship_count"))


@query
def feed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.feed_counters(reports(spark, sf_dir))


# --- statistical analyses, hysteresis, events --------------------------------


def _verdicts(statistic: str, params: Statistical) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = analyses.verdicts(changes(spark, sf_dir), stats(spark, sf_dir), statistic, params)
        return rows.select("mmsi", "ts_ms", "cell_id", F.col("total").cast("long").alias("total"), F.col("own").cast("long").alias("own"), "abnormal")

    return run


QUERIES["ana_type_size"] = _verdicts(TYPE_SIZE, LEARNED)
QUERIES["ana_course"] = _verdicts(COURSE, LEARNED)
QUERIES["ana_course_aggregated"] = _verdicts(COURSE, LEARNED_ALL)
QUERIES["ana_speed"] = _verdicts(SPEED, LEARNED)
QUERIES["ana_speed_aggregated"] = _verdicts(SPEED, LEARNED_ALL)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hysteresis.with_state(analyses.verdicts(changes(spark, sf_dir), stats(spark, sf_dir), SPEED, LEARNED))


@query
def hysteresis_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("mmsi", "epoch", "ts_ms", "abnormal", F.col("run").cast("int").alias("run"), "raised")


@query
def hysteresis_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hysteresis.transitions(states(spark, sf_dir)).select("mmsi", "epoch", "ts_ms", "transition")


@query
def event_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in hysteresis.CERTAINTY])
    return states(spark, sf_dir).select("mmsi", "epoch", "ts_ms", "certainty", F.element_at(names, F.col("certainty") + 1).alias("label"))


@query
def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.with_ids(events.intervals(states(spark, sf_dir), events.SPEED))
    return rows.select("event_id", "event_type", "mmsi", "epoch", "start_ms", "end_ms", "state", "n_points")


@query
def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.points(states(spark, sf_dir), events.SPEED).select("event_type", "mmsi", "epoch", "interval", "ts_ms", "lat", "lon", "certainty")


@query
def event_previous_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states(spark, sf_dir)
    return events.previous_points(rows, events.intervals(rows, events.SPEED), 5)


@query
def event_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.vessels(events.intervals(states(spark, sf_dir), events.SPEED))


@query
def event_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.described(events.intervals(states(spark, sf_dir), events.SPEED))
    return rows.select("mmsi", "start_ms", "title", "description")


@query
def event_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sample.event_store(spark, sf_dir)[0]
    return events.set_suppressed(stored, [3, 5, 8]).groupBy("suppressed").agg(F.count(F.lit(1)).alias("n"))


@query
def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sample.event_store(spark, sf_dir)[0]
    changed = stored.where("event_id % 4 = 0").withColumn("state", F.lit("PAST")).withColumn("event_id", F.when(F.col("event_id") % 8 == 0, F.col("event_id")).otherwise(F.col("event_id") + 1_000_000_000))
    return events.upserted(stored, changed).select("event_id", "event_type", "state")


@query
def event_involved(spark: SparkSession, sf_dir: str) -> DataFrame:
    behaviours = sample.event_store(spark, sf_dir)[1]
    return events.involved(behaviours).select("event_id", F.array_join(F.transform("mmsis", lambda m: m.cast("string")), ",").alias("mmsis"))


@query
def event_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.arbitrary_secondary(sample.event_store(spark, sf_dir)[1]).select("event_id", "mmsi", "name")


@query
def event_last_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.most_recent_points(sample.event_store(spark, sf_dir)[2]).select("event_id", "mmsi", "ts", "lat", "lon", "certainty")


@query
def event_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.extents(sample.event_store(spark, sf_dir)[2])
    return rows.select("event_id", *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")])


@query
def kml_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, behaviours, points = sample.event_store(spark, sf_dir)
    rows = events.replay_windows(stored, behaviours, events.extents(points))
    text = lambda c: F.array_join(F.transform(c, lambda m: m.cast("string")), ",").alias(c)
    return rows.select("event_id", F.col("from").alias("from_time"), F.col("to").alias("to_time"), text("primary"), text("secondary"), "too_long", "too_large")


# --- kinematics --------------------------------------------------------------


@query
def drift_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("mmsi", "ts_ms", tracks.is_drifting().alias("drifting"))


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_drift(reports(spark, sf_dir), 5, 300)


@query
def drift_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("mmsi", "ts_ms", "drift_period", "tracked_long")


@query
def drift_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("mmsi", "ts_ms", F.round("drift_metres", 3).alias("drift_metres"), "drift_far")


@query
def ana_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyses.drift(reports(spark, sf_dir), Drift(period_minutes=5, metres=30.0))
    return rows.select("mmsi", "epoch", "ts_ms", "sustained_drift", "raised", "transition")


def _drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_speed_drops(reports(spark, sf_dir))


@query
def ssc_sudden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drops(spark, sf_dir).select("mmsi", "ts_ms", "is_low", "last_high_ms", "sudden")


@query
def ssc_sustained_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drops(spark, sf_dir).select("mmsi", "ts_ms", "low_reported")


@query
def ssc_sustained_calculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drops(spark, sf_dir).select("mmsi", "ts_ms", F.round("calculated_knots", 3).alias("calculated_knots"), "low_calculated")


@query
def ana_sudden_speed_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyses.sudden_speed_changes(reports(spark, sf_dir), SuddenSpeedChange())
    return events.described_speed_changes(rows).select("mmsi", "start_ms", "end_ms", "fired_ms", "sog1", "sog2", "title", "description")


def detected(spark: SparkSession, sf_dir: str) -> event_tables.Tables:
    """The event store's tables over all six types of event."""
    rows, fleet = reports(spark, sf_dir), sample.fleet_reports(spark, sf_dir)
    statistical = {SPEED: events.SPEED, COURSE: events.COURSE, TYPE_SIZE: events.TYPE_SIZE}

    def judged() -> list[event_tables.Tables]:
        moved = scratch.written(changes(spark, sf_dir), "changes")
        learned = scratch.written(statistics.train(moved), "statistics")
        return event_tables.of_statistics(moved, learned, {statistic: (LEARNED, kind) for statistic, kind in statistical.items()})

    parts = scratch.at_once(
        judged,
        lambda: [event_tables.of_states(analyses.drift(rows, Drift(period_minutes=5, metres=30.0)), events.DRIFT)],
        lambda: [event_tables.of_speed_changes(analyses.sudden_speed_changes(rows, SuddenSpeedChange()))],
        lambda: [event_tables.of_encounters(analyses.encounter_runs(fleet, ENCOUNTER), fleet)],
    )
    return event_tables.combined([p for found in parts for p in found])


def _millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


@query
def detect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected(spark, sf_dir)
    rows = found.events.join(found.behaviours.where("is_primary"), "event_id")
    return rows.select("event_id", "event_type", "state", _millis("start_time").alias("start_ms"), _millis("end_time").alias("end_ms"), "mmsi", "ship_type", "length")


@query
def detect_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).points.select("event_id", "mmsi", _millis("ts").alias("ts_ms"), "certainty")


# --- geometry and pairs ------------------------------------------------------


def _shape(build) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sample.position_reports(spark, sf_dir)
        made = build(F.col("cog"), F.col("to_bow") + F.col("to_stern"), F.col("to_port") + F.col("to_starboard"), F.col("to_stern"), F.col("to_starboard"))
        return rows.select("mmsi", "ts_ms", *[F.round(made[c], 6).alias(c) for c in ("x", "y", "alpha", "beta", "theta")])

    return run


QUERIES["safety_zone"] = _shape(geo.safety_zone)
QUERIES["vessel_extent"] = _shape(geo.vessel_extent)


@query
def vessel_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.position_reports(spark, sf_dir)
    lat, lon = geo.vessel_centre(F.col("lat"), F.col("lon"), F.col("cog"), F.col("to_stern"), F.col("to_bow"), F.col("to_port"), F.col("to_starboard"))
    return rows.select("mmsi", "ts_ms", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query
def geo_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir)
    w = tracks.track_window()
    lat0, lon0 = F.lag("lat").over(w), F.lag("lon").over(w)
    north, east = geo.degree_lengths(F.col("lat"))
    return rows.select(
        "mmsi", "ts_ms", F.round(geo.rhumb_distance(lat0, lon0, F.col("lat"), F.col("lon")), 3).alias("rhumb"), F.round(geo.rhumb_bearing(lat0, lon0, F.col("lat"), F.col("lon")), 3).alias("bearing"),
        F.round(geo.cartesian_distance(lat0, lon0, F.col("lat"), F.col("lon")), 3).alias("plane"), F.round(geo.compass_to_cartesian(F.col("cog").cast("double")), 3).alias("from_east"),
        F.round(geo.direction_difference(F.col("cog"), F.col("hdg")), 3).alias("turn"), F.round(north, 3).alias("degree_north"), F.round(east, 3).alias("degree_east"),
    )


@query
def ellipse_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = sample.position_reports(spark, sf_dir).groupBy("mmsi").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return one.select("mmsi", F.posexplode(geo.ellipse_outline(F.col("lat"), F.col("lon"), F.lit(100.0), F.lit(40.0), 0.1, 63)).alias("k", "p")).select("mmsi", "k", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query
def nearby_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs.nearby(sample.fleet_reports(spark, sf_dir), 30_000, columns=("mmsi",), digits=3)
    return rows.select("run_ms", "a_mmsi", "b_mmsi", "a_ts_ms", "b_ts_ms", "near_metres")


@query
def nearby_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far north and on both sides of the 180th meridian."""
    return pairs.nearby(sample.polar_reports(spark, sf_dir), 30_000, columns=("mmsi",), digits=2).select("run_ms", "a_mmsi", "b_mmsi", "near_metres")


@query
def encounter_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.encounter_candidates(sample.fleet_reports(spark, sf_dir), ENCOUNTER, ("mmsi",)).select("run_ms", "a_mmsi", "b_mmsi")


@query
def ana_close_encounter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.encounter_verdicts(sample.fleet_reports(spark, sf_dir), ENCOUNTER).select("run_ms", "a_mmsi", "meets", "near")


@query
def encounter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.encounters(analyses.encounter_runs(sample.fleet_reports(spark, sf_dir), ENCOUNTER))
    zone = F.col("safety_zone")
    return rows.select("mmsi", "other", "start_ms", "end_ms", "state", "n_points", F.round(zone["lat"], 6).alias("zone_lat"), F.round(zone["lon"], 6).alias("zone_lon"), F.round(zone["heading"], 3).alias("heading"), "description")


@query
def ana_reason_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in (COURSE, SPEED):
        rows = analyses.reason_counters(changes(spark, sf_dir), name, LEARNED).select(F.lit(name).alias("statistic"), "reason", "n")
        out = rows if out is None else out.union(rows)
    return out


@query
def free_flow_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyses.free_flow(sample.fleet_reports(spark, sf_dir), FLOW, ("mmsi",))
    return rows.select("run_ms", "a_mmsi", "b_mmsi", geo.rounded(F.col("distance"), 3).alias("distance"), geo.rounded(F.col("bearing"), 3).alias("bearing"))


@query
def ana_free_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.free_flow_reports(sample.fleet_reports(spark, sf_dir), FLOW, 5 * 60_000).select("run_ms", "a_mmsi", "b_mmsi")


@query
def free_flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_files.free_flow_rows(analyses.free_flow(sample.fleet_reports(spark, sf_dir), FLOW, ("mmsi",), event_files.free_flow_texts()))
    return rows.select(F.col("TIMESTAMP (GMT)").alias("stamp"), "MMSI1", "NAME1", "TP1", "LOA1", "BM1", "LAT1", "LON1", "MMSI2", "NAME2", "LAT2", "LON2")


# --- searches ----------------------------------------------------------------


@query
def qry_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.event_types(sample.event_store(spark, sf_dir)[0])


@query
def qry_event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.event_by_id(sample.event_store(spark, sf_dir)[0], 42).select("event_id", "event_type", "state", "title")


def _search(**conditions) -> Query:
    return lambda spark, sf_dir: search.search(*sample.event_store(spark, sf_dir), **conditions).select("event_id", "event_type", "start_time", "end_time")


QUERIES["qry_search_time"] = _search(begin=SPAN[0], end=SPAN[1])
QUERIES["qry_search_type"] = _search(event_type="DriftEvent")
QUERIES["qry_search_vessel"] = _search(vessel="CS1*4")
QUERIES["qry_search_number"] = _search(vessel="219000007")
QUERIES["qry_search_area"] = _search(area=AREA)
QUERIES["qry_search_all"] = _search(begin=SPAN[0], end=SPAN[1], event_type="CloseEncounterEvent", vessel="VESSEL", area=(55.4, 11.2, 55.0, 11.0))


@query
def qry_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.events_between(sample.event_store(spark, sf_dir)[0], *SPAN).select("event_id", "start_time", "end_time")


@query
def qry_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent_events(sample.event_store(spark, sf_dir)[0], 5).select("event_id", "start_time")


@query
def qry_ongoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, behaviours, _ = sample.event_store(spark, sf_dir)
    return search.ongoing_event(stored, behaviours, 219000008, "CloseEncounterEvent").select("event_id", "start_time")


def _saved(spark: SparkSession, sf_dir: str) -> str:
    """The event table in a store by day and cell, after two runs: all events as if still open, then as they ended."""
    tables = event_tables.Tables(*sample.event_store(spark, sf_dir))
    path = scratch.scratch_path(spark, "event-store")
    early = tables.events.withColumns({"end_time": F.lit(None).cast("timestamp_ntz"), "state": F.lit("ONGOING")})
    event_store.save(event_tables.Tables(early, tables.behaviours, tables.points.where("certainty < 2")), path)
    event_store.save(tables, path, merge=True)
    return path


@query
def qry_store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store.search(spark, _saved(spark, sf_dir), begin=SPAN[0], end=SPAN[1], area=AREA).select("event_id", "event_type", "start_time", "end_time")


@query
def qry_store_ongoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store.ongoing(spark, _saved(spark, sf_dir), 219000008, "CloseEncounterEvent").select("event_id", "start_time")


@query
def qry_store_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = event_store.read(spark, _saved(spark, sf_dir))
    return stored.points.join(stored.events.where("not suppressed").select("event_id", "state"), "event_id").select("event_id", "state", "mmsi", "ts", "lat", "lon", "certainty")


@query
def qry_cells_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cells_in_area(stats(spark, sf_dir), Grid(), 55.01, 11.004, 55.002, 11.0)


@query
def qry_cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cell_ids(stats(spark, sf_dir), COURSE)


@query
def qry_cell_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cell_statistic(stats(spark, sf_dir), SPEED, 6134162149)


@query
def qry_statistic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.counts(stats(spark, sf_dir))


@query
def qry_first_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_cell(stats(spark, sf_dir), TYPE_SIZE)


@query
def qry_missing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.missing_statistics(stats(spark, sf_dir), (TYPE_SIZE, "HeadingStatistic"))


@query
def qry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and statistics of a store that is written and read back."""
    path = scratch.scratch_path(spark, "statistics")
    statistics_store.write(stats(spark, sf_dir), path, statistics_store.Metadata(Grid().resolution, 10))
    stored, meta = statistics_store.read(spark, path)
    row = spark.createDataFrame([(meta.grid_resolution, meta.downsampling, meta.format_version)], "grid_resolution double, downsampling int, format_version short")
    names = search.statistic_names(stored).agg(F.array_join(F.sort_array(F.collect_list("statistic")), ",").alias("statistics"))
    return row.join(F.broadcast(names))  # one row each


@query
def qry_types_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.types_with_counts(search.events_between(sample.event_store(spark, sf_dir)[0], *SPAN))


@query
def qry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report_lines(*sample.event_store(spark, sf_dir), *SPAN)


@query
def csv_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_files.event_rows(*sample.event_store(spark, sf_dir))


@query
def filter_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, behaviours, points = sample.event_store(spark, sf_dir)
    last = events.most_recent_points(points).join(behaviours.where("is_primary").select("event_id", "mmsi"), ["event_id", "mmsi"])
    return stored.join(last, "event_id").select("event_id", formats.filter_suggestion(F.col("start_time"), F.col("end_time"), F.col("lat"), F.col("lon")).alias("suggestion"))


@query
def date_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd/MM/yyyy")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "dd/MM/yyyy HH:mm")).otherwise(F.lit("tomorrow"))
    return rows.select("event_id", formats.parse_date(text).alias("parsed"))


@query
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.event_store(spark, sf_dir)[0].groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("n", "event_type", formats.sentence(F.col("event_type")).alias("words"))
