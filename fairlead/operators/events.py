"""Events from raised intervals: the event rows, their vessels and tracking points, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions import formats, vessel
from fairlead.functions.categories import label

# Event types of the analyses.
COURSE, SPEED, TYPE_SIZE = "CourseOverGroundEvent", "SpeedOverGroundEvent", "ShipSizeOrTypeEvent"
DRIFT, SPEED_CHANGE, ENCOUNTER = "DriftEvent", "SuddenSpeedChangeEvent", "CloseEncounterEvent"


def numbered(states: DataFrame) -> DataFrame:
    """Rows with the number of their raised interval; the lowering row belongs to the interval it ends."""
    w = Window.partitionBy("mmsi", "epoch").orderBy("ts_ms", "seq")
    return states.withColumn("interval", F.sum(F.when(F.col("transition") == "RAISE", 1).otherwise(0)).over(w))


def intervals(states: DataFrame, event_type: str) -> DataFrame:
    """One row for each raised interval: start, end (null while it lasts), state and the report that raised it.

    A later epoch of the vessel ends what its earlier ones left open, at their last report.
    """
    rows = numbered(states)
    first = F.struct(*[c for c in rows.columns if c not in ("mmsi", "epoch", "interval")])
    spans = rows.where("interval > 0 and (raised or transition = 'LOWER')").groupBy("mmsi", "epoch", "interval").agg(
        F.min(F.when(F.col("transition") == "RAISE", F.col("ts_ms"))).alias("start_ms"),
        F.min(F.when(F.col("transition") == "LOWER", F.col("ts_ms"))).alias("lowered_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.count_if("raised").alias("n_points"),
        F.min_by(F.when(F.col("transition") == "RAISE", first), F.struct((F.col("transition") != "RAISE").alias("x"), "ts_ms", "seq")).alias("at"),
    )
    newest = Window.partitionBy("mmsi")
    spans = spans.withColumn("_over", F.col("epoch") < F.max("epoch").over(newest))
    end = F.coalesce("lowered_ms", F.when(F.col("_over"), F.col("last_ms")))
    out = spans.withColumn("end_ms", end)
    return out.select(
        F.lit(event_type).alias("event_type"), "mmsi", "epoch", "interval", "start_ms", "end_ms",
        F.when(F.col("end_ms").isNull(), "ONGOING").otherwise("PAST").alias("state"), "n_points", "at",
    )


def event_id(event_type: Column, mmsi: Column, start_ms: Column) -> Column:
    """The number that an event keeps in every run: 63 bits of a digest of its type, primary vessel and start."""
    key = F.concat_ws(":", event_type, mmsi.cast("string"), start_ms.cast("string"))
    high = F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    return (high % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def with_ids(events: DataFrame) -> DataFrame:
    """event_id by content: no ranking, and the same event has the same id whatever else a run finds."""
    return events.select(event_id(F.col("event_type"), F.col("mmsi"), F.col("start_ms")).alias("event_id"), *events.columns)


def collisions(events: DataFrame) -> DataFrame:
    """Ids that stand for more than one event; none is to be expected below some hundred million events."""
    kinds = events.groupBy("event_id").agg(F.count_distinct("event_type", "start_time").alias("n"), F.count(F.lit(1)).alias("rows"))
    return kinds.where("n > 1").select("event_id", "n")


def points(states: DataFrame, event_type: str) -> DataFrame:
    """Tracking points of every interval, the row that raised it to the last raised one, with their certainty."""
    rows = numbered(states).where("interval > 0 and raised")
    return rows.select(F.lit(event_type).alias("event_type"), "mmsi", "epoch", "interval", "ts_ms", "lat", "lon", "sog", "cog", "hdg", "certainty")


def previous_points(reports: DataFrame, events: DataFrame, history_minutes: int = 30, decided_only: bool = True) -> DataFrame:
    """Reports of an event's vessel in the history before its start; undecided ones only if asked for."""
    seen = reports.where("certainty > 0") if decided_only and "certainty" in reports.columns else reports
    keys = events.select("event_type", "mmsi", "interval", "epoch", "start_ms")
    span = (F.col("ts_ms") < F.col("start_ms")) & (F.col("ts_ms") >= F.col("start_ms") - history_minutes * 60_000)
    return seen.join(keys, ["mmsi", "epoch"]).where(span).select("event_type", "mmsi", "epoch", "interval", "ts_ms", "lat", "lon")


def vessels(events: DataFrame) -> DataFrame:
    """The primary behaviour's vessel of each event."""
    at = lambda c: F.col("at")[c]
    return events.select(
        "event_type", "mmsi", "interval", "epoch", F.lit(True).alias("is_primary"), vessel.name_or_mmsi(at("name"), F.col("mmsi")).alias("name"), at("callsign").alias("callsign"),
        at("imo").alias("imo"), at("ship_type").alias("ship_type"), (at("to_bow") + at("to_stern")).alias("length"),
    )


def described(events: DataFrame) -> DataFrame:
    """Title and description of the statistical and drift events."""
    at = lambda c: F.col("at")[c]
    name = vessel.name_or_mmsi(at("name"), F.col("mmsi"))
    when = formats.stamp(formats.from_millis(F.col("start_ms")))
    place = formats.position(at("lat"), at("lon"))
    has = {f.name for f in events.schema["at"].dataType.fields}
    bucket = lambda c: at(c) if c in has else F.lit(None).cast("int")
    kind = label("type", bucket("type_bucket"))
    head = lambda what: F.concat(F.lit(f"{what} of "), name, F.lit(" ("), kind, F.lit(") on position "), place, F.lit(" at "), when, F.lit(": "))
    moving = F.concat(
        F.lit("cog:"), formats.fixed(at("cog"), 0), F.lit("("), label("course", bucket("course_bucket")), F.lit(") sog:"), formats.fixed(at("sog"), 1), F.lit("("), label("speed", bucket("speed_bucket")),
        F.lit(") type:"), at("ship_type").cast("string"), F.lit("("), kind, F.lit(") size:"), (at("to_bow") + at("to_stern")).cast("string"), F.lit("("), label("size", bucket("size_bucket")), F.lit(")."),
    )
    still = F.concat(F.lit("type:"), at("ship_type").cast("string"), F.lit("("), kind, F.lit(") size:"), (at("to_bow") + at("to_stern")).cast("string"), F.lit("("), label("size", bucket("size_bucket")), F.lit(")."))
    e = F.col("event_type")
    titles = {COURSE: "Abnormal course over ground", SPEED: "Abnormal speed over ground", TYPE_SIZE: "Abnormal type and size of ship", DRIFT: "Drift"}
    title = F.lit(None).cast("string")
    for k, t in titles.items():
        title = F.when(e == k, t).otherwise(title)
    text = F.when(e == COURSE, F.concat(head(titles[COURSE]), moving)).when(e == SPEED, F.concat(head(titles[SPEED]), moving)).when(e == TYPE_SIZE, F.concat(head(titles[TYPE_SIZE]), still))
    text = text.when(e == DRIFT, F.concat(name, F.lit(" is drifting on position "), place, F.lit(" at "), when))
    return events.withColumn("title", title).withColumn("description", text)


def described_speed_changes(events: DataFrame) -> DataFrame:
    """Title and description of rows of ``sudden_speed_changes``."""
    from fairlead.functions.categories import ship_type_bucket

    kind = F.coalesce(formats.capitalized(label("type", ship_type_bucket(F.col("ship_type")))), F.lit("unknown type"))
    seconds = formats.fixed((F.col("end_ms") - F.col("start_ms")) / 1000.0, 1)
    text = F.concat(
        F.lit("Sudden speed change of "), vessel.name_or_mmsi(F.col("name"), F.col("mmsi")), F.lit(" ("), kind, F.lit(") on position "), formats.position(F.col("lat"), F.col("lon")), F.lit(" at "),
        formats.stamp(formats.from_millis(F.col("start_ms"))), F.lit(": From "), formats.fixed(F.col("sog1"), 1), F.lit(" kts to "), formats.fixed(F.col("sog2"), 1), F.lit(" kts in "), seconds, F.lit(" secs."),
    )
    return events.withColumn("title", F.lit("Sudden speed change")).withColumn("description", text)


def encounter_states(runs: DataFrame) -> DataFrame:
    """Runs as rows with verdicts, one for each vessel and run."""
    return runs.select("mmsi", F.lit(0).alias("epoch"), F.col("run_ms").alias("ts_ms"), F.lit(0).alias("seq"), "abnormal", "with")


def encounters_of(states: DataFrame) -> DataFrame:
    """Close encounters from rows with their state; ``pair`` is what raised them."""
    from fairlead.functions.categories import ship_type_bucket

    found = intervals(states, ENCOUNTER)
    pair = F.col("at.with")
    kind = lambda c, unknown: F.coalesce(label("type", ship_type_bucket(c)), F.lit(unknown))
    text = F.concat(
        F.lit("Close encounter between "), vessel.name_or_mmsi(pair["a_name"], F.col("mmsi")), F.lit(" ("), kind(pair["a_ship_type"], "unknown type"), F.lit(") and "), vessel.name_or_mmsi(pair["b_name"], pair["b_mmsi"]),
        F.lit(" ("), kind(pair["b_ship_type"], "?"), F.lit(") on "), formats.stamp(formats.from_millis(pair["a_ts_ms"])), F.lit("."),
    )
    return found.select(
        "event_type", "mmsi", "epoch", "interval", pair["b_mmsi"].alias("other"), "start_ms", "end_ms", "state", "n_points", pair["zone"].alias("safety_zone"), pair["extent"].alias("secondary_extent"),
        F.lit("Close encounter").alias("title"), text.alias("description"), pair.alias("pair"),
    )


def encounters(runs: DataFrame) -> DataFrame:
    """Close encounters from runs: raised by the first run that meets, lowered by the first later one that does not."""
    from fairlead.operators.hysteresis import with_state

    return encounters_of(with_state(encounter_states(runs), 1, 1)).drop("epoch", "interval", "pair")


def set_suppressed(events: DataFrame, ids: list[int], suppressed: bool = True) -> DataFrame:
    return events.withColumn("suppressed", F.when(F.col("event_id").isin(ids), suppressed).otherwise(F.col("suppressed")))


def upserted(stored: DataFrame, changed: DataFrame, key: str = "event_id") -> DataFrame:
    """Stored rows replaced by changed ones of the same key, and new ones added."""
    return stored.join(changed.select(key), key, "left_anti").select(*stored.columns).unionByName(changed.select(*stored.columns))


def involved(behaviours: DataFrame) -> DataFrame:
    """Sorted distinct vessels of each event."""
    return behaviours.groupBy("event_id").agg(F.sort_array(F.collect_set("mmsi")).alias("mmsis"))


def arbitrary_secondary(behaviours: DataFrame) -> DataFrame:
    """One non-primary vessel of each event that has any: the smallest mmsi."""
    return behaviours.where("not is_primary").groupBy("event_id").agg(F.min_by(F.struct(*behaviours.columns), "mmsi").alias("b")).select("b.*")


def most_recent_points(points_: DataFrame) -> DataFrame:
    """Each behaviour's last point; points of equal time count once (the least certain one first)."""
    return points_.groupBy("event_id", "mmsi").agg(F.max_by(F.struct(*[c for c in points_.columns if c not in ("event_id", "mmsi")]), F.struct("ts", (-F.col("certainty")).alias("c"))).alias("p")).select("event_id", "mmsi", "p.*")


def extents(points_: DataFrame, metres: float = 1000.0) -> DataFrame:
    """Box around each event's raised and uncertain points, ``metres`` wider to the north-west and south-east."""
    from fairlead.functions import geo

    box = points_.where("certainty in (2, 3)").groupBy("event_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    step = F.lit(metres * 0.7071067811865476)
    return box.select(
        "event_id",
        geo.local_lat(-step, F.col("s")).alias("south"),
        geo.local_lat(step, F.col("n")).alias("north"),
        geo.local_lon(-step, F.col("n"), F.col("w")).alias("west"),
        geo.local_lon(step, F.col("s"), F.col("e")).alias("east"),
    )


def replay_windows(events: DataFrame, behaviours: DataFrame, boxes: DataFrame) -> DataFrame:
    """Replay span (15 minutes before to 10 after, 20 after the start if it has no end), vessels and size warnings."""
    first = F.col("start_time") - F.expr("INTERVAL 15 MINUTES")
    last = F.coalesce(F.col("end_time") + F.expr("INTERVAL 10 MINUTES"), F.col("start_time") + F.expr("INTERVAL 20 MINUTES"))
    sides = behaviours.groupBy("event_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("is_primary"), F.col("mmsi")))).alias("primary"), F.sort_array(F.collect_set(F.when(~F.col("is_primary"), F.col("mmsi")))).alias("secondary")
    )
    rows = events.select("event_id", "event_type", first.alias("from"), last.alias("to")).join(sides, "event_id").join(boxes, "event_id", "left")
    minutes = (F.unix_micros(F.col("to").cast("timestamp")) - F.unix_micros(F.col("from").cast("timestamp"))) / 60e6
    from fairlead.functions import geo

    area = (F.col("north") - F.col("south")) * geo.METRES * (F.col("east") - F.col("west")) * geo.METRES * F.cos(F.radians("south")) / 1e6
    secondary = F.when(F.col("event_type") == ENCOUNTER, F.col("secondary")).otherwise(F.array().cast("array<int>"))
    return rows.select("event_id", "from", "to", "primary", secondary.alias("secondary"), (minutes > 360).alias("too_long"), F.coalesce(area > 2500, F.lit(False)).alias("too_large"))
