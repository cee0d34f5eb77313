"""Position reports and an event store derived from the driver's ``events`` table, with integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Ship types by user_id % 12, and event types by event_id % 6.
SHIP_TYPES = (80, 70, 60, 70, 30, 84, 36, 52, 79, 90, 0, 31)
EVENT_TYPES = ("CloseEncounterEvent", "CourseOverGroundEvent", "DriftEvent", "ShipSizeOrTypeEvent", "SpeedOverGroundEvent", "SuddenSpeedChangeEvent")
BASE_MMSI = 219_000_000
BASE_MS = 1_704_067_200_000
STEP_MS = 10_000
#: One vessel in seven is silent for an hour after its 30th report.
SILENCE_MS = 3_600_000


def _mod(name: str, k: int) -> Column:
    return F.col(name) % k


def _reports(spark: SparkSession, sf_dir: str, lat_e6: Column, lon_e6: Column) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.withColumn("n", n).withColumn("p", _mod("user_id", 7))
    p, u = F.col("p"), F.col("user_id")
    sog = F.when(p == 4, 30).when((p == 5) & (F.col("n") >= 20), 2).when(p == 5, 120).when((p == 6) & (_mod("n", 13) < 8), 350).otherwise(100 + _mod("event_id", 30))
    cog = F.when(p == 4, 900).when((p == 3) & (_mod("n", 17) < 7), 1800).otherwise(_mod("event_id", 250))
    kinds = F.array(*[F.lit(t) for t in SHIP_TYPES])
    return rows.select(
        (BASE_MMSI + u).cast("int").alias("mmsi"),
        (F.lit(BASE_MS) + STEP_MS * F.col("n").cast("long") + F.when((p == 2) & (F.col("n") > 30), SILENCE_MS).otherwise(0)).alias("ts_ms"),
        F.col("n").alias("seq"),
        F.concat(F.lit("VESSEL "), u.cast("string"), F.lit("@@")).alias("name"),
        F.concat(F.lit("CS"), u.cast("string")).alias("callsign"),
        (9_000_000 + u).cast("int").alias("imo"),
        F.element_at(kinds, (u % 12 + 1).cast("int")).alias("ship_type"),
        (5 + u * 37 % 150).cast("int").alias("to_bow"),
        (5 + u * 53 % 120).cast("int").alias("to_stern"),
        (2 + u * 7 % 15).cast("int").alias("to_port"),
        (2 + u * 11 % 15).cast("int").alias("to_starboard"),
        (lat_e6 / 1_000_000.0).cast("double").alias("lat"),
        (lon_e6 / 1_000_000.0).cast("double").alias("lon"),
        (sog / 10.0).cast("float").alias("sog"),
        (cog / 10.0).cast("float").alias("cog"),
        F.when(p == 4, 0).otherwise(5).cast("float").alias("hdg"),
    )


def position_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessels on a few common tracks: many reports in each grid cell."""
    p, n, u = F.col("p"), F.col("n"), F.col("user_id")
    lat = F.when(p == 4, 55_000_000 + 2000 * (u % 10)).when(p == 5, 55_000_000 + 2000 * (u % 10) + 500 * F.least(n, F.lit(20))).otherwise(55_000_000 + 2000 * (u % 10) + 500 * n)
    lon = F.when(p == 4, 11_000_000 + 150 * n).otherwise(11_000_000 + 2000 * (u % 4))
    return _reports(spark, sf_dir, lat, lon)


def fleet_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vessels spread over the sea, a few of them near each other."""
    n, u = F.col("n"), F.col("user_id")
    lat = 55_000_000 + 25_000 * (u % 12) + 900 * (u % 5) + 150 * n
    lon = 10_700_000 + 40_000 * (u * 7 % 9) + 700 * (u % 3)
    return _reports(spark, sf_dir, lat, lon)


def polar_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vessels at 80 degrees north, on both sides of the 180th meridian."""
    n, u = F.col("n"), F.col("user_id")
    lat = 80_000_000 + 2500 * (u % 12) + 900 * (u % 5) + 150 * n
    lon = (179_900_000 + 40_000 * (u * 7 % 9) + 7000 * (u % 3) + 180_000_000) % 360_000_000 - 180_000_000
    return _reports(spark, sf_dir, lat, lon)


def event_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, behaviours, tracking points): one event for each row of the table."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (e % 6 + 1).cast("int"))
    end = F.when(e % 5 == 0, None).otherwise(F.col("ts") + F.make_dt_interval(mins=(e % 120).cast("int")))
    events = rows.select(
        "event_id",
        kind.alias("event_type"),
        F.when(end.isNull(), "ONGOING").otherwise("PAST").alias("state"),
        F.col("ts").alias("start_time"),
        end.alias("end_time"),
        (e % 17 == 0).alias("suppressed"),
        F.concat(F.lit("Event "), e.cast("string")).alias("title"),
        F.concat(F.lit("Event of user "), u.cast("string")).alias("description"),
    )
    second = F.when(e % 6 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    parts = rows.select("event_id", "ts", "user_id", F.explode(second).alias("is_primary")).withColumn("v", u + F.when(F.col("is_primary"), 0).otherwise(1))
    v = F.col("v")
    behaviours = parts.select(
        "event_id",
        (BASE_MMSI + v).cast("int").alias("mmsi"),
        "is_primary",
        (9_000_000 + v).cast("int").alias("imo"),
        F.concat(F.lit("VESSEL "), v.cast("string")).alias("name"),
        F.concat(F.lit("CS"), v.cast("string")).alias("callsign"),
        F.element_at(F.array(*[F.lit(t) for t in SHIP_TYPES]), (v % 12 + 1).cast("int")).alias("ship_type"),
        (10 + v * 37 % 250).cast("int").alias("length"),
    )
    k = F.col("k")
    points = parts.select("event_id", "ts", "v", F.explode(F.sequence(F.lit(0), (e % 3).cast("int"))).alias("k")).select(
        "event_id",
        (BASE_MMSI + v).cast("int").alias("mmsi"),
        (F.col("ts") + F.make_dt_interval(mins=k)).alias("ts"),
        ((55_000_000 + 1000 * (e % 500) + 100 * k) / 1_000_000.0).cast("double").alias("lat"),
        ((11_000_000 + 1000 * (v % 300) + 100 * k) / 1_000_000.0).cast("double").alias("lon"),
        ((100 + e % 30) / 10.0).cast("float").alias("sog"),
        (e % 360).cast("float").alias("cog"),
        (e % 360).cast("float").alias("hdg"),
        F.lit(False).alias("interpolated"),
        ((e + k) % 4).cast("int").alias("certainty"),
    )
    return events, behaviours, points
