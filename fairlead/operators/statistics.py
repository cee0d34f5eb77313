"""Histograms of cell changes, the statistics they make and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import categories
from fairlead.functions.formats import percent
from fairlead.functions.vessel import vessel_length

TYPE_SIZE, COURSE, SPEED = "ShipTypeAndSizeStatistic", "CourseOverGroundStatistic", "SpeedOverGroundStatistic"
MIN_SOG = 2.0
#: Highest stored keys (buckets less one) of type, size, course and speed.
TOP = {"k1": 7, "k2": 4, COURSE: 11, SPEED: 7}


def with_buckets(rows: DataFrame) -> DataFrame:
    """Buckets of a report; unusable values have none."""
    length = vessel_length(F.col("to_bow"), F.col("to_stern"))
    return rows.select(
        "*",
        categories.ship_type_bucket(F.col("ship_type")).alias("type_bucket"),
        categories.length_bucket(length).alias("size_bucket"),
        categories.course_bucket(F.col("cog")).alias("course_bucket"),
        categories.speed_bucket(F.col("sog")).alias("speed_bucket"),
    )


def _third(statistic: str) -> Column:
    return F.lit(None).cast("int") if statistic == TYPE_SIZE else F.col("course_bucket" if statistic == COURSE else "speed_bucket") - 1


def counted(statistic: str) -> Column:
    """Which cell changes a statistic counts (a null speed counts for type and size only)."""
    known = F.col("cell_id").isNotNull() & F.col("type_bucket").isNotNull() & F.col("size_bucket").isNotNull()
    if statistic == TYPE_SIZE:
        return known & F.coalesce(F.col("sog") >= MIN_SOG, F.lit(True))
    if statistic == COURSE:
        return known & F.coalesce(F.col("sog") >= MIN_SOG, F.lit(False)) & F.col("course_bucket").isNotNull()
    return known & F.col("sog").isNotNull()


def histogram(changes: DataFrame, statistic: str) -> DataFrame:
    """(statistic, cell_id, k1, k2, k3, ship_count) of one statistic; keys count from 0."""
    rows = with_buckets(changes).where(counted(statistic))
    keys = [F.lit(statistic).alias("statistic"), F.col("cell_id"), (F.col("type_bucket") - 1).alias("k1"), (F.col("size_bucket") - 1).alias("k2"), _third(statistic).alias("k3")]
    return rows.select(*keys).groupBy("statistic", "cell_id", "k1", "k2", "k3").agg(F.count(F.lit(1)).alias("ship_count"))


def train(changes: DataFrame) -> DataFrame:
    """All three statistics from one pass: a row is exploded to those that count it, then counted once."""
    rows = with_buckets(changes)
    entry = lambda s: F.when(counted(s), F.struct(F.lit(s).alias("statistic"), _third(s).alias("k3")))
    rows = rows.select("cell_id", (F.col("type_bucket") - 1).alias("k1"), (F.col("size_bucket") - 1).alias("k2"), F.explode(F.array_compact(F.array(*[entry(s) for s in (TYPE_SIZE, COURSE, SPEED)]))).alias("e"))
    return rows.groupBy(F.col("e.statistic").alias("statistic"), "cell_id", "k1", "k2", F.col("e.k3").alias("k3")).agg(F.count(F.lit(1)).alias("ship_count"))


def merged(*tables: DataFrame) -> DataFrame:
    """Statistics trained apart, added up."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out.groupBy("statistic", "cell_id", "k1", "k2", "k3").agg(F.sum("ship_count").alias("ship_count"))


def totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("statistic", "cell_id").agg(F.sum("ship_count").alias("total"))


def sums_over_type(stats: DataFrame) -> DataFrame:
    """Sums over the ship types below the last one, which this sum leaves out though totals have it."""
    kept = F.when(F.col("k1") < TOP["k1"], F.col("ship_count")).otherwise(0)
    return stats.where("k3 is not null").groupBy("statistic", "cell_id", "k2", "k3").agg(F.sum(kept).alias("ship_count"))


def by_cell(stats: DataFrame) -> DataFrame:
    """One row for each cell of one statistic: its total and a map from packed keys to counts (480 at most)."""
    key = (F.col("k1") * 5 + F.col("k2")) * 12 + F.coalesce("k3", F.lit(0))
    return stats.groupBy("cell_id").agg(F.sum("ship_count").alias("total"), F.map_from_entries(F.collect_list(F.struct(key, F.col("ship_count")))).alias("counts"))


def nested(stats: DataFrame) -> DataFrame:
    """Maps type -> size -> third bucket -> count for each cell; buckets count from 1, a statistic without third has bucket 0."""

    def as_map(key: Column, value: Column) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("key"), value.alias("value")))))

    def keyed(key: Column, value: Column) -> Column:
        by_key = lambda a, b: a["key"] - b["key"]  # noqa: E731  maps have no order of their own
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), value.alias("value"))), by_key))

    thirds = stats.groupBy("statistic", "cell_id", "k1", "k2").agg(as_map(F.coalesce(F.col("k3") + 1, F.lit(0)), F.col("ship_count")).alias("v"))
    sizes = thirds.groupBy("statistic", "cell_id", "k1").agg(keyed(F.col("k2") + 1, F.col("v")).alias("v"))
    return sizes.groupBy("statistic", "cell_id").agg(keyed(F.col("k1") + 1, F.col("v")).alias("data"))


def probability_table(spark: SparkSession, stats: DataFrame, statistic: str) -> DataFrame:
    """Every combination of buckets in every cell of a statistic: count and percent, null where there is none."""
    stats = stats.where(F.col("statistic") == statistic)
    k1 = spark.range(TOP["k1"] + 1).select(F.col("id").cast("int").alias("k1"))
    k2 = spark.range(TOP["k2"] + 1).select(F.col("id").cast("int").alias("k2"))
    third = spark.range(TOP[statistic] + 1).select(F.col("id").cast("int").alias("k3")) if statistic in TOP else spark.range(1).select(F.lit(None).cast("int").alias("k3"))
    buckets = F.broadcast(k1.join(k2).join(third))  # 480 rows at most
    cells = totals(stats).join(buckets)
    same = (cells["cell_id"] == stats["cell_id"]) & (cells["k1"] == stats["k1"]) & (cells["k2"] == stats["k2"]) & cells["k3"].eqNullSafe(stats["k3"])
    rows = cells.join(stats, same, "left")
    return rows.select(cells["cell_id"], cells["k1"], cells["k2"], cells["k3"], "ship_count", percent(F.col("ship_count"), F.col("total")).alias("percent"))


def cell_display(stats: DataFrame, show: int = 1000, strong: int = 5000) -> DataFrame:
    """How a cell is drawn: totals, their mean, stroke class and opacity; cells below ``show`` in all are hidden."""
    wide = totals(stats).groupBy("cell_id").pivot("statistic", [TYPE_SIZE, COURSE, SPEED]).agg(F.first("total"))
    a, b, c = (F.coalesce(F.col(s), F.lit(0)) for s in (TYPE_SIZE, COURSE, SPEED))
    mean = (a + b + c) / 3.0
    rows = wide.select("cell_id", a.alias("type_size"), b.alias("course"), c.alias("speed"), mean.alias("mean"))
    most = F.greatest("type_size", "course", "speed")
    stroke = F.when(most >= strong, 2).when(most >= show, 1).otherwise(0)
    return rows.where(most >= show).select("*", stroke.alias("stroke"), (0.05 + F.least(F.col("mean") / 500.0, F.lit(1.0)) * 0.5).alias("opacity"))


def reason_counters(changes: DataFrame) -> DataFrame:
    """For each statistic, how many cell changes it counted and why it left out the others (first reason)."""
    rows = with_buckets(changes)
    slow = F.coalesce(F.col("sog") < MIN_SOG, F.lit(False))

    def reason(statistic: str) -> Column:
        out = F.when(slow, "slow") if statistic != SPEED else F.when(F.lit(False), "slow")
        if statistic != TYPE_SIZE:
            out = out.when(F.col("sog").isNull(), "unknown speed")
        out = out.when(F.col("cell_id").isNull(), "unknown cell").when(F.col("type_bucket").isNull(), "unknown type").when(F.col("size_bucket").isNull(), "unknown length")
        return (out.when(F.col("course_bucket").isNull(), "unknown course") if statistic == COURSE else out).otherwise("counted")

    each = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), reason(s).alias("reason")) for s in (TYPE_SIZE, COURSE, SPEED)]))
    return rows.select(each.alias("e")).groupBy(F.col("e.statistic").alias("statistic"), F.col("e.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def feed_counters(reports: DataFrame) -> DataFrame:
    """Messages, vessels, cells and messages a second of a feed."""
    span = F.max("ts_ms") - F.min("ts_ms")
    rows = reports.agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("mmsi").alias("vessels"), F.count_distinct("cell_id").alias("cells"), span.alias("span"))
    return rows.select("messages", "vessels", "cells", F.round(F.when(F.col("span") > 0, F.col("messages") * 1000.0 / F.col("span")), 6).alias("rate"))
