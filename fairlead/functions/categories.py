"""Category buckets of ship type, length, course and speed, their labels and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bucket labels, in bucket order from 1.
LABELS = {
    "type": ("tanker", "cargo", "passenger", "support", "fishing", "class b", "other", "undef"),
    "size": ("undef", "1-50m", "50-100m", "100-200m", "200-999m"),
    "course": ("000-030", "030-060", "060-090", "090-120", "120-150", "150-180", "180-210", "210-240", "240-270", "270-300", "300-330", "330-360"),
    "speed": ("0-1kts", "1-5kts", "5-10kts", "10-15kts", "15-20kts", "20-30kts", "30-50kts", "50-100kts"),
}


def ship_type_bucket(ship_type: Column) -> Column:
    """1..8; null stays null, all that no range names is 8."""
    t = ship_type
    return (
        F.when(t.isNull(), None)
        .when(t.between(80, 89), 1)
        .when(t.between(70, 79), 2)
        .when(t.between(40, 49) | t.between(60, 69), 3)
        .when(t.between(31, 35) | t.between(50, 55), 4)
        .when(t == 30, 5)
        .when(t.between(36, 37), 6)
        .when(t.between(1, 29) | t.between(90, 99), 7)
        .otherwise(8)
        .cast("int")
    )


def length_bucket(length: Column) -> Column:
    """1..5; lengths below 0 or from 999 have no bucket (null, counted as unusable)."""
    n = length
    return F.when(n < 0, None).when(n < 1, 1).when(n < 50, 2).when(n < 100, 3).when(n < 200, 4).when(n < 999, 5).cast("int")


def course_bucket(cog: Column) -> Column:
    """1..12 in 32-bit arithmetic; a negative course truncates towards 0, 360 is 1."""
    share = ((cog.cast("float") % F.lit(360).cast("float")).cast("float") / F.lit(30).cast("float")).cast("float")
    return (share.cast("int") + 1).cast("int")


def speed_bucket(sog: Column) -> Column:
    """1..8; negative speeds and NaN fall to 8."""
    s = sog.cast("float")
    known = F.when(s.isNull(), None)
    bad = F.isnan(s) | (s < 0)
    return known.when(bad, 8).when(s < 1, 1).when(s < 5, 2).when(s < 10, 3).when(s < 15, 4).when(s < 20, 5).when(s < 30, 6).when(s < 50, 7).otherwise(8).cast("int")


def label(kind: str, bucket: Column) -> Column:
    """The bucket's label, or the number as text where there is none."""
    names = F.array(*[F.lit(x) for x in LABELS[kind]])
    inside = bucket.between(1, len(LABELS[kind]))
    return F.when(inside, F.try_element_at(names, bucket.cast("int"))).otherwise(bucket.cast("string"))


def dictionary(spark: SparkSession, kind: str) -> DataFrame:
    rows = list(enumerate(LABELS[kind], 1))
    return spark.createDataFrame(rows, "bucket int, label string")
