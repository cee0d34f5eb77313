"""Names, availability and vessel predicates; every predicate is false (never null) where it cannot be decided."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.functions.categories import ship_type_bucket


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def trim_name(name: Column) -> Column:
    """``@`` is a blank; blanks and control characters go from both ends; null is empty."""
    return F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), "@", " "), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def name_or_mmsi(name: Column, mmsi: Column) -> Column:
    clean = trim_name(name)
    return F.when(clean == "", F.concat(F.lit("MMSI "), mmsi.cast("string"))).otherwise(clean)


def name_and_mmsi(name: Column, mmsi: Column) -> Column:
    clean = trim_name(name)
    return F.when(clean == "", F.concat(F.lit("MMSI "), mmsi.cast("string"))).otherwise(F.concat(clean, F.lit(" ("), mmsi.cast("string"), F.lit(")")))


def sog_available(sog: Column) -> Column:
    return _sure(sog < F.lit(102.3).cast("float"))


def cog_available(cog: Column) -> Column:
    return _sure(cog < 360)


def heading_available(hdg: Column) -> Column:
    return _sure(hdg < 360)


def vessel_length(to_bow: Column, to_stern: Column) -> Column:
    return to_bow + to_stern


def is_category(ship_type: Column, bucket: int) -> Column:
    return _sure(ship_type_bucket(ship_type) == bucket)


def is_tanker(t: Column) -> Column:
    return is_category(t, 1)


def is_cargo(t: Column) -> Column:
    return is_category(t, 2)


def is_tanker_or_cargo(t: Column) -> Column:
    """As both together, with half the code."""
    return _sure(ship_type_bucket(t).isin(1, 2))


def is_passenger(t: Column) -> Column:
    return is_category(t, 3)


def is_support(t: Column) -> Column:
    return is_category(t, 4)


def is_fishing(t: Column) -> Column:
    return is_category(t, 5)


def is_class_b(t: Column) -> Column:
    return is_category(t, 6)


def is_undefined(t: Column) -> Column:
    return is_category(t, 8)


def is_special_craft(t: Column) -> Column:
    return _sure(t.between(50, 55))


def is_engaged_in_towing(t: Column) -> Column:
    return _sure(t.isin(31, 32))


def is_engaged_in_fishing(t: Column) -> Column:
    return _sure(t == 30)


def is_unknown_type_or_size(t: Column, length: Column) -> Column:
    return t.isNull() | length.isNull()


def is_slow(sog: Column) -> Column:
    return _sure(sog < 3.0)


def is_speed_invalid(sog: Column) -> Column:
    return _sure(sog > 102)


def is_long(length: Column) -> Column:
    return _sure(length >= 30)


def is_very_long(length: Column) -> Column:
    return _sure(length >= 75)


def is_small(length: Column) -> Column:
    return _sure(length < 30)


def predicted_too_long(ts_ms: Column, last_ais_ms: Column, minutes: int) -> Column:
    """Off at -1; else the last real report is missing (-1) or older than ``minutes``."""
    if minutes == -1:
        return F.lit(False)
    return _sure((last_ais_ms == -1) | (ts_ms - last_ais_ms > minutes * 60_000))
