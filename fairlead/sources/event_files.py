"""Event sinks: past events as CSV rows and free-flow pairs as CSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import formats
from fairlead.functions.vessel import trim_name
from fairlead.operators.events import arbitrary_secondary, involved, most_recent_points

# The columns of the two files.
EVENT_COLUMNS = (
    "eventId", "eventType", "startTime", "endTime", "title", "description", "mmsis",
    "pMmsi", "pName", "pCallsign", "pType", "pLength", "pLat", "pLon", "pSog", "pCog", "pHdg",
    "sMmsi", "sName", "sCallsign", "sType", "sLength", "sLat", "sLon", "sSog", "sCog", "sHdg",
    "filterSuggest",
)
FREE_FLOW_COLUMNS = (
    "TIMESTAMP (GMT)", "MMSI1", "NAME1", "TP1", "LOA1", "BM1", "COG1", "HDG1", "SOG1", "LAT1", "LON1",
    "MMSI2", "NAME2", "TP2", "LOA2", "BM2", "COG2", "HDG2", "SOG2", "LAT2", "LON2", "BRG", "DST",
)


def local_time(ts: Column) -> Column:
    """ISO time without what is zero at its end: seconds, then fractions in groups of three digits."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"000$", ""), r"\.(000)?$", ""), r"^(.{16}):00$", "$1")


def event_rows(events: DataFrame, behaviours: DataFrame, points: DataFrame) -> DataFrame:
    """One row for each past event, all columns as text; the second vessel's are null where there is none."""
    last = most_recent_points(points)

    def side(rows: DataFrame, p: str) -> DataFrame:
        found = rows.join(last, ["event_id", "mmsi"])
        return found.select(
            "event_id", F.col("mmsi").cast("string").alias(f"{p}Mmsi"), F.col("name").alias(f"{p}Name"), F.col("callsign").alias(f"{p}Callsign"), F.col("ship_type").cast("string").alias(f"{p}Type"),
            F.col("length").cast("string").alias(f"{p}Length"), formats.fixed(F.col("lat"), 4).alias(f"{p}Lat"), formats.fixed(F.col("lon"), 4).alias(f"{p}Lon"),
            formats.fixed(F.col("sog"), 1).alias(f"{p}Sog"), formats.fixed(F.col("cog"), 0).alias(f"{p}Cog"), formats.fixed(F.col("hdg"), 0).alias(f"{p}Hdg"),
            F.col("lat").alias(f"_{p}lat"), F.col("lon").alias(f"_{p}lon"),
        )

    rows = events.where("state = 'PAST'").join(involved(behaviours), "event_id").join(side(behaviours.where("is_primary"), "p"), "event_id").join(side(arbitrary_secondary(behaviours), "s"), "event_id", "left")
    return rows.select(
        F.col("event_id").cast("string").alias("eventId"), F.col("event_type").alias("eventType"), local_time(F.col("start_time")).alias("startTime"), local_time(F.col("end_time")).alias("endTime"), "title", "description",
        F.concat(F.lit("["), F.array_join(F.transform("mmsis", lambda m: m.cast("string")), ", "), F.lit("]")).alias("mmsis"),
        *EVENT_COLUMNS[7:27],
        formats.filter_suggestion(F.col("start_time"), F.col("end_time"), F.col("_plat"), F.col("_plon")).alias("filterSuggest"),
    )


def free_flow_texts(s: str = "", lat: str = "_lat", lon: str = "_lon") -> dict[str, Column]:
    """What the free-flow file says of one vessel alone: columns are prefixed ``s``, its centre is ``lat``, ``lon``."""
    c = lambda x: F.col(f"{s}{x}")
    whole = lambda x: x.cast("string")
    return {
        "text_mmsi": whole(c("mmsi")), "text_name": F.translate(trim_name(c("name")), ",", " "), "text_tp": whole(c("ship_type")), "text_loa": whole(c("to_bow") + c("to_stern")),
        "text_bm": whole(c("to_port") + c("to_starboard")), "text_cog": formats.fixed(c("cog"), 0), "text_hdg": formats.fixed(c("hdg"), 0), "text_sog": formats.fixed(c("sog"), 0),
        "text_lat": formats.fixed(F.col(lat), 4), "text_lon": formats.fixed(F.col(lon), 4), "text_stamp": F.date_format(formats.from_millis(c("ts_ms")), "yyyy-MM-dd HH:mm:ss"),
    }


def free_flow_rows(pairs: DataFrame) -> DataFrame:
    """Rows of the free-flow file, all columns as text; texts that the pairs have already are taken as they are."""

    def side(s: str, n: int) -> list[Column]:
        texts = free_flow_texts(f"{s}_", f"c{s}_lat", f"c{s}_lon")
        texts = {t: F.col(f"{s}_{t}") if f"{s}_{t}" in pairs.columns else made for t, made in texts.items()}
        stamp = texts.pop("text_stamp").alias("TIMESTAMP (GMT)")
        return [*([stamp] if n == 1 else []), *[made.alias(f"{t.removeprefix('text_').upper()}{n}") for t, made in texts.items()]]

    tail = [F.floor("bearing").cast("string").alias("BRG"), F.floor("distance").cast("string").alias("DST")]
    return pairs.select(*side("a", 1), *side("b", 2), *tail)


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Quoted where needed, quotes doubled."""
    rows.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
