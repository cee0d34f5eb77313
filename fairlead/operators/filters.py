"""Row filters in their fixed order: box, mask, expression, names, black list, down-sampling."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.vessel import trim_name

Box = tuple[float, float, float, float]  # south, north, west, east

#: Masks of up to so many boxes are sent to all tasks; larger ones meet reports by whole degrees.
BROADCAST_BOXES = 10_000


def within_box(df: DataFrame, north: float | None, south: float | None, west: float | None, east: float | None) -> DataFrame:
    """Reports inside the box, edges included; no position is outside; with a bound missing all stay."""
    if None in (north, south, west, east):
        return df
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def mask_boxes(xml: str) -> list[Box]:
    """The bounding box of each polygon in a mask document; polygons with a bad number are left out."""
    out = []
    for area in ET.fromstring(xml).iter("area_polygon"):
        for polygon in area:
            try:
                points = [(float(p.attrib["lat"]), float(p.attrib["lon"])) for p in polygon]
            except (KeyError, ValueError):
                continue
            if points:
                lats, lons = zip(*points, strict=True)
                out.append((min(lats), max(lats), min(lons), max(lons)))
    return out


def outside_mask(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """Reports in none of ``boxes(south, north, west, east)``; a report without position stays."""
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    if boxes.limit(BROADCAST_BOXES + 1).count() <= BROADCAST_BOXES:
        return df.join(F.broadcast(boxes), inside, "left_anti")
    cells = lambda low, high: F.explode(F.sequence(F.floor(low), F.floor(high)))
    dealt = boxes.withColumn("d_lat", cells(F.col("south"), F.col("north"))).withColumn("d_lon", cells(F.col("west"), F.col("east")))
    keyed = df.withColumn("k_lat", F.floor("lat")).withColumn("k_lon", F.floor("lon"))
    met = (F.col("k_lat") == F.col("d_lat")) & (F.col("k_lon") == F.col("d_lon")) & inside
    return keyed.join(dealt, met, "left_anti").drop("k_lat", "k_lon")


def where(df: DataFrame, expression: str | None) -> DataFrame:
    """A Spark SQL condition; blank keeps all."""
    return df.where(F.expr(expression)) if expression and expression.strip() else df


def glob_pattern(glob: str) -> str:
    """A name glob (``*`` any text, ``?`` one character) as an anchored pattern, letters in either case."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return f"(?is)^{body}$"


def name_matches(name: Column, globs: Iterable[str]) -> Column:
    clean = trim_name(name)
    found = F.lit(False)
    for glob in globs:
        found = found | clean.rlike(glob_pattern(glob.strip()))
    return found


def without_names(df: DataFrame, globs: Iterable[str]) -> DataFrame:
    globs = [g for g in globs if g.strip()]
    return df.where(~name_matches(F.col("name"), globs)) if globs else df


def usable_mmsis(values: Iterable[int]) -> list[int]:
    return sorted({int(v) for v in values if 1 <= int(v) <= 999_999_999})


def without_vessels(df: DataFrame, mmsis: Iterable[int]) -> DataFrame:
    """Black list; numbers that no vessel can have, such as -1, are ignored."""
    listed = usable_mmsis(mmsis)
    return df.where(~F.col("mmsi").isin(listed)) if listed else df


def spaced(groups: list[np.ndarray], times: np.ndarray, span: int, before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows stay if each is ``span`` or more after its group's last one that stayed.

    Rows are sorted by group and time; ``before`` is the group and time of the last row that stayed
    earlier, and the same of these rows is returned.  Every row names the first row that could follow
    it, and what is reached from the groups' first rows is found by doubling those steps.
    """
    n = len(times)
    fresh = np.ones(n, bool)
    fresh[1:] = np.any([g[1:] != g[:-1] for g in groups], axis=0)
    low = int(times.min())
    key = (np.cumsum(fresh) - 1) * (int(times.max()) - low + span + 1) + (times - low)
    step = np.append(np.searchsorted(key, key + span), n)
    stays = np.append(fresh, False)
    if before is not None and before[0] == tuple(g[0] for g in groups):
        stays[0] = False
        first = int(np.searchsorted(key, before[1] + span - low)) if before[1] + span > low else 0
        stays[first] = True
    while True:
        reached = stays.copy()
        reached[step[stays]] = True
        if (reached == stays).all():
            break
        stays, step = reached, step[step]
    stays = stays[:n]
    last = int(np.flatnonzero(stays)[-1]) if stays.any() else None
    kept = before if last is None else (tuple(g[last] for g in groups), int(times[last]))
    return stays, kept


def thinned(milliseconds: int, groups: list[int], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if batch.num_rows:
                stays, before = spaced([batch.column(g).to_numpy() for g in groups], batch.column(at).to_numpy(), milliseconds, before)
                batch = batch.filter(pa.array(stays))
            yield batch

    return run


def down_sample(df: DataFrame, seconds: int) -> DataFrame:
    """A vessel's report stays if it is ``seconds`` or more after the last one that stayed.

    Vessels are dealt by mmsi and sorted by time, and read as a stream that
    carries one pair of numbers, so a long history is never held in memory.
    Reports without vessel or time are left out.
    """
    if seconds <= 0:
        return df
    rows = df.where("mmsi is not null and ts_ms is not null").repartition("mmsi").sortWithinPartitions("mmsi", "ts_ms", "seq")
    return rows.mapInArrow(thinned(seconds * 1000, [df.columns.index("mmsi")], df.columns.index("ts_ms")), df.schema)


def down_sample_buckets(df: DataFrame, seconds: int) -> DataFrame:
    """Cheaper and approximate: the first report of each aligned span of ``seconds``."""
    span = F.floor(F.col("ts_ms") / (seconds * 1000))
    first = df.groupBy("mmsi", span.alias("span")).agg(F.min(F.struct("ts_ms", "seq")).alias("first"))
    keys = first.select("mmsi", F.col("first.ts_ms").alias("ts_ms"), F.col("first.seq").alias("seq"))
    return df.join(keys, ["mmsi", "ts_ms", "seq"], "left_semi")
