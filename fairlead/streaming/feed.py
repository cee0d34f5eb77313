"""A live line feed to messages: packets are put together across micro-batches.

The lines of one source come from one reader, whose order a shuffle of one input
partition keeps; its state is the packet in the making
(time line and parts so far), so it never grows beyond one packet.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairlead.sources import nmea

_SENTENCE = re.compile(r"(![A-Z]{2}VD[MO],.*)$")
_NAMES = [c.split()[0] for c in nmea.MESSAGE_SCHEMA.split(", ")]


def _assembled(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, open_ = state.get if state.exists else (0, "{}")
    held = {"clock": None, "parts": []} | json.loads(open_)
    out = []
    for line in (x for frame in frames for x in frame["value"]):
        count += 1
        found = _SENTENCE.search(line)
        if line.startswith("$PGHP"):
            held["clock"] = line
        if not found:
            continue
        fields = found[1].split(",")
        if len(fields) < 7:
            continue
        if fields[2] == "1":
            held["parts"] = []
        held["parts"].append(fields[5])
        if fields[1] != fields[2]:
            continue
        if str(len(held["parts"])) == fields[1]:
            try:
                stamp = fields[7] if len(fields) > 7 else None
                out.append({"file": key[0], "seq": count, "ts_ms": nmea.packet_time(held["clock"], stamp)} | nmea.decode("".join(held["parts"])))
            except ValueError:
                pass
        held = {"clock": None, "parts": []}
    state.update((count, json.dumps(held)))
    if out:
        yield pd.DataFrame([{c: r.get(c) for c in _NAMES} for r in out], columns=_NAMES).astype(object)


def messages(lines: DataFrame) -> DataFrame:
    """Messages of a stream of lines (source, value); undecodable packets are dropped."""
    keyed = lines.select(F.col("source").alias("file"), "value")
    return keyed.groupBy("file").applyInPandasWithState(_assembled, nmea.MESSAGE_SCHEMA, "count long, held string", "append", GroupStateTimeout.NoTimeout)


def from_tcp(spark: SparkSession, url: str, spool: str | None = None) -> DataFrame:
    """Messages of ``tcp://host:port``; give a ``spool`` that outlives the session with the stream's checkpoint."""
    host, _, port = url.removeprefix("tcp://").partition(":")
    return messages(nmea.read_socket(spark, host, int(port), spool))


def _first_of_repeats(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts_ms", "file", "seq"], kind="stable")
    stays = []
    for now in rows["ts_ms"]:
        stays.append(last is None or now - last >= nmea.REPEAT_MS)
        last = int(now) if stays[-1] else last
    state.update((last,))
    if state.getCurrentWatermarkMs() < last + nmea.REPEAT_MS:
        state.setTimeoutTimestamp(last + nmea.REPEAT_MS)
    found = rows[stays]
    if len(found):
        yield found[_NAMES].astype(object).where(found[_NAMES].notna(), None)


def distinct(decoded: DataFrame) -> DataFrame:
    """A stream of messages without those that several receivers passed on, by the rule of the batch filter.

    The state is the time of the last one that stayed, for each message of the last ``REPEAT_MS``.
    """
    rows = decoded.where("ts_ms is not null and mmsi is not null").withColumn("_same", nmea.same_message()).withColumn("_at", F.timestamp_millis("ts_ms"))
    timed = rows.withWatermark("_at", f"{nmea.REPEAT_MS} milliseconds")
    return timed.groupBy("mmsi", "_same").applyInPandasWithState(_first_of_repeats, nmea.MESSAGE_SCHEMA, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def from_folder(spark: SparkSession, folder: str, files_at_once: int = 8, newest_first: bool = False) -> DataFrame:
    """Messages of the AIS files of a folder and of those that come later, so many files in a micro-batch.

    A file is read whole in one batch, in the order of its lines, and once, whatever fails in between.
    """
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once).option("latestFirst", newest_first)
    return messages(reader.load(folder).select(F.input_file_name().alias("source"), "value"))
