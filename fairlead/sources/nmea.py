"""AIS sentences to rows: tag and time lines, multi-part payloads, and the 6-bit message layout.

A file is text; a packet is the run of lines up to the last part of its
sentence.  Lines are read in order inside a block of a file (large plain files
have many), and packets are put together in one pass over them; what lies before a
block's first packet end or after its last is kept as a fragment, and a file's few
fragments are put together afterwards.  Payloads are decoded in Arrow batches.
Lines that make no message are dropped and can be counted.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITION_TYPES = (1, 2, 3, 18)
STATIC_TYPES = (5, 24)

MESSAGE_SCHEMA = (
    "file string, seq long, msg_type int, kind string, mmsi int, ts_ms long, lat double, lon double, sog float, cog float, hdg float, "
    "name string, callsign string, imo int, ship_type int, to_bow int, to_stern int, to_port int, to_starboard int"
)
_COLUMNS = [c.split()[0] for c in MESSAGE_SCHEMA.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in MESSAGE_SCHEMA.split(", ")])


LINES = "file string, block long, value string"
PACKETS = "file string, seq long, clock string, payload string, stamp string, whole boolean"
_SENTENCE = re.compile(r"^(?:\\.*\\)?(![A-Z]{2}VD[MO],.*)$")


def read_lines(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, block, value) of plain, ``.gz`` and ``.zip`` files, a block's lines in order.

    A block begins at that byte of its file.  Plain files are split; a ``.gz`` file is one block, read as a
    stream; a ``.zip`` file is unpacked whole by one task.
    """

    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    lines = (reader.option("pathGlobFilter", pattern) if pattern else reader).option("lineSep", "\n").text(path).where(~F.endswith(F.lower("_metadata.file_path"), F.lit(".zip")))
    plain = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"))
    zips = "*.zip" if not pattern else pattern if pattern.lower().endswith(".zip") else f"{pattern}.zip" if pattern.endswith("*") else None
    if zips is None:
        return plain
    whole = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", zips).format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as inner:
                            part = [x.decode("latin-1").rstrip("\r\n") for x in inner]
                        yield pa.record_batch([pa.array([f"{file}#{name}"] * len(part), pa.string()), pa.array([0] * len(part), pa.int64()), pa.array(part, pa.string())], names=["file", "block", "value"])

    return plain.union(whole.mapInArrow(unpack, LINES))


class _Packets:
    """Lines in order to packets; what comes before the first end and after the last one is a fragment."""

    def __init__(self, file: str, block: int, begins: bool):
        self.file, self.block, self.line = file, block, 0
        self.head = None if begins else []  # lines up to the first end, where the block may begin inside a packet
        self.clock, self.parts = None, []
        self.tail: list[str] = []

    def add(self, line: str) -> tuple | None:
        self.line += 1
        found = _SENTENCE.match(line)
        fields = found[1].split(",") if found else None
        ends = bool(fields) and len(fields) > 2 and fields[1] == fields[2]
        if self.head is not None:
            self.head.append(line)
            if ends:
                self.tail, self.done, self.head = [], self.head, None
                return None
            return None
        if not (fields or line.startswith("$PGHP")):
            return None
        self.tail.append(line)
        if line.startswith("$PGHP"):
            self.clock = line
        if fields and len(fields) >= 7:
            self.parts.append((fields[2], fields[5], fields[1], fields[7] if len(fields) > 7 else None))
        if not ends:
            return None
        out = None
        if self.parts:
            parts = sorted(self.parts, key=lambda p: p[0])
            whole = parts[0][2].isdigit() and int(parts[0][2]) == len(parts)
            out = (self.file, self.block + self.line, self.clock, "".join(p[1] for p in parts), parts[-1][3], whole)
        self.clock, self.parts, self.tail = None, [], []
        return out


def _rows(packets: list[tuple], fragments: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*packets, strict=True)) if packets else [[]] * 6
    n, m = len(packets), len(fragments)
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
    some = [pa.concat_arrays([pa.array(c, k), pa.nulls(m, k)]) for c, k in zip(columns, kinds, strict=True)]
    some[0] = pa.array([*columns[0], *[f[0] for f in fragments]], pa.string())
    extra = [pa.array([None] * n + [f[k] for f in fragments], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.list_(pa.string())))]
    return pa.record_batch([*some, *extra], names=["file", "seq", "clock", "payload", "stamp", "whole", "block", "place", "lines"])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets of each run of lines, and its fragments: place 0 before the first end, 1 after the last."""
    now: _Packets | None = None

    def fragments(p: _Packets) -> list[tuple]:
        out = []
        if p.head is not None:
            out.append((p.file, p.block, 0, p.head))
        else:
            if getattr(p, "done", None):
                out.append((p.file, p.block, 0, p.done))
            if p.tail:
                out.append((p.file, p.block, 1, p.tail))
        return out

    for batch in batches:
        packets, left = [], []
        for file, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if now is None or (file, block) != (now.file, now.block):
                if now is not None:
                    left += fragments(now)
                now = _Packets(file, block, block == 0)
            found = now.add(line)
            if found:
                packets.append(found)
        yield _rows(packets, left)
    if now is not None:
        yield _rows([], fragments(now))


def _over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets of fragments, sorted by file, block and place."""
    now: _Packets | None = None
    for batch in batches:
        packets = []
        for file, block, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if now is None or file != now.file:
                now = _Packets(file, block, True)
            now.block, now.line = block, 0
            packets += [p for p in map(now.add, lines) if p]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*packets, strict=True) if packets else [[]] * 6, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=[c.split()[0] for c in PACKETS.split(", ")])


def packets(lines: DataFrame) -> DataFrame:
    """One row for each packet: file, seq (ascending in a file), time line, joined payload, stamp and whether no part is missing.

    Files whose blocks hold no packet end at all are fragments too, so nothing is lost at borders.
    """
    found = lines.mapInArrow(_put_together, f"{PACKETS}, block long, place long, lines array<string>")
    names = [c.split()[0] for c in PACKETS.split(", ")]
    whole = found.where("lines is null").select(*names)
    parts = found.where("lines is not null").select("file", "block", "lines", "place").repartition("file").sortWithinPartitions("file", "block", "place")
    return whole.union(parts.select("file", "block", "lines").mapInArrow(_over_borders, PACKETS))


def _bits(payload: str) -> str:
    out = []
    for c in payload:
        v = ord(c) - 48
        v = v - 8 if v > 40 else v
        if not 0 <= v < 64:
            raise ValueError("not an armoured payload")
        out.append(format(v, "06b"))
    return "".join(out)


def _unsigned(bits: str, first: int, count: int) -> int:
    if len(bits) < first + count:
        raise ValueError("the payload is too short")
    return int(bits[first : first + count], 2)


def _signed(bits: str, first: int, count: int) -> int:
    value = _unsigned(bits, first, count)
    return value - (1 << count) if value >> (count - 1) else value


def _text(bits: str, first: int, count: int) -> str:
    codes = [_unsigned(bits, first + 6 * k, 6) for k in range(count)]
    return "".join(chr(c + 64) if c < 32 else chr(c) for c in codes)


def decode(payload: str) -> dict:
    """The fields of a message of types 1, 2, 3, 5, 18 and 24; other types give their type and mmsi."""
    bits = _bits(payload)
    kind = _unsigned(bits, 0, 6)
    out = {"msg_type": kind, "mmsi": _unsigned(bits, 8, 30), "kind": "position" if kind in POSITION_TYPES else "static" if kind in STATIC_TYPES else "other"}
    if kind in POSITION_TYPES:
        at = {"sog": 50, "lon": 61, "lat": 89, "cog": 116, "hdg": 128} if kind != 18 else {"sog": 46, "lon": 57, "lat": 85, "cog": 112, "hdg": 124}
        lon, lat = _signed(bits, at["lon"], 28) / 600_000, _signed(bits, at["lat"], 27) / 600_000
        out |= {"lat": lat if abs(lat) <= 90 else None, "lon": lon if abs(lon) <= 180 else None}
        out |= {"sog": _unsigned(bits, at["sog"], 10) / 10, "cog": _unsigned(bits, at["cog"], 12) / 10, "hdg": float(_unsigned(bits, at["hdg"], 9))}
    elif kind == 5:
        out |= {"imo": _unsigned(bits, 40, 30), "callsign": _text(bits, 70, 7), "name": _text(bits, 112, 20), "ship_type": _unsigned(bits, 232, 8)}
        out |= {"to_bow": _unsigned(bits, 240, 9), "to_stern": _unsigned(bits, 249, 9), "to_port": _unsigned(bits, 258, 6), "to_starboard": _unsigned(bits, 264, 6)}
    elif kind == 24:
        if _unsigned(bits, 38, 2) == 0:
            out |= {"name": _text(bits, 40, 20)}
        else:
            out |= {"ship_type": _unsigned(bits, 40, 8), "callsign": _text(bits, 90, 7)}
            out |= {"to_bow": _unsigned(bits, 132, 9), "to_stern": _unsigned(bits, 141, 9), "to_port": _unsigned(bits, 150, 6), "to_starboard": _unsigned(bits, 156, 6)}
    return out


def packet_time(clock: str | None, stamp: str | None) -> int | None:
    """Milliseconds of a packet: its time line, else the seconds appended to the sentence."""
    if clock:
        year, month, day, hour, minute, second, millis = map(int, clock.split(",")[2:9])
        return int(datetime(year, month, day, hour, minute, second, tzinfo=UTC).timestamp()) * 1000 + millis
    return int(stamp) * 1000 if stamp and stamp.isdigit() else None


#: Characters of the longest payload that is looked into.
_LONGEST = 72
_ARMOUR = np.full(256, 255, np.uint8)
_ARMOUR[48:88], _ARMOUR[96:128] = np.arange(40), np.arange(40, 72)
_ARMOUR[(_ARMOUR > 63) & (_ARMOUR < 255)] = 255


class _Payloads:
    """Many payloads as one matrix of bits."""

    def __init__(self, payloads: pa.Array):
        texts = payloads.fill_null("").cast(pa.binary())
        raw = texts.buffers()
        offsets = np.frombuffer(raw[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = _ARMOUR[np.frombuffer(raw[2], np.uint8)] if raw[2] is not None else np.zeros(0, np.uint8)
        length = np.diff(offsets)
        bad = np.concatenate([[0], np.cumsum(data == 255)])
        self.good = bad[offsets[1:]] == bad[offsets[:-1]]
        at = offsets[:-1, None] + np.arange(_LONGEST)
        inside = np.arange(_LONGEST) < length[:, None]
        values = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8) & 63
        self.bits = np.unpackbits(values[:, :, None], axis=2)[:, :, 2:].reshape(len(length), _LONGEST * 6)
        self.size = np.minimum(length, _LONGEST) * 6

    def unsigned(self, first: int, count: int) -> np.ndarray:
        return self.bits[:, first : first + count] @ (1 << np.arange(count - 1, -1, -1, dtype=np.int64))

    def signed(self, first: int, count: int) -> np.ndarray:
        value = self.unsigned(first, count)
        return value - ((value >> (count - 1)) << count)

    def text(self, first: int, count: int) -> np.ndarray:
        codes = self.bits[:, first : first + 6 * count].reshape(-1, count, 6) @ (1 << np.arange(5, -1, -1))
        letters = np.where(codes < 32, codes + 64, codes).astype(np.uint8)
        return np.array([x.decode("latin-1") for x in np.ascontiguousarray(letters).view(f"V{count}").ravel().tolist()], object)


def decode_batch(payloads: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which payloads are messages, and their fields as :func:`decode` gives them (None or nan where a type has none)."""
    p = _Payloads(payloads)
    n = len(p.size)
    kind = p.unsigned(0, 6)
    part = p.unsigned(38, 2)
    moving, class_b, five, named = np.isin(kind, (1, 2, 3)), kind == 18, kind == 5, (kind == 24) & (part == 0)
    sized = (kind == 24) & (part != 0)
    need = np.select([moving, class_b, five, named, sized], [137, 133, 270, 160, 162], 38)
    good = p.good & (p.size >= need)
    fields: dict[str, np.ndarray] = {"msg_type": kind, "mmsi": p.unsigned(8, 30)}
    fields["kind"] = np.where(moving | class_b, "position", np.where(five | (kind == 24), "static", "other")).astype(object)

    def either(choices: list[tuple[np.ndarray, object]], none: object) -> np.ndarray:
        out = np.full(n, none, object if none is None else np.float64)
        for where, value in choices:
            out[where] = value[where]
        return out

    for name, a, b, scale in (("sog", 50, 46, 10), ("cog", 116, 112, 10), ("hdg", 128, 124, 1)):
        width = {"sog": 10, "cog": 12, "hdg": 9}[name]
        fields[name] = either([(moving, p.unsigned(a, width) / scale), (class_b, p.unsigned(b, width) / scale)], np.nan)
    for name, a, b, width, most in (("lat", 89, 85, 27, 90), ("lon", 61, 57, 28, 180)):
        value = either([(moving, p.signed(a, width) / 600_000), (class_b, p.signed(b, width) / 600_000)], np.nan)
        fields[name] = np.where(np.abs(value) <= most, value, np.nan)
    fields["name"] = either([(five, p.text(112, 20)), (named, p.text(40, 20))], None)
    fields["callsign"] = either([(five, p.text(70, 7)), (sized, p.text(90, 7))], None)
    fields["imo"] = either([(five, p.unsigned(40, 30))], np.nan)
    for name, a, b, width in (("ship_type", 232, 40, 8), ("to_bow", 240, 132, 9), ("to_stern", 249, 141, 9), ("to_port", 258, 150, 6), ("to_starboard", 264, 156, 6)):
        fields[name] = either([(five, p.unsigned(a, width)), (sized, p.unsigned(b, width))], np.nan)
    return good, fields


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, fields = decode_batch(batch.column(4))
        times = []
        for k, (clock, stamp) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            try:
                times.append(packet_time(clock, stamp))
            except ValueError:
                good[k] = False
                times.append(None)
        known = {"file": batch.column(0), "seq": batch.column(1), "ts_ms": pa.array(times, pa.int64())}
        columns = [known.get(f.name) if f.name in known else pa.array(fields[f.name], from_pandas=True).cast(f.type) for f in _ARROW]
        yield pa.record_batch(columns, schema=_ARROW).filter(pa.array(good))


def messages(found: DataFrame) -> DataFrame:
    """Decoded messages of whole packets; what cannot be decoded is dropped."""
    return found.where("whole").select("file", "seq", "clock", "stamp", "payload").mapInArrow(_decoded, MESSAGE_SCHEMA)


def counters(found: DataFrame, decoded: DataFrame) -> DataFrame:
    """Packets read, and messages by kind."""
    kinds = decoded.groupBy(F.col("kind").alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return found.agg(F.count(F.lit(1)).alias("n")).select(F.lit("packets").alias("counter"), "n").union(kinds)


#: The same message within this time is one that several receivers passed on.
REPEAT_MS = 10_000


def same_message() -> Column:
    """What two copies of one message have in common, as a number."""
    return F.xxhash64(*[c for c in _COLUMNS if c not in ("file", "seq", "ts_ms")])


def distinct_messages(decoded: DataFrame) -> DataFrame:
    """Without repeats of a message that several receivers passed on.

    In the order of time, a message stays if the last equal one that stayed is ``REPEAT_MS`` or more before it,
    wherever borders of time lie; messages without time or vessel are left out.
    """
    from fairlead.operators.filters import thinned

    rows = decoded.where("ts_ms is not null and mmsi is not null").withColumn("_same", same_message())
    dealt = rows.repartition("mmsi", "_same").sortWithinPartitions("mmsi", "_same", "ts_ms", "file", "seq")
    at = rows.columns.index
    return dealt.mapInArrow(thinned(REPEAT_MS, [at("mmsi"), at("_same")], at("ts_ms")), rows.schema).drop("_same")


def reports(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, statics): names without padding; seq orders a vessel's reports of equal time."""
    positions = decoded.where("kind = 'position' and ts_ms is not null").select("mmsi", "ts_ms", "seq", "lat", "lon", "sog", "cog", "hdg")
    static = ["name", "callsign", "imo", "ship_type", "to_bow", "to_stern", "to_port", "to_starboard"]
    statics = decoded.where("kind = 'static' and ts_ms is not null").select("mmsi", "ts_ms", "seq", *static)
    return positions, statics


def read_socket(spark: SparkSession, host: str, port: int, spool: str | None = None) -> DataFrame:
    """A stream of lines (source, value) from ``tcp://host:port``; ``spool`` keeps what is not yet processed, over restarts."""
    from fairlead.sources import tcp
    from fairlead.sources.scratch import scratch_path

    spark.dataSource.register(tcp.Lines)
    return spark.readStream.format(tcp.NAME).option("host", host).option("port", port).option("spool", spool or scratch_path(spark, "spool")).load()


def source(spark: SparkSession, url: str) -> DataFrame:
    """``file://dir/pattern`` (with all folders below) or ``tcp://host:port``; anything else is refused."""
    kind, _, rest = url.partition("://")
    if kind == "file":
        folder, _, pattern = rest.rpartition("/")
        return read_lines(spark, folder or "/", pattern or None, recursive=True)
    if kind == "tcp":
        host, _, port = rest.partition(":")
        return read_socket(spark, host, int(port))
    raise ValueError(f"unknown protocol in {url!r}: file and tcp are known")
