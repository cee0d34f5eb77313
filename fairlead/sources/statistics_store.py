"""The statistics store: Parquet by statistic in numbered versions, the newest whole one counts.

A version is a list of parts: its own files and those of earlier versions that it
still counts.  :func:`append` writes only what is new, and merges it with the last
parts as long as they are not much larger, so that a store of n rows has some log n
parts and a row is written again some log n times; :func:`write` makes one part of
all.  A version is written beside the others and becomes current by its manifest,
which lists its files with sizes and checksums and is written last, so readers never
see half of one; the version before the current one is kept with its parts.

Readers pass over a version of which a file is missing, cut or changed.  Writers
rename such versions ``.corrupt`` first; readers change nothing.  A fault in reaching
the files is no damage and is raised.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.sources.scratch import written

SCHEMA = "cell_id long, k1 int, k2 int, k3 int, ship_count long, statistic string"
METADATA = "grid_resolution double, downsampling int, format_version short, stream string, batch long, parts array<long>"
FORMAT_VERSION = 1
#: Rows of a file at most: a task reads a file whole to prove it.
FILE_ROWS = 4_000_000
#: A part is merged with what is written next if it has this many times the bytes at most.
TIER = 2


@dataclass(frozen=True)
class Metadata:
    grid_resolution: float
    downsampling: int
    format_version: int = FORMAT_VERSION
    stream: str | None = None  # the stream that wrote it, and the last of its batches that is counted
    batch: int | None = None
    parts: tuple[int, ...] = ()  # the versions whose files it counts, oldest first


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions, oldest first."""
    fs, make = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(make(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(make(path))]
    found = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
    return [n for n in found if fs.exists(make(f"{path}/v{n}/manifest.json"))]


def _checked(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Name, size and checksum of each data file of a version, one task for some files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{path}/v{number}")
    name = F.regexp_extract("path", f"/v{number}/((?:statistics|metadata)/.*)$", 1)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.crc32("content").alias("crc"))


def manifest(spark: SparkSession, path: str, number: int) -> dict[str, list[int]]:
    """The files that a version has of its own: [size, checksum] by name."""
    fs, make = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    stream = fs.open(make(f"{path}/v{number}/manifest.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _write_manifest(spark: SparkSession, path: str, number: int) -> None:
    fs, make = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    text = json.dumps({r["name"]: [r["bytes"], r["crc"]] for r in _checked(spark, path, number).collect()})
    stream = fs.create(make(f"{path}/v{number}/manifest.tmp"), True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.rename(make(f"{path}/v{number}/manifest.tmp"), make(f"{path}/v{number}/manifest.json"))


def _own_damage(spark: SparkSession, path: str, number: int, content: bool) -> str | None:
    """What is wrong with a version's own files: sizes by a listing; their bytes too if asked for."""
    fs, make = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(make(f"{path}/v{number}/manifest.json")):
        return "no manifest"
    try:
        listed = manifest(spark, path, number)
    except ValueError:
        return "a broken manifest"
    for name, (size, _) in listed.items():
        file = make(f"{path}/v{number}/{name}")
        if not fs.exists(file):
            return f"{name} is missing"
        if fs.getFileStatus(file).getLen() != size:
            return f"{name} has another size"
    if content:
        try:
            found = _checked(spark, path, number).collect()
        except (PySparkException, Py4JError) as fault:
            if "ChecksumException" in str(fault):  # the file system's own proof
                return "a file has changed"
            raise
        wrong = [r["name"] for r in found if listed.get(r["name"], [0, -1])[1] != r["crc"]]
        if wrong:
            return f"{wrong[0]} has changed"
    return None


def _metadata(spark: SparkSession, path: str, number: int) -> Metadata | None:
    row = spark.read.schema(METADATA).parquet(f"{path}/v{number}/metadata").first()
    if row is None or row["format_version"] != FORMAT_VERSION:
        return None
    found = Metadata(**row.asDict())
    return replace(found, parts=tuple(found.parts or (number,)))


def damage(spark: SparkSession, path: str, number: int, content: bool = True) -> str | None:
    """Why a version cannot be used; None for a good one. All files of all its parts are looked at."""
    own = _own_damage(spark, path, number, content)
    if own:
        return own
    found = _metadata(spark, path, number)
    if found is None:
        return f"no metadata of format {FORMAT_VERSION}"
    for part in found.parts:
        other = None if part == number else _own_damage(spark, path, part, content)
        if other:
            return f"part {part}: {other}"
    return None


def quarantine(spark: SparkSession, path: str) -> list[int]:
    """Rename versions of which a file is missing or cut; for writers only, who look at sizes alone."""
    fs, make = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    bad = [n for n in versions(spark, path) if _own_damage(spark, path, n, False)]
    for n in bad:
        fs.rename(make(f"{path}/v{n}"), make(f"{path}/v{n}.corrupt"))
    return bad


def _put(stats: DataFrame, path: str, metadata: Metadata, parts: tuple[int, ...], keep: int) -> int:
    """A new version of these parts and its own files; its manifest completes it. Returns its number."""
    spark = stats.sparkSession
    fs, make = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(make(path))] if fs.exists(make(path)) else []
    number = max([0, *(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(make(f"{path}/{n}/manifest.json")))]) + 1
    # sorted by cell inside each statistic: row groups of a cell range can be skipped
    rows = stats.repartitionByRange("statistic", "cell_id").sortWithinPartitions("statistic", "cell_id", "k1", "k2", "k3")
    fs.delete(make(f"{path}/v{number}"), True)
    rows.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("statistic").parquet(f"{path}/v{number}/statistics")
    row = [(metadata.grid_resolution, metadata.downsampling, metadata.format_version, metadata.stream, metadata.batch, [*parts, number])]
    spark.createDataFrame(row, METADATA).coalesce(1).write.parquet(f"{path}/v{number}/metadata")
    _write_manifest(spark, path, number)
    quarantine(spark, path)
    known = versions(spark, path)
    needed = {p for n in known[-keep:] for p in (n, *_metadata(spark, path, n).parts)}
    for old in known:
        if old not in needed:
            fs.delete(make(f"{path}/v{old}"), True)
    return number


def write(stats: DataFrame, path: str, metadata: Metadata, keep: int = 2) -> int:
    """A new version of one part; returns its number."""
    return _put(stats, path, metadata, (), keep)


def append(found: DataFrame, path: str, metadata: Metadata, keep: int = 2) -> int:
    """A new version that counts ``found`` beside what is stored; the bytes written follow ``found``."""
    spark = found.sparkSession
    found = written(found, "counts")
    try:
        _, current = read_metadata(spark, path, content=False)
    except FileNotFoundError:
        return write(found, path, metadata, keep)
    parts, size = list(current.parts), _bytes_of(found)
    merged = found
    while parts and (more := sum(s for s, _ in manifest(spark, path, parts[-1]).values())) <= TIER * size:
        merged, size = merged.unionByName(_part(spark, path, parts.pop())), size + more
    return _put(_summed(merged) if len(parts) < len(current.parts) else found, path, metadata, tuple(parts), keep)


def _bytes_of(table: DataFrame) -> int:
    """Bytes of a written table, from its files."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _part(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/v{number}/statistics").select("statistic", "cell_id", "k1", "k2", "k3", "ship_count")


def _summed(stats: DataFrame) -> DataFrame:
    return stats.groupBy("statistic", "cell_id", "k1", "k2", "k3").agg(F.sum("ship_count").alias("ship_count"))


def read_metadata(spark: SparkSession, path: str, content: bool = True) -> tuple[int, Metadata]:
    """Number and metadata of the newest version that can be used; without ``content``, sizes alone are proven."""
    for number in reversed(versions(spark, path)):
        if not damage(spark, path, number, content):
            return number, _metadata(spark, path, number)
    raise FileNotFoundError(f"no statistics in {path}")


def read(spark: SparkSession, path: str, content: bool = True) -> tuple[DataFrame, Metadata]:
    """The newest version that can be used; counts of several parts are added up."""
    _, metadata = read_metadata(spark, path, content)
    stats = _part(spark, path, metadata.parts[0])
    for number in metadata.parts[1:]:
        stats = stats.unionByName(_part(spark, path, number))
    return (_summed(stats) if len(metadata.parts) > 1 else stats), replace(metadata, parts=())


def get(stats: DataFrame, statistic: str, cell_id: int) -> DataFrame:
    """One cell of one statistic: the partition and the row groups of that cell are read."""
    return stats.where((F.col("statistic") == statistic) & (F.col("cell_id") == cell_id))
