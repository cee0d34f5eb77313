"""The relational event store: three tables behind JDBC, written by upsert and read back.

Rows travel from the executors into staging tables; one transaction of the
database then replaces what has the same event id, so a failed job leaves the
store as it was.  An event's id is made of its type, primary vessel and start, so
runs over different times stand side by side and a run that is repeated changes
nothing; an id that would stand for two events is refused.  The driver jar is the
session's.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators.event_tables import Tables

# The tables' columns, in standard SQL.
SCHEMA = {
    "event": "event_id BIGINT NOT NULL PRIMARY KEY, event_type VARCHAR(64), state VARCHAR(16), start_time TIMESTAMP, end_time TIMESTAMP, suppressed BOOLEAN, title VARCHAR(255), description VARCHAR(2000)",
    "behaviour": "event_id BIGINT NOT NULL, mmsi INTEGER NOT NULL, is_primary BOOLEAN, imo INTEGER, name VARCHAR(64), callsign VARCHAR(32), ship_type INTEGER, length INTEGER",
    "tracking_point": "event_id BIGINT NOT NULL, mmsi INTEGER NOT NULL, ts TIMESTAMP NOT NULL, lat DOUBLE PRECISION, lon DOUBLE PRECISION, sog REAL, cog REAL, hdg REAL, interpolated BOOLEAN, certainty INTEGER",
}


def columns(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMA[table].split(", ")]


def url_of(values: Mapping[str, str]) -> tuple[str, dict[str, str]] | None:
    """JDBC address and properties of the store that a settings file names; None for the CSV store."""
    kind = values["events.repository.type"].strip().lower()
    if kind == "h2":
        return f"jdbc:h2:{values['events.h2.file']};AUTO_SERVER=TRUE", {"driver": "org.h2.Driver"}
    if kind == "pgsql":
        at = {k: values[f"events.pgsql.{k}"] for k in ("host", "port", "name", "username", "password")}
        return f"jdbc:postgresql://{at['host']}:{at['port']}/{at['name']}", {"driver": "org.postgresql.Driver", "user": at["username"], "password": at["password"]}
    if kind == "csv":
        return None
    raise ValueError(f"unknown event store {kind!r}")


class _Session:
    """One connection of the driver, for statements that move no rows through it."""

    def __init__(self, spark: SparkSession, url: str, properties: Mapping[str, str]):
        jvm = spark._jvm
        settings = jvm.java.util.Properties()
        for key, value in properties.items():
            settings.setProperty(key, value)
        if "driver" in properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
        self._open = jvm.java.sql.DriverManager.getConnection(url, settings)
        self._open.setAutoCommit(False)

    def __enter__(self) -> _Session:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self._open.commit()
        else:
            self._open.rollback()
        self._open.close()

    def run(self, statement: str) -> None:
        made = self._open.createStatement()
        try:
            made.execute(statement)
        finally:
            made.close()

    def count(self, query: str) -> int:
        made = self._open.createStatement()
        try:
            found = made.executeQuery(query)
            found.next()
            return int(found.getLong(1))
        finally:
            made.close()

    def has(self, table: str) -> bool:
        found = self._open.getMetaData().getTables(None, None, "%", None)
        names = set()
        while found.next():
            names.add(found.getString("TABLE_NAME").lower())
        found.close()
        return table in names


def create(spark: SparkSession, url: str, properties: Mapping[str, str]) -> None:
    """The tables that are not there yet."""
    with _Session(spark, url, properties) as session:
        for table, described in SCHEMA.items():
            if not session.has(table):
                session.run(f"CREATE TABLE {table} ({described})")


def _plain(rows: DataFrame, table: str) -> DataFrame:
    return rows.select(*[F.col(c).cast("timestamp") if t == "timestamp_ntz" else F.col(c) for c, t in rows.select(*columns(table)).dtypes])


#: What makes a row of each table one of its own.
_KEYS = {"event": ("event_id",), "behaviour": ("event_id", "mmsi"), "tracking_point": ("event_id", "mmsi", "ts")}


def save(tables: Tables, url: str, properties: Mapping[str, str], merge: bool = False) -> None:
    """Write events with their behaviours and points; what the store has of the same events is replaced.

    With ``merge``, behaviours and points of these events that are not written again stay: a run that goes on
    with an event brings only its later points.
    """
    spark = tables.events.sparkSession
    create(spark, url, properties)
    rows = {"event": tables.events, "behaviour": tables.behaviours, "tracking_point": tables.points}
    run = uuid.uuid4().hex[:8]
    try:
        for table, frame in rows.items():
            with _Session(spark, url, properties) as session:
                session.run(f"CREATE TABLE staged_{table}_{run} ({SCHEMA[table].replace(' PRIMARY KEY', '')})")
            _plain(frame, table).write.jdbc(url, f"staged_{table}_{run}", mode="append", properties=dict(properties))
        with _Session(spark, url, properties) as session:
            other = "s.event_type <> e.event_type OR s.start_time <> e.start_time"
            inside = session.count(f"SELECT COUNT(*) FROM staged_event_{run} s, staged_event_{run} e WHERE s.event_id = e.event_id AND ({other})")
            if inside or session.count(f"SELECT COUNT(*) FROM staged_event_{run} s, event e WHERE s.event_id = e.event_id AND ({other})"):
                raise ValueError("one event id stands for different events; nothing was stored")
            for table in rows:
                names = ", ".join(columns(table))
                same = " AND ".join(f"s.{c} = {table}.{c}" for c in _KEYS[table]) if merge else f"s.event_id = {table}.event_id"
                session.run(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM staged_{table if merge else 'event'}_{run} s WHERE {same})")
                session.run(f"INSERT INTO {table} ({names}) SELECT {names} FROM staged_{table}_{run}")
    finally:
        with _Session(spark, url, properties) as session:
            for table in rows:
                if session.has(f"staged_{table}_{run}"):
                    session.run(f"DROP TABLE staged_{table}_{run}")


def load(spark: SparkSession, url: str, properties: Mapping[str, str], partitions: int = 1) -> Tables:
    """The stored tables, as searches and sinks take them; read in ``partitions`` ranges of event ids."""
    found = []
    limits = spark.read.jdbc(url, "(SELECT MIN(event_id) AS low, MAX(event_id) AS high FROM event) ids", properties=dict(properties)).first()
    for table in SCHEMA:
        if partitions > 1 and limits[0] is not None:
            frame = spark.read.jdbc(url, table, "event_id", limits[0], limits[1] + 1, partitions, properties=dict(properties))
        else:
            frame = spark.read.jdbc(url, table, properties=dict(properties))
        frame = frame.toDF(*[c.lower() for c in frame.columns])
        times = [c for c, t in frame.dtypes if t.startswith("timestamp")]
        found.append(frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}))
    return Tables(*found)
