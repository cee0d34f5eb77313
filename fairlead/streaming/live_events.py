"""Events out of a stream: every micro-batch goes on with detection where the one before ended.

A micro-batch is a run of :func:`fairlead.operators.resume.detect`.  What it must hand
on lies in tables below ``state``, one folder for each batch, completed by their last
table.  Events are merged into the store by their ids and each batch's pairs go to a
place of its own, so a batch that is tried again changes nothing.  Runs of the clock
are closed ``late_minutes`` behind the newest report.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fairlead.config import Settings
from fairlead.operators import resume

Split = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
Sink = Callable[[resume.Found, int], None]


@dataclass
class State:
    """The folders of carried tables of one stream."""

    path: str

    def _files(self, spark: SparkSession):
        make = spark._jvm.org.apache.hadoop.fs.Path
        return make, make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, spark: SparkSession) -> list[int]:
        """Batches whose state is complete."""
        make, fs = self._files(spark)
        if not fs.exists(make(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(make(self.path))]
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(make(f"{self.path}/{n}/closed/_SUCCESS")))

    def load(self, spark: SparkSession, number: int) -> resume.Carry:
        """What the newest batch before this one left."""
        before = [n for n in self.numbers(spark) if n < number]
        return resume.load(spark, f"{self.path}/batch={before[-1]}") if before else resume.Carry()

    def save(self, spark: SparkSession, carry: resume.Carry, number: int) -> None:
        """Complete a batch; of the earlier ones only the last stays."""
        resume.save(carry, f"{self.path}/batch={number}")
        make, fs = self._files(spark)
        for old in self.numbers(spark)[:-2]:
            fs.delete(make(f"{self.path}/batch={old}"), True)


def follow(batch: DataFrame, number: int, split: Split, stats: DataFrame | None, settings: Settings, sink: Sink, state: State, late_minutes: int = 10, ended: bool = False) -> None:
    """One micro-batch; nothing if it was completed before. ``ended`` closes all that is open to the clock."""
    spark = batch.sparkSession
    if number in state.numbers(spark):
        return
    carry = state.load(spark, number)
    positions, statics = split(batch)
    newest = positions.agg(F.max("ts_ms")).first()[0]
    if newest is None and carry.reports is None:
        return
    if newest is None:
        newest = carry.reports.agg(F.max("ts_ms")).first()[0]
    late = -2 * 60_000 if ended else late_minutes * 60_000
    found = resume.detect(positions, statics, stats, settings, carry, newest - late)
    sink(found, number)
    state.save(spark, found.carry, number)


def start(messages: DataFrame, split: Split, stats: DataFrame | None, settings: Settings, sink: Sink, state: str, checkpoint: str, late_minutes: int = 10, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Follow a stream; ``split`` makes positions and static reports of a batch, ``trigger`` is Spark's (default: each minute)."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()  # both kinds of report are read from it
        try:
            follow(batch, number, split, stats, settings, sink, State(state), late_minutes)
        finally:
            batch.unpersist()

    every = dict(trigger or {"processingTime": "1 minute"})
    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**every).start()


def drain(query: StreamingQuery) -> None:
    """Stop when all that has arrived is processed and stored; nothing is cut off in the middle."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def into_store(values: Mapping[str, str]) -> Sink:
    """Events into the store that a settings file names, by merge; each batch's pairs below their own folder."""
    from fairlead.plans import jobs
    from fairlead.sources import event_files

    def put(found: resume.Found, number: int) -> None:
        tables = found.tables
        jobs.store(jobs.Detected(*((tables.events, tables.behaviours, tables.points) if tables else (None,) * 3), None), values, merge=True)
        if found.flow is not None:
            event_files.write_csv(event_files.free_flow_rows(found.flow), f"{values['analysis.freeflow.csvfile']}/batch={number}", "overwrite")

    return put
