"""Live pairs of vessels: a run is closed by the watermark, and its vessels then meet as in batch.

Each vessel's latest report at each run is a streaming aggregate, whose state is the
few runs that are still open.  All of a run's rows leave it in the same micro-batch,
which the batch operators analyse; a batch that is tried again overwrites its folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fairlead.config import CloseEncounter, FreeFlow
from fairlead.operators import analyses
from fairlead.operators.pairs import NEAR_MS


def closed_runs(reports: DataFrame, run_ms: int, keep_ms: int = NEAR_MS, late_minutes: int = 10) -> DataFrame:
    """Stream of each vessel's latest report at each run, with ``run_ms``."""
    first = (F.ceil(F.col("ts_ms") / run_ms) * run_ms).cast("long")
    rows = reports.where("lat is not null and lon is not null").withColumn("_first", first).where(F.col("_first") <= F.col("ts_ms") + keep_ms - 1)
    rows = rows.withColumn("_at", F.explode(F.sequence("_first", F.col("ts_ms") + keep_ms - 1, F.lit(run_ms).cast("long")))).withColumn("run", F.timestamp_millis("_at")).drop("_first", "_at")
    latest = F.max_by(F.struct(*reports.columns), F.struct("ts_ms", "seq")).alias("r")
    runs = rows.withWatermark("run", f"{late_minutes} minutes").groupBy("run", "mmsi").agg(latest)
    return runs.select(F.unix_millis("run").alias("run_ms"), "r.*")


def _start(runs: DataFrame, analyse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    def add(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return runs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encounter_runs(reports: DataFrame, params: CloseEncounter, path: str, checkpoint: str, late_minutes: int = 10) -> StreamingQuery:
    """Rows of ``analyses.encounter_runs`` for every closed run, below ``path``."""
    runs = closed_runs(reports, params.run_seconds * 1000, late_minutes=late_minutes)
    return _start(runs, lambda batch: analyses.encounter_runs(batch, params), path, checkpoint)


def free_flow(reports: DataFrame, params: FreeFlow, path: str, checkpoint: str, late_minutes: int = 10) -> StreamingQuery:
    """Rows of ``analyses.free_flow`` for every closed run, below ``path``."""
    runs = closed_runs(reports.where(analyses.free_flow_guard(params)), params.run_seconds * 1000, late_minutes=late_minutes)
    return _start(runs, lambda batch: analyses.free_flow(batch, params), path, checkpoint)
