"""Live detection: one state for each vessel follows its cell, its silences and the hysteresis.

The statistics are a static table joined by cell before the state; the state is
four numbers, so a vessel's history is never kept.  A vessel that is silent past
``stale_minutes`` of event time is lowered by a timer and its state removed.
Reports that arrive behind a vessel's newest one are left out, as the watermark
leaves out those behind all.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairlead.config import Statistical
from fairlead.functions.geo import Grid
from fairlead.operators import analyses, statistics
from fairlead.operators.hysteresis import LOWER_AFTER, RAISE_AFTER

OUTPUT = "mmsi int, ts_ms long, cell_id long, abnormal boolean, raised boolean, transition string"
STATE = "ts_ms long, cell_id long, raised boolean, score int"


def _follow(stale_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        last, cell, raised, score = state.get if state.exists else (None, None, False, 0)
        if state.hasTimedOut:
            if raised:
                out.append((key[0], last, cell, None, False, "LOWER"))
            state.remove()
        else:
            rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts_ms", "seq"], kind="stable")
            for r in rows.itertuples(index=False):
                if last is not None and r.ts_ms < last:
                    continue
                if last is not None and r.ts_ms - last > stale_ms:
                    if raised:
                        out.append((key[0], last, cell, None, False, "LOWER"))
                    cell, raised, score = None, False, 0
                changed, cell, last = cell != r.cell_id, int(r.cell_id), int(r.ts_ms)
                if not changed or not r.analysed:
                    continue
                before = raised
                if bool(r.abnormal) == raised:
                    score = 0
                else:
                    score += 1
                    if score >= (LOWER_AFTER if raised else RAISE_AFTER):
                        raised, score = not raised, 0
                step = "RAISE" if raised and not before else "MAINTAIN" if raised else "LOWER" if before else None
                out.append((key[0], last, cell, bool(r.abnormal), raised, step))
            if last is not None:
                state.update((last, cell, raised, score))
                if state.getCurrentWatermarkMs() < last + stale_ms:
                    state.setTimeoutTimestamp(last + stale_ms)
        if out:
            yield pd.DataFrame(out, columns=["mmsi", "ts_ms", "cell_id", "abnormal", "raised", "transition"]).astype({"abnormal": object})

    return run


def transitions(reports: DataFrame, stats: DataFrame, statistic: str, params: Statistical, stale_minutes: int = 30, late_minutes: int = 10) -> DataFrame:
    """Stream of verdicts and transitions of one statistical analysis, from a stream of reports with cells."""
    judged = analyses.judged(reports, stats, statistic, params).withColumn("ts", F.timestamp_millis("ts_ms")).where("cell_id is not null")
    rows = judged.select("mmsi", "ts_ms", "seq", "ts", "cell_id", "analysed", "abnormal").withWatermark("ts", f"{late_minutes} minutes")
    return rows.groupBy("mmsi").applyInPandasWithState(_follow(stale_minutes * 60_000), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def learn(changes: DataFrame, path: str, checkpoint: str, grid: Grid | None = None, downsampling: int = 0, trigger: Mapping[str, object] | None = None):
    """Stream of cell changes into the statistics store: each batch adds a part with its own counts.

    The version names the stream and the batch, so a batch that is tried again after its write counts once.
    ``trigger`` is Spark's (default: all that is there).
    """
    from fairlead.sources import statistics_store

    def add(batch: DataFrame, number: int) -> None:
        try:
            _, metadata = statistics_store.read_metadata(batch.sparkSession, path, content=False)
            if metadata.stream == checkpoint and metadata.batch is not None and number <= metadata.batch:
                return
        except FileNotFoundError:
            metadata = statistics_store.Metadata((grid or Grid()).resolution, downsampling)
        statistics_store.append(statistics.train(batch), path, replace(metadata, stream=checkpoint, batch=number))

    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**dict(trigger or {"availableNow": True})).start()
