"""Raise and lower with hysteresis, by windows alone.

A contrary verdict always resets the count, so the state is the last trigger: a
run of ``raise_after`` abnormal verdicts raises, a run of ``lower_after`` normal
ones lowers.  Tracks (vessel and epoch) start anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RAISE_AFTER, LOWER_AFTER = 3, 5
# Certainty of a tracking point, stored as its number.
CERTAINTY = ("UNDEFINED", "LOWERED", "UNCERTAIN", "RAISED")


def with_state(verdicts: DataFrame, raise_after: int = RAISE_AFTER, lower_after: int = LOWER_AFTER) -> DataFrame:
    """Adds raised, transition (RAISE, MAINTAIN, LOWER or null), run and certainty to rows with ``abnormal``.

    A track that goes on from an earlier run begins with its last row there, with ``held_run`` and ``held_raised``.
    """
    track = Window.partitionBy("mmsi", "epoch").orderBy("ts_ms", "seq")
    so_far = track.rowsBetween(Window.unboundedPreceding, 0)
    change = F.coalesce(F.col("abnormal") != F.lag("abnormal").over(track), F.lit(False))
    rows = verdicts.withColumn("_change", change).withColumn("_k", F.row_number().over(track))
    # the number before a run's first, less what an earlier run counted: runs are counted in the track's own order
    before = F.coalesce(F.col("held_run") - 1, F.lit(0)) if "held_run" in verdicts.columns else F.lit(0)
    start = F.when(F.col("_change") | (F.col("_k") == 1), F.col("_k") - 1 - before)
    rows = rows.withColumn("_start", start).withColumn("run", (F.col("_k") - F.last("_start", ignorenulls=True).over(so_far)).cast("int"))
    trigger = F.when(F.col("abnormal") & (F.col("run") >= raise_after), True).when(~F.col("abnormal") & (F.col("run") >= lower_after), False)
    rows = rows.withColumn("_trigger", F.coalesce("held_raised", trigger) if "held_raised" in verdicts.columns else trigger)
    rows = rows.withColumn("raised", F.coalesce(F.last("_trigger", ignorenulls=True).over(so_far), F.lit(False)))
    before = F.coalesce(F.lag("raised").over(track), F.lit(False))
    rows = rows.withColumn("_before", before)
    step = F.when(F.col("raised") & ~F.col("_before"), "RAISE").when(F.col("raised"), "MAINTAIN").when(F.col("_before"), "LOWER")
    sure = F.when(F.col("raised") & F.col("abnormal"), 3).when(F.col("raised") | F.col("abnormal"), 2).otherwise(1)
    return rows.withColumn("transition", step).withColumn("certainty", sure.cast("int")).drop("_change", "_k", "_start", "_trigger", "_before")


def transitions(states: DataFrame) -> DataFrame:
    return states.where("transition is not null")
