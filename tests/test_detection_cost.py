"""What detection costs: frames that only grow, few sorts, code that the JVM compiles, and steps that run once; with the results of plain Python."""

import random

from pyspark.sql import functions as F

from fairlead.config import Drift, SuddenSpeedChange
from fairlead.operators import analyses, hysteresis, tracks
from fairlead.plans import catalog
from fairlead.sources import sample, scratch

REPORT = "mmsi int, epoch int, ts_ms long, seq long, lat double, lon double, sog float, cog float, hdg float, name string, callsign string, imo int, ship_type int, to_bow int, to_stern int, to_port int, to_starboard int"
#: Longer methods (bytes of code) are left to the JVM's interpreter.
COMPILED = 8000


def awkward(spark, n=160):
    """Two vessels with reports at equal times, silences, and speeds that are missing or no numbers."""
    rng, rows = random.Random(7), []
    for mmsi in (1, 2):
        t = 0
        for k in range(n):
            t += rng.choice([0, 10_000, 10_000, 20_000, 59_999, 60_000, 60_001, 300_000, 1_800_000, 1_800_001])
            sog = rng.choice([3.0] * 12 + [0.5, 0.5, 9.0, None, float("nan")])
            rows.append((mmsi, k // 80, t, k, 56.0 + k * 1e-3, 12.0, sog, 0.0, 90.0, "N", "C", 9, 70, 80, 20, 5, 5))
    return spark.createDataFrame(rows, REPORT)


def test_windows_are_those_of_a_plain_search(spark):
    rows = awkward(spark)
    period, history, span = 300_000, 1_800_000, 60_000
    for high, low in ((7.0, 1.0), (7.0, 5.0)):
        got = tracks.with_speed_drops(tracks.with_drift(rows, 5, 300), high, low).orderBy("mmsi", "seq").collect()
        nan = lambda x: float("inf") if x is not None and x != x else x  # noqa: E731  no number is the largest
        run = None
        for k, r in enumerate(got):
            mine = [o for o in got if (o["mmsi"], o["epoch"]) == (r["mmsi"], r["epoch"])]
            back = lambda ms: [o for o in mine if r["ts_ms"] - ms <= o["ts_ms"] <= r["ts_ms"]]
            assert r["drift_period"] == all(o["drifting"] for o in back(period))
            assert r["tracked_long"] == (r["ts_ms"] - min(o["ts_ms"] for o in back(history)) > period)
            speeds = [nan(o["sog"]) for o in back(span) if o["sog"] is not None]
            assert r["low_reported"] == (not speeds or max(speeds) <= low)
            before = got[k - 1] if k and (got[k - 1]["mmsi"], got[k - 1]["epoch"]) == (r["mmsi"], r["epoch"]) else None
            run = run if r["drifting"] and before and before["drifting"] else (r["lat"], r["lon"])
            assert (r["from_lat"], r["from_lon"]) == run
    assert {(r["drift_period"], r["tracked_long"], r["low_reported"]) for r in got} >= {(True, True, True), (False, True, False), (True, False, True)}


def test_runs_go_on_from_what_was_held(spark):
    data = [(1, 0, k, k, a, *held) for k, (a, held) in enumerate([(True, (2, False)), (True, (None, None)), (False, (None, None)), (False, (None, None)), (True, (None, None))])]
    rows = spark.createDataFrame(data, "mmsi int, epoch int, ts_ms long, seq long, abnormal boolean, held_run int, held_raised boolean")
    got = [(r["run"], r["raised"]) for r in hysteresis.with_state(rows).orderBy("seq").collect()]
    assert got == [(2, False), (3, True), (1, True), (2, True), (1, True)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def longest_method(df):
    parts = df._jdf.queryExecution().debug().codegenToSeq()
    return max(parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size()))


def test_kinematic_analyses_are_compiled_and_sorted_once_a_track(spark, sf_dir):
    rows = catalog.reports(spark, sf_dir)
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        drift, drops = analyses.drift(rows, Drift(period_minutes=5, metres=30.0)), analyses.sudden_speed_changes(rows, SuddenSpeedChange())
        assert longest_method(drift) <= COMPILED and longest_method(drops) <= COMPILED
        # by user and by vessel for the reports, by track, and by track for what is kept
        assert plan(drift).count("Sort [") <= 4
        states = hysteresis.with_state(awkward(spark).withColumn("abnormal", F.col("sog") > 2))
        assert plan(states).count("Sort [") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_vessels_meet_once(spark, monkeypatch):
    labels = []
    write = scratch.written
    monkeypatch.setattr(analyses, "written", lambda df, label: labels.append((label, plan(df).count("MapInArrow"))) or write(df, label), raising=False)
    runs = analyses.encounter_runs(sample.fleet_reports(spark, "/root/testdata/sf0.01"), catalog.ENCOUNTER)
    assert "MapInArrow" not in plan(runs) and labels == [("snapshots", 0), ("verdicts", 1)]
    assert {r["abnormal"] for r in runs.select("abnormal").distinct().collect()} == {True, False}


def test_parts_run_side_by_side_and_in_order(spark):
    import threading

    meet = threading.Barrier(3)  # broken unless all three run at once
    assert scratch.at_once(*[lambda k=k: meet.wait(60) * 0 + spark.range(k).count() for k in (3, 1, 2)]) == [3, 1, 2]
    assert scratch.at_once() == []


def test_tables_of_events_are_read_from_what_was_written(spark):
    """Points, behaviours and events do not number and describe intervals anew: their plans have no window for events."""
    from fairlead.operators import event_tables, events

    tables = event_tables.of_states(analyses.drift(catalog.reports(spark, "/root/testdata/sf0.01"), Drift(period_minutes=5, metres=30.0)), events.DRIFT)
    assert "Window" not in plan(tables.events) and "Window" not in plan(tables.behaviours) and plan(tables.points).count("Window [") == 1
    assert tables.events.count() == tables.behaviours.count() > 0
