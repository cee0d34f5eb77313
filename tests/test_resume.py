"""Detection in several runs against one run over all, in batch and from a stream."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fairlead import config
from fairlead.config import Drift, Statistical, SuddenSpeedChange
from fairlead.operators import resume, tracks
from fairlead.plans import catalog
from fairlead.sources import sample

SF = "/root/testdata/sf0.01"
LEARNED = Statistical(True, 4, 0.25)
OFF = config.Settings(course=Statistical(False), speed=Statistical(False), type_size=Statistical(False))
OFF = replace(OFF, drift=replace(OFF.drift, enabled=False), speed_change=replace(OFF.speed_change, enabled=False), encounter=replace(OFF.encounter, enabled=False), free_flow=replace(OFF.free_flow, enabled=False), down_sample_seconds=0)
TRACKS = replace(OFF, course=LEARNED, speed=LEARNED, type_size=LEARNED, drift=Drift(enabled=True, period_minutes=5, metres=30.0), speed_change=SuddenSpeedChange(enabled=True))
FLEET = replace(OFF, encounter=catalog.ENCOUNTER, free_flow=catalog.FLOW)


def parts_of(reports):
    statics = reports.groupBy("mmsi").agg((F.min("ts_ms") - 1).alias("ts_ms"), F.lit(0).cast("long").alias("seq"), *[F.first(c).alias(c) for c in tracks.STATIC])
    return reports.drop("epoch", "cell_id"), statics


def rows(tables):
    events = {(r["event_id"], r["event_type"], r["state"], r["start_time"], r["end_time"], r["title"], r["description"]) for r in tables.events.collect()}
    behaviours = {tuple(r) for r in tables.behaviours.collect()}
    return {e[0]: e for e in events}, {(b[0], b[1]): b for b in behaviours}, {(p["event_id"], p["mmsi"], p["ts"]): p["certainty"] for p in tables.points.collect()}


def in_runs(positions, statics, stats, settings, cuts, tmp_path, until=None):
    """What the store and the pair file have after runs over the spans between the cuts."""
    store, flow, carry = ({}, {}, {}), [], None
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = positions if low is None else positions.where(F.col("ts_ms") > low)
        part = part if high is None else part.where(F.col("ts_ms") <= high)
        known = statics if k == 0 else statics.limit(0)
        found = resume.detect(part, known, stats, settings, carry, until if high is None else None)
        for kept, new in zip(store, rows(found.tables), strict=True):
            kept.update(new)
        if found.flow is not None:
            flow += [(r["a_mmsi"], r["b_mmsi"], r["a_ts_ms"], r["run_ms"]) for r in found.flow.collect()]
        resume.save(found.carry, f"file://{tmp_path}/carry-{k}")
        carry = resume.load(positions.sparkSession, f"file://{tmp_path}/carry-{k}")
    return store, sorted(flow), carry


@pytest.mark.parametrize("name, settings", [("tracks", TRACKS), ("dense", replace(TRACKS, interpolation_seconds=4, course=Statistical(False))), ("fleet", FLEET)])
def test_runs_over_parts_equal_one_over_all(spark, tmp_path, name, settings):
    reports = sample.fleet_reports(spark, SF) if name == "fleet" else catalog.reports(spark, SF)
    stats = None if name == "fleet" else catalog.stats(spark, SF)
    positions, statics = parts_of(reports)
    cuts = [positions.selectExpr(f"percentile_approx(ts_ms, {p}) AS t").first()["t"] for p in ((0.5,) if name == "dense" else (0.4, 0.7))]
    late = positions.agg(F.max("ts_ms")).first()[0] + 120_000
    want = in_runs(positions, statics, stats, settings, [], f"{tmp_path}/one", late)
    got = in_runs(positions, statics, stats, settings, cuts, f"{tmp_path}/many", late)
    assert got[0][0] == want[0][0] and got[0][1] == want[0][1]
    assert got[0][2] == want[0][2] and got[1] == want[1]
    assert len({e[1] for e in want[0][0].values()}) >= (1 if name == "fleet" else 4) and (want[1] or name != "fleet")
    assert got[2].reports.count() < positions.count() / (1 if name == "dense" else 2)


def test_stream_of_reports_fills_the_store_as_one_run_does(spark, tmp_path, monkeypatch):
    from fairlead.sources import relational
    from fairlead.streaming import live_events

    address = "jdbc:derby:memory:live;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    monkeypatch.setattr(relational, "url_of", lambda values: address)
    settings = replace(TRACKS, course=Statistical(False), type_size=Statistical(False))
    stats = catalog.stats(spark, SF)
    positions, statics = parts_of(catalog.reports(spark, SF))
    both = positions.unionByName(statics.withColumn("lat", F.lit(None).cast("double")), allowMissingColumns=True).withColumn("static", F.col("lat").isNull())
    middle = positions.selectExpr("percentile_approx(ts_ms, 0.5) AS t").first()["t"]
    for k, part in enumerate((both.where(F.col("static") | (F.col("ts_ms") <= middle)), both.where(~F.col("static") & (F.col("ts_ms") > middle)))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    split = lambda batch: (batch.where("not static").select(*positions.columns), batch.where("static").select(*statics.columns))
    state = f"file://{tmp_path}/state"
    failed = []

    def sink(found, number):
        live_events.into_store({})(found, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after it was stored")

    begin = lambda: live_events.start(stream, split, stats, settings, sink, state, f"{tmp_path}/cp", trigger={"availableNow": True})
    with pytest.raises(Exception, match="lost after"):
        begin().awaitTermination(200)
    begin().awaitTermination(200)  # the batch is tried again
    assert failed and live_events.State(state).numbers(spark) == [0, 1]
    want = rows(resume.detect(positions, statics, stats, settings).tables)
    back = relational.load(spark, *address)
    got = {r["event_id"]: (r["event_type"], r["state"], r["start_time"], r["end_time"]) for r in back.events.collect()}
    assert got == {k: e[1:5] for k, e in want[0].items()} and len({e[0] for e in got.values()}) == 3
    assert {(p["event_id"], p["mmsi"], p["ts"]): p["certainty"] for p in back.points.collect()} == want[2] and back.behaviours.count() == len(want[1])


def test_files_are_followed_at_a_limited_rate_and_once(spark, tmp_path):
    from fairlead.streaming import feed, live_events

    line = "!AIVDM,1,1,,B,133m@ogP00PD;88MD5MTDww@2D7k,0*46"
    for k in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join([line] * (k + 1)) + "\n")
    stream = feed.from_folder(spark, f"file://{tmp_path}/in", files_at_once=2)
    seen = []
    for _ in range(2):  # stopped and begun again: nothing comes twice
        query = stream.writeStream.foreachBatch(lambda batch, number: seen.append(batch.count())).option("checkpointLocation", f"{tmp_path}/cp").start()
        live_events.drain(query)
        assert not query.isActive
    assert sum(seen) == 15 and len([n for n in seen if n]) == 3
