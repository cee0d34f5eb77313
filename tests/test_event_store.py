"""The event store of files: saves over several runs, pruned searches, writers that fail or meet."""

import re

import pytest
from pyspark.sql import functions as F

from fairlead.operators import search
from fairlead.operators.event_tables import Tables
from fairlead.plans import catalog, jobs
from fairlead.sources import event_store, sample


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(*[t.persist() for t in sample.event_store(spark, sf_dir)])


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('events')}/store"
    event_store.save(tables, path)
    return path


def of(tables, condition):
    events = tables.events.where(condition)
    return Tables(events, tables.behaviours.join(events, "event_id", "left_semi"), tables.points.join(events, "event_id", "left_semi"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def opened(df):
    """The files that a plan reads."""
    return set(df.inputFiles())


def test_all_rows_come_back(spark, tables, stored):
    for got, want in zip(vars(event_store.read(spark, stored)).values(), vars(tables).values(), strict=True):
        assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("conditions", [{}, {"begin": catalog.SPAN[0]}, {"end": catalog.SPAN[1]}, {"begin": catalog.SPAN[0], "end": catalog.SPAN[1], "area": catalog.AREA}, {"area": (90.0, 180.0, -90.0, -180.0)}, {"vessel": "VESSEL", "event_type": "DriftEvent"}])
def test_searches_equal_those_over_all_rows(spark, tables, stored, conditions):
    assert rows(event_store.search(spark, stored, **conditions)) == rows(search.search(tables.events, tables.behaviours, tables.points, **conditions))


def test_other_searches(spark, tables, stored):
    assert event_store.between(spark, stored, *catalog.SPAN).collect() == search.events_between(tables.events, *catalog.SPAN).collect()
    for n in (1, 30, 5000):
        assert event_store.recent(spark, stored, n).collect() == search.recent_events(tables.events, n).collect()
    assert event_store.ongoing(spark, stored, 219000008, "CloseEncounterEvent").collect() == search.ongoing_event(tables.events, tables.behaviours, 219000008, "CloseEncounterEvent").collect()


def test_searches_open_few_files(spark, stored):
    every = event_store.spanned(spark, stored)
    span = event_store.spanned(spark, stored, *catalog.SPAN)
    days = {re.search(r"day=([0-9-]+)", f)[1] for f in span.events.inputFiles()}
    assert "2024-01-05" in days and "2024-01-12" in days and max(days) == "2024-01-12" and min(days) >= "2024-01-04"
    assert len(opened(span.points)) < len(opened(every.points)) / 2
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*last#", plan(span.events))
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", plan(event_store.spanned(spark, stored, area=catalog.AREA).points))
    assert event_store.spanned(spark, stored, "2030-01-01", "2030-02-01").events.count() == 0


def test_an_event_over_days_is_found_by_its_end(spark, tmp_path, tables):
    long = of(tables, "event_id = 1")
    long.events = long.events.withColumn("end_time", F.expr("start_time + INTERVAL 40 DAYS"))
    path = f"file://{tmp_path}/store"
    event_store.save(long, path)
    start = long.events.first()["start_time"]
    late = (start.replace(hour=0) + (long.events.first()["end_time"] - start)).isoformat()
    assert event_store.search(spark, path, begin=late).count() == 1 == search.search(long.events, long.behaviours, long.points, begin=late).count()


def test_runs_stand_side_by_side_and_repeats_change_nothing(spark, tables, tmp_path):
    path = f"file://{tmp_path}/store"
    half = of(tables, "start_time < TIMESTAMP_NTZ '2024-01-15 12:00:00'")
    for part in (half, of(tables, "start_time >= TIMESTAMP_NTZ '2024-01-15 12:00:00'"), half):
        event_store.save(part, path)
    assert rows(event_store.read(spark, path).events) == rows(tables.events) and rows(event_store.read(spark, path).points) == rows(tables.points)
    before = event_store.days(spark, path)
    event_store.save(of(tables, "event_id = 7"), path)
    after = event_store.days(spark, path)
    assert sum(before[d] != after[d] for d in before) == 1  # only the event's day was written
    assert event_store.vacuum(spark, path) > 0 and rows(event_store.read(spark, path).behaviours) == rows(tables.behaviours)


def test_merge_keeps_what_is_not_written_again(spark, tables, tmp_path):
    path = f"file://{tmp_path}/store"
    whole = of(tables, "event_id = 2")
    first = whole.points.orderBy("ts").limit(1)
    later = Tables(whole.events.withColumn("title", F.lit("x")), whole.behaviours.limit(0), whole.points.join(first.select("ts"), "ts", "left_anti"))
    event_store.save(Tables(whole.events, whole.behaviours, first), path)
    event_store.save(later, path, merge=True)
    found = event_store.read(spark, path)
    assert rows(found.points) == rows(whole.points) and rows(found.behaviours) == rows(whole.behaviours) and [r["title"] for r in found.events.collect()] == ["x"]
    event_store.save(later, path)
    assert event_store.read(spark, path).behaviours.count() == 0 and event_store.search(spark, path).count() == 1


def test_what_is_refused_changes_nothing(spark, tables, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    one = of(tables, "event_id = 3")
    event_store.save(one, path)
    kept = rows(event_store.read(spark, path).events)
    for change, words in (({"event_type": F.lit("Other")}, "different"), ({"end_time": F.expr("start_time - INTERVAL 1 DAY")}, "before they start"), ({"start_time": F.lit(None).cast("timestamp_ntz")}, "no id")):
        with pytest.raises(ValueError, match=words):
            event_store.save(Tables(one.events.withColumns(change), one.behaviours, one.points), path)
    publish = event_store._publish

    def beaten(spark, path, number, found):
        publish(spark, path, number, event_store.days(spark, path))  # another writer came first
        publish(spark, path, number, found)

    monkeypatch.setattr(event_store, "_publish", beaten)
    with pytest.raises(RuntimeError, match="another writer"):
        event_store.save(of(tables, "event_id < 9"), path)
    assert rows(event_store.read(spark, path).events) == kept


def test_awkward_rows(spark, tables, tmp_path):
    path = f"file://{tmp_path}/store"
    event_store.save(of(tables, "false"), path)
    assert event_store.days(spark, path) == {} and event_store.read(spark, path).events.count() == 0 and event_store.search(spark, path).count() == 0
    some = of(tables, "event_id < 40")
    odd = Tables(
        some.events.unionByName(some.events.where("event_id = 5")).withColumn("description", F.when(F.col("event_id") == 6, F.repeat(F.lit("x"), 1_000_000))).withColumn("day", F.lit("clash")).withColumn("last", F.lit(1)),
        tables.behaviours.withColumn("version", F.lit("clash")), some.points.withColumn("lat", F.when(F.col("event_id") != 5, F.col("lat"))).withColumn("cell", F.lit("clash")),
    )
    event_store.save(odd, path)
    found = event_store.read(spark, path)
    assert found.events.where("event_id = 5").count() == 2 and found.events.where("length(description) = 1000000").count() == 1
    assert rows(found.behaviours) == rows(some.behaviours) and rows(found.points) == rows(odd.points.select(*found.points.columns))
    assert not event_store.search(spark, path, area=(90.0, 180.0, -90.0, -180.0)).where("event_id = 5").count()


def test_whole_days_can_go(spark, tables, stored, tmp_path):
    path = f"file://{tmp_path}/store"
    event_store.save(tables, path)
    event_store.delete(spark, path, ["2024-01-05", "1999-01-01"])
    assert rows(event_store.read(spark, path).events) == rows(tables.events.where("to_date(start_time) <> DATE '2024-01-05'"))


def test_the_job_takes_the_store_that_settings_name(spark, tables, tmp_path):
    some = of(tables, "event_id < 20")
    jobs.store(jobs.Detected(some.events, some.behaviours, some.points, None), {"events.repository.type": "Parquet", "events.parquet.path": f"file://{tmp_path}/store"})
    assert rows(event_store.read(spark, f"file://{tmp_path}/store").events) == rows(some.events)
