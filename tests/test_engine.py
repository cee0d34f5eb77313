"""State machines against plain Python, goldens of analyses, stores, settings and streams."""

import random

import pytest
from pyspark.sql import functions as F

from fairlead import config
from fairlead.config import Drift, Statistical, SuddenSpeedChange
from fairlead.operators import analyses, events, filters, hysteresis, search, statistics, tracks
from fairlead.operators.statistics import COURSE, TYPE_SIZE
from fairlead.plans import catalog, jobs
from fairlead.sources import event_files, nmea, sample, statistics_store
from fairlead.streaming import live

REPORT = "mmsi int, epoch int, ts_ms long, seq long, lat double, lon double, sog float, cog float, hdg float, name string, callsign string, imo int, ship_type int, to_bow int, to_stern int, to_port int, to_starboard int"


def vessel_track(spark, rows, ship_type=70, bow=80, stern=20):
    """rows of (ts_ms, lat, lon, sog, cog, hdg)."""
    data = [(1, 0, t, i, lat, lon, sog, cog, hdg, "NAME", "CALL", 9, ship_type, bow, stern, 5, 5) for i, (t, lat, lon, sog, cog, hdg) in enumerate(rows)]
    return spark.createDataFrame(data, REPORT)


def sequential(verdicts, raise_after=3, lower_after=5):
    raised, score, out = False, 0, []
    for abnormal in verdicts:
        before = raised
        if abnormal == raised:
            score = 0
        else:
            score += 1
            if score >= (lower_after if raised else raise_after):
                raised, score = not raised, 0
        step = "RAISE" if raised and not before else "MAINTAIN" if raised else "LOWER" if before else None
        certainty = 1 if not raised and score == 0 else 3 if raised and score == 0 else 2
        out.append((raised, step, certainty))
    return out


def test_hysteresis_equals_the_sequential_machine(spark):
    rng = random.Random(5)
    data, want = [], []
    for mmsi in range(6):
        verdicts = [rng.random() < (0.5 if mmsi % 2 else 0.8 if k // 20 % 2 else 0.2) for k in range(300)]
        want += [(mmsi, k, *w) for k, w in enumerate(sequential(verdicts))]
        data += [(mmsi, 0, k * 1000, k, v) for k, v in enumerate(verdicts)]
    rows = spark.createDataFrame(data, "mmsi int, epoch int, ts_ms long, seq long, abnormal boolean")
    got = hysteresis.with_state(rows).select("mmsi", "seq", "raised", "transition", "certainty").orderBy("mmsi", "seq").collect()
    assert [tuple(r) for r in got] == want


def test_certainty_golden(spark):
    verdicts = [False, True, True, True, True, False, True] + [False] * 5
    rows = spark.createDataFrame([(1, 0, k, k, v) for k, v in enumerate(verdicts)], "mmsi int, epoch int, ts_ms long, seq long, abnormal boolean")
    got = [r["certainty"] for r in hysteresis.with_state(rows).orderBy("seq").collect()]
    assert got == [1, 2, 2, 3, 3, 2, 3, 2, 2, 2, 2, 1]


def _stats(spark, cell, table, statistic):
    return spark.createDataFrame([(statistic, cell, a, b, c, n) for (a, b, c), n in table.items()], "statistic string, cell_id long, k1 int, k2 int, k3 int, ship_count long")


@pytest.mark.parametrize("key, abnormal", [((1, 1), True), ((2, 2), True), ((2, 3), False)])
def test_type_size_golden(spark, key, abnormal):
    table = {(2, 0): 17, (2, 1): 87, (2, 2): 2, (2, 3): 618, (3, 2): 842, (3, 3): 954, (4, 2): 154, (5, 3): 34}
    stats = _stats(spark, 7, {(*k, None): n for k, n in table.items()}, TYPE_SIZE)
    ship = {1: 70, 2: 60}[key[0]]  # stored keys count from 0: cargo and passenger
    length = {1: 49, 2: 99, 3: 199}[key[1]]
    rows = vessel_track(spark, [(0, 56.0, 12.0, 10.0, 10.0, 10.0)], ship, length, 0).withColumn("cell_id", F.lit(7).cast("long"))
    got = analyses.judged(rows, stats, TYPE_SIZE, Statistical(True, 1000, 0.001)).first()
    assert (got["total"], got["own"], got["abnormal"]) == (sum(table.values()), table.get(key, 0), abnormal)


def test_few_ships_are_never_abnormal(spark):
    stats = _stats(spark, 7, {(1, 3, 4): 600, (1, 3, 5): 399}, COURSE)
    rows = vessel_track(spark, [(0, 56.0, 12.0, 10.0, 200.0, 10.0)], 70, 150, 20).withColumn("cell_id", F.lit(7).cast("long"))
    assert not analyses.judged(rows, stats, COURSE, Statistical(True, 1000, 0.001)).first()["abnormal"]
    assert analyses.judged(rows, stats, COURSE, Statistical(True, 900, 0.001)).first()["abnormal"]


def test_unseen_cell_is_normal(spark):
    stats = _stats(spark, 8, {(1, 3, 4): 6000}, COURSE)
    rows = vessel_track(spark, [(0, 56.0, 12.0, 10.0, 200.0, 10.0)]).withColumn("cell_id", F.lit(7).cast("long"))
    assert not analyses.judged(rows, stats, COURSE, Statistical(True, 10, 0.9)).first()["abnormal"]


@pytest.mark.parametrize("sog, cog, hdg, drifting", [(3.0, 0.0, 90.0, True), (3.0, 0.0, 45.0, False), (3.0, 0.0, 46.0, True), (3.0, 0.0, 135.0, False), (3.0, 0.0, 134.0, True), (0.9, 0.0, 90.0, False), (5.1, 0.0, 90.0, False), (1.0, 350.0, 80.0, True), (3.0, None, 90.0, False)])
def test_drift_predicate(spark, sog, cog, hdg, drifting):
    rows = vessel_track(spark, [(0, 56.0, 12.0, sog, cog, hdg)])
    assert rows.select(tracks.is_drifting()).first()[0] is drifting


def test_drift_needs_period_and_distance(spark):
    far = [(t * 7000, 56.0 + t * 1e-4, 12.0, 3.0, 0.0, 90.0) for t in range(120)]
    near = [(t * 7000, 56.0 + t * 1e-5, 12.0, 3.0, 0.0, 90.0) for t in range(120)]
    short = far[:60]
    for rows, raised in ((far, True), (near, False), (short, False)):
        got = analyses.drift(vessel_track(spark, rows), Drift()).where("raised").count() > 0
        assert got is raised


def speed_drop(spark, rows):
    return analyses.sudden_speed_changes(vessel_track(spark, rows), SuddenSpeedChange()).collect()


def test_sudden_speed_change_fires_after_sustained_low_speed(spark):
    rows = [(0, 56.0, 12.0, 12.2, 0.0, 0.0)] + [(8000 * k, 56.0, 12.0, 0.1, 0.0, 0.0) for k in range(1, 12)]
    (event,) = speed_drop(spark, rows)
    assert (event["start_ms"], event["end_ms"]) == (0, 8000)


def test_no_sudden_speed_change(spark):
    gap = [(0, 56.0, 12.0, 12.2, 0.0, 0.0)] + [(61_000 + 8000 * k, 56.0, 12.0, 0.1, 0.0, 0.0) for k in range(12)]
    slower = [(0, 56.0, 12.0, 22.2, 0.0, 0.0)] + [(8000 * k, 56.0, 12.0, 9.0, 0.0, 0.0) for k in range(1, 12)]
    moving = [(0, 56.0, 12.0, 12.2, 0.0, 0.0)] + [(8000 * k, 56.0 + k * 1e-3, 12.0, 0.1, 0.0, 0.0) for k in range(1, 12)]
    assert not speed_drop(spark, gap) and not speed_drop(spark, slower) and not speed_drop(spark, moving)


def test_down_sampling_is_greedy_across_batches(spark):
    rng = random.Random(3)
    rows = [(m, rng.randrange(0, 200_000), k) for m in range(3) for k in range(200)]
    got = {(r["mmsi"], r["ts_ms"], r["seq"]) for r in filters.down_sample(spark.createDataFrame(rows, "mmsi int, ts_ms long, seq long"), 7).collect()}
    want = set()
    for m in range(3):
        last = None
        for _, t, k in sorted(r for r in rows if r[0] == m):
            if last is None or t - last >= 7000:
                want.add((m, t, k))
                last = t
    assert got == want


def test_mask_boxes_and_large_masks(spark, monkeypatch):
    xml = '<areas><area_polygon name="a"><polygon><point lat="55.0" lon="11.0"/><point lat="55.5" lon="10.5"/></polygon><polygon><point lat="x" lon="1"/></polygon></area_polygon></areas>'
    assert filters.mask_boxes(xml) == [(55.0, 55.5, 10.5, 11.0)]
    points = spark.createDataFrame([(55.2, 10.7), (55.2, 11.2), (None, None), (-33.5, -70.5)], "lat double, lon double")
    boxes = spark.createDataFrame([(55.0, 55.5, 10.5, 11.0), (-34.0, -33.0, -71.0, -70.0)], "south double, north double, west double, east double")
    small = sorted(map(str, filters.outside_mask(points, boxes).collect()))
    monkeypatch.setattr(filters, "BROADCAST_BOXES", 1)
    assert sorted(map(str, filters.outside_mask(points, boxes).collect())) == small
    assert len(small) == 2


TEMPLATE = "\n".join(f"{k} = " + ("true" if k.endswith("enabled") else "h2" if k == "events.repository.type" else "55.8, 11.2, 54.7, 10.6" if k.endswith("freeflow.bbox") else "" if "skip" in k or "expression" in k else "5") for k in config.KEYS)


def test_settings(spark):
    values = config.parse_properties("# note\n" + TEMPLATE)
    assert config.problems(values) == []
    made = config.settings(values)
    assert made.free_flow.box == (55.8, 11.2, 54.7, 10.6) and made.drift.enabled and made.course.least_count == 5
    for key, value, words in (("events.repository.type", "oracle", "one of"), ("analysis.cog.pd", "x", "no number"), ("analysis.freeflow.bbox", "1,2", "four numbers"), ("analysis.freeflow.run.period", "0", "above")):
        assert any(words in p for p in config.problems(values | {key: value}))
    missing = dict(values)
    del missing["events.csv.file"]
    with pytest.raises(ValueError, match="missing key"):
        config.settings(missing)


def test_store_versions(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one = _stats(spark, 7, {(1, 2, 3): 5, (1, 2, 4): 6}, COURSE)
    meta = statistics_store.Metadata(0.0018, 60)
    assert [statistics_store.write(one, path, meta) for _ in range(3)] == [1, 2, 3]
    assert statistics_store.versions(spark, path) == [2, 3]
    stats, found = statistics_store.read(spark, path)
    assert found == meta and sorted(map(tuple, stats.collect())) == sorted(map(tuple, one.collect()))
    assert statistics_store.get(stats, COURSE, 7).count() == 2 and statistics_store.get(stats, TYPE_SIZE, 7).count() == 0
    for f in (tmp_path / "store/v3/metadata").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "store/v3/metadata").glob(".*.crc"):
        f.unlink()
    assert statistics_store.read_metadata(spark, path)[0] == 2 and statistics_store.versions(spark, path) == [2, 3]  # readers rename nothing
    assert statistics_store.write(one, path, meta) == 4
    assert statistics_store.versions(spark, path) == [2, 4] and (tmp_path / "store/v3.corrupt").exists()
    for f in [f for d in (tmp_path / "store/v4/statistics").iterdir() if d.is_dir() for f in d.iterdir() if f.name.endswith((".parquet", ".crc"))]:
        f.unlink() if f.name.endswith(".crc") else f.write_bytes(b"junk")
    assert statistics_store.read_metadata(spark, path)[0] == 2


def test_store_is_proven_by_its_manifest(spark, tmp_path):
    path, folder = f"file://{tmp_path}/store", tmp_path / "store"
    meta = statistics_store.Metadata(0.0018, 60)
    one, two = (_stats(spark, cell, {(1, 2, 3): 5, (1, 2, 4): 6}, COURSE) for cell in (7, 8))

    def file(version):
        found = next(folder.glob(f"v{version}/statistics/*/*.parquet"))
        (found.parent / f".{found.name}.crc").unlink(missing_ok=True)
        return found

    for number, harm in enumerate(("cut", "flip", "lose"), 1):
        statistics_store.write(one, path, meta)
        last = statistics_store.write(two, path, meta)
        victim = file(last)
        raw = victim.read_bytes()
        if harm == "cut":
            victim.write_bytes(raw[: len(raw) // 2])
        elif harm == "flip":
            victim.write_bytes(raw[:10] + bytes([raw[10] ^ 1]) + raw[11:])
        else:
            victim.unlink()
        assert statistics_store.read_metadata(spark, path)[0] == last - 1, harm
        stats, _ = statistics_store.read(spark, path)
        assert {r["cell_id"] for r in stats.collect()} == {7}
        assert (statistics_store.read_metadata(spark, path, content=False)[0] == last) == (harm == "flip")


def test_store_grows_by_what_is_new(spark, tmp_path):
    path, folder = f"file://{tmp_path}/log", tmp_path / "log"
    meta = statistics_store.Metadata(0.0018, 60)
    size = lambda v: sum(f.stat().st_size for f in (folder / f"v{v}").glob("statistics/**/*.parquet"))
    many = spark.range(200_000).selectExpr("id AS cell_id", "1 AS k1", "CAST(id % 8 AS INT) AS k2", "0 AS k3", "1L AS ship_count", f"'{COURSE}' AS statistic")
    base = statistics_store.append(many, path, meta)
    written = []
    for k in range(9):
        number = statistics_store.append(many.where(f"cell_id < {20 * (k + 1)}"), path, meta)
        written.append(size(number))
        stats, found = statistics_store.read(spark, path)
        assert statistics_store._metadata(spark, path, number).parts[0] == base and found.parts == ()
        assert stats.agg(F.sum("ship_count")).first()[0] == 200_000 + sum(20 * (j + 1) for j in range(k + 1))
    assert max(written) < size(base) / 20 and len(statistics_store._metadata(spark, path, number).parts) <= 5
    assert stats.where("cell_id < 20").select("ship_count").distinct().collect() == [(10,)]
    assert len(statistics_store.versions(spark, path)) < 9  # parts that nothing counts are gone
    (victim := next((folder / f"v{base}").glob("statistics/*/*.parquet"))).write_bytes(b"")
    assert victim.exists() and "part 1" in statistics_store.damage(spark, path, number)


def test_jobs(spark, sf_dir, tmp_path):
    reports = catalog.reports(spark, sf_dir)
    path = f"file://{tmp_path}/stats"
    settings = config.Settings(course=Statistical(True, 4, 0.25), speed=Statistical(True, 4, 0.25), type_size=Statistical(True, 4, 0.25))
    jobs.build_statistics(reports, path, settings)
    jobs.add_statistics(reports, path, settings)
    stats, _ = statistics_store.read(spark, path)
    assert stats.agg(F.sum("ship_count")).first()[0] == 2 * catalog.stats(spark, sf_dir).agg(F.sum("ship_count")).first()[0]
    found = jobs.detect(reports, stats, settings)
    assert found.flow.count() >= 0
    ids = [r["event_id"] for r in found.events.collect()]
    sides = found.behaviours.groupBy("event_id").agg(F.count_if("is_primary").alias("n")).collect()
    assert len(ids) == len(set(ids)) and {r["event_id"]: r["n"] for r in sides} == dict.fromkeys(ids, 1)
    assert {r["event_id"] for r in found.points.select("event_id").distinct().collect()} == set(ids)


def test_detection_masks_boxes_and_fills_gaps(spark):
    from dataclasses import replace

    # north at 20 knots: reports each 10 s, then 5 minutes of silence, then more of them
    times = [*range(0, 60_000, 10_000), *range(360_000, 420_000, 10_000)]
    rows = vessel_track(spark, [(t, 56.0 + t * 10.2889 / 1000 / 111319.49, 12.0, 20.0, 0.0, 0.0) for t in times], bow=150, stern=50)
    statics = rows.select("mmsi", F.lit(-1).cast("long").alias("ts_ms"), "seq", *tracks.STATIC).limit(1)
    off = Statistical(enabled=False)
    plain = config.Settings(
        bounds=None, down_sample_seconds=0, course=off, type_size=off, speed=Statistical(True, 4, 0.25), speed_change=SuddenSpeedChange(enabled=False), drift=Drift(enabled=False),
        encounter=config.CloseEncounter(enabled=False), free_flow=config.FreeFlow(enabled=False),
    )

    def points(settings):
        reports = jobs.tracked(rows.drop("epoch"), statics, settings)
        seen = tracks.with_cells(tracks.interpolated(jobs.tracked(rows.drop("epoch"), statics, plain), 10))
        cells = [r["cell_id"] for r in seen.select("cell_id").distinct().collect()]
        stats = spark.createDataFrame([(s, c, 7, 5, 1, 100) for s in (statistics.SPEED, TYPE_SIZE) for c in cells], "statistic string, cell_id long, k1 int, k2 int, k3 int, ship_count long")
        found = jobs.detect(reports, stats, settings)
        starts = found.events.join(found.points, "event_id").groupBy("event_id", F.unix_millis(F.col("start_time").cast("timestamp")).alias("start_ms")).agg(F.count_if(F.col("certainty") >= 2).alias("n_points")).collect()
        return [(r["start_ms"], r["n_points"]) for r in starts], len(cells)

    found, cells = points(plain)
    assert cells >= 0.9 * (times[-1] * 10.2889 / 1000 / 200)
    bare, _ = points(replace(plain, interpolation_seconds=0))
    ((start, n),) = found
    assert n > sum(k for _, k in bare) and 0 < start < 360_000
    limited, _ = points(replace(plain, speed=Statistical(True, 4, 0.25, prediction_minutes=1)))
    assert sum(k for _, k in limited) < n
    masked, _ = points(replace(plain, mask=((55.9, 57.0, 11.0, 13.0),)))
    assert masked == []
    assert config.settings(config.parse_properties(TEMPLATE), [(1.0, 2.0, 3.0, 4.0)]).mask == ((1.0, 2.0, 3.0, 4.0),)


def test_report_golden_csv(spark):
    stored = spark.sql("select 0L event_id, 'SuddenSpeedChangeEvent' event_type, 'PAST' state, timestamp_ntz'2017-01-22 10:00:00' start_time, cast(null as timestamp_ntz) end_time, false suppressed, 'title' title, 'description' description")
    behaviours = spark.sql("select 0L event_id, 123456789 mmsi, true is_primary, 123456 imo, 'name' name, 'callsign' callsign, 1 ship_type, 30 length")
    points = spark.sql("select 0L event_id, 123456789 mmsi, timestamp_ntz'2017-01-22 10:00:00' ts, 56.0D lat, 12.0D lon, 12.0F sog, 45.0F cog, 46.0F hdg, false interpolated, 3 certainty")
    got = event_files.event_rows(stored, behaviours, points).first()
    assert tuple(got.asDict()) == event_files.EVENT_COLUMNS
    assert list(got) == ["0", "SuddenSpeedChangeEvent", "2017-01-22T10:00", None, "title", "description", "[123456789]", "123456789", "name", "callsign", "1", "30", "56.0000", "12.0000", "12.0", "45", "46"] + [None] * 10 + ['-start "2017-01-22-09:50" -end "2017-01-22-10:20" -exp "m.pos within circle(56.0000,12.0000,1000)"']


SENTENCES = r"""\si:AISD*3F\
$PGHP,1,2014,8,7,14,37,24,435,219,,2190076,1,6D*6D
!BSVDM,2,1,5,A,5:02Ih01WrRsEH57J20H5P8u8N222222222222167H66663k085QBS1H,0*55
!BSVDM,2,2,5,A,888888888888880,2*38
\si:AISD*3F\
$PGHP,1,2014,8,7,14,42,6,278,219,,2190076,1,3B*53
!BSVDM,1,1,,A,1:02Ih001U0d=V:Op85<2aT>0<0F,0*3B
no sentence
!BSVDM,1,1,,A,%%%,0*3B
"""


def test_sentences(spark, tmp_path):
    import gzip
    import zipfile

    (tmp_path / "a.ais").write_text(SENTENCES)
    (tmp_path / "b.ais.gz").write_bytes(gzip.compress(SENTENCES.encode()))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.ais", SENTENCES)
    decoded = nmea.messages(nmea.packets(nmea.read_lines(spark, f"file://{tmp_path}")))
    got = decoded.groupBy("file").agg(F.sort_array(F.collect_list("msg_type")).alias("t"), F.max("sog").alias("sog"), F.max("mmsi").alias("mmsi")).collect()
    assert [r["t"] for r in got] == [[1, 5]] * 3 and {round(r["sog"], 1) for r in got} == {10.1} and {r["mmsi"] for r in got} == {671128000}
    positions, statics = nmea.reports(decoded)
    assert positions.first()["ts_ms"] == 1407422526278 and statics.first()["ts_ms"] == 1407422244435
    with pytest.raises(ValueError, match="unknown protocol"):
        nmea.source(spark, "http://x")


def test_live_equals_batch(spark, sf_dir, tmp_path):
    reports = catalog.reports(spark, "/root/testdata/sf0.01")
    stats = spark.createDataFrame(catalog.stats(spark, "/root/testdata/sf0.01").toArrow().to_pylist(), "statistic string, cell_id long, k1 int, k2 int, k3 int, ship_count long")
    rows = reports.drop("epoch")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = live.transitions(stream, stats, statistics.SPEED, catalog.LEARNED)
    query = out.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = {(r["mmsi"], r["ts_ms"], r["transition"]) for r in spark.table("live").where("transition is not null and abnormal is not null").collect()}
    states = hysteresis.with_state(analyses.verdicts(tracks.cell_changes(reports), stats, statistics.SPEED, catalog.LEARNED))
    want = {(r["mmsi"], r["ts_ms"], r["transition"]) for r in hysteresis.transitions(states).collect()}
    assert len(want) > 100 and got == want


def test_search_rules():
    search.check_parameters(recent=5)
    with pytest.raises(ValueError):
        search.check_parameters(area=(1, 2, 3, None))
    with pytest.raises(ValueError):
        search.check_parameters(recent=5, vessel="x")


def test_search_guard_and_json(spark, sf_dir):
    import json

    assert search.worth_searching("x") and search.worth_searching(begin="01/01/2024", end="02/01/2024 10:00") and not search.worth_searching(" ", "01/01/2024", "1/1")
    stored = sample.event_store(spark, sf_dir)
    rows = {r["event_id"]: json.loads(r["json"]) for r in search.as_json(*[f.where("event_id in (5, 6)") for f in stored]).collect()}
    assert rows[6]["event_type"] and [b["secondary"] for b in rows[6]["behaviours"]] == [False, True] and len(rows[5]["behaviours"]) == 1
    times = [p["ts"] for p in rows[5]["behaviours"][0]["points"]]
    assert len(times) == 3 and times == sorted(times)


def test_pair_limits(spark):
    from fairlead.operators import pairs

    base = (56.0, 12.0)
    others = {2: (56.01, 12.0, 0), 3: (56.0, 12.02, 20_000), 4: (56.0, 12.0, -59_000), 5: (56.02, 12.0, 0), 6: (56.0, 12.0, -60_000)}
    rows = [(1, 120_000, 0, *base)] + [(m, 120_000 + min(dt, 0), 0, lat, lon) for m, (lat, lon, dt) in others.items()]
    found = pairs.nearby(spark.createDataFrame(rows, "mmsi int, ts_ms long, seq long, lat double, lon double"), 30_000)
    assert {r["b_mmsi"] for r in found.where("a_mmsi = 1 and run_ms = 120000").collect()} == {2, 3, 4}


@pytest.mark.parametrize("metres", [1852.0, 200.0, 20_000.0])
def test_pairs_at_all_latitudes(spark, metres):
    from math import cos, hypot, radians

    from fairlead.functions.geo import METRES
    from fairlead.operators import pairs

    rng, places = random.Random(8), [(78.0, 15.004), (78.0, 15.064), (-78.0, 15.004), (-78.0, 15.064), (89.999, 0.0), (89.999, 170.0), (-90.0, 3.0), (80.0, 10.049), (80.0, 10.139), (0.0, 179.9997), (0.0, -179.9997), (80.0, 180.0), (80.0, -180.0), (80.0, -179.95), (80.0, 179.95)]
    for lat in (0.0, 55.0, -55.0, 70.0, 78.0, -78.0, 85.0, 89.5, -89.9, 89.99):
        east = min(180.0, 2 * metres / METRES / cos(radians(lat)))
        places += [(max(-90.0, min(90.0, lat + rng.uniform(-2, 2) * metres / METRES)), rng.uniform(-east, east)) for _ in range(25)]
    frame = spark.createDataFrame([(m, 120_000, 0, *p) for m, p in enumerate(places)], "mmsi int, ts_ms long, seq long, lat double, lon double")
    got = sorted((r["a_mmsi"], r["b_mmsi"]) for r in pairs.nearby(frame, 60_000, metres).where("run_ms = 120000").select("a_mmsi", "b_mmsi").collect())
    turn = lambda d: min(abs(d), 360 - abs(d))
    far = lambda a, b: hypot(turn(b[1] - a[1]) * METRES * cos(radians(a[0])), (b[0] - a[0]) * METRES)
    assert got == [(i, j) for i, a in enumerate(places) for j, b in enumerate(places) if i != j and far(a, b) < metres]
    assert metres < 1852 or {(0, 1), (1, 0), (2, 3), (3, 2)} <= set(got)


def test_store_event_ids_are_stable(spark, sf_dir):
    rows = events.intervals(catalog.states(spark, "/root/testdata/sf0.01"), events.SPEED)
    one, two = (events.with_ids(rows).select("event_id", "mmsi", "start_ms").orderBy("event_id").collect() for _ in range(2))
    assert one == two and len({r["event_id"] for r in one}) == len(one) and all(0 <= r["event_id"] < 1 << 63 for r in one)
    later = events.with_ids(rows.where("start_ms > 1704500000000")).select("event_id", "mmsi", "start_ms").collect()  # a run that finds other events beside
    assert set(later) <= set(one)
    assert sample.event_store(spark, sf_dir)[0].count() == 1000


def test_spaced_rows_equal_the_sequential_rule():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        n, span = int(rng.integers(1, 60)), int(rng.integers(1, 40))
        rows = sorted((int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(-100, 100, n), strict=True))
        want, last, group = [], None, None
        for a, b, t in rows:
            stays = (a, b) != group or t - last >= span
            want.append(stays)
            if stays:
                group, last = (a, b), t
        got, before, at = [], None, 0
        while at < n:
            part = rows[at : at + int(rng.integers(1, 20))]
            a, b, t = (np.array(c) for c in zip(*part, strict=True))
            stays, before = filters.spaced([a, b], t, span, before)
            got += stays.tolist()
            at += len(part)
        assert got == want


def test_learning_counts_a_repeated_batch_once(spark, sf_dir, tmp_path):
    """The checkpoint's last commit is lost, as if the query had died after the write."""
    changes = tracks.cell_changes(catalog.reports(spark, sf_dir)).limit(200)
    changes.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/in")
    path, checkpoint = f"file://{tmp_path}/stats", f"file://{tmp_path}/cp"
    for _ in range(2):
        live.learn(stream(), path, checkpoint).awaitTermination(120)
        once = statistics_store.read(spark, path)[0].agg(F.sum("ship_count")).first()[0]
        for f in (tmp_path / "cp/commits").iterdir():
            f.unlink()
    assert statistics_store.versions(spark, path) == [1] and once == statistics.train(spark.read.parquet(f"{tmp_path}/in")).agg(F.sum("ship_count")).first()[0]


def test_relational_store_upserts_and_reads_back(spark, sf_dir):
    from fairlead.operators.event_tables import Tables
    from fairlead.sources import relational

    url, properties = "jdbc:derby:memory:events;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    stored = Tables(*[f.where("event_id < 200") for f in sample.event_store(spark, sf_dir)])
    relational.save(stored, url, properties)
    changed = Tables(stored.events.where("event_id < 20").withColumn("state", F.lit("GONE")), stored.behaviours.where("event_id < 20"), stored.points.where("event_id < 20 and certainty = 3"))
    relational.save(changed, url, properties)
    for partitions in (1, 4):
        back = relational.load(spark, url, properties, partitions)
        rows = lambda frame, table: sorted(map(str, frame.select(*relational.columns(table)).collect()))
        want = stored.events.withColumn("state", F.when(F.col("event_id") < 20, "GONE").otherwise(F.col("state")))
        assert rows(back.events, "event") == rows(want, "event") and rows(back.behaviours, "behaviour") == rows(stored.behaviours, "behaviour")
        assert rows(back.points, "tracking_point") == rows(stored.points.where("event_id >= 20 or certainty = 3"), "tracking_point")
    assert search.search(back.events, back.behaviours, back.points, event_type="DriftEvent").count() == search.search(stored.events, stored.behaviours, stored.points, event_type="DriftEvent").count() > 0
    values = {"events.repository.type": " PGSQL", **{f"events.pgsql.{k}": k for k in ("host", "port", "name", "username", "password")}}
    assert relational.url_of(values)[0] == "jdbc:postgresql://host:port/name" and relational.url_of({"events.repository.type": "csv"}) is None


def test_relational_store_keeps_all_runs(spark, sf_dir, monkeypatch):
    from dataclasses import replace

    from fairlead.operators.event_tables import Tables
    from fairlead.sources import relational

    address = "jdbc:derby:memory:months;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    monkeypatch.setattr(relational, "url_of", lambda values: address)
    settings = config.Settings(course=Statistical(False), speed=Statistical(True, 4, 0.25), type_size=Statistical(False), drift=Drift(enabled=True, period_minutes=5, metres=30.0))
    settings = replace(settings, encounter=replace(settings.encounter, enabled=False), free_flow=replace(settings.free_flow, enabled=False))
    reports, stats = catalog.reports(spark, "/root/testdata/sf0.01"), catalog.stats(spark, "/root/testdata/sf0.01")
    middle = reports.selectExpr("percentile_approx(ts_ms, 0.5) AS t").first()["t"]
    runs = [jobs.detect(part, stats, settings) for part in (reports.where(F.col("ts_ms") < middle), reports.where(F.col("ts_ms") >= middle))]
    seen = set()
    for run in (*runs, runs[1], runs[0]):  # the same run twice counts once
        jobs.store(run, {})
        seen |= {r["event_id"] for r in run.events.collect()}
        back = relational.load(spark, *address)
        assert sorted(r["event_id"] for r in back.events.select("event_id").collect()) == sorted(seen)
    assert all({r["event_id"] for r in run.events.collect()} & seen for run in runs) and back.behaviours.count() == len(seen)
    assert back.points.count() == sum(run.points.count() for run in runs)
    # a run that goes on with an event adds to its points
    some = runs[0].events.limit(1).collect()[0]["event_id"]
    only = Tables(*[f.where(F.col("event_id") == some) for f in (runs[0].events, runs[0].behaviours, runs[0].points)])
    relational.save(Tables(only.events, only.behaviours, only.points.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))), *address, merge=True)
    assert relational.load(spark, *address).points.where(F.col("event_id") == some).count() == 2 * only.points.count()
    wrong = Tables(only.events.withColumn("event_type", F.lit("other")), only.behaviours, only.points)
    with pytest.raises(ValueError, match="different events"):
        relational.save(wrong, *address)


def test_csv_store_gets_past_events(spark, sf_dir, tmp_path):
    found = catalog.detected(spark, sf_dir)
    values = {"events.repository.type": "csv", "events.csv.file": f"file://{tmp_path}/events"}
    jobs.store(jobs.Detected(found.events, found.behaviours, found.points, None), values)
    rows = spark.read.option("header", True).option("escape", '"').csv(values["events.csv.file"])
    assert rows.count() == found.events.where("state = 'PAST'").count() > 0


def _streamed(spark, rows, tmp_path, batches=3):
    """The rows as a stream of several files, in the order of time."""
    for k in range(batches):
        low, high = (rows.selectExpr(f"percentile_approx(ts_ms, {x}) as t").first()["t"] for x in (k / batches, (k + 1) / batches))
        part = rows.where((F.col("ts_ms") > low) | F.lit(k == 0)).where((F.col("ts_ms") <= high) | F.lit(k == batches - 1))
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def _collected(spark, stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).collect()


def test_live_kinematics_equal_batch(spark, tmp_path):
    from fairlead.streaming import kinematic

    reports = catalog.reports(spark, "/root/testdata/sf0.01")
    stream = _streamed(spark, reports.drop("epoch"), tmp_path)
    params = Drift(period_minutes=5, metres=30.0)
    got = {(r["mmsi"], r["ts_ms"], r["sustained_drift"], r["raised"], r["transition"]) for r in _collected(spark, kinematic.drift(stream, params), "live_drift", tmp_path)}
    want = {(r["mmsi"], r["ts_ms"], r["sustained_drift"], r["raised"], r["transition"]) for r in analyses.drift(reports, params).collect()}
    assert got == want and any(w[4] == "RAISE" for w in want)
    fields = ("mmsi", "start_ms", "end_ms", "fired_ms", "sog1", "sog2")
    got = {tuple(r[c] for c in fields) for r in _collected(spark, kinematic.sudden_speed_changes(stream, SuddenSpeedChange()), "live_speed", tmp_path)}
    want = {tuple(r[c] for c in fields) for r in analyses.sudden_speed_changes(reports, SuddenSpeedChange()).collect()}
    assert got == want and want


def test_live_pairs_equal_batch(spark, tmp_path):
    from fairlead.streaming import live_pairs

    fleet = sample.fleet_reports(spark, "/root/testdata/sf0.01")
    stream = _streamed(spark, fleet, tmp_path)
    for name, begin, batch, params in (
        ("encounters", live_pairs.encounter_runs, analyses.encounter_runs, catalog.ENCOUNTER),
        ("flow", live_pairs.free_flow, analyses.free_flow, catalog.FLOW),
    ):
        query = begin(stream, params, f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp", late_minutes=1)
        query.awaitTermination(240)
        assert query.exception() is None
        found = spark.read.parquet(f"{tmp_path}/{name}").drop("batch")
        last = found.agg(F.max("run_ms")).first()[0]
        want = batch(fleet, params).where(F.col("run_ms") <= last)
        columns = [c for c in ("run_ms", "mmsi", "abnormal", "a_mmsi", "b_mmsi", "a_ts_ms", "distance") if c in want.columns]
        rows = lambda frame: sorted(map(tuple, frame.select(columns).collect()))
        assert rows(found) == rows(want) and found.count() > 10
