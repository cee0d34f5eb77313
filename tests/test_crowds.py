"""Pairs where many vessels lie at one place: worked out by blocks, with the rows of plain pairs."""

from collections import Counter

from pyspark.sql import functions as F

from fairlead.config import CloseEncounter
from fairlead.operators import analyses, pairs

RUN = 1_704_067_200_000


def crowd(spark, n=900, places=((55.0, 11.0), (55.009, 11.0), (55.5, 11.0))):
    """n vessels of all kinds, dealt over the places, with reports of two ages."""
    u, at = F.col("id"), F.element_at(F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in places]), (F.col("id") % len(places) + 1).cast("int"))
    types = F.array(*[F.lit(t) for t in (80, 70, 60, 30, 84, 36, 52, 0, 31, None, 39)])
    return spark.range(n).select(
        (1000 + u).cast("int").alias("mmsi"), (F.lit(RUN) - (u % 7 == 0).cast("int") * 20_000).alias("ts_ms"), F.lit(0).alias("seq"), F.concat(F.lit("V"), u.cast("string")).alias("name"), F.lit("C").alias("callsign"), u.cast("int").alias("imo"),
        F.element_at(types, (u % 11 + 1).cast("int")).alias("ship_type"), (u * 37 % 150).cast("int").alias("to_bow"), F.when(u % 29 != 0, u * 53 % 120).cast("int").alias("to_stern"), (2 + u * 7 % 15).cast("int").alias("to_port"),
        (2 + u * 11 % 15).cast("int").alias("to_starboard"), at["lat"].alias("lat"), at["lon"].alias("lon"), F.when(u % 31 != 0, u * 13 % 200 / 10.0).cast("float").alias("sog"), (u * 17 % 3600 / 10.0).cast("float").alias("cog"), F.when(u % 23 != 0, u * 19 % 360).cast("float").alias("hdg"),
    )


def test_crowds_meet_as_blocks(spark):
    rows = crowd(spark)
    blocks = pairs.blocked(pairs.snapshots(rows, 60_000).where(F.col("run_ms") == RUN).select("run_ms", "ts_ms", "lat", "lon", "mmsi"), pairs.PLACE)
    sizes = [r["n"] for r in blocks.select(F.size("members").alias("n")).collect()]
    assert sum(sizes) == 900 and max(sizes) <= 2 * pairs.BLOCK and 6 <= len(sizes) <= 9  # two ages at each of three places, the crowds of over 256 in two
    assert pairs.near_blocks(blocks, blocks).count() <= 9 * 9
    found = pairs.nearby(rows, 60_000, columns=("mmsi",), digits=1).where(F.col("run_ms") == RUN)
    got = Counter((r["near_metres"], r["n"]) for r in found.groupBy("near_metres").agg(F.count("*").alias("n")).collect())
    assert got == Counter([(0.0, 3 * 300 * 299), (1001.9, 2 * 300 * 300)])
    assert found.select("a_mmsi", "b_mmsi").distinct().count() == found.count()


def test_candidates_of_a_crowd_are_the_filtered_pairs(spark):
    params = CloseEncounter(run_seconds=60)
    rows = crowd(spark, 400).where("ts_ms is not null")
    first, second, kinds = analyses._encountering(params)
    kind = rows.select("mmsi", F.coalesce(first, F.lit(False)).alias("f"), F.coalesce(second, F.lit(False)).alias("s"), kinds.alias("k")).collect()
    kind = {r["mmsi"]: (r["f"], r["s"], r["k"]) for r in kind}
    every = pairs.nearby(rows, 60_000, columns=("mmsi",)).select("run_ms", "a_mmsi", "b_mmsi").collect()
    want = sorted((t, a, b) for t, a, b in every if kind[a][0] and kind[b][1] and not kind[a][2] & kind[b][2])
    got = sorted(tuple(r) for r in analyses.encounter_candidates(rows, params, ("mmsi",)).select("run_ms", "a_mmsi", "b_mmsi").collect())
    assert got == want and len(want) > 10_000


def test_verdicts_of_a_crowd_are_those_of_its_pairs(spark):
    params = CloseEncounter(run_seconds=60)
    rows = crowd(spark, 500, ((55.0, 11.0), (55.002, 11.0), (55.0, 11.004), (55.009, 179.9999), (55.009, -179.9999)))
    rows = rows.union(crowd(spark, 80, tuple((56.0 + k * 0.0025, 12.0) for k in range(60))).withColumn("mmsi", F.col("mmsi") + 5000))
    plain = analyses.close_encounters(rows, params).groupBy("run_ms", "a_mmsi")
    want = plain.agg(F.max("meets").alias("meets"), F.count("*").alias("near"), F.min(F.when(F.col("meets"), F.struct("near_metres", "b_mmsi"))).alias("n")).select("run_ms", "a_mmsi", "meets", "near", "n.near_metres", "n.b_mmsi")
    got = analyses.encounter_verdicts(rows, params)
    text = lambda df: sorted(map(str, df.collect()))
    assert text(got) == text(want) and {r["meets"] for r in got.collect()} == {True, False}


def test_ovals_touch_in_numpy_as_in_spark(spark):
    import numpy as np

    from fairlead.functions import geo
    from fairlead.operators import meetings

    rng = np.random.default_rng(5)
    make = lambda far: {"x": rng.normal(0, far, 4000), "y": rng.normal(0, far, 4000), "alpha": rng.choice([0.0, 40.0, 150.0], 4000), "beta": rng.choice([0.0, 5.0, 30.0], 4000), "theta": rng.uniform(0, 360, 4000)}
    a, b = make(1), make(120)
    rows = spark.createDataFrame([tuple(float(e[k][i]) for e in (a, b) for k in a) for i in range(4000)], ", ".join(f"{s}{k} double" for s in "ab" for k in a))
    shape = lambda s: F.struct(*[F.col(f"{s}{k}").alias(k) for k in a])
    want = [r["t"] for r in rows.select(geo.intersects(shape("a"), shape("b")).alias("t")).collect()]
    assert meetings.touching(a, b).tolist() == want and 400 < sum(want) < 3600


def test_decimals_are_those_of_the_stored_value(spark):
    import random

    from fairlead.functions import formats

    rng = random.Random(4)
    values = [55.00705, 55.08445, 11.00005, -55.00705, -0.00001, 0.0, 0.03125, 0.09375, 1e12 + 0.5, 54.99995] + [rng.randrange(-18_000_000, 18_000_000) / 1e5 + rng.choice([0, 5e-5, 1e-9]) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", formats.fixed(F.col("x"), 4).alias("t"), formats.fixed(F.col("x"), 1).alias("u")).collect()
    assert [(r["t"], r["u"]) for r in rows] == [(f"{r['x']:.4f}", f"{r['x']:.1f}") for r in rows]


def test_narrow_free_flow_is_that_of_all_columns(spark, sf_dir):
    from fairlead.plans.catalog import FLOW
    from fairlead.sources import sample

    fleet = sample.fleet_reports(spark, sf_dir)
    key = ["run_ms", "a_mmsi", "b_mmsi", "a_ts_ms", "distance", "bearing"]
    wide, narrow = analyses.free_flow(fleet, FLOW), analyses.free_flow(fleet, FLOW, ("mmsi",))
    assert set(wide.columns) - set(narrow.columns) >= {"a_name", "b_to_bow"}
    assert sorted(map(tuple, wide.select(key).collect())) == sorted(map(tuple, narrow.select(key).collect()))


def test_free_flow_texts_are_made_before_vessels_meet(spark, sf_dir):
    from fairlead.plans.catalog import FLOW, QUERIES
    from fairlead.sources import event_files

    plan = QUERIES["free_flow_rows"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    of_pairs, alone = plan.split("Generate explode(b_members")
    assert "format_string" in alone and "format_string" not in of_pairs and "date_format" not in of_pairs
    fleet = crowd(spark, 300)
    text = lambda df: sorted(map(str, df.collect()))
    plain = event_files.free_flow_rows(analyses.free_flow(fleet, FLOW))
    made = event_files.free_flow_rows(analyses.free_flow(fleet, FLOW, ("mmsi",), event_files.free_flow_texts()))
    assert made.columns == list(event_files.FREE_FLOW_COLUMNS) == plain.columns
    assert text(made) == text(plain) != []


def test_courses_differ_as_by_remainders(spark):
    from fairlead.functions import geo

    values = [0.0, 0.1, 24.9, 90.0, 180.0, 359.9, 360.0, 361.5, -0.1, -180.0, -359.9999, -720.25, 1080.0, float("nan"), None]
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    turn = F.pmod(F.col("a") - F.col("b"), F.lit(360.0))
    found = rows.select(geo.direction_difference(F.col("a"), F.col("b")).alias("got"), F.least(turn, 360.0 - turn).alias("want")).collect()
    assert [str(r["got"]) for r in found] == [str(r["want"]) for r in found]


def test_members_of_which_only_the_number_is_kept_are_numbers(spark, sf_dir):
    from fairlead.plans.catalog import QUERIES

    rows = pairs.snapshots(crowd(spark), 60_000).select("run_ms", "ts_ms", "lat", "lon", "mmsi")
    blocks = pairs.blocked(rows, pairs.PLACE)
    assert blocks.schema["members"].dataType.simpleString() == "array<int>"
    numbers = [r["members"] for r in blocks.collect()]
    assert all(n == sorted(n) for n in numbers) and sorted(sum(numbers, [])) == sorted(r["mmsi"] for r in rows.collect())
    for name in ("nearby_polar", "nearby_tracks", "encounter_candidates"):
        assert "struct(mmsi" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_pairs_come_from_small_blocks(spark, monkeypatch):
    seen, meet = [], pairs.near_blocks
    monkeypatch.setattr(pairs, "near_blocks", lambda first, second, *a: seen.extend([first, second]) or meet(first, second, *a))
    rows = crowd(spark, 2700)
    found = pairs.nearby(rows, 60_000, columns=("mmsi",)).where(F.col("run_ms") == RUN)
    assert found.where("near_metres = 0").count() == 3 * 900 * 899
    analyses.encounter_candidates(rows, CloseEncounter(run_seconds=60), ("mmsi",))
    sizes = [max(r["n"] for r in side.select(F.size("members").alias("n")).collect()) for side in seen]
    assert len(sizes) == 4 and 10 < min(sizes) and max(sizes) <= 2 * pairs.LISTED


def test_blocks_meet_in_many_tasks(spark):
    blocks = pairs.blocked(pairs.snapshots(crowd(spark), 60_000).select("run_ms", "ts_ms", "lat", "lon", "mmsi"), pairs.PLACE)
    plan = pairs.near_blocks(blocks, blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {8 * spark.sparkContext.defaultParallelism}") == 2  # no task gets much more than its share of the crowds


def sailing(spark, vessels, minutes, seed=3):
    """Large cargo vessels and others at a few places, most of them on like courses, with a report about each minute."""
    u, k = F.col("id") % vessels, F.floor(F.col("id") / vessels)
    chance = lambda n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    turned = F.when(u % 5 == 0, 3590).otherwise(100) + chance(250)
    return spark.range(vessels * minutes).where(chance(11) != 0).select(
        (1000 + u * 70_001).cast("int").alias("mmsi"), (F.lit(RUN) + k * 60_000 - chance(50) * 1000).alias("ts_ms"), k.alias("seq"), F.lit("V").alias("name"), F.lit("C").alias("callsign"), u.cast("int").alias("imo"),
        F.when(u % 13 == 0, 30).otherwise(70 + u % 20).cast("int").alias("ship_type"), (60 + u % 90).cast("int").alias("to_bow"), F.lit(40).alias("to_stern"), F.when(u % 17 != 0, 5 + u % 11).cast("int").alias("to_port"),
        (3 + u % 7).cast("int").alias("to_starboard"), (55.0 + u % 3 * 0.004 + k * 0.0005).alias("lat"), F.when(u % 2 == 0, 11.0).otherwise(11.001).alias("lon"), F.lit(12.0).cast("float").alias("sog"), (turned % 3600 / 10.0).cast("float").alias("cog"), (u % 360).cast("float").alias("hdg"),
    )


def test_reports_of_free_flow_are_the_thinned_pairs(spark):
    from fairlead.operators import flows
    from fairlead.plans.catalog import FLOW

    rows = sailing(spark, 400, 24)
    rows = rows.withColumn("ts_ms", F.col("ts_ms") + F.when(F.col("seq") > 15, 3 * 60_000).otherwise(0))
    key = ["run_ms", "a_mmsi", "b_mmsi", "a_ts_ms"]
    every = analyses.free_flow(rows, FLOW, ("mmsi",)).select(key)
    for period in (60_000, 5 * 60_000, 9 * 60_000 + 1):
        want = sorted(map(tuple, pairs.throttled(every, period).collect()))
        assert sorted(map(tuple, analyses.free_flow_reports(rows, FLOW, period).select(key).collect())) == want
        assert 20_000 < len(want) < every.count()
    # no pair is a row in a shuffle, and what crosses it is some two bytes a pair
    plan = analyses.free_flow_reports(rows, FLOW, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [a_mmsi" in plan and "b_mmsi" not in plan.split("RepartitionByExpression [a_mmsi")[1]
    assert flows.LISTS.count("binary") == 1


def test_lists_are_thinned_alike_in_parts_of_any_size(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from fairlead.operators import flows

    rng = np.random.default_rng(8)
    numbers = np.unique(np.concatenate([rng.integers(-(2**31), 2**31, 40), rng.integers(0, 300_000, 60)]))
    rows = [(a, at, at // 60_000 * 60_000 + 60_000, np.sort(rng.choice(numbers, rng.integers(1, 60), replace=False))) for a in (-7, 0, 5, 2**31 - 1) for at in sorted(rng.integers(0, 3_000_000, 40).tolist())]
    steps, wide = flows._lists(np.concatenate([r[3] for r in rows]), np.array([len(r[3]) for r in rows]))
    many, back = flows._numbers(steps, wide)
    assert many.tolist() == [len(r[3]) for r in rows] and back.tolist() == np.concatenate([r[3] for r in rows]).tolist()
    want, last = [], {}
    for a, at, run, seconds in rows:
        for b in seconds.tolist():
            if (a, b) not in last or at >= last[a, b] + 300_000:
                last[a, b] = at
                want.append((run, a, b, at))
    whole = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), steps, wide], ["run_ms", "a_mmsi", "a_ts_ms", "steps", "wide"])
    for most, size in ((1, 160), (100, 7), (1 << 18, 50), (1 << 18, 160)):
        monkeypatch.setattr(flows, "THINNED", most)
        found = [tuple(r.values()) for part in flows.reported(300_000)(whole.slice(k, size) for k in range(0, len(rows), size)) for r in part.to_pylist()]
        assert sorted(found) == sorted(want) and len(want) < sum(many)
