"""Golden values of scalar functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.functions import categories, formats, geo, vessel
from fairlead.functions.geo import Grid


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


@pytest.mark.parametrize("cog, bucket", [(0.0, 1), (29.999, 1), (30.0, 2), (359.999, 12), (360.0, 1), (-45.0, 0)])
def test_course_buckets(spark, cog, bucket):
    assert one(spark, b=categories.course_bucket(F.lit(cog).cast("float")))["b"] == bucket


def test_labels(spark):
    got = one(spark, a=categories.label("type", F.lit(1)), b=categories.label("type", F.lit(8)), c=categories.label("course", F.lit(1)), d=categories.label("speed", F.lit(2)), e=categories.label("size", F.lit(9)))
    assert got == {"a": "tanker", "b": "undef", "c": "000-030", "d": "1-5kts", "e": "9"}


def test_speed_and_length_edges(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (50.0,), (-1.0,), (float("nan"),), (None,)], "x float")
    assert [r[0] for r in rows.select(categories.speed_bucket(F.col("x"))).collect()] == [1, 2, 8, 8, 8, None]
    lengths = spark.createDataFrame([(0,), (1,), (49,), (50,), (100,), (200,), (998,), (999,), (-1,), (None,)], "x int")
    assert [r[0] for r in lengths.select(categories.length_bucket(F.col("x"))).collect()] == [1, 2, 2, 3, 4, 5, 5, None, None, None]


def test_grid(spark):
    grid = Grid(200)
    assert grid.resolution == 0.0017966313162819712
    box = grid.box(F.lit(6249302540))
    got = one(spark, **box, cell=grid.cell(F.lit(56.0342), F.lit(12.6491)))
    assert got["cell"] == 6249302540
    assert [round(got[k], 6) for k in ("south", "north", "west", "east")] == [56.033337, 56.035134, 12.648284, 12.650081]


def test_grid_south_west(spark):
    grid = Grid(200)
    cell = grid.cell(F.lit(-33.9), F.lit(-70.2))
    got = one(spark, **grid.box(cell))
    assert got["south"] <= -33.9 < got["north"] and got["west"] <= -70.2 < got["east"]


ZONES = [
    (90, 33, 6.0, {}, (42.0, -1.5), None),
    (0, 33, 6.0, {}, (1.5, 42.0), None),
    (45, 65, 5.5, {}, (8.485281374, 5.656854249), (100, 22.5, 45)),
    (90, 65, 5.5, {}, (10, -2), (100, 22.5, 0)),
    (90, 65, 5.5, {"length": 1.0}, (-15, -2), (75, 22.5, 0)),
    (90, 65, 5.5, {"breadth": 5.0}, (10, -2), (100, 37.5, 0)),
    (90, 65, 5.5, {"behind": 0.75}, (-15, -2), (125, 22.5, 0)),
]


@pytest.mark.parametrize("cog, stern, starboard, config, centre, shape", ZONES)
def test_safety_zone(spark, cog, stern, starboard, config, centre, shape):
    zone = geo.safety_zone(F.lit(float(cog)), F.lit(100.0), F.lit(15.0), F.lit(float(stern)), F.lit(starboard), **config)
    got = one(spark, z=zone)["z"]
    assert (got["x"], got["y"]) == pytest.approx(centre, abs=1e-6)
    if shape:
        assert (got["alpha"], got["beta"], got["theta"]) == pytest.approx(shape, abs=1e-6)


CENTRES = [
    ((0, 50, 50, 10, 10), (56.0, 12.0)),
    ((90, 50, 50, 10, 10), (56.0, 12.0)),
    ((180, 50, 50, 10, 10), (56.0, 12.0)),
    ((0, 25, 75, 10, 10), (56.000225, 12.0)),
    ((0, 75, 25, 10, 10), (55.999774, 12.0)),
    ((0, 50, 50, 5, 15), (56.0, 12.000081)),
    ((0, 50, 50, 15, 5), (56.0, 11.999919)),
]


@pytest.mark.parametrize("args, centre", CENTRES)
def test_vessel_centre(spark, args, centre):
    hdg, stern, bow, port, starboard = args
    lat, lon = geo.vessel_centre(F.lit(56.0), F.lit(12.0), F.lit(float(hdg)), F.lit(stern), F.lit(bow), F.lit(port), F.lit(starboard))
    got = one(spark, lat=lat, lon=lon)
    golden = [float(np.float32(x)) for x in centre]  # the values are 32-bit, 4e-6 apart here
    assert [got["lat"], got["lon"]] == pytest.approx(golden, abs=1e-6)


def test_ellipses_meet(spark):
    make = lambda x, y, a, b, t: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(t).alias("theta"))
    one_ = make(0.0, 0.0, 100.0, 20.0, 0.0)
    got = one(spark, touch=geo.intersects(one_, make(0.0, 30.0, 15.0, 15.0, 0.0)), apart=geo.intersects(one_, make(0.0, 40.0, 15.0, 15.0, 0.0)), inside=geo.intersects(one_, make(50.0, 0.0, 1.0, 1.0, 0.0)), around=geo.intersects(make(50.0, 0.0, 1.0, 1.0, 0.0), one_))
    assert got == {"touch": True, "apart": False, "inside": True, "around": True}


def test_directions_and_keys(spark):
    got = one(spark, a=geo.direction_difference(F.lit(350.0), F.lit(10.0)), b=geo.direction_difference(F.lit(-54.0), F.lit(0.0)), c=geo.compass_to_cartesian(F.lit(0.0)), d=geo.compass_to_cartesian(F.lit(90.0)), k=formats.pack_key(F.lit(2), F.lit(4), F.lit(3), 5, 12))
    assert got == {"a": 20.0, "b": 54.0, "c": 90.0, "d": 0.0, "k": 2 * 60 + 4 * 12 + 3}


def test_key_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(formats.checked_key(F.lit(8), F.lit(0), F.lit(0), 7, 4, 11)).collect()


def test_names(spark):
    got = one(spark, a=vessel.trim_name(F.lit("LOTUS@@@ ")), b=vessel.trim_name(F.lit(None).cast("string")), c=vessel.name_or_mmsi(F.lit("@@"), F.lit(219)), d=vessel.name_and_mmsi(F.lit("X"), F.lit(219)))
    assert got == {"a": "LOTUS", "b": "", "c": "MMSI 219", "d": "X (219)"}


def test_predicates_are_never_null(spark):
    none = F.lit(None).cast("int")
    got = one(spark, a=vessel.is_tanker(none), b=vessel.is_slow(F.lit(None).cast("float")), c=vessel.is_small(none), d=vessel.is_unknown_type_or_size(none, F.lit(3)), e=vessel.sog_available(F.lit(102.3).cast("float")))
    assert got == {"a": False, "b": False, "c": False, "d": True, "e": False}


def test_dates_and_percent(spark):
    got = one(spark, a=formats.parse_date(F.lit("05/10/2014")), b=formats.parse_date(F.lit("05/10/2014 16:19")), c=formats.parse_date(F.lit("x")), d=formats.percent(F.lit(1), F.lit(3)), e=formats.percent(F.lit(1), F.lit(0)))
    assert str(got["a"]) == "2014-10-05 00:00:00" and str(got["b"]) == "2014-10-05 16:19:00" and got["c"] is None and got["d"] == 33.33 and got["e"] is None


def test_ellipses_meet_as_their_rims_say(spark):
    """Random and grazing pairs, some inside each other, against a dense rim that is refined around its deepest point."""
    import math
    import random

    rng = random.Random(11)

    def level(e, x, y):
        c, d = math.cos(math.radians(e[4])), math.sin(math.radians(e[4]))
        dx, dy = x - e[0], y - e[1]
        return math.hypot((dx * c + dy * d) / e[2], (dy * c - dx * d) / e[3])

    def rim(e, t):
        c, d = math.cos(math.radians(e[4])), math.sin(math.radians(e[4]))
        u, v = e[2] * math.cos(t), e[3] * math.sin(t)
        return e[0] + u * c - v * d, e[1] + u * d + v * c

    def deepest(a, b):
        at, step = 0.0, 2 * math.pi / 512
        places = [k * step for k in range(512)]
        for _ in range(5):
            at = min(places, key=lambda t: level(a, *rim(b, t)))
            places = [at + k * step / 32 for k in range(-32, 33)]
            step /= 32
        return level(a, *rim(b, at))

    make = lambda far, big: (rng.uniform(-far, far), rng.uniform(-far, far), rng.uniform(1, big), rng.uniform(1, big / 2), rng.uniform(0, 360))
    pairs = [(make(200, 300), make(200, 300)) for _ in range(300)] + [(make(5, 400), make(5, 3)) for _ in range(20)]
    for _ in range(300):  # a small one pushed to the rim of a large one, and a little further or back
        a, b = make(10, 400), make(10, 40)
        for _ in range(60):
            near = deepest(a, b)
            b = (a[0] + (b[0] - a[0]) / near, a[1] + (b[1] - a[1]) / near, *b[2:]) if near < 0.999 or near > 1.001 else b
        for shift in (1 - 1e-4, 1 + 1e-4):
            pairs.append((a, (a[0] + (b[0] - a[0]) * shift, a[1] + (b[1] - a[1]) * shift, *b[2:])))
    pairs += [((0, 0, 10, 5, 0), (20, 0, 10, 5, 0)), ((0, 0, 10, 5, 0), (0, 0, 10, 5, 0)), ((0, 0, 0, 0, 0), (0, 0, 0, 0, 0)), ((0, 0, 5, 0, 90), (4, 0, 0, 3, 10)), ((0, 0, 9, 4, 0), (300, 0, 9, 4, 0))]
    shape = "struct<x:double,y:double,alpha:double,beta:double,theta:double>"
    frame = spark.createDataFrame([(k, *(tuple(map(float, e)) for e in pair)) for k, pair in enumerate(pairs)], f"k int, a {shape}, b {shape}")
    rows = frame.select("k", geo.intersects(F.col("a"), F.col("b")).alias("one"), geo.intersects(F.col("b"), F.col("a")).alias("two")).orderBy("k").collect()
    assert all(r["one"] == r["two"] for r in rows)
    got = [r["one"] for r in rows]
    assert got[-5:] == [True, True, True, False, False]
    sure = 0
    for (a, b), met in zip(pairs[:-5], got, strict=False):
        near = deepest(a, b)
        want = near <= 1 or level(b, a[0], a[1]) <= 1 or level(a, b[0], b[1]) <= 1
        if abs(near - 1) > 1e-7:
            sure += 1
            assert met == want, (a, b, near)
    assert sure > 850
