"""Grid cells, local planes, rhumb lines and ellipses as column expressions.

The local plane has ``METRES`` metres to a degree, times the cosine of the
reference latitude eastwards.  Directions on it are degrees counter-clockwise
from east.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES = 111319.49
EARTH_RADIUS = 6371228.0
KNOTS = 1.9438444924406046
EQUATOR = 40_075_000


@dataclass(frozen=True)
class Grid:
    """Square cells of ``metres``; cell_id = floor(lat/res) * columns + floor(lon/res), for either sign."""

    metres: float = 200

    @property
    def columns(self) -> int:
        return int(EQUATOR / self.metres)

    @property
    def resolution(self) -> float:
        return 360 / (EQUATOR / self.metres)

    def row(self, lat: Column) -> Column:
        return F.floor(lat / self.resolution)

    def column(self, lon: Column) -> Column:
        return F.floor(lon / self.resolution)

    def cell(self, lat: Column, lon: Column) -> Column:
        return (self.row(lat) * self.columns + self.column(lon)).cast("long")

    def box(self, cell_id: Column) -> dict[str, Column]:
        """south, north, west, east of a cell."""
        half = self.columns // 2
        column = F.pmod(cell_id + half, F.lit(self.columns)) - half
        row = ((cell_id - column) / self.columns).cast("long")
        return {"south": row * self.resolution, "north": (row + 1) * self.resolution, "west": column * self.resolution, "east": (column + 1) * self.resolution}


def compass_to_cartesian(degrees: Column) -> Column:
    return F.pmod(F.lit(450.0) - degrees, F.lit(360.0))


def cartesian_to_compass(degrees: Column) -> Column:
    return F.pmod(F.lit(450.0) - degrees, F.lit(360.0))


def direction_difference(a: Column, b: Column) -> Column:
    """The smallest angle between two directions, 0 to 180."""
    turn = a.cast("double") - b.cast("double")
    # the remainder of doubles is slow, and seldom needed
    turn = F.when(F.abs(turn) < 360.0, F.when(turn < 0.0, turn + 360.0).otherwise(turn)).otherwise(F.pmod(turn, F.lit(360.0)))
    return F.least(turn, 360.0 - turn)


def _turned(degrees: Column) -> Column:
    """A difference of longitudes by the shorter way around."""
    return F.when(F.abs(degrees) <= 180.0, degrees).otherwise(F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0)


def local_x(lon: Column, ref_lat: Column, ref_lon: Column, shrink: Column | None = None) -> Column:
    """``shrink`` is the cosine of the reference latitude, where it is known already."""
    return _turned(lon - ref_lon) * METRES * (F.cos(F.radians(ref_lat)) if shrink is None else shrink)


def local_y(lat: Column, ref_lat: Column) -> Column:
    return (lat - ref_lat) * METRES


def local_lat(y: Column, ref_lat: Column) -> Column:
    return ref_lat + y / METRES


def local_lon(x: Column, ref_lat: Column, ref_lon: Column) -> Column:
    return _turned(ref_lon + x / (METRES * F.cos(F.radians(ref_lat))))


def cartesian_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(local_x(lon2, lat1, lon1), 2) + F.pow(local_y(lat2, lat1), 2))


def _stretched(lat: Column) -> Column:
    """The latitude's place on a Mercator chart."""
    return F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483)))


def rhumb_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dphi = F.radians(lat2) - F.radians(lat1)
    dpsi = _stretched(lat2) - _stretched(lat1)
    q = F.when(F.abs(dpsi) > 1e-12, dphi / dpsi).otherwise(F.cos(F.radians(lat1)))
    turn = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    return F.sqrt(dphi * dphi + q * q * F.pow(F.radians(turn), 2)) * EARTH_RADIUS


def rounded(x: Column, digits: int) -> Column:
    """Halves up by arithmetic; ``round`` makes a decimal number of each value."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def rhumb_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    turn = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    return F.pmod(F.degrees(F.atan2(F.radians(turn), _stretched(lat2) - _stretched(lat1))) + 360.0, F.lit(360.0))


def predicted(lat: Column, lon: Column, sog: Column, cog: Column, millis: Column) -> tuple[Column, Column]:
    """Dead reckoning on the local plane."""
    way = sog.cast("double") / KNOTS * millis / 1000.0
    rad = F.radians(cog.cast("double"))
    return local_lat(way * F.cos(rad), lat), local_lon(way * F.sin(rad), lat, lon)


def ellipse(direction: Column, loa: Column, beam: Column, stern: Column, starboard: Column, l1: float, b1: float, xc: float, x: Column | None = None, y: Column | None = None) -> Column:
    """An ellipse along ``direction``; (x, y) is the antenna on the local plane (the origin if not given).

    The centre lies loa*xc - stern ahead and starboard - beam/2 to the left of the antenna.
    """
    x, y = F.lit(0.0) if x is None else x, F.lit(0.0) if y is None else y
    theta = compass_to_cartesian(direction.cast("double"))
    ahead = loa * F.lit(float(xc)) - stern
    left = starboard - beam / 2.0
    rad = F.radians(theta)
    return F.struct(
        (x + ahead * F.cos(rad) - left * F.sin(rad)).alias("x"),
        (y + ahead * F.sin(rad) + left * F.cos(rad)).alias("y"),
        (loa * l1 / 2.0).alias("alpha"),
        (beam * b1 / 2.0).alias("beta"),
        theta.alias("theta"),
    )


def safety_zone(direction: Column, loa: Column, beam: Column, stern: Column, starboard: Column, length: float = 2.0, breadth: float = 3.0, behind: float = 0.25, **at: Column) -> Column:
    l1 = max(length, 1.0 + 2.0 * behind)
    return ellipse(direction, loa, beam, stern, starboard, l1, max(breadth, 1.5), -behind + 0.5 * l1, **at)


def vessel_extent(direction: Column, loa: Column, beam: Column, stern: Column, starboard: Column, **at: Column) -> Column:
    return ellipse(direction, loa, beam, stern, starboard, 1.0, 1.0, 0.5, **at)


def vessel_centre(lat: Column, lon: Column, hdg: Column, stern: Column, bow: Column, port: Column, starboard: Column) -> tuple[Column, Column]:
    """Centre of the hull; whole metres, as the halves are cut."""
    ahead = F.floor((bow + stern) / 2) - stern
    left = F.floor((port + starboard) / 2) - starboard
    rad = F.radians(compass_to_cartesian(hdg.cast("double")))
    x, y = ahead * F.cos(rad) - left * F.sin(rad), ahead * F.sin(rad) + left * F.cos(rad)
    return local_lat(y, lat), local_lon(x, lat, lon)


#: Half axes below this many metres, such as those of vessels without dimensions, count as this long.
LEAST_AXIS = 0.01


def _axis(length: Column) -> Column:
    return F.greatest(length, F.lit(LEAST_AXIS))


def _in_frame(e: Column, x: Column, y: Column, turn: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """A point in the frame where ``e`` is the unit circle; ``turn`` is the cosine and sine of its direction, where they are known already."""
    cos, sin = (F.cos(F.radians(e["theta"])), F.sin(F.radians(e["theta"]))) if turn is None else turn
    dx, dy = x - e["x"], y - e["y"]
    return (dx * cos + dy * sin) / _axis(e["alpha"]), (dy * cos - dx * sin) / _axis(e["beta"])


def contains(e: Column, x: Column, y: Column, turn: tuple[Column, Column] | None = None) -> Column:
    u, v = _in_frame(e, x, y, turn)
    return u * u + v * v <= 1.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def intersects(a: Column, b: Column) -> Column:
    """Whether two ellipses on one plane have a point in common; touching counts.

    Where a is the unit circle, b is w'Bw <= 0 and a is w'Aw <= 0 with A = diag(1, 1, -1) in homogeneous
    coordinates.  The two are apart exactly if det(kA + B) has two distinct positive roots k, which the
    discriminant and the signs of the cubic's coefficients show.  Pairs whose bounding circles are apart
    are not worked out.
    """

    def in_frame(at: Column) -> Column:
        """b's quadratic form p uu + 2 q uv + s vv around (u, v) in a's frame."""
        u, v = _in_frame(a, b["x"], b["y"])
        c, d = F.cos(at), F.sin(at)
        m11, m12 = _axis(a["alpha"]) * c / _axis(b["alpha"]), _axis(a["beta"]) * d / _axis(b["alpha"])
        m21, m22 = _axis(a["alpha"]) * d / _axis(b["beta"]), _axis(a["beta"]) * c / _axis(b["beta"])
        return F.struct((m11 * m11 + m21 * m21).alias("p"), (m21 * m22 - m11 * m12).alias("q"), (m12 * m12 + m22 * m22).alias("s"), u.alias("u"), v.alias("v"))

    def cubic(g: Column) -> Column:
        """Coefficients x, y, z of k^3 + x k^2 + y k + z."""
        p, q, s, u, v = (g[c] for c in "pqsuv")
        r, t = p * u + q * v, q * u + s * v
        w = u * r + v * t - 1.0
        return F.struct((p + s - w).alias("x"), (p * s - q * q - w * (p + s) + t * t + r * r).alias("y"), (w * q * q - w * p * s + t * t * p - 2.0 * q * t * r + r * r * s).alias("z"))

    def apart(k: Column) -> Column:
        x, y, z = k["x"], k["y"], k["z"]
        discriminant = 18.0 * x * y * z - 4.0 * x * x * x * z + x * x * y * y - 4.0 * y * y * y - 27.0 * z * z
        return (discriminant > 0.0) & ((x <= 0.0) | (y <= 0.0))

    reach = F.greatest(a["alpha"], a["beta"], F.lit(LEAST_AXIS)) + F.greatest(b["alpha"], b["beta"], F.lit(LEAST_AXIS))
    far = F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2) > reach * reach
    exact = _let(_let(F.radians(a["theta"] - b["theta"]), in_frame), lambda g: _let(cubic(g), lambda k: ~apart(k)))
    return F.when(far, False).otherwise(exact)


def ellipse_position(e: Column, ref_lat: Column, ref_lon: Column) -> Column:
    """Where an ellipse lies: centre, compass heading of the long axis and the half axes."""
    return F.struct(
        local_lat(e["y"], ref_lat).alias("lat"), local_lon(e["x"], ref_lat, ref_lon).alias("lon"), cartesian_to_compass(e["theta"]).alias("heading"), e["alpha"].alias("major"), e["beta"].alias("minor")
    )


def degree_lengths(lat: Column) -> tuple[Column, Column]:
    """Metres to a degree of latitude and of longitude, by the usual cosine series."""
    r = F.radians(lat)
    north = 111132.92 - 559.82 * F.cos(2 * r) + 1.175 * F.cos(4 * r) - 0.0023 * F.cos(6 * r)
    east = 111412.84 * F.cos(r) - 93.5 * F.cos(3 * r) + 0.118 * F.cos(5 * r)
    return north, east


def ellipse_outline(lat: Column, lon: Column, major: Column, minor: Column, step: float = 0.01, points: int = 629) -> Column:
    """Positions along an ellipse on the chart."""
    north, east = degree_lengths(lat)
    a, b = major / north, minor / east

    def place(k: Column) -> Column:
        t = k * step
        r = a * b / F.sqrt(F.pow(b * F.cos(t), 2) + F.pow(a * F.sin(t), 2))
        return F.struct((lat + r * F.cos(t)).alias("lat"), (lon + r * F.sin(t)).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), place)
