"""Which vessels of near blocks meet: safety zones and extents of many vessels at once, in numpy, over rows of block pairs.

A first vessel asks the second ones of its nearest blocks, by their number, and stops
at the first that it meets; blocks that are farther than one it meets, or out of reach
of its zone, are counted only.  So a crowd costs few tests a vessel, not one a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from fairlead.config import CloseEncounter
from fairlead.functions.geo import KNOTS, LEAST_AXIS, METRES

SCHEMA = "run_ms long, a_mmsi int, near long, near_metres double, b_mmsi int"
#: Pairs that are tested at once at most, and how many second vessels one asks at once at most.
AT_ONCE, WIDEST = 1 << 18, 64

Arrays = dict[str, np.ndarray]


def turned(degrees: np.ndarray) -> np.ndarray:
    """A difference of longitudes by the shorter way around; the remainder of doubles is slow, and seldom needed."""
    wide = ~(np.abs(degrees) <= 180.0)
    if wide.any():
        degrees = degrees.copy()
        degrees[wide] = np.mod(degrees[wide] + 180.0, 360.0) - 180.0
    return degrees


def _predicted(v: Arrays, lat: np.ndarray, lon: np.ndarray, millis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`fairlead.functions.geo.predicted`."""
    way, rad = v["sog"] / KNOTS * millis / 1000.0, np.radians(v["cog"])
    return lat + way * np.cos(rad) / METRES, turned(lon + way * np.sin(rad) / (METRES * np.cos(np.radians(lat))))


def _oval(v: Arrays, direction: str, l1: float, b1: float, xc: float) -> Arrays:
    """As :func:`fairlead.functions.geo.ellipse`, around the antenna."""
    loa, beam = v["to_bow"] + v["to_stern"], v["to_port"] + v["to_starboard"]
    theta = np.mod(450.0 - v[direction], 360.0)
    ahead, left, rad = loa * xc - v["to_stern"], v["to_starboard"] - beam / 2.0, np.radians(theta)
    return {"x": ahead * np.cos(rad) - left * np.sin(rad), "y": ahead * np.sin(rad) + left * np.cos(rad), "alpha": loa * l1 / 2.0, "beta": beam * b1 / 2.0, "theta": theta}


def touching(a: Arrays, b: Arrays) -> np.ndarray:
    """As :func:`fairlead.functions.geo.intersects`; places that are no numbers are far."""
    reach = np.maximum(np.maximum(a["alpha"], a["beta"]), LEAST_AXIS) + np.maximum(np.maximum(b["alpha"], b["beta"]), LEAST_AXIS)
    out = (b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2 <= reach * reach
    near = np.flatnonzero(out)
    a, b = {k: x[near] for k, x in a.items()}, {k: x[near] for k, x in b.items()}
    a1, a2, b1, b2 = (np.maximum(e[k], LEAST_AXIS) for e in (a, b) for k in ("alpha", "beta"))
    rad, at = np.radians(a["theta"]), np.radians(a["theta"] - b["theta"])
    dx, dy, c, d = b["x"] - a["x"], b["y"] - a["y"], np.cos(at), np.sin(at)
    u, v = (dx * np.cos(rad) + dy * np.sin(rad)) / a1, (dy * np.cos(rad) - dx * np.sin(rad)) / a2
    m11, m12, m21, m22 = a1 * c / b1, a2 * d / b1, a1 * d / b2, a2 * c / b2
    p, q, s = m11 * m11 + m21 * m21, m21 * m22 - m11 * m12, m12 * m12 + m22 * m22
    r, t = p * u + q * v, q * u + s * v
    w = u * r + v * t - 1.0
    x, y, z = p + s - w, p * s - q * q - w * (p + s) + t * t + r * r, w * q * q - w * p * s + t * t * p - 2.0 * q * t * r + r * r * s
    discriminant = 18.0 * x * y * z - 4.0 * x * x * x * z + x * x * y * y - 4.0 * y * y * y - 27.0 * z * z
    out[near] = ~((discriminant > 0.0) & ((x <= 0.0) | (y <= 0.0)))
    return out


def members(column: pa.ListArray) -> tuple[np.ndarray, Arrays]:
    """How many members each row has, and their columns one after the other."""
    many, every = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()
    found = {f.name: every.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(every.type)}
    return many, {k: x.astype(np.int64 if k == "mmsi" else np.float64) for k, x in found.items()}


def _asked(a: Arrays, b: Arrays, entries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each of ``entries`` the first of the seconds from ``low`` to ``high`` that it meets, or -1."""
    found, width = np.full(len(entries), -1), 1
    open_ = np.flatnonzero(low < high)
    at = low.copy()
    while len(open_):
        for part in np.array_split(open_, -(-len(open_) * width // AT_ONCE)):
            many = np.minimum(high[part] - at[part], width)
            start = np.cumsum(many) - many
            second = np.arange(int(many.sum())) - np.repeat(start - at[part], many)
            first = np.repeat(entries[part], many)
            zone, extent = {k: a[k][first] for k in ("x", "y", "alpha", "beta", "theta")}, {k: b[k][second] for k in ("alpha", "beta", "theta")}
            extent["x"] = turned(b["lon"][second] - a["lon"][first]) * METRES * a["cos"][first] + b["x"][second]
            extent["y"] = (b["lat"][second] - a["lat"][first]) * METRES + b["y"][second]
            meets = touching(zone, extent) & (a["mmsi"][first] != b["mmsi"][second])
            least = np.minimum.reduceat(np.where(meets, second, np.iinfo(np.int64).max), start)
            hit = least < np.iinfo(np.int64).max
            found[part[hit]] = least[hit]
            at[part] += many
        open_ = open_[(found[open_] < 0) & (at[open_] < high[open_])]
        width = min(width * 2, WIDEST)
    return found


def met(params: CloseEncounter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of block pairs as rows of first vessels: how many others are near in the block, and of those it meets the nearest."""
    l1 = max(params.length, 1.0 + 2.0 * params.behind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if not c.endswith("members")}
            (many_a, a), (many_b, b) = members(batch.column("a_members")), members(batch.column("b_members"))
            of_a, of_b = np.repeat(np.arange(len(many_a)), many_a), np.repeat(np.arange(len(many_b)), many_b)
            now = np.maximum(row["a_ts_ms"], row["b_ts_ms"])
            for v, s, of in ((a, "a", of_a), (b, "b", of_b)):
                v["lat"], v["lon"] = _predicted(v, row[f"{s}_lat"][of], row[f"{s}_lon"][of], (now - row[f"{s}_ts_ms"])[of])
            a |= _oval(a, "cog", l1, max(params.breadth, 1.5), -params.behind + 0.5 * l1)
            b |= _oval(b, "hdg", 1.0, 1.0, 0.5)
            a["cos"] = np.cos(np.radians(a["lat"]))
            low = np.cumsum(many_b) - many_b
            # a vessel is not near itself
            key = of_b << 32 | b["mmsi"]
            own = np.searchsorted(key, of_a << 32 | a["mmsi"], "right") - np.searchsorted(key, of_a << 32 | a["mmsi"], "left")
            near = many_b[of_a] - own
            # how far the block's extents reach from the place of its first member, as seen from the first vessel
            away = lambda k: np.abs(b[k] - b[k][low][of_b])
            wide = np.maximum(np.maximum(b["alpha"], b["beta"]), LEAST_AXIS) + np.hypot(b["x"], b["y"]) + np.hypot(turned(away("lon")), away("lat")) * METRES
            wide = np.maximum.reduceat(wide, low)
            x = turned(b["lon"][low][of_a] - a["lon"]) * METRES * a["cos"] - a["x"]
            y = (b["lat"][low][of_a] - a["lat"]) * METRES - a["y"]
            far = np.hypot(x, y) > np.maximum(np.maximum(a["alpha"], a["beta"]), LEAST_AXIS) + wide[of_a] + 1.0
            # the nearest block of each vessel in each run first; those farther than one that it meets are not asked
            _, at = np.unique(row["run_ms"], return_inverse=True)
            _, who = np.unique(at[of_a] << 32 | a["mmsi"], return_inverse=True)
            metres = row["near_metres"][of_a]
            best = np.full(who.max() + 1, np.inf)
            np.minimum.at(best, who, metres)
            other, left = np.full(len(of_a), -1), np.ones(len(of_a), bool)
            for _ in range(2):
                ask = left & (metres <= best[who])
                entries = np.flatnonzero(ask & ~far)
                other[entries] = _asked(a, b, entries, low[of_a[entries]], (low + many_b)[of_a[entries]])
                left &= ~ask
                best[:] = np.inf
                hit = np.flatnonzero(other >= 0)
                np.minimum.at(best, who[hit], metres[hit])
            hit, some = other >= 0, near > 0
            columns = [row["run_ms"][of_a], a["mmsi"].astype(np.int32), near, pa.array(metres, mask=~hit), pa.array(b["mmsi"][other].astype(np.int32), mask=~hit)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["run_ms", "a_mmsi", "near", "near_metres", "b_mmsi"]).filter(pa.array(some))

    return run
