"""Live drifting and sudden speed changes: one state for each vessel follows its last minutes.

The rules are those of the batch windows, read in the order of time.  The state is
a vessel's reports of the longest window (half an hour at most by default) and a
few numbers; what is older is dropped.  A silence past ``stale_minutes`` begins a
new epoch, as in batch.  Reports behind a vessel's newest one are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from math import cos, log, pi, radians, sqrt, tan

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairlead.config import Drift, SuddenSpeedChange
from fairlead.functions.geo import EARTH_RADIUS, KNOTS
from fairlead.operators import analyses, tracks

HISTORY_MS = 30 * 60_000
DRIFT_OUTPUT = "mmsi int, ts_ms long, sustained_drift boolean, raised boolean, transition string"
SPEED_OUTPUT = "mmsi int, start_ms long, end_ms long, fired_ms long, sog1 float, sog2 float"
STATE = "held string"


def _rhumb(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    stretched = lambda lat: log(tan(radians(lat) / 2 + pi / 4))
    dphi, dpsi = radians(lat2) - radians(lat1), stretched(lat2) - stretched(lat1)
    q = dphi / dpsi if abs(dpsi) > 1e-12 else cos(radians(lat1))
    turn = radians((lon2 - lon1 + 180.0) % 360.0 - 180.0)
    return sqrt(dphi * dphi + q * q * turn * turn) * EARTH_RADIUS


def _drifting(params: Drift) -> Callable[[dict, dict], dict | None]:
    period = params.period_minutes * 60_000
    reach = max(HISTORY_MS, period + 1)

    def step(held: dict, r: dict) -> dict | None:
        held["seen"] = [x for x in held["seen"] if x[0] >= r["ts_ms"] - reach] + [[r["ts_ms"], r["drifting"]]]
        if not r["drifting"]:
            held["from"] = None
        elif held["from"] is None:
            held["from"] = [r["lat"], r["lon"]]
        if not r["kept"]:
            return None
        far = bool(r["drifting"] and _rhumb(*held["from"], r["lat"], r["lon"]) > params.metres)
        long_drift = all(d for t, d in held["seen"] if t >= r["ts_ms"] - period)
        sustained = long_drift and r["ts_ms"] - held["seen"][0][0] > period and far
        held["run"] = bool(r["drifting"] and (held["run"] or sustained))
        before, held["raised"] = held["raised"], held["run"]
        name = "RAISE" if held["raised"] and not before else "MAINTAIN" if held["raised"] and sustained else "LOWER" if before and not held["raised"] else None
        return {"ts_ms": r["ts_ms"], "sustained_drift": sustained, "raised": held["raised"], "transition": name}

    return step


def _speed_change(params: SuddenSpeedChange) -> Callable[[dict, dict], dict | None]:
    decay, span = params.decay_seconds * 1000, params.sustain_seconds * 1000

    def step(held: dict, r: dict) -> dict | None:
        last = held["seen"][-1] if held["seen"] else None
        if last is not None:  # the way from a report to the next one belongs to the former
            way, time = _rhumb(last[2], last[3], r["lat"], r["lon"]), r["ts_ms"] - last[0]
            last[4] = way / (time / 1000.0) * KNOTS if time else (float("inf") if way > 0 else None)
        held["seen"] = [x for x in held["seen"] if x[0] >= r["ts_ms"] - span] + [[r["ts_ms"], r["sog"], r["lat"], r["lon"], None]]
        low = r["sog"] is not None and r["sog"] <= params.low
        if r["sog"] is not None and params.high <= r["sog"] <= 102.2000001:
            held["high"] = [r["ts_ms"], r["sog"]]
        if not r["kept"]:
            return None
        if not low:
            held |= {"stop": None, "observed": None, "fired": False}
            return None
        if held["stop"] is None:
            held["stop"] = [r["ts_ms"], r["sog"]]
        if held["observed"] is None and held["high"] and r["ts_ms"] - held["high"][0] <= decay:
            held["observed"] = r["ts_ms"]
        reported = [x[1] for x in held["seen"] if x[1] is not None]
        calculated = [x[4] for x in held["seen"][:-1] if x[4] is not None and x[0] < r["ts_ms"]]
        slow = (not reported or max(reported) <= params.low) and (not calculated or max(calculated) <= params.low)
        if held["fired"] or held["observed"] is None or held["observed"] >= r["ts_ms"] or not slow:
            return None
        held["fired"] = True
        return {"start_ms": held["high"][0], "end_ms": held["stop"][0], "fired_ms": r["ts_ms"], "sog1": held["high"][1], "sog2": held["stop"][1]}

    return step


_FRESH = {"seen": [], "from": None, "run": False, "raised": False, "high": None, "stop": None, "observed": None, "fired": False}


def _follow(step: Callable[[dict, dict], dict | None], columns: list[str], stale_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {"last": None} | json.loads(json.dumps(_FRESH))
        out = []
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts_ms", "seq"], kind="stable")
        for r in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            if held["last"] is not None and r["ts_ms"] < held["last"]:
                continue
            if held["last"] is not None and r["ts_ms"] - held["last"] > stale_ms:
                held |= json.loads(json.dumps(_FRESH))
            held["last"] = int(r["ts_ms"])
            found = step(held, r)
            if found:
                out.append({"mmsi": key[0]} | found)
        state.update((json.dumps(held),))
        if held["last"] is not None and state.getCurrentWatermarkMs() < held["last"] + stale_ms:
            state.setTimeoutTimestamp(held["last"] + stale_ms)
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _stream(rows: DataFrame, step: Callable[[dict, dict], dict | None], output: str, stale_minutes: int, late_minutes: int) -> DataFrame:
    timed = rows.where("lat is not null and lon is not null").withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", f"{late_minutes} minutes")
    columns = [c.split()[0] for c in output.split(", ")]
    return timed.groupBy("mmsi").applyInPandasWithState(_follow(step, columns, stale_minutes * 60_000), output, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drift(reports: DataFrame, params: Drift, stale_minutes: int = 30, late_minutes: int = 10) -> DataFrame:
    """Stream of analysed reports with ``sustained_drift``, ``raised`` and ``transition``."""
    flags = reports.withColumn("drifting", tracks.is_drifting(params.least_sog, params.most_sog, params.angle)).withColumn("kept", F.coalesce(analyses.drift_guard(reports, params), F.lit(False)))
    return _stream(flags.select("mmsi", "ts_ms", "seq", "lat", "lon", "drifting", "kept"), _drifting(params), DRIFT_OUTPUT, stale_minutes, late_minutes)


def sudden_speed_changes(reports: DataFrame, params: SuddenSpeedChange, stale_minutes: int = 30, late_minutes: int = 10) -> DataFrame:
    """Stream of sudden speed changes, one row when each fires."""
    flags = reports.withColumn("kept", F.coalesce(analyses.speed_change_guard(reports, params), F.lit(False)))
    return _stream(flags.select("mmsi", "ts_ms", "seq", "lat", "lon", "sog", "kept"), _speed_change(params), SPEED_OUTPUT, stale_minutes, late_minutes)
