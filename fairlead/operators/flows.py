"""Vessels that sail the same way, worked out in numpy over rows of block pairs, and reported again after a while only.

What crosses the shuffle is a list of numbers for a first vessel, a run and a block of second ones: two bytes a
pair, as differences of sorted numbers.  A first vessel's lists are then read in the order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fairlead.config import FreeFlow
from fairlead.functions.geo import LEAST_AXIS, METRES
from fairlead.operators.filters import spaced
from fairlead.operators.meetings import Arrays, members, turned

#: ``steps`` are 16-bit differences of the sorted seconds, the last value for those in ``wide`` (each list's first, and wide ones).
LISTS = "run_ms long, a_mmsi int, a_ts_ms long, steps binary, wide array<long>"
REPORTS = "run_ms long, a_mmsi int, b_mmsi int, a_ts_ms long"
OWN = ("x", "y", "alpha", "beta", "shrink", "cos", "sin")
#: Pairs that are worked out at once at most (their columns stay in a core's cache) and that are thinned at once, unless one vessel has more.
AT_ONCE, THINNED = 1 << 15, 1 << 16
WIDE = 0xFFFF

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _parts(many: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` pairs at most; one row at least."""
    ends, begin = np.cumsum(many), 0
    while begin < len(many):
        done = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, done + most, "right")), begin + 1)
        yield begin, end
        begin = end


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As :func:`fairlead.functions.geo.direction_difference`."""
    turn = a - b
    wide = ~(np.abs(turn) < 360.0)
    if wide.any():
        turn[wide] = np.mod(turn[wide], 360.0)
    turn = np.where(turn < 0.0, turn + 360.0, turn)
    return np.minimum(turn, 360.0 - turn)


def _inside(a: Callable[[str], np.ndarray], b: Callable[[str], np.ndarray]) -> np.ndarray:
    """As :func:`fairlead.functions.geo.contains`, on a plane around the first's centre; what is no number is outside."""
    dx = turned(b("lon") - a("lon")) * METRES * a("shrink") - a("x")
    dy = (b("lat") - a("lat")) * METRES - a("y")
    cos, sin = a("cos"), a("sin")
    u, v = (dx * cos + dy * sin) / np.maximum(a("alpha"), LEAST_AXIS), (dy * cos - dx * sin) / np.maximum(a("beta"), LEAST_AXIS)
    return u * u + v * v <= 1.0


def _lists(seconds: np.ndarray, many: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Sorted numbers, ``many`` for each list, as steps and wide steps."""
    ends = np.concatenate([[0], np.cumsum(many)])
    steps = np.diff(seconds, prepend=0)
    steps[ends[:-1]] = seconds[ends[:-1]]
    wide = (steps < 0) | (steps >= WIDE)
    wide[ends[:-1]] = True
    wide_ends = np.concatenate([[0], np.cumsum(wide)])[ends]
    small = np.where(wide, WIDE, steps).astype("<u2")
    of_steps = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(small)])
    return of_steps, pa.ListArray.from_arrays(pa.array(wide_ends.astype(np.int32)), pa.array(steps[wide]))


def _numbers(steps: pa.Array, wide: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each list has, and the numbers one list after the other."""
    offsets = np.frombuffer(steps.buffers()[1], np.int32)[steps.offset : steps.offset + len(steps) + 1].astype(np.int64) // 2
    small = np.frombuffer(steps.buffers()[2], "<u2")[offsets[0] : offsets[-1]].astype(np.int64)
    small[small == WIDE] = wide.flatten().to_numpy(zero_copy_only=False)
    many, total = np.diff(offsets), np.cumsum(small)
    low = offsets[:-1] - offsets[0]
    return many, total - np.repeat(total[low] - small[low], many)


def sailing(params: FreeFlow) -> Batches:
    """Rows of block pairs as ``LISTS``: the second vessels that sail as a first one does, in its ellipse."""

    def found(row: Arrays, a: Arrays, b: Arrays, of_a: np.ndarray, low: np.ndarray, many_b: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = many_b[of_a]
        for begin, end in _parts(many, AT_ONCE):
            some, start = many[begin:end], np.cumsum(many[begin:end]) - many[begin:end]
            second = np.arange(int(some.sum())) - np.repeat(start - low[of_a[begin:end]], some)
            first = lambda k: np.repeat(a[k][begin:end], some)  # noqa: B023, E731
            other = lambda k: b[k][second]  # noqa: B023, E731
            with np.errstate(invalid="ignore", over="ignore"):
                keep = (_difference(first("cog"), other("cog")) < params.course_degrees) & _inside(first, other) & (first("mmsi") != other("mmsi"))
            hits = np.add.reduceat(keep, start, dtype=np.int64)
            at = np.flatnonzero(hits)
            if len(at):
                steps, wide = _lists(b["mmsi"][second[keep]], hits[at])
                rows = of_a[begin:end][at]
                columns = [pa.array(row["run_ms"][rows]), pa.array(a["mmsi"][begin:end][at].astype(np.int32)), pa.array(row["a_ts_ms"][rows]), steps, wide]
                yield pa.RecordBatch.from_arrays(columns, ["run_ms", "a_mmsi", "a_ts_ms", "steps", "wide"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("run_ms", "a_ts_ms")}
                (many_a, a), (many_b, b) = members(batch.column("a_members")), members(batch.column("b_members"))
                yield from found(row, a, b, np.repeat(np.arange(len(many_a)), many_a), np.cumsum(many_b) - many_b, many_b)

    return run


def reported(period_ms: int) -> Batches:
    """``LISTS``, sorted by first vessel, its time and run, as ``REPORTS``: a pair again only ``period_ms`` after its last report.

    The seconds reported within the period before are kept of one first vessel at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder, held, held_ms = None, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for begin, end in _parts(pc.binary_length(batch.column("steps")).to_numpy() // 2, THINNED):
                part = batch.slice(begin, end - begin)
                many, seconds = _numbers(part.column("steps"), part.column("wide"))
                of, at, runs = (part.column(c).to_numpy().astype(np.int64) for c in ("a_mmsi", "a_ts_ms", "run_ms"))
                if of[0] != holder:
                    held, held_ms = held[:0], held_ms[:0]
                who = np.concatenate([[0], np.cumsum(of[1:] != of[:-1])])
                each = np.concatenate([np.full(len(held), -1), np.repeat(np.arange(len(of)), many)])
                seconds, times = np.concatenate([held, seconds]), np.concatenate([held_ms, np.repeat(at, many)])
                # pairs as one number, in the order of time within each: the lists are sorted already
                key = np.where(each < 0, 0, who[each]) << 33 | seconds + (1 << 31)
                order = np.argsort(key, kind="stable")
                key, times, each = key[order], times[order], each[order]
                stays, _ = spaced([key], times, period_ms, None)
                new = np.flatnonzero(stays & (each >= 0))
                rows = each[new]
                seconds = seconds[order]
                columns = [runs[rows], of[rows].astype(np.int32), seconds[new].astype(np.int32), at[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["run_ms", "a_mmsi", "b_mmsi", "a_ts_ms"])
                # what may hold back later rows of the last vessel: each pair's last report
                holder = of[-1]
                kept = np.flatnonzero(stays)
                last = np.append(key[kept][1:] != key[kept][:-1], True)
                kept = kept[last & (key[kept] >> 33 == who[-1]) & (times[kept] + period_ms > at[-1])]
                held, held_ms = seconds[kept], times[kept]

    return run
