"""Best-fit packing by a grouping genetic algorithm on islands.

Method.  Documents are tokenised and cut into pieces of at most ``capacity``
ids; only longer documents are cut, and their first piece takes the remainder.
Pieces are dealt by hash, of the row's place too, into blocks of about ``BLOCK``
pieces.  Each block is evolved by several populations: a chromosome is a
partition of the pieces into bins; every child is made by crossover, which injects
whole well-filled bins of the second parent that are fuller than what they break
(and a few others), drops the first parent's bins that hold any injected piece, and
best-fits the displaced pieces.  So a child joins the full bins of both parents.
One mutation of each child empties the least-filled bin and a few others that have
room and fills them anew, each with the longest piece left and those that fill the
rest of it most; it stays if the child is no worse.  After each epoch an island's
elite migrates to the next island of its block, through a table in the shared
folder.  The best island's bins become sequences.

Memory follows ``BLOCK``, not the table.  A population stops at the lower bound
of total ids / ``capacity`` bins, after ``generations``, or after ``patience``
generations in which no bin was saved; a block can stop above its bound, and README
has measured figures.

Defined results: a null text is empty and becomes one piece, the end id; null
and repeated ids are packed like any others, and many equal rows are dealt to all
blocks; other ids are cast to long; a very long text is encoded whole by one
task; an empty table gives no rows; extra columns are left out, whatever their
names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import BATCH_BYTES, lean, materialize, release, sized_slices, text_buffers
from fairlead.llm.tokens import END_ID, default_tokenizer, encoder

CAPACITY = 1024
BLOCK = 8192
#: Tasks of an epoch at most; each then holds several blocks.
TASKS = 20_000
WELL_FILLED = 0.97
#: Share of well-filled bins that are injected whatever they break.
BOLD = 0.1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long"
STATE = "block long, island int, lengths binary, elite binary, bins int"


@dataclass(frozen=True)
class Search:
    """How long a block is evolved."""

    islands: int = 2
    epochs: int = 2
    population: int = 6
    generations: int = 60
    children: int = 8
    patience: int = 20


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` ids begin, and ``n``; the first piece takes the remainder."""
    if n <= capacity:
        return [0, n]
    return [0, *range((n - 1) % capacity + 1, n + 1, capacity)]


def _pieces(tokenizer: str, capacity: int):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, turn = encoder(tokenizer), 0
        for batch in batches:
            for part in sized_slices(batch, "text"):
                ids, edge = model.encode_buffers(*text_buffers(part.column(1)), end=END_ID)
                raw, rows = ids.view(np.uint8), []
                for doc, first, last in zip(part.column(0).to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    cuts = cut_points(last - first, capacity)
                    turn += 1
                    rows += [(doc, k, a, b - a, zlib.crc32(raw[4 * (first + a) : 4 * (first + b)]), turn) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "turn"])

    return run


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece; ``turn`` counts the rows of a task and tells equal rows apart once the table is written."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_pieces(tokenizer or default_tokenizer(), capacity), keep=True), PIECES)


class _Bins:
    """Best fit over residual capacities: open bins by residual, and a bit for each residual in use."""

    def __init__(self, capacity: int):
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0
        self.capacity = capacity

    def add(self, bin_id: int, residual: int) -> None:
        self.open[residual].append(bin_id)
        self.used |= 1 << residual

    def place(self, length: int) -> tuple[int, int]:
        """The fullest bin with room and its residual, or (-1, capacity) for a new one."""
        fits = self.used >> length
        if not fits:
            return -1, self.capacity
        residual = length + (fits & -fits).bit_length() - 1
        stack = self.open[residual]
        found = stack.pop()
        if not stack:
            self.used &= ~(1 << residual)
        return found, residual


def best_fit(lengths: np.ndarray, bin_of: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Put the pieces of ``order`` (now in no bin, -1) into the bins of the others or new ones."""
    kept = bin_of >= 0
    names, inverse = np.unique(bin_of[kept], return_inverse=True)
    out = np.full(len(lengths), -1, np.int64)
    out[kept] = inverse
    bins = _Bins(capacity)
    for b, fill in enumerate(np.bincount(inverse, lengths[kept], len(names)).astype(np.int64).tolist()):
        if fill < capacity:
            bins.add(b, capacity - fill)
    n = len(names)
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        b, residual = bins.place(length)
        if b < 0:
            b, n = n, n + 1
        out[i] = b
        if residual > length:
            bins.add(b, residual - length)
    return out


def fitness(lengths: np.ndarray, bin_of: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the sum of squared fills (a few full bins beat many half-full ones)."""
    fill = np.bincount(bin_of, lengths) / capacity
    return -len(fill), float((fill**2).sum())


def crossover(lengths: np.ndarray, first: np.ndarray, second: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(second, lengths)
    fullest_broken = np.zeros(len(fill))
    np.maximum.at(fullest_broken, second, np.bincount(first, lengths)[first])
    chosen = (fill >= WELL_FILLED * capacity) & ((fill > fullest_broken) | (rng.random(len(fill)) < BOLD))
    injected = chosen[second]
    broken = np.zeros(int(first.max()) + 1, bool)
    broken[first[injected]] = True
    child = np.where(broken[first], -1, first)
    child[injected] = second[injected] + len(broken)
    loose = np.flatnonzero(child < 0)
    return best_fit(lengths, child, loose[np.argsort(-lengths[loose], kind="stable")], capacity)


def refilled(lengths: np.ndarray, bin_of: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """New bins for the pieces of ``loose``: each begins with the longest left and takes others that fill it most.

    Which sums the others reach is kept as the bits of one number, as it was before each of them.
    """
    out, bins = bin_of.copy(), int(bin_of.max(initial=-1)) + 1
    left = loose[np.argsort(-lengths[loose], kind="stable")].tolist()
    short = (-lengths[left]).tolist()  # ascending, for bisection
    while left:
        head = left.pop(0)
        room = capacity + short.pop(0)
        out[head] = bins
        reached, tried, at = 1, [], bisect_left(short, -room)
        inside = (2 << room) - 1
        while at < len(left) and not reached >> room & 1:
            tried.append(reached)
            reached |= reached << -short[at] & inside
            at += 1
        total = reached.bit_length() - 1
        for k in range(at - 1, at - 1 - len(tried), -1):
            if not tried[k - at] >> total & 1:
                out[left[k]] = bins
                total += short[k]
                del left[k], short[k]
        bins += 1
    return out


def mutate(lengths: np.ndarray, bin_of: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(bin_of, lengths)
    room = np.flatnonzero(fill < capacity)
    if len(room) < 2:
        return bin_of
    some = int(rng.integers(4, 20))
    emptied = np.zeros(len(fill), bool)
    emptied[room[np.argmin(fill[room])]] = True
    emptied[rng.choice(room, min(some, len(room)), replace=False)] = True
    if rng.random() < 0.5:
        emptied[rng.integers(len(fill), size=some // 2 + 1)] = True
    loose = emptied[bin_of]
    names = np.cumsum(~emptied) - 1
    return refilled(lengths, np.where(loose, -1, names[bin_of]), np.flatnonzero(loose), capacity)


def evolve(lengths: np.ndarray, migrants: list[np.ndarray], capacity: int, seed: int, search: Search = Search()) -> np.ndarray:
    """One epoch of one island; returns its elite."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    empty = np.full(len(lengths), -1, np.int64)
    serial = 0
    scored: list[tuple[tuple[int, float], int, np.ndarray]] = []

    def add(made: np.ndarray) -> None:
        nonlocal serial
        scored.append((fitness(lengths, made, capacity), serial, made))  # of equals the newer one leads
        serial += 1

    def fittest() -> list[tuple[tuple[int, float], int, np.ndarray]]:
        """The population, one of each fitness: equals would only be crossed with themselves."""
        ranked = sorted(scored, key=lambda x: x[:2], reverse=True)
        return [x for k, x in enumerate(ranked) if not k or x[0] != ranked[k - 1][0]][: search.population]

    for known in migrants:
        add(known)
    while len(scored) < search.population:
        noise = 0 if not scored else 0.05 * capacity
        order = np.argsort(-(lengths + rng.normal(0, 1, len(lengths)) * noise), kind="stable")
        add(best_fit(lengths, empty, order, capacity))
    scored = fittest()
    still = 0
    for _ in range(search.generations):
        if -scored[0][0][0] <= least or still >= search.patience:
            break
        bins, parents = scored[0][0][0], [x[2] for x in scored]
        for _ in range(search.children):
            one, two = rng.choice(len(parents), 2, replace=len(parents) < 2)
            child = crossover(lengths, parents[one], parents[two], capacity, rng)
            mutant = mutate(lengths, child, capacity, rng)
            add(max(child, mutant, key=lambda x: (fitness(lengths, x, capacity), x is mutant)))
        scored = fittest()
        still = 0 if scored[0][0][0] > bins else still + 1
    return scored[0][2]


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)


def _found(key, rows: pd.DataFrame, capacity: int, islands: int) -> pd.DataFrame:
    """The lengths of a block's pieces that share bins, one row for each island."""
    lengths = _in_order(rows)["length"].to_numpy(np.int64)
    packed = lengths[lengths < capacity].astype("<u4").tobytes()
    return pd.DataFrame({"block": key[0], "island": np.arange(islands, dtype=np.int32), "lengths": packed, "elite": b"", "bins": 0})


def _epoch(number: int, capacity: int, search: Search):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, "<u4").astype(np.int64)
                if len(lengths):
                    known = [np.frombuffer(x, "<u4").astype(np.int64) for x in (row.elite, row.migrant) if x]
                    best = evolve(lengths, known, capacity, zlib.crc32(f"{row.block}/{row.island}/{number}".encode()), search)
                else:
                    best = np.zeros(0, np.int64)
                out.append((row.block, row.island, row.lengths, best.astype("<u4").tobytes(), int(best.max(initial=-1)) + 1))
            yield pd.DataFrame(out, columns=["block", "island", "lengths", "elite", "bins"])

    return run


def _placed(capacity: int):
    def run(key, rows: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(rows)
        lengths = rows["length"].to_numpy(np.int64)
        full = int((lengths >= capacity).sum())
        shared = np.frombuffer(best["elite"].iloc[0], "<u4").astype(np.int64) if len(best) else np.zeros(0, np.int64)
        bin_of = np.concatenate([np.arange(full), shared + full])
        order = np.argsort(bin_of, kind="stable")
        size = lengths[order]
        run_start = np.cumsum(size) - size
        new = np.concatenate([[True], np.diff(bin_of[order]) > 0])
        offset = np.empty(len(rows), np.int64)
        offset[order] = run_start - np.maximum.accumulate(np.where(new, run_start, 0))
        rows["sequence_id"] = key[0] * (1 << 32) + bin_of
        rows["offset"] = offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY, block: int = BLOCK, search: Search = Search()
) -> DataFrame:
    """One row for each piece with its sequence and its place there."""
    cut = materialize(pieces(docs, text, doc_id, tokenizer, capacity), "pieces", BATCH_BYTES)
    blocks = max(1, -(-cut.count() // block))
    cut_rows = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", "turn"), F.lit(blocks)))
    state = materialize(cut_rows.groupBy("block").applyInPandas(lambda key, rows: _found(key, rows, capacity, search.islands), STATE), "islands")
    tasks = min(blocks * search.islands, TASKS)
    for number in range(search.epochs):
        moved = state.select("block", ((F.col("island") + 1) % search.islands).alias("island"), F.col("elite").alias("migrant"))
        # the number of partitions is named: small rows hold long work, and must not be put together by size
        ready = state.join(moved, ["block", "island"]).repartition(tasks, F.col("block"), F.col("island"))
        after = materialize(ready.mapInPandas(_epoch(number, capacity, search), STATE), "islands")
        release(state)
        state = after
    best = state.groupBy("block").agg(F.min_by("elite", F.struct("bins", "island")).alias("elite"))
    schema = f"{PIECES.removesuffix(', turn long')}, sequence_id long, offset long"
    placed = materialize(cut_rows.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(_placed(capacity), schema), "placed")
    release(cut, state)
    return placed
