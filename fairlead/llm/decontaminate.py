"""Benchmark decontamination: an FM-index of each training shard, searched for benchmark windows.

Method.  A shard is a run of documents of about ``SLICE_BYTES`` of text.  Its
words become numbers and its FM-index is searched for the windows, last word
first, by wavelet-matrix ranks; hits are located through sampled suffix positions
and their word ranges merged into spans to remove.  Windows with a word that the
shard lacks are left out before.  Shards are independent: nothing is shuffled,
and memory follows a shard.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text.  The driver
makes each block's arrays once (words as numbers, distinct windows as positions
in them, the items of each window) and sends them on their own.  With one block,
words that it lacks, and runs of words too short for any window, become
separators before the index is made.  With more, a shard's index is made once
over all its words and asked block by block; ``HELD`` shards wait for each block,
so that a block is opened once for all of them.

A window is 13 consecutive words of an item (all of a shorter item).  A document
is contaminated if a twentieth or more of its words are in occurrences.  Words
are compared by 64-bit hashes.

Defined results: a null text has no words and no hits; items without words or
without id are left out, ids that repeat are one item; an empty benchmark hits
nothing; a very long text is a shard of its own; repeated rows give repeated
results; extra columns stay untouched in :func:`clean` and are left out
elsewhere, whatever their names; a null doc_id is judged like any other, other
ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import Words, char_class, lean, mix64, sized_slices, text_buffers
from fairlead.llm.fm_index import FMIndex

WINDOW = 13
SHARE = 20
BLOCK_BYTES = 32 << 20
#: Shards that wait for a block where there are several.
HELD = 32
_BREAK = 1
_Q = mix64(np.arange(201, 201 + WINDOW, dtype=np.uint64)) | np.uint64(1)


class Phrases:
    """The windows of a block of items as arrays: a few numbers for each word of the block."""

    def __init__(self, items: list[tuple[str, str | None]]):
        words = Words(*text_buffers(pa.array([t for _, t in items], pa.string())), char_class("alnum"))
        self.vocabulary, number = np.unique(words.hash, return_inverse=True)
        self.number = number.astype(np.int32)
        count = np.diff(words.offsets)
        size = np.minimum(count, WINDOW)
        windows = np.where(size > 0, count - size + 1, 0)
        owner = np.repeat(np.arange(len(items)), windows)
        start = np.repeat(words.offsets[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        length = np.repeat(size, windows)
        key = length.astype(np.uint64)
        for j in range(WINDOW):
            inside = j < length
            key[inside] += words.hash[start[inside] + j] * _Q[j]
        _, at, of = np.unique(mix64(key), return_index=True, return_inverse=True)
        self.start, self.length = start[at].astype(np.int32), length[at].astype(np.int32)
        self.shortest = int(length.min()) if len(length) else 0
        self.names = sorted({i for i, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        named = np.array([place[i] for i, _ in items], np.int64)
        pairs = np.unique(of * max(1, len(self.names)) + named[owner])
        self.item = (pairs % max(1, len(self.names))).astype(np.int32)
        self.item_at = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(at) + 1)).astype(np.int32)

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return self.vocabulary[at] == hashes

    def items_of(self, windows: np.ndarray) -> set[str]:
        return {self.names[k] for w in windows.tolist() for k in self.item[self.item_at[w] : self.item_at[w + 1]].tolist()}


class Shard:
    """The FM-index of a run of texts' words; ``known`` marks the words that can be in windows of ``shortest`` or more."""

    def __init__(self, words: Words, known: np.ndarray, shortest: int):
        self.index = None
        if not shortest or not known.any():
            return
        starts = np.zeros(len(known), bool)
        starts[words.offsets[:-1][words.offsets[:-1] < len(known)]] = True
        edge = known.copy()
        edge[1:] &= ~known[:-1] | starts[1:]
        run = np.cumsum(edge) - 1
        size = np.bincount(run[known], minlength=int(edge.sum()))
        kept = np.flatnonzero(known & (size[np.maximum(run, 0)] >= shortest))
        if not len(kept):
            return
        self.vocabulary, number = np.unique(words.hash[kept], return_inverse=True)
        gap = np.concatenate([[0], np.cumsum((np.diff(kept) > 1) | starts[kept[1:]])])
        place = np.arange(len(kept)) + gap
        text = np.full(int(place[-1]) + 1, _BREAK, np.int64)
        text[place] = number + 2
        self.word_at = np.full(len(text), -1, np.int32)
        self.word_at[place] = kept
        self.index = FMIndex(text, len(self.vocabulary) + 2)

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence inside one text."""
        none = np.zeros(0, np.int64)
        if self.index is None or not phrases.shortest:
            return none, none
        at = np.minimum(np.searchsorted(self.vocabulary, phrases.vocabulary), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == phrases.vocabulary, at + 2, 0).astype(np.int32)[phrases.number]
        absent = np.concatenate([[0], np.cumsum(symbol == 0, dtype=np.int32)])
        able = np.flatnonzero(absent[phrases.start + phrases.length] == absent[phrases.start])
        if not len(able):
            return none, none
        place = phrases.start[able][:, None] + phrases.length[able][:, None] + np.arange(-WINDOW, 0)
        first, last = self.index.search(np.where(place >= phrases.start[able][:, None], symbol[np.maximum(place, 0)], 0).astype(np.int64))
        count = np.maximum(last - first, 0)
        rows = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.repeat(able, count), self.word_at[self.index.locate(rows)].astype(np.int64)


@dataclass
class _Held:
    """A shard's rows and what was found in them so far."""

    part: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray
    words: Words
    shard: Shard
    depth: np.ndarray
    items: dict[int, set[str]] = field(default_factory=dict)

    def ask(self, phrases: Phrases) -> None:
        window, first = self.shard.occurrences(phrases)
        if not len(window):
            return
        np.add.at(self.depth, first, 1)
        np.add.at(self.depth, first + phrases.length[window], -1)
        doc = np.searchsorted(self.words.offsets, first, side="right") - 1
        pairs = np.unique(doc * np.int64(len(phrases.start)) + window)
        doc, window = np.divmod(pairs, len(phrases.start))
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self.items.setdefault(int(doc[a]), set()).update(phrases.items_of(window[a:b]))

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flags of hit words, and each text's words and hit words."""
        hit = np.cumsum(self.depth)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        return hit, np.diff(self.words.offsets), total[self.words.offsets[1:]] - total[self.words.offsets[:-1]]

    def spans(self, hit: np.ndarray, n_hit: np.ndarray) -> list[list[dict]]:
        """Merged ranges of hit words, in code points."""
        out: list[list[dict]] = [[] for _ in range(self.part.num_rows)]
        if not hit.any():
            return out
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        for d in np.flatnonzero(n_hit).tolist():
            a, b = self.words.offsets[d], self.words.offsets[d + 1]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b], [0]]))).reshape(-1, 2)
            base = points[self.offsets[d]]
            out[d] = [{"start": int(points[self.words.start[a + x]] - base), "end": int(points[self.words.end[a + y - 1]] - base)} for x, y in edges.tolist()]
        return out


def _judged(batches: Iterator[pa.RecordBatch], column: str, blocks: list) -> Iterator[_Held]:
    """Every run of rows, after all blocks."""
    only = blocks[0].value if len(blocks) == 1 else None
    flags = char_class("alnum")
    waiting: list[_Held] = []

    def asked() -> Iterator[_Held]:
        for b in blocks:
            phrases = b.value
            for held in waiting:
                held.ask(phrases)
            if only is None:
                b.__dict__.pop("_value", None)  # the next block takes its room
        yield from waiting
        waiting.clear()

    for batch in batches:
        for part in sized_slices(batch, column):
            data, offsets = text_buffers(part.column(part.schema.get_field_index(column)))
            words = Words(data, offsets, flags)
            shard = Shard(words, np.ones(len(words.hash), bool), 1) if only is None else Shard(words, only.knows(words.hash), only.shortest)
            waiting.append(_Held(part, data, offsets, words, shard, np.zeros(len(words.hash) + 1, np.int64)))
            if only is not None or len(waiting) >= HELD:
                yield from asked()
    if waiting:
        yield from asked()


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def _search(blocks: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _judged(batches, "text", blocks):
            hit, n_words, n_hit = held.hits()
            items = [sorted(held.items.get(d, ())) for d in range(held.part.num_rows)]
            yield pa.record_batch([held.part.column(0), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(held.spans(hit, n_hit), pa.list_(_SPAN))], schema=_OUT)

    return run


def _kept(blocks: list, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _judged(batches, column, blocks):
            _, n_words, n_hit = held.hits()
            yield held.part.filter(pa.array((n_hit == 0) | (SHARE * n_hit < n_words)))

    return run


def _sent(benchmark: DataFrame, block_bytes: int) -> list:
    """The benchmark's items in blocks of bounded size, each made into arrays and a broadcast."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    blocks = []
    for k in range(count):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else items
        blocks.append(spark.sparkContext.broadcast(Phrases(sorted((r["item_id"], r["text"]) for r in block.collect()))))
    return blocks


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, the items (as text, sorted) with occurring windows, and spans to remove."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_search(_sent(benchmark, block_bytes))), SCHEMA)


def contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names, contaminated().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated rows; what stays is unchanged.

    No join, since the verdict is made on the row: ids may be null or repeat.
    """
    return docs.mapInArrow(lean(_kept(_sent(benchmark, block_bytes), text)), docs.schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text less its spans."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])
