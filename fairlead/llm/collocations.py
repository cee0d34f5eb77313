"""Phrase collocation mining by generalised suffix automata of shards.

Method.  A shard is a block of about ``SHARD_BYTES`` of texts of one language.  Its
words are numbered, and the suffix automaton of all its pieces is built bounded to
``WORDS`` words: :class:`Automaton` sorts the word positions by the words read
backward from there, which is the tree of the automaton's suffix links; positions
that share the last ``d`` words are one node, nodes with the same end positions
are one state.  A state has its longest phrase, the length from which its phrases
begin, the count of its end positions and its link.  All phrases of the states go
out with their counts, packed by bucket of the phrase's hash, and are reduced
globally as texts, so no count rests on a hash.

Of the frequent phrases, each of two or more words is cut at every place and keeps
its lowest score.  A phrase hangs by its suffix link on the one without its first
word, and by a transition on the one without its last; counts never rise from a
phrase to a longer one, so a phrase is subsumed exactly if one of the phrases that
are one word longer has half its count.

Defined results: null texts are empty and give nothing; a null language is
``und``; repeated rows count again; ids are not used; ties of scores are ordered
by count, then by the phrase's bytes; a very long text is one shard, in one task; a
language without candidates has no rows, nor has an empty table; extra columns are
left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import estimated_bytes, materialize, mix64, release, sized_slices, text_buffers

WORDS = 3
LEAST = 10
TOP = 2000
#: A phrase goes if a longer candidate has this share (of 100) of its count.
SUBSUMED = 50
SHARD_BYTES = 4 << 20
#: Phrases of a shard whose texts are made at once.
CHUNK = 1 << 17
#: Bytes of stored input for a bucket of phrases, and buckets at least.
BUCKET_BYTES, LEAST_BUCKETS = 2 << 20, 64
#: Phrases that a merge holds before it adds up what repeats.
MERGED_ROWS = 500_000
#: Level-one partitions of a language in the ranking.
SPREAD = 64

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Pieces:
    """Words of a run of texts, lower-cased and joined by single spaces, with the words before each in its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~_GAPS[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        at, to = edges[edges < len(data)], edges[edges > 0] - 1
        begins[at] = inside[at]
        ends[to] |= inside[to]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.length = end - start
        first = np.cumsum(self.length + 1) - self.length - 1
        self.start = first
        text = np.full(int(self.length.sum()) + len(start), 0x20, np.uint8)
        text[_spans(first, self.length)] = _LOWER[data[inside]]
        self.text = text
        # a piece ends at each separator and at the end of each text
        marks = np.cumsum(_ENDS[data])[start] if len(start) else start
        breaks = np.ones(len(start), bool)
        breaks[1:] = (marks[1:] != marks[:-1]) | (np.diff(np.searchsorted(offsets, start, side="right")) > 0)
        at = np.arange(len(start))
        self.before = at - np.maximum.accumulate(np.where(breaks, at, 0))
        bare = np.concatenate([[0], np.cumsum(self.length)])
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bare.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = np.fromiter((zlib.crc32(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))

    def phrases(self, end: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and lengths of the phrases of so many words that end at these words, each with a line feed."""
        begin = self.start[end - words + 1]
        length = self.start[end] + self.length[end] - begin
        edge = np.cumsum(length + 1) - length - 1
        out = np.full(int(length.sum()) + len(end), 0x0A, np.uint8)
        out[_spans(edge, length)] = self.text[_spans(begin, length)]
        return out, length + 1


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after the other."""
    if not len(start):
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class Automaton:
    """The suffix automaton of pieces of numbered words, for phrases of ``depth`` words at most.

    States are arrays: ``end`` (a word where its phrases end), ``longest`` and
    ``shortest`` (their words), ``count`` (of all end positions) and ``link`` (the
    state of the longest suffix with more end positions; -1 is the root).
    """

    def __init__(self, ids: np.ndarray, before: np.ndarray, depth: int = WORDS):
        back = [np.where(before >= d, np.roll(ids, d) + 1, 0) for d in range(depth)]
        order = np.lexsort(back[::-1]) if depth * int(ids.max(initial=0) + 2).bit_length() > 63 else np.argsort(_packed(back))
        n = len(ids)
        first, size, parent = [], [], []  # of the nodes of each depth, in the order of their positions
        fresh = np.zeros(n, bool)
        fresh[:1] = True
        for d in range(depth):
            word = back[d][order]
            fresh[1:] |= word[1:] != word[:-1]
            edges = np.flatnonzero(fresh)
            there = word[edges] > 0
            first.append(edges[there])
            size.append(np.diff(np.append(edges, n))[there])
            parent.append(np.searchsorted(first[d - 1], first[d], side="right") - 1 if d else np.full(len(first[0]), -1))
        # a node that has a child with all its end positions is of the child's state
        taken = [np.zeros(len(f), bool) for f in first]
        for d in range(1, depth):
            whole = size[d] == size[d - 1][parent[d]]
            taken[d - 1][parent[d][whole]] = True
        base = np.cumsum([0, *(int((~t).sum()) for t in taken)])
        number = [np.cumsum(~t) - 1 + b for t, b in zip(taken, base, strict=False)]
        self.end = np.concatenate([order[f[~t]] for f, t in zip(first, taken, strict=True)])
        self.count = np.concatenate([s[~t] for s, t in zip(size, taken, strict=True)])
        self.longest = np.repeat(np.arange(1, depth + 1), np.diff(base))
        self.shortest, self.link = self.longest.copy(), np.full(len(self.end), -1)
        for d in range(depth):
            node, own = np.flatnonzero(~taken[d]), number[d][~taken[d]]
            up, level = parent[d][node], d - 1
            while level >= 0 and len(node):
                same = taken[level][up] & (size[level][up] == self.count[own])
                self.link[own[~same]] = number[level][up[~same]]
                self.shortest[own[same]] = level + 1
                own, up = own[same], parent[level][up[same]]
                node, level = own, level - 1

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, words, count) of every distinct phrase."""
        times = self.longest - self.shortest + 1
        state = np.repeat(np.arange(len(self.end)), times)
        words = _spans(self.shortest, times)
        return self.end[state], words, self.count[state]


def _packed(back: list[np.ndarray]) -> np.ndarray:
    bits = int(max(b.max(initial=0) for b in back) + 1).bit_length()
    key = back[0]
    for b in back[1:]:
        key = (key << bits) | b
    return key


def _counted(buckets: int, depth: int, shard_bytes: int):
    """Each shard's phrases and counts, a row for each bucket that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for name in pc.unique(batch.column(0)).to_pylist():
                rows = batch.filter(pc.equal(batch.column(0), name))
                seed = np.uint64(zlib.crc32(name.encode()))
                for part in sized_slices(rows, "text", shard_bytes):
                    pieces = Pieces(*text_buffers(part.column(1)))
                    if not len(pieces.ids):
                        continue
                    end, words, count = Automaton(pieces.ids, pieces.before, depth).phrases()
                    code = np.full(len(end), seed)
                    for d in range(depth):
                        longer = words > d
                        code[longer] = mix64(code[longer] * np.uint64(0x100000001B3) + pieces.codes[pieces.ids[end[longer] - d]] + np.uint64(1))
                    bucket = (code % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    used, first = np.unique(bucket[order], return_index=True)
                    step = max(1, len(used) * CHUNK // len(order))
                    last = np.append(first[1:], len(order))
                    for k in range(0, len(used), step):  # some buckets at a time, since the phrases overlap and their texts are much longer
                        names, a, b = used[k : k + step], first[k : k + step], last[k : k + step]
                        own = order[a[0] : b[-1]]
                        text, length = pieces.phrases(end[own], words[own])
                        edge, a, b = np.concatenate([[0], np.cumsum(length)]), a - a[0], b - a[0]
                        times = count[own].astype("<u4")
                        packed = [packer.compress(text[edge[i] : edge[j]]) for i, j in zip(a, b, strict=True)]
                        counts = [packer.compress(times[i:j]) for i, j in zip(a, b, strict=True)]
                        yield pa.record_batch([pa.array([name] * len(names)), pa.array(names), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "bucket", "phrases", "counts"])

    return run


def _merged(least: int):
    """The counts of one bucket of a language over all shards; a row without phrase has its words in all."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        sums: pa.Table | None = None
        for texts, counts in zip(group.column("phrases").to_pylist(), group.column("counts").to_pylist(), strict=True):
            data = np.frombuffer(unpacker.decompress(texts), np.uint8)
            n = np.frombuffer(unpacker.decompress(counts), "<u4").astype(np.int64)
            edge = np.concatenate([[0], np.flatnonzero(data == 0x0A) + 1]).astype(np.int64)
            more = pa.table({"phrase": pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edge), pa.py_buffer(data)]), "f": n})
            sums = more if sums is None else pa.concat_tables([sums, more])
            if sums.num_rows > MERGED_ROWS:
                sums = _summed(sums)
        sums = _summed(sums)
        spaces = pc.count_substring(sums.column("phrase"), " ")
        total = pc.sum(sums.column("f").filter(pc.equal(spaces, 0))).as_py() or 0
        kept = sums.filter(pc.greater_equal(sums.column("f"), least))
        words = pc.add(pc.filter(spaces, pc.greater_equal(sums.column("f"), least)), 1)
        phrase = pc.binary_slice(kept.column("phrase"), 0, -1).cast(pa.large_string()).cast(pa.string())
        n = kept.num_rows
        lang = key[0].as_py()
        return pa.table(
            {
                "lang": pa.array([lang] * (n + 1), pa.string()),
                "words": pa.concat_arrays([pa.array([0], pa.int32()), *words.cast(pa.int32()).chunks]),
                "phrase": pa.concat_arrays([pa.array([None], pa.string()), *phrase.chunks]),
                "f": pa.concat_arrays([pa.array([total], pa.int64()), *kept.column("f").cast(pa.int64()).chunks]),
            }
        )

    return run


def _summed(rows: pa.Table) -> pa.Table:
    return rows.group_by("phrase").aggregate([("f", "sum")]).rename_columns(["phrase", "f"])


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = WORDS, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, words, phrase, f of all phrases of ``depth`` words at most with f of ``least`` or more; words 0 has parts of n."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null and text <> ''")
    buckets = max(LEAST_BUCKETS, estimated_bytes(docs) // BUCKET_BYTES)
    packed = rows.mapInArrow(_counted(buckets, depth, shard_bytes), "lang string, bucket long, phrases binary, counts binary")
    return packed.groupBy("lang", "bucket").applyInArrow(_merged(least), "lang string, words int, phrase string, f long")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10^16."""
    wide = lambda c: c.cast("decimal(16,0)")
    above, below = wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right)
    return F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)")).cast("long")


def _first_words(phrase: Column, k: Column | int) -> Column:
    return F.substring_index(phrase, " ", k)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = WORDS, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score."""
    found = materialize(counts(docs, text, lang, depth, least), "phrases")
    totals = found.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    single = found.where("words > 0").select("lang", "phrase", "f")
    candidates = found.where("words > 1")
    cuts = None
    for words in range(2, depth + 1):
        for k in range(1, words):
            own = candidates.where(F.col("words") == words).select("lang", "phrase", "words", F.col("f").alias("a"), F.lit(k).alias("k"), _first_words(F.col("phrase"), k).alias("left"), _first_words(F.col("phrase"), k - words).alias("right"))
            cuts = own if cuts is None else cuts.unionByName(own)
    part = lambda side, name: single.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # by suffix link and by transition: the phrases that are one word shorter
    shorter = candidates.where("words > 2").select("lang", F.explode(F.array(F.expr("substring(phrase, locate(' ', phrase) + 1)"), F.expr("substring_index(phrase, ' ', words - 1)"))).alias("phrase"), "f")
    longer = shorter.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)).alias("turn"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for keys in (["lang", "turn"], ["lang"]):  # the second level sees SPREAD * top rows of a language at most
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    out = rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    done = materialize(out, "collocations")
    release(found)
    return done
