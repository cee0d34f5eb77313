"""Spelling variants: words at distance one, by a trie self-join with active-node sets.

Method.  The vocabulary's words are dealt to tries.  For a pair whose shorter word
has ``m`` letters, the place ``c`` where the words begin to differ lies in the first
or in the second half of 0..m; the letters before that half and those behind it are
the same in both words.  So a word enters the trie of its first half (for pairs that
differ behind it) and the trie of its second half (for pairs that differ before it),
for ``m`` its own length and one less.  A trie of more than ``LARGEST`` words is dealt
anew by half of its range of places, and so on down to a single place, where a trie
holds no more words than there are letters: each pair meets in exactly one trie.

A task reads its tries sorted and joins many at once (:func:`near_pairs`).  Going
down letter by letter, a node's active nodes are itself (distance zero) and pairs at
distance one: of two children of one node (a replaced letter), or of a node and its
child (an inserted letter, as far right as it can stand).  Pairs at distance one
survive only by equal letters; they are emitted where both nodes end a word.

Defined results: a null text has no runs; ids that are null count as the text
``None``; repeated rows count again; ties of ``n`` are broken by code-point order; a
word without near words is its own root; an empty table has no words; a very long run
is one word; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import materialize, release

SHORTEST = 7
LEAST = 2
#: A near word is a word's form if it occurs this many times as often.
DOMINANT = 10
#: Of the occurrences, those whose checksum this divides lose a letter.
TYPO = 31
LARGEST = 4096
#: Rows that a task joins at once, and distinct words that it counts at once.
_BLOCK, _HELD = 1 << 16, 1 << 18
_LOWER = {c: c + 32 for c in range(65, 91)}


def _counted(shortest: int):
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                head = zlib.crc32(f"{doc_id.as_py()}:".encode())
                for word, n in Counter(runs((text.as_py() or "").translate(_LOWER))).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % TYPO == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    seen[word] += n
                if len(seen) > _HELD:
                    yield out()
        yield out()

    return run


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): distinct runs of letters, lower-cased and with their planted typos, that occur often enough."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = rows.mapInArrow(_counted(shortest), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _dealt(words: DataFrame) -> DataFrame:
    """Rows (trie, m, low, high, word) for halves of the places of ``words`` (with m, low, high)."""
    mid = F.expr("(low + high) div 2")
    halves = F.array(F.struct(F.col("low"), mid.alias("high")), F.struct(mid.alias("low"), F.col("high")))
    each = words.withColumn("half", F.explode(halves)).select("word", "m", F.col("half.low").alias("low"), F.col("half.high").alias("high"))
    # letters before the places and behind them; two tries of one number are joined together, which finds nothing more
    behind = F.expr("if(high < m, right(word, m - high), '')")
    return each.withColumn("trie", F.xxhash64("m", "low", "high", F.expr("left(word, low)"), behind))


def near_words(words: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(a, b): all pairs of the distinct ``words(word, n)`` at distance one, each once; b is the longer or the later word."""
    own = F.length("word")
    start = words.withColumn("m", F.explode(F.array(own, own - 1))).where("m >= 1").select("word", "m", F.lit(0).alias("low"), (F.col("m") + 1).alias("high"))
    level, found = _dealt(start), []
    while True:
        sizes = level.groupBy("trie").agg(F.count(F.lit(1)).alias("size"), F.max(F.expr("high - low")).alias("width"))
        large = materialize(sizes.where((F.col("size") > largest) & (F.col("width") > 1)).select("trie"), "large-tries")
        none = large.isEmpty()
        cold = level if none else level.join(large, "trie", "left_anti")
        dealt = cold.repartition("trie").sortWithinPartitions("trie", "m", "low", "high", "word")
        found.append(materialize(dealt.select("trie", "m", "low", "high", "word").mapInArrow(_joined, "a string, b string"), "near-words"))
        if none:
            release(large)
            break
        after = materialize(_dealt(level.join(large, "trie", "left_semi").where("high - low > 1")), "tries")
        release(large)
        level = after
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs._fairlead_parts = [*found, level]
    return pairs


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins whole tries, many at once; the last of a block waits for the rest of its words."""
    schema, held, rows = None, [], 0
    for batch in batches:
        schema = batch.schema
        held.append(batch)
        rows += batch.num_rows
        if rows >= _BLOCK:
            table = pa.Table.from_batches(held).combine_chunks()
            trie = table.column("trie").to_numpy()
            cut = int(np.searchsorted(trie, trie[-1]))
            if cut:
                yield from near_pairs(table.slice(0, cut))
                table = table.slice(cut)
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield from near_pairs(pa.Table.from_batches(held, schema).combine_chunks())


class _Forest:
    """Tries as sorted words: a node is its first word, and its depth is the level that is looked at."""

    def __init__(self, trie: np.ndarray, words: list[str]):
        raw = [w.encode("utf-32-le") for w in words]
        self.length = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
        self.start = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
        # letters in common with the word before; -1 where a trie begins
        same = np.zeros(len(words), np.int64)
        both = np.minimum(self.length[1:], self.length[:-1])
        alive = np.flatnonzero(trie[1:] == trie[:-1])
        depth = 0
        while len(alive):
            alive = alive[both[alive] > depth]
            alive = alive[self.letters[self.start[alive] + depth] == self.letters[self.start[alive + 1] + depth]]
            depth += 1
            same[alive + 1] = depth
        same[0] = -1
        same[1:][trie[1:] != trie[:-1]] = -1
        self.same = same

    def children(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parent, letter, child) of all nodes of this depth, sorted by parent and letter."""
        at = np.flatnonzero((self.length > depth) & (self.same <= depth))
        heads = np.flatnonzero(self.same < depth)
        parent = heads[np.searchsorted(heads, at, side="right") - 1]
        return parent, self.letters[self.start[at] + depth], at

    def ends(self, node: np.ndarray, depth: int) -> np.ndarray:
        return self.length[node] == depth


_LETTERS = 1 << 21


def _meet(u: np.ndarray, v: np.ndarray, of_u: tuple, of_v: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children of u and of v by equal letters, and which pair (u, v) they come from."""
    parent, letter, child = of_u
    first, last = np.searchsorted(parent, u), np.searchsorted(parent, u, side="right")
    n = last - first
    pair = np.repeat(np.arange(len(u)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    keys = of_v[0] * _LETTERS + of_v[1]
    wanted = v[pair] * _LETTERS + letter[at]
    to = np.searchsorted(keys, wanted)
    hit = to < len(keys)
    hit[hit] = keys[to[hit]] == wanted[hit]
    return child[at[hit]], of_v[2][to[hit]], pair[hit]


def near_pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of words at distance one whose first difference lies in their trie's range of places."""
    names = table.column("word").to_pylist()
    number, m, low, high = (table.column(c).to_numpy() for c in ("trie", "m", "low", "high"))
    trie = np.zeros(len(m), np.int64)
    trie[1:] = np.cumsum((number[1:] != number[:-1]) | (m[1:] != m[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    forest = _Forest(trie, names)
    none = np.zeros(0, np.int64)
    found_a, found_b = [none], [none]

    def emit(u: np.ndarray, v: np.ndarray, at_u: int, at_v: int) -> None:
        ends = forest.ends(u, at_u) & forest.ends(v, at_v) & (m[u] == at_u)
        found_a.append(u[ends])
        found_b.append(v[ends])

    replaced, inserted = (none, none), (none, none)
    here = forest.children(0)
    for depth in range(int(forest.length.max(initial=0)) + 1):
        below = forest.children(depth + 1)
        # pairs at distance one go down by equal letters
        a, b, _ = _meet(*replaced, here, here)
        x, y, _ = _meet(*inserted, here, below)
        parent, letter, child = here
        opened = (low[child] <= depth) & (depth < high[child])
        # a replaced letter: two children of one node
        step = 1
        while True:
            first = np.flatnonzero(opened[:-step] & (parent[:-step] == parent[step:])) if step < len(parent) else none
            if not len(first):
                break
            a, b = np.concatenate([a, child[first]]), np.concatenate([b, child[first + step]])
            step += 1
        # an inserted letter: a node and its child; what follows must differ from it
        u, c = parent[opened], child[opened]
        emit(u, c, depth, depth + 1)
        p, q, pair = _meet(u, c, here, below)
        after = p != c[pair]
        x, y = np.concatenate([x, p[after]]), np.concatenate([y, q[after]])
        replaced, inserted = (a, b), (x, y)
        emit(a, b, depth + 1, depth + 1)
        emit(x, y, depth + 1, depth + 2)
        here = below
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    words = table.column("word").combine_chunks()
    for k in range(0, max(1, len(a)), _BLOCK):
        yield pa.record_batch([words.take(pa.array(a[k : k + _BLOCK])), words.take(pa.array(b[k : k + _BLOCK]))], names=["a", "b"])


def group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST, dominant: int = DOMINANT, largest: int = LARGEST) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = materialize(vocabulary(docs, text, doc_id, shortest, least), "words")
    pairs = near_words(words, largest)
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = links.join(known, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("other_n"), F.col("other"))).alias("best"))
    form_n = -F.col("best.col1")
    held = F.when(form_n >= dominant * F.col("n"), F.col("best.other"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), held.alias("form"), F.when(held.isNotNull(), form_n).alias("form_n"))
    rows = materialize(rows, "forms")
    release(words, *pairs._fairlead_parts)
    roots = _roots(rows.where("form is not null").select("word", F.col("form").alias("root")))
    done = rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = materialize(done, "spelling")
    release(rows, roots)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last; each round doubles the steps."""
    now = materialize(forms, "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        ended = after.join(now.select(F.col("word").alias("root")), "root", "left_semi").isEmpty()
        release(now)
        now = after
        if ended:
            return now
