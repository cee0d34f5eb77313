"""N-gram Jaccard join and its components, by a token-group matrix.

Method.  A document's set is its distinct 5-word shingles (64-bit hashes).
Documents with equal sets become one node at once.

1. *Order.*  One pass counts shingles in ``BUCKETS`` hashed counters, a bounded
   table summed over all documents; a shingle's class is its counter's size on a
   scale of eights.  The order (rare classes first, then by hash) decides only
   how fast the join is, never its result.
2. *Prefixes.*  Two sets of similarity t share at least ``ELL`` of their first
   n - ceil(t n) + ELL shingles in that order.  Those are dealt by shingle, and
   shingles that only one node has are dropped: what is left is small.  A common
   shingle is dealt in ``SALTS`` parts by its class, so none fills a task.
3. *Groups.*  Similar nodes are partitioned into groups: by their most and by
   their least common shared shingle, around the node that shares most; members
   are held against that node and linked ones form one group (a component so far).
4. *Matrix.*  Each group's union of prefix shingles is stored by shingle, group
   and band of set sizes.  The first shingle, in the order, that two linked sets
   share leaves each of them enough shingles behind it to reach the overlap that
   both sizes ask for.  A query looks a shingle up only in the bands for which
   enough is left behind it, so the shingles of a passage that very many texts
   share bring those texts together only where the passage can make a link.  A
   met group with several members is bounded by the count of the query's prefix
   shingles in its union, and opened if that reaches what a link needs.
5. An opened group first sends a few delegates; where none links, the query meets
   all members of a small group, and of a large one if its whole set can link by
   the bound with the group's whole union.  Pairs inside one group are never made.
6. Compared pairs are decided on their whole sets, 100 * both >= 75 * either.

Copies are never expanded, and a cluster of near copies costs one comparison a
member and not all pairs.  Keys other than shingles (groups, hubs) are keys of
plain joins, whose large sides Spark splits.

Defined results: a text without words, or null, has an empty set, links with
nothing and is its own component; with fewer than five words the whole sequence
is one shingle; a very long text is read whole and its set held by one task;
rows that repeat a doc_id are one document; a null doc_id gets its n_shingles and
a null component and links with nothing; ids are cast to long; an empty table
gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import BATCH_BYTES, Words, char_class, lean, materialize, mix64, release, sized_slices, text_buffers
from fairlead.llm.components import components

K = 5
PERCENT = 75
ELL = 12
BUCKETS = 1 << 22
#: Members of an opened group that a query is held against first.
DELEGATES = 4
#: Opened groups of up to so many members meet a query member by member; larger ones first by their union.
SMALL = 64
#: Into how many parts a shingle of each class is dealt.
SALTS = (1, 1, 4, 32, 256, 2048, 16384, 131072)
_CLASS_BITS = 3
_PLACE_BITS = 12
_SLICES = 64
#: Packed counters that one task adds up; more are added in two steps.
_FAN_IN = 512
_FLUSH = 2 << 20
#: Signatures of sets that a task remembers so as not to deal copies again; beyond them copies are dealt, and meet later.
SEEN = 50_000
_Q = mix64(np.arange(101, 101 + K, dtype=np.uint64)) | np.uint64(1)


def least_overlap(n: np.ndarray | int):
    return -(-PERCENT * n // 100)


def prefix_length(n: np.ndarray | int):
    return np.minimum(n, n - least_overlap(n) + ELL)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted uint64."""
    words = Words(data, offsets, flags)
    w, at = words.hash, words.offsets
    long = mix64(sum((w[j : len(w) - K + 1 + j] * _Q[j] for j in range(K)), np.uint64(0))) if len(w) >= K else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= K:
            out.append(np.unique(long[a : b - K + 1]))
        elif b > a:
            short = (w[a:b] * _Q[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short ^ np.uint64(0xA5A5A5A5A5A5A5A5)])))
        else:
            out.append(w[:0])
    return out


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit numbers."""
    one = mix64(tokens ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64)
    two = mix64(tokens + np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]):
    flags = char_class("nonspace")
    for batch in batches:
        for part in sized_slices(batch, "text"):
            yield part, shingle_sets(*text_buffers(part.column(1)), flags)


_SURVEY = "doc_id long, n long, s1 long, s2 long, slice int, counts binary"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and this task's counters as packed slices."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
    counts, waiting, held = None, [], 0

    def flush():
        nonlocal counts, waiting, held
        add = np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        counts = add.astype(np.uint32) if counts is None else np.add(counts, add, out=counts, casting="unsafe")
        waiting, held = [], 0

    for part, sets in _sets(batches):
        signs = [signature(s) for s in sets]
        size = len(sets)
        yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in signs], pa.int64()), pa.array([y for _, y in signs], pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], schema=schema)
        waiting.append((np.concatenate(sets) >> np.uint64(64 - 22)).astype(np.int32))
        held += len(waiting[-1])
        if held >= _FLUSH:
            flush()
    if held:
        flush()
    if counts is not None:
        some = [(k, _packed(c.astype("<u2"))) for k, c in enumerate(np.minimum(counts, 65535).reshape(_SLICES, -1)) if c.any()]
        none = pa.nulls(len(some), pa.int64())
        yield pa.record_batch([none, none, none, none, pa.array([k for k, _ in some], pa.int32()), pa.array([c for _, c in some], pa.binary())], schema=schema)


def _packed(counts: np.ndarray) -> bytes:
    """Compressed counters, low bytes first: the high ones are nearly all zero."""
    return zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(len(counts), -1).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, BUCKETS // _SLICES)
    return np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel()


def _added(level: float | None):
    """Sums of packed counters by slice, read as a stream; with a level their classes, two to a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                add = _unpacked(packed.as_py())
                total[k] = total[k] + add if k in total else add.astype("<u8")
        for k, counts in total.items():
            if level is None:
                out = _packed(counts)
            else:
                steps = [level * 8**j for j in range((1 << _CLASS_BITS) - 1)]
                kinds = np.searchsorted(steps, counts, side="left").astype(np.uint8)
                out = (kinds[0::2] << 4 | kinds[1::2]).tobytes()
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([out], pa.binary())], names=["slice", "counts"])

    return run


def shingle_classes(survey: DataFrame, shingles: int, blobs: int) -> np.ndarray:
    """Classes of the counters by how far they stand out from the mean; ``BUCKETS`` / 2 bytes, whatever the input."""
    mean = shingles / BUCKETS
    level = mean + 8 * mean**0.5 + 32
    parts = survey.where("slice is not null").select("slice", "counts")
    fan = -(-blobs // (_SLICES * _FAN_IN))
    if fan > 1:
        parts = parts.repartition(_SLICES * fan, F.col("slice"), F.pmod(F.xxhash64("counts"), F.lit(fan))).mapInArrow(lean(_added(None)), "slice int, counts binary")
    found = materialize(parts.repartition(_SLICES, F.col("slice")).mapInArrow(lean(_added(level)), "slice int, counts binary"), "classes", BATCH_BYTES)
    out = np.zeros((_SLICES, BUCKETS // _SLICES // 2), np.uint8)
    for row in found.collect():  # one row for each of the 64 slices
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    release(found)
    return out.ravel()


def _prefixes(packed):
    """The first shingles of each set in the order: key (class, then hash), and the node's mark with the place from 1.

    The mark is the upper part of the signature, the place the lower ``_PLACE_BITS``.  Places beyond these bits
    count as the last of them, and nodes of one mark share their postings: either only leaves more to compare.
    """
    shift = np.uint64(63 - _CLASS_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.stack([packed.value >> 4, packed.value & 15], 1).ravel()
        seen: set[tuple[int, int, int]] = set()
        for _, sets in _sets(batches):
            keys, signs = [], []
            for tokens in sets:
                if not len(tokens):
                    continue
                sign = signature(tokens)
                if (*sign, len(tokens)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add((*sign, len(tokens)))
                order = (tokens >> np.uint64(_CLASS_BITS + 1)) | (classes[tokens >> np.uint64(64 - 22)].astype(np.uint64) << shift)
                first = int(prefix_length(len(tokens)))
                keys.append(np.sort(np.partition(order, first - 1)[:first] if first < len(order) else order))
                signs.append(sign[0])
            if keys:
                runs = np.fromiter(map(len, keys), np.int64, len(keys))
                place = np.arange(1, int(runs.sum()) + 1) - np.repeat(np.cumsum(runs) - runs, runs)
                most = (1 << _PLACE_BITS) - 1
                mark = np.repeat(np.array(signs, np.int64) >> _PLACE_BITS << _PLACE_BITS, runs)
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(mark | np.minimum(place, most))], names=["token", "at"])

    return run


def _salts(token: Column) -> Column:
    """Into how many parts a shingle is dealt, by its class."""
    return F.element_at(F.array(*[F.lit(k) for k in SALTS]), F.shiftright(token, 63 - _CLASS_BITS).cast("int") + 1)


def _salt(token: Column, by: Column) -> Column:
    return F.pmod(F.xxhash64(by), _salts(token)).cast("int")


def _in_all_parts(rows: DataFrame) -> DataFrame:
    """Rows repeated to every part of their shingle."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("token")) - 1)))


def _bitmap(ids: DataFrame, bits: int):
    """A set of ids as ``2**bits`` hashed bits (false positives only), built in slices."""
    width = 16

    def fill(key, rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << width, bool)
        flags[rows["at"].to_numpy()] = True
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(flags).tobytes()]})

    place = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    cells = ids.select(place.alias("p")).distinct().select(F.shiftright("p", width).alias("slice"), F.col("p").bitwiseAND((1 << width) - 1).cast("int").alias("at"))
    out = np.zeros((1 << (bits - width), 1 << (width - 3)), np.uint8)
    for row in cells.groupBy("slice").applyInPandas(fill, "slice long, bits binary").collect():  # 2**bits bits, in slices
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _listed(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))


def _whole_sets(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            kept = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7))) & 1 == 1))
            if not kept.num_rows:
                continue
            for part, sets in _sets(iter([kept])):
                yield pa.record_batch([part.column(0), _listed(sets)], names=["rid", "tokens"])

    return run


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose whole sets reach the threshold; a row holds one pair's sets, and a hub's side can be split."""
    one = sets.select(F.col("rid").alias("b"), F.col("tokens").alias("tb"))
    two = sets.select(F.col("rid").alias("a"), F.col("tokens").alias("ta"))
    hubs = two.join(pairs.select("a").distinct(), "a", "left_semi")
    rows = pairs.join(one, "b").join(hubs, "a")
    both = F.size(F.array_intersect("ta", "tb"))
    return rows.where(100 * both >= PERCENT * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _reach(n: Column) -> Column:
    return F.least(F.lit(ELL), F.ceil(n * PERCENT / 100))


def _length(n: Column) -> Column:
    return F.least(n, n - F.ceil(n * PERCENT / 100) + ELL)


def _shared(x: Column, y: Column) -> Column:
    """Shingles that two linked sets of these sizes share at least."""
    return F.ceil((x + y) * PERCENT / (100.0 + PERCENT))


def _needed(x: Column, y: Column) -> Column:
    """Common prefix shingles that two linked sets of these sizes have at least.

    They share ``both`` shingles; the first k of those in the order lie in either prefix as long as
    n - both + k is within that prefix.
    """
    both = _shared(x, y)
    return F.least(_length(x) - x + both, _length(y) - y + both)


def _fits(x: Column, y: Column) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def _nodes(posts: DataFrame, reps: DataFrame) -> DataFrame:
    """Nodes that share enough prefix shingles with others to link at all: rid, n, those shingles and their places.

    ``most`` and ``least`` name a node's most and least common shared shingle; ``weight`` is high for a
    node whose whole prefix is shared, such as the text that many near copies were made from.  A shingle
    dealt in parts counts as shared, and as common as its class says.
    """
    mark = F.shiftright("at", _PLACE_BITS)
    # the part is folded into the lower bits of the shingle's key, and out again
    key = F.col("key")
    dealt = posts.select(F.col("token").bitwiseXOR(_salt(F.col("token"), mark).cast("long")).alias("key"), "at")
    part = Window.partitionBy("key")
    spread = dealt.select("*", F.min(mark).over(part).alias("lo"), F.max(mark).over(part).alias("hi"), F.count(F.lit(1)).over(part).alias("found"))
    split = _salts(key) > 1
    df = F.when(split, F.pow(F.lit(8.0), F.shiftright(key, 63 - _CLASS_BITS)) * 32).otherwise(F.col("found")).cast("long")
    cell = F.struct(key.bitwiseXOR(_salt(key, mark).cast("long")).alias("token"), F.col("at").bitwiseAND((1 << _PLACE_BITS) - 1).cast("int").alias("place"), df.alias("df"))
    shared = spread.where(split | (F.col("lo") != F.col("hi"))).select(mark.alias("mark"), cell.alias("cell"))
    found = shared.groupBy("mark").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    able = found.join(reps.select(F.shiftright("s1", _PLACE_BITS).alias("mark"), "n", "rid"), "mark").where(F.size("cells") >= _reach(F.col("n")))
    common = F.transform("cells", lambda c: F.struct(c["df"], c["token"]))
    weight = F.aggregate("cells", F.lit(0.0), lambda total, c: total + F.log1p(c["df"]))
    return able.select(
        "rid", "n", F.col("cells.token").alias("tokens"), F.col("cells.place").alias("places"), F.array_max(common)["token"].alias("most"), F.array_min(common)["token"].alias("least"),
        F.round(weight / _length(F.col("n")), 6).alias("weight"),
    )


def _star_pairs(nodes: DataFrame) -> DataFrame:
    """Each node with the centres of its two groups, where common cells and sizes allow a link."""
    pairs = None
    for name in ("most", "least"):
        rows = nodes.select("rid", "n", F.col(name).alias("token"), "weight")
        centres = _in_all_parts(rows.groupBy("token").agg(F.max(F.struct("weight", (-F.col("rid")).alias("r"), "n")).alias("c")))
        rows = rows.withColumn("salt", _salt(F.col("token"), F.col("rid")))
        some = rows.join(centres, ["token", "salt"]).where((F.col("rid") != -F.col("c.r")) & _fits(F.col("n"), F.col("c.n"))).select((-F.col("c.r")).alias("a"), F.col("rid").alias("b"))
        pairs = some if pairs is None else pairs.union(some)
    return _bounded(pairs.distinct(), nodes)


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose prefixes share enough."""
    one = nodes.select(F.col("rid").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    two = nodes.select(F.col("rid").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    both = pairs.join(one, "a").join(two, "b")
    return both.where(F.size(F.array_intersect("ta", "tb")) >= _needed(F.col("na"), F.col("nb"))).select("a", "b")


def _between(n: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The sizes in [low, high] that fit a set of size n."""
    return F.greatest(low, F.ceil(n * PERCENT / 100)), F.least(high, F.floor(n * 100 / PERCENT))


def _least_needed(n: Column, low: Column, high: Column) -> Column:
    """The least that ``_needed`` asks of a partner with a size in [low, high]: it is concave but for
    rounding (2 at most), so at an end.
    """
    first, last = _between(n, low, high)
    return F.least(_needed(n, first), _needed(n, last)) - 2


def _band(n: Column | None = None) -> Column:
    return F.floor(F.log(F.col("n") if n is None else n) / F.log(F.lit(1.1))).cast("int")


def _wide(band: Column) -> Column:
    """Three bands in one: all sizes that fit a set lie in two or three of these."""
    return F.floor(band / 3).cast("int")


def _grouped(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes with their group, itself where it has no other, and the group's size."""
    sized = groups.join(groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    named = nodes.join(sized, nodes["rid"] == sized["node"], "left")
    return named.select(*nodes.columns, _band().alias("band"), F.coalesce("component", "rid").alias("group"), F.coalesce("size", F.lit(1)).alias("size"))


def _met(grouped: DataFrame) -> DataFrame:
    """Query nodes and larger groups that share a shingle early enough for a link.

    Behind its place a shingle leaves ``tail`` shingles of a set, itself included.  The first shared one of
    two linked sets has a tail of at least ``_shared`` in both.  So a cell is stored for the sizes of query
    that its tail allows and no others, by wide bands of the query's size.  Of two single nodes the larger
    set (by name if equal) asks, which leaves the smaller one's cells with few sizes; of two groups of
    several the smaller group's nodes ask (by name if equal), and single nodes ask all of these.
    """
    cells = grouped.select("rid", "n", "band", "group", "size", F.explode(F.arrays_zip("tokens", "places")).alias("c"))
    cells = cells.select("rid", "n", "band", "group", "size", F.col("c.tokens").alias("token"), (F.col("n") - F.col("c.places") + 1).alias("tail"))
    n = F.col("n")
    smallest = F.ceil(n * PERCENT / 100)
    largest = F.least(F.floor(n * 100 / PERCENT), F.floor(F.col("tail") * (100 + PERCENT) / PERCENT) - n)
    cells = cells.where(smallest <= largest)
    group = [F.col("group").alias("g"), F.col("size").alias("g_size"), F.col("band").alias("g_band")]
    single = cells.where((F.col("size") == 1) & (n <= largest)).select("token", *group, n.alias("low"), n.alias("high"), F.col("tail").alias("g_tail"), n.alias("first"), largest.alias("last"))
    several = cells.where("size > 1").groupBy("token", *group).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("tail").alias("g_tail"), F.min(smallest).alias("first"), F.max(largest).alias("last"))
    matrix = single.union(several).withColumn("wide", F.explode(F.sequence(_wide(_band(F.col("first"))), _wide(_band(F.col("last")))))).drop("first", "last")
    # few parts here: the side that is repeated to all of them can be as large as the other
    parts = F.ceil(F.sqrt(_salts(F.col("token")))).cast("int")
    matrix = matrix.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    asked = cells.select("rid", "n", "group", "size", "token", "tail", _wide(F.col("band")).alias("wide"), F.pmod(F.xxhash64("rid"), parts).cast("int").alias("salt"))
    named = F.col("g") < F.col("group")
    larger = (F.col("g_size") > F.col("size")) | ((F.col("g_size") == F.col("size")) & F.when(F.col("size") > 1, named).otherwise((F.col("low") < n) | ((F.col("low") == n) & named)))
    first, last = F.greatest(F.col("low"), smallest), F.least(F.col("high"), F.floor(n * 100 / PERCENT))
    able = larger & (first <= last) & (_shared(n, first) <= F.least("tail", "g_tail"))
    found = asked.join(matrix, ["token", "salt", "wide"]).where(able)
    return found.select("rid", "n", F.col("g").alias("group"), F.col("g_size").alias("size"), F.col("g_band").alias("band")).distinct()


def _opened(grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the matrix leaves: pairs (a, b) with single nodes, and (rid, n, group, band) of opened groups."""
    met = materialize(_met(grouped), "met")
    single = met.where("size = 1").select(F.col("rid").alias("a"), F.col("group").alias("b"))
    many = met.where("size > 1").select("rid", "n", "group", "band")
    inside = grouped.where("size > 1").join(many.select("group", "band").distinct(), ["group", "band"], "left_semi")
    union = inside.select("group", "band", "n", F.size("tokens").alias("total"), F.explode("tokens").alias("token"))
    union = union.groupBy("group", "band", "token").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    asked = many.join(grouped.select("rid", F.explode("tokens").alias("token")), "rid").join(union, ["group", "band", "token"])
    asked = asked.groupBy("rid", "n", "group", "band").agg(F.count(F.lit(1)).alias("cells"), F.min("low").alias("low"), F.max("high").alias("high"))
    opened = materialize(asked.where(F.col("cells") >= _least_needed(F.col("n"), F.col("low"), F.col("high"))).select("rid", "n", "group", "band"), "opened")
    pairs = materialize(single, "singles")
    release(met)
    return pairs, opened


def _members(grouped: DataFrame) -> DataFrame:
    """Members of groups of several: b, nb, prefix shingles, weight and the group and band they belong to."""
    return grouped.where("size > 1").select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), "weight", "group", "band")


def _delegate_pairs(opened: DataFrame, members: DataFrame) -> DataFrame:
    """Each query with at most ``DELEGATES`` members of an opened group: the one that shares most and some by hash.

    One link joins the query to the whole group, so most queries need no more.
    """
    one = F.struct("b", "nb")
    picks = [F.max_by(one, F.struct("weight", (-F.col("b")).alias("r")))] + [F.min_by(one, F.xxhash64("b", F.lit(k))) for k in range(1, DELEGATES)]
    chosen = members.groupBy("group", "band").agg(F.array_distinct(F.array(*picks)).alias("m"))
    pairs = opened.join(chosen, ["group", "band"]).select("rid", "n", F.explode("m").alias("m")).where(_fits(F.col("n"), F.col("m.nb")))
    return pairs.select(F.col("rid").alias("a"), F.col("m.b").alias("b"))


def _unresolved(opened: DataFrame, groups: DataFrame) -> DataFrame:
    """Opened groups that their query is still apart from."""
    named = groups.select(F.col("node").alias("rid"), F.col("component").alias("own"))
    of = groups.select(F.col("node").alias("group"), F.col("component").alias("its"))
    rows = opened.join(named, "rid", "left").join(of, "group", "left")
    return rows.where(F.coalesce("own", "rid") != F.coalesce("its", "group")).select("rid", "n", "group", "band")


def _small_group_pairs(nodes: DataFrame, opened: DataFrame, members: DataFrame) -> DataFrame:
    """Queries and all members of opened groups of at most ``SMALL``, where their prefixes share enough."""
    asks = opened.join(nodes.select("rid", F.col("tokens").alias("ta")), "rid")
    able = _fits(F.col("n"), F.col("nb")) & (F.size(F.array_intersect("ta", "tb")) >= _needed(F.col("n"), F.col("nb")))
    return asks.join(members, ["group", "band"]).where(able).select(F.col("rid").alias("a"), "b").distinct()


def _large_group_links(rows: DataFrame, nodes: DataFrame, opened: DataFrame, members: DataFrame) -> DataFrame:
    """Queries against groups by whole sets: the overlap with the group's whole union, then every member of what is left."""
    unit = ["group", "band"]
    asked = members.select("b", "nb", *unit).join(opened.select(*unit).distinct(), unit)
    sets = _sets_of(rows, opened.select(F.col("rid").alias("id")).union(asked.select("b")).distinct())
    inside = asked.join(sets.select(F.col("rid").alias("b"), F.explode("tokens").alias("token")), "b")
    union = inside.groupBy(*unit, "token").agg(F.min("nb").alias("low"))
    cells = opened.join(sets, "rid").select("rid", "n", *unit, F.explode("tokens").alias("token"))
    met = cells.join(union, [*unit, "token"]).groupBy("rid", "n", *unit).agg(F.count(F.lit(1)).alias("both"), F.min("low").alias("low"))
    smallest = F.greatest(F.col("low"), F.ceil(F.col("n") * PERCENT / 100))
    left = met.where(F.col("both") >= _shared(F.col("n"), smallest)).select("rid", "n", "both", *unit)
    left = left.join(nodes.select("rid", F.col("tokens").alias("ta")), "rid")
    able = _fits(F.col("n"), F.col("nb")) & (F.col("both") >= _shared(F.col("n"), F.col("nb")))
    able = able & (F.size(F.array_intersect("ta", "tb")) >= _needed(F.col("n"), F.col("nb")))
    pairs = materialize(left.join(members, unit).where(able).select(F.col("rid").alias("a"), "b").distinct(), "candidates")
    links = materialize(_links(pairs, sets), "pairs")
    release(sets, pairs)
    return links


def _sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole sets (rid, tokens) of the wanted ids and of few others; only these leave the scan."""
    wanted = materialize(wanted, "wanted")
    bits = min(28, max(20, (16 * wanted.count() - 1).bit_length()))
    marked = rows.sparkSession.sparkContext.broadcast(_bitmap(wanted, bits))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits).alias("at")
    sets = materialize(rows.select("doc_id", "text", place).mapInArrow(lean(_whole_sets(marked)), "rid long, tokens array<long>"), "tokens", BATCH_BYTES)
    release(wanted)
    return sets


def _decide(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links among candidate pairs, as a table."""
    pairs = materialize(pairs, "candidates")
    if pairs.isEmpty():
        return pairs
    sets = _sets_of(rows, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    links = materialize(_links(pairs, sets), "pairs")
    release(pairs, sets)
    return links


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of every row.

    The rows are in a table in the shared folder; all other scratch tables are gone when this returns.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    survey = materialize(rows.mapInArrow(lean(_survey), _SURVEY), "survey", BATCH_BYTES)
    sizes = materialize(survey.where("slice is null").select("doc_id", "n", "s1", "s2"), "sizes")
    reps = materialize(sizes.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rid")), "sets")
    shingles, blobs = survey.agg(F.sum("n"), F.count("slice")).first()
    classes = spark.sparkContext.broadcast(shingle_classes(survey, shingles or 0, blobs))
    release(survey)
    rows = rows.where("doc_id is not null")
    nodes = materialize(_nodes(rows.mapInArrow(lean(_prefixes(classes)), "token long, at long"), reps), "nodes", BATCH_BYTES)

    links = _decide(rows, _star_pairs(nodes))
    tables = [links]
    groups = components(links)
    grouped = materialize(_grouped(nodes, groups), "grouped")
    release(nodes)

    def with_more(found: DataFrame) -> None:
        nonlocal links, groups
        tables.append(found)
        if not found.isEmpty():
            release(groups)
            links = links.union(found)
            groups = components(links)

    singles, opened = _opened(grouped)
    members = _members(grouped)
    with_more(_decide(rows, _bounded(singles.union(_delegate_pairs(opened, members)).distinct(), grouped)))
    sizes_of = members.groupBy("group", "band").agg(F.count(F.lit(1)).alias("members"))
    apart = materialize(_unresolved(opened, groups).join(sizes_of, ["group", "band"]), "opened")
    small, large = apart.where(F.col("members") <= SMALL), apart.where(F.col("members") > SMALL)
    more = [] if small.isEmpty() else [_decide(rows, _small_group_pairs(grouped, small, members))]
    if not large.isEmpty():
        more.append(_large_group_links(rows, grouped, large, members))
    if more:
        with_more(more[0] if len(more) == 1 else more[0].union(more[1]))
    release(grouped, singles, opened, apart, *tables, *more)

    named = reps.join(groups, reps["rid"] == groups["node"], "left").select("n", "s1", "s2", F.coalesce("component", "rid").alias("component_id"))
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    out = sizes.join(named, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    out = materialize(out, "components")
    release(sizes, reps, groups)
    return out


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` less every document that is not its component's smallest id; rows that stay are unchanged."""
    found = join(docs, text, doc_id)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
