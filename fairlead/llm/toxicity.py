"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly.

Method.  A word is a run of letters and digits, in lower case, between ``<`` and
``>``; its subwords are its character n-grams of ``GRAMS`` characters, hashed to
``ROWS`` embeddings.  A word's vector is the mean of its subwords', a window's the
mean of its words', so an unseen misspelling shares most of its vectors with the
word that it stands for.  Windows of ``WINDOW`` words overlap by half; a linear
softmax gives each a log odds, and a text has that of its worst window: one foul
sentence counts as much in a long text as in a short one.

Embeddings and softmax are trained together in numpy on the driver, by momentum on
the softmax's cross entropy, from a bounded sample of labelled rows of the learning
fold (``SAMPLE`` of each label, texts of at most ``LONGEST`` code points, the first
by a hash of the id): ``WARM`` rounds on averages of whole texts, then rounds in
which a text stands for its worst window so far.  A fifth of the sample is kept out
of that and calibrates the log odds to a probability by logistic regression, with
the labels' shares in the whole table as prior.

Defined results: a text without words, or null, scores the prior of an empty
window's log odds, as any text does without rows of both labels; labels that are
null are not learned from; repeated rows give repeated results; ids of labels and
rows that repeat are learned once; a very long text is scored whole by one task,
and is never learned from; extra columns are left out, whatever their names; ids are
cast to long.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import Words, char_class, in_fold, mix64, sized_slices, text_buffers
from fairlead.llm.quality import calibrate, hash_order

SAMPLE = 2000
LONGEST = 20_000
GRAMS = (3, 4, 5, 6)
ROWS = 1 << 17
DIMENSIONS = 8
WINDOW = 8
WARM, ROUNDS = 20, 120
RATE = 1.0
THRESHOLD = 0.3
SEED = 11
#: Words whose log odds a task remembers.
_REMEMBERED = 1 << 20


def subwords(words: list[str], grams: tuple[int, ...] = GRAMS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all subwords of the words, one word after the other, and each word's first."""
    framed = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    start = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(start + sizes, sizes) - np.arange(len(points))  # characters from here to the word's end
    owner, row = [], []
    code = np.zeros(len(points), np.uint64)
    for k in range(max(grams)):
        ahead = np.zeros(len(points), np.uint64)
        ahead[: len(points) - k] = points[k:] if k else points
        code = code * np.uint64(0x100000001B3) + ahead + np.uint64(1)
        if k + 1 in grams:
            whole = np.flatnonzero(left > k)
            owner.append(of[whole])
            row.append((mix64(code[whole]) % np.uint64(rows)).astype(np.int64))
    if 1 not in grams:  # a word shorter than all n-grams is one subword
        short = np.flatnonzero(sizes < min(grams))
        owner.append(short)
        row.append((mix64(points[start[short] + 1] + np.uint64(1 << 40)) % np.uint64(rows)).astype(np.int64) if len(short) else short)
    owner, row = np.concatenate(owner), np.concatenate(row)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(words)))
    return row[order], first


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and text of every window of texts with so many words; a text without words has none."""
    step = WINDOW // 2
    each = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // step) + 1), 0)
    text = np.repeat(np.arange(len(counts)), each)
    place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    base = (np.cumsum(counts) - counts)[text]
    begin = base + place * step
    return begin, np.minimum(begin + WINDOW, base + counts[text]), text


def _worst(value: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's greatest value and its place; -1 for a text without any."""
    out, at = np.zeros(texts), np.full(texts, -1)
    if len(value):
        edge = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out[text[edge]] = np.maximum.reduceat(value, edge)
        order = np.lexsort((np.arange(len(value))[::-1], value, text))
        at[text[edge]] = order[np.append(edge[1:], len(text)) - 1]
    return out, at


@dataclass
class Model:
    odds: np.ndarray  # the log odds that each embedding row adds: its vector times the difference of the softmax's weights
    offset: float
    weights: list[float]  # of the calibration: intercept and slope; the intercept alone if nothing was learned
    mean: float = 0.0
    scale: float = 1.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores runs of texts; distinct words are looked up once."""

    def __init__(self, model: Model):
        self.model = model
        self.flags = char_class("alnum")
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def _odds(self, data: np.ndarray, words: Words) -> np.ndarray:
        """Log odds of each word: the mean over its subwords."""
        distinct, place, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == distinct[known]
        value = np.zeros(len(distinct))
        value[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            texts = [spelled(raw[a:b].decode("utf-8", "replace")) for a, b in zip(words.start[place[new]].tolist(), words.end[place[new]].tolist(), strict=True)]
            rows, first = subwords(texts)
            value[new] = np.add.reduceat(self.model.odds[rows].astype(np.float64), first) / np.diff(np.append(first, len(rows)))
            if len(self.hashes) + len(new) > _REMEMBERED:
                self.hashes, self.values = distinct, value
            else:
                order = np.argsort(merged := np.concatenate([self.hashes, distinct[new]]))
                self.hashes, self.values = merged[order], np.concatenate([self.values, value[new]])[order]
        return value[inverse]

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log odds of each text's worst window."""
        words = Words(data, offsets, self.flags)
        counts = np.diff(words.offsets)
        sums = np.concatenate([[0.0], np.cumsum(self._odds(data, words))]) if len(words.start) else np.zeros(1)
        begin, end, text = _windows(counts)
        worst, _ = _worst((sums[end] - sums[begin]) / np.maximum(end - begin, 1), text, len(counts))
        return worst + self.model.offset

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.model.weights[0])
        if len(self.model.weights) > 1:
            z = z + self.model.weights[1] * (self.raw(data, offsets) - self.model.mean) / self.model.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def spelled(word: str) -> str:
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word.lower())


class _Descent:
    """Momentum with steps of one scale for all values, so that what many texts share moves most."""

    def __init__(self, rate: float):
        self.rate, self.mean, self.scale = rate, 0.0, 0.0

    def step(self, value: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.mean = 0.8 * self.mean + 0.2 * slope
        self.scale = max(0.9 * self.scale, float(np.abs(slope).max(initial=1e-12)))
        return value - self.rate * self.mean / self.scale


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def train(texts: list[list[int]], words: list[str], labels: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and its intercepts, fitted together; texts are lists of word numbers.

    ``share`` weighs the texts.  A text's vector is the mean of its words' (the
    first ``WARM`` rounds) or of those of its worst window.
    """
    rng = np.random.default_rng(SEED)
    rows, first = subwords(words)
    size = np.diff(np.append(first, len(rows)))
    table = rng.normal(0, 0.1, (ROWS, DIMENSIONS)).astype(np.float32)
    weights, bias = rng.normal(0, 1, (DIMENSIONS, 2)), np.zeros(2)
    steps = [_Descent(RATE), _Descent(RATE / 4), _Descent(RATE / 4)]
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter((w for t in texts for w in t), np.int64, int(counts.sum()))
    begin, end, text = _windows(counts)
    base = np.cumsum(counts) - counts
    goal = np.eye(2)[labels]
    for turn in range(ROUNDS):
        low, high = base, base + counts
        if turn >= WARM:
            odds = np.add.reduceat((table @ (weights[:, 1] - weights[:, 0]).astype(np.float32))[rows], first) / size
            sums = np.concatenate([[0.0], np.cumsum(odds[flat], dtype=np.float64)])
            _, at = _worst((sums[end] - sums[begin]) / (end - begin), text, len(texts))
            low, high = begin[at], end[at]
        n = high - low
        used, word = np.unique(flat[_ranges(low, n)], return_inverse=True)
        of = np.repeat(np.arange(len(texts)), n)
        own, edge = rows[_ranges(first[used], size[used])], np.cumsum(size[used]) - size[used]
        vector = np.add.reduceat(table[own], edge, axis=0) / size[used][:, None]
        mean = np.stack([np.bincount(of, vector[word, k], len(texts)) for k in range(DIMENSIONS)], 1) / n[:, None]
        logits = mean @ weights + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        error = (odds / odds.sum(1, keepdims=True) - goal) * share[:, None]
        back = (error @ weights.T) / n[:, None]
        by_word = np.stack([np.bincount(word, back[of, k], len(used)) for k in range(DIMENSIONS)], 1) / size[used][:, None]
        slope = np.stack([np.bincount(own, np.repeat(by_word[:, k], size[used]), ROWS) for k in range(DIMENSIONS)], 1)
        weights, bias = steps[1].step(weights, mean.T @ error), steps[2].step(bias, error.sum(0))
        table = steps[0].step(table, slope).astype(np.float32)
    return table, weights, bias


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample; the labels' shares are counted over the whole table."""
    known = labels.select(F.col(doc_id).alias("__fl_id"), F.col(label).cast("int").alias("__fl_label")).where("__fl_label in (0, 1) and __fl_id is not null").where(in_fold(F.col("__fl_id")))
    share = {r[0]: r[1] for r in known.groupBy("__fl_label").count().collect()}
    prior = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    chosen = None
    for value in (0, 1):  # the joined side is 2 * sample rows at most
        some = known.where(F.col("__fl_label") == value).distinct().orderBy(F.xxhash64("__fl_id"), "__fl_id").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select(F.col(doc_id).alias("__fl_id"), F.col(text).alias("__fl_text")).where(F.length("__fl_text").between(1, LONGEST))
    once = texts.join(F.broadcast(chosen), "__fl_id").groupBy("__fl_id", "__fl_label").agg(F.min("__fl_text").alias("__fl_text"))  # ids that repeat are one row
    rows = sorted(((r["__fl_id"], r["__fl_label"], r["__fl_text"]) for r in once.collect()), key=lambda r: (hash_order(r[0]), r))
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), prior)


def fit(texts: list[str], labels: np.ndarray, prior: float) -> Model:
    """Train on four fifths of each label's texts, calibrate on the rest."""
    numbers: dict[str, int] = {}
    flags = char_class("alnum")
    bags = []
    for t in texts:
        raw = t.encode("utf-8", "replace")
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), flags)
        bags.append([numbers.setdefault(spelled(raw[a:b].decode("utf-8", "replace")), len(numbers)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
    kept = np.array([bool(b) for b in bags], bool)
    rank = np.zeros(len(texts), np.int64)
    for value in (0, 1):
        own = kept & (labels == value)
        rank[own] = np.arange(int(own.sum()))
    aside = kept & (rank % 5 == 4)
    learned = kept & ~aside
    nothing = Model(np.zeros(ROWS, np.float32), 0.0, [float(np.log(prior / (1 - prior)))])
    if any(((labels == v) & part).sum() < 1 for v in (0, 1) for part in (aside, learned)):
        return nothing
    y = labels[learned]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    table, weights, bias = train([bags[k] for k in np.flatnonzero(learned)], list(numbers), y, share)
    model = Model((table @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]), [0.0, 1.0])
    data, offsets = text_buffers(pa.array([texts[k] for k in np.flatnonzero(aside)], pa.large_string()))
    raw = model.scorer().raw(data, offsets)
    (model.weights, means, scales) = calibrate(raw[:, None], labels[aside].astype(float), prior)
    model.mean, model.scale = means[0], scales[0]
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for part in sized_slices(batch, "text"):
                data, offsets = text_buffers(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(scorer.score(data, offsets))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and predicted (1 if the score reaches ``THRESHOLD``)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
