"""Quality classifier by compression with dictionaries of good and of bad text.

Method.  A bounded sample of labelled rows (``SAMPLE`` of each label, texts of at
most ``LONGEST`` code points, the first by a hash of the id; only rows of the
learning fold) is split in two.  One half of each label trains a zstandard
dictionary.  A text is compressed in blocks of ``CHUNK`` bytes with either
dictionary; the difference of the two sizes over their sum, and the compressed
share of the text (junk that repeats itself compresses well either way), are
the only inputs.  The other half calibrates them to a probability by logistic
regression, with the labels' shares in the whole table as prior.

Defined results: a text without bytes, or null, scores ``EMPTY_SCORE``; without
rows of both labels every other text scores the share of label 1 (0.5 with no
labels); labels that are null are not learned from; repeated rows give repeated
results; a very long text is compressed whole, block by block, by one task, and is
never learned from; ids of labels and rows that repeat are learned once; extra
columns stay untouched in :func:`keep_good` and are left out elsewhere, whatever
their names; ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import in_fold, lean, sized_slices, text_buffers

SAMPLE = 2000
LONGEST = 20_000
DICTIONARY = 112 << 10
CHUNK = 1024
LEVEL = 3
ACCEPT = 0.7
EMPTY_SCORE = 0.5


@dataclass
class Model:
    good: bytes
    bad: bytes
    raw: bool
    weights: list[float]  # intercept, then one for each input; the intercept alone if nothing was learned
    means: list[float]
    scales: list[float]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.packers = []
        for content in (model.good, model.bad) if len(model.weights) > 1 else ():
            kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
            dictionary.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))

    def inputs(self, text: memoryview | bytes) -> tuple[float, float]:
        good, bad = (sum(len(p.compress(text[i : i + CHUNK])) for i in range(0, len(text), CHUNK)) for p in self.packers)
        return (bad - good) / (bad + good), float(np.log((good + bad) / (2 * len(text))))

    def score(self, text: memoryview | bytes) -> float:
        if not len(text):
            return EMPTY_SCORE
        z = self.model.weights[0]
        if self.packers:
            z += sum(w * (x - m) / s for w, x, m, s in zip(self.model.weights[1:], self.inputs(text), self.model.means, self.model.scales, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _dictionary(texts: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or plain content where there is too little to train on."""
    parts = [t[i : i + 2000] for t in texts for i in range(0, len(t), 2000)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes(), False
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:], True


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[list[float], list[float], list[float]]:
    """Logistic regression by Newton steps; rows weigh so that label 1 has the share ``prior``."""
    means, scales = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - means) / scales])
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (share * (y - p)) - 1e-3 * len(y) * w
        bend = (z * (share * p * (1 - p))[:, None]).T @ z + 1e-3 * len(y) * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w.tolist(), means.tolist(), scales.tolist()


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample; the labels' shares are counted over the whole table."""
    known = labels.select(F.col(doc_id).alias("__fl_id"), F.col(label).cast("int").alias("__fl_label")).where(f"__fl_label in (0, 1) and __fl_id is not null").where(in_fold(F.col("__fl_id")))
    share = {r[0]: r[1] for r in known.groupBy("__fl_label").count().collect()}
    prior = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    chosen = None
    for value in (0, 1):  # the joined side is 2 * sample rows at most
        some = known.where(F.col("__fl_label") == value).distinct().orderBy(F.xxhash64("__fl_id"), "__fl_id").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select(F.col(doc_id).alias("__fl_id"), F.col(text).alias("__fl_text")).where(F.length("__fl_text").between(1, LONGEST))
    once = texts.join(F.broadcast(chosen), "__fl_id").groupBy("__fl_id", "__fl_label").agg(F.min("__fl_text").alias("__fl_text"))  # ids that repeat are one row
    rows = sorted({(r["__fl_id"], r["__fl_label"], r["__fl_text"]) for r in once.collect()}, key=lambda r: (hash_order(r[0]), r))
    by = {v: [r[2].encode() for r in rows if r[1] == v] for v in (0, 1)}
    if min(len(by[0]), len(by[1])) < 2:
        return Model(b"", b"", True, [float(np.log(prior / (1 - prior)))], [], [])
    halves = {v: len(by[v]) // 2 for v in by}
    (good, one), (bad, two) = (_dictionary(by[v][: halves[v]]) for v in (1, 0))
    if one != two:
        good, bad = (b"".join(by[v][: halves[v]])[-DICTIONARY:] for v in (1, 0))
    scorer = Model(good, bad, one or two, [0.0, 0.0, 0.0], [0, 0], [1, 1]).scorer()
    rest = {v: by[v][halves[v] :] for v in by}
    x = np.array([scorer.inputs(t) for v in (1, 0) for t in rest[v]])
    y = np.array([1.0] * len(rest[1]) + [0.0] * len(rest[0]))
    return Model(good, bad, one or two, *calibrate(x, y, prior))


def hash_order(value: int) -> int:
    """A fixed order that has nothing to do with the ids' own."""
    return (value * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            text = batch.schema.get_field_index("__fl_text")
            for part in sized_slices(batch, "__fl_text"):
                data, offsets = text_buffers(part.column(text))
                view = memoryview(np.ascontiguousarray(data))
                scores = [scorer.score(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != text), pa.array(scores, pa.float64())], names=[*(n for n in part.schema.names if n != "__fl_text"), "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and predicted (1 if the score reaches ``ACCEPT``)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__fl_text"))
    out = rows.mapInArrow(lean(_scored(model)), "doc_id long, score double")
    return out.select("doc_id", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def _kept(model: Model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for part in sized_slices(batch, column):
                data, offsets = text_buffers(part.column(part.schema.get_field_index(column)))
                view = memoryview(np.ascontiguousarray(data))
                good = [scorer.score(view[a:b]) >= ACCEPT for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield part.filter(pa.array(good, pa.bool_()))

    return run


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the classifier accepts, whole; no join, since the verdict is made on the row."""
    return docs.mapInArrow(lean(_kept(model, text)), docs.schema)
