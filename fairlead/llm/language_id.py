"""Language identification with hyperdimensional profiles.

Method.  Each letter of any script, in lower case, and what is no letter has a
random +1/-1 vector of ``DIMENSIONS``, drawn from its code point as seed, so workers
make the same ones without a table.  A trigram's vector is the product of its
letters' vectors, each rotated by its place; a text is the sum of its trigrams' vectors, and a language
is the sum of its sample texts, each of length one.  A text's language is the
prototype of greatest cosine; the score is the softmax of ``SHARPNESS`` times the
cosines.

Prototypes are learned from a bounded sample: for each language ``SAMPLE`` texts
at most (``SAMPLE_ROWS`` in all) of at most ``LONGEST`` code points, chosen by a
hash of the id from rows of the learning fold with a language.

Defined results: a text that is null or has no letter is ``und`` with score 0, as
is every text where no language is known; rows without language are not learned
from, and a language whose texts of the fold are all over ``LONGEST`` is never
predicted; repeated rows give repeated results and are learned once; a very long
text is counted whole by one task; ids are cast to long; extra columns are left
out, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import in_fold, sized_slices

DIMENSIONS = 1024
SAMPLE = 400
SAMPLE_ROWS = 8000
LONGEST = 20_000
SHARPNESS = 20.0
SEED = 7
_BLOCK = 256
#: Trigrams whose vectors are made at once.
_GRAMS = 8192


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """A symbol for each code point: the letter's in lower case, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = ord(c.lower()[0])
    return table


@lru_cache(None)
def _signs(symbol: int) -> bytes:
    """A symbol's vector as bits; all letters together are some 18 MB."""
    return np.random.default_rng([SEED, symbol]).bytes(DIMENSIONS // 8)


def letter_vectors(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols' vectors of +1/-1, rotated for the first, second and third place of a trigram."""
    bits = np.frombuffer(b"".join(map(_signs, symbols.tolist())), np.uint8).reshape(len(symbols), DIMENSIONS // 8)
    base = (np.unpackbits(bits, axis=1).astype(np.int8) * 2 - 1).astype(np.int8)
    return np.roll(base, 2, 1), np.roll(base, 1, 1), base


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of all texts, which texts have a letter, and the symbols.

    A trigram is a number of three digits to the base of how many symbols there are.
    """
    texts = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = symbol_table()[points]
    of = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes)])
    kept = np.ones(len(symbols), bool)
    kept[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
    letters = np.zeros(len(texts), bool)
    letters[np.unique(of[symbols > 0])] = True
    symbols, of = symbols[kept], of[kept]
    present = np.zeros(0x110000, bool)
    present[symbols] = True
    alphabet = np.flatnonzero(present)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    digits, base = place[symbols], len(alphabet)
    code = (digits[:-2] * base + digits[1:-1]) * base + digits[2:]
    inside = (symbols[1:-1] > 0) | (of[:-2] == of[2:])
    code, of = code[inside], of[1:-1][inside]
    if len(texts) * base**3 < 1 << 62:
        key, count = np.unique(of * base**3 + code, return_counts=True)
        return key // base**3, key % base**3, count, letters, alphabet
    names, rank = np.unique(code, return_inverse=True)
    key, count = np.unique(of * len(names) + rank, return_counts=True)
    return key // len(names), names[key % len(names)], count, letters, alphabet


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's vector of length one (zero without letters), and which texts have a letter."""
    text, code, count, letters, alphabet = trigrams(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    one, two, three = letter_vectors(alphabet)
    base = len(alphabet)
    for first in range(0, len(texts), _BLOCK):
        a, b = np.searchsorted(text, [first, first + _BLOCK])
        used, column = np.unique(code[a:b], return_inverse=True)
        order = np.argsort(column, kind="stable")
        column, row, times = column[order], text[a:b][order] - first, count[a:b][order]
        for low in range(0, len(used), _GRAMS):
            some = used[low : low + _GRAMS]
            x, y = np.searchsorted(column, [low, low + _GRAMS])
            counts = np.zeros((min(_BLOCK, len(texts) - first), len(some)), np.float32)
            counts[row[x:y], column[x:y] - low] = times[x:y]
            grams = one[some // (base * base)] * two[some // base % base] * three[some % base]
            out[first : first + _BLOCK] += counts @ grams.astype(np.float32)
    length = np.sqrt((out.astype(np.float64) ** 2).sum(1))
    out /= np.maximum(length, 1e-12)[:, None].astype(np.float32)
    out[~letters] = 0
    return out, letters


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> dict[str, np.ndarray]:
    """A prototype for each language."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null").where(in_fold(F.col("id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    most = max(1, min(SAMPLE, SAMPLE_ROWS // len(counts)))
    # a hash threshold for each language lets through about 1.5 times what is kept
    rates = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.5 * most / n + 30 / n))])
    short = known.where(F.length("text").between(1, LONGEST)).withColumn("order", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)))
    chosen = short.where(F.col("order") < rates[F.col("lang")] * (1 << 30)).groupBy("lang", "order").agg(F.min("text").alias("text"))  # equal rows are one
    rows = chosen.collect()
    out = {}
    for name in counts:
        texts = [t for _, t in sorted((r["order"], r["text"]) for r in rows if r["lang"] == name)[:most]]
        bundle = profiles(texts)[0].astype(np.float64).sum(0) if texts else np.zeros(DIMENSIONS)
        length = float(np.sqrt((bundle**2).sum()))
        if length > 0:
            out[name] = (bundle / length).astype(np.float32)
    return out


def _predicted(prototypes: dict[str, np.ndarray]):
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names], 1) if names else np.zeros((DIMENSIONS, 0), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text"):
                vectors, letters = profiles([t or "" for t in part.column(1).to_pylist()])
                if names:
                    cosine = (vectors @ matrix).astype(np.float64)
                    best = cosine.argmax(1)
                    share = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
                    score = np.where(letters, 1 / share.sum(1), 0.0)
                    lang = [names[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    near = np.where(letters, cosine.max(1), 0.0)
                else:
                    lang, score, near = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                yield pa.record_batch([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(near)], names=["doc_id", "lang_pred", "score", "cosine"])

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score and the winning cosine."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predicted(prototypes), "doc_id long, lang_pred string, score double, cosine double")
