"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Native: Spark SQL functions only.  A pattern's matches come from
``regexp_extract_all`` and the text between them from ``split`` with the same
pattern, so a running sum over the lengths of gaps and matches gives code-point
positions; only matches that pass their validator (octet range, Luhn, mod-97,
digit counts) become spans.  Quantifiers are possessive and matches begin at a
run's start, which changes no match and keeps every scan linear in the text.
Sums run over blocks of ``RUN`` matches and then over the blocks, and context is
put together from the ends of the gaps and matches before a span, so a text's
cost follows its length and its number of matches.

The ``CONTEXT_WIDTH`` characters before a span move its score: words of its kind
raise it, words of examples and order numbers lower it.  Base kinds (email, ip,
card, phone) are reported whenever they pass their validator, whatever their
score; others only from ``THRESHOLD``: iban, confirmed by mod-97, always reaches
it, and ssn, which has no checksum, only by its context.

Defined results: a null text is empty and has no spans; repeated rows give
repeated results; a very long text is scanned whole by one task; positions count
code points, the end is exclusive; extra columns are left out, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

_LOCAL = "A-Za-z0-9._%+-"
#: Same matches as the plain patterns: a match can only begin where a run begins, or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9][A-Z0-9]++",
    "ssn": r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]",
}
#: What a text must hold for a kind's pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
CONTEXT_WIDTH = 40
CONTEXT_GAIN = 0.25
THRESHOLD = 0.5
SCORES = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|@",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social|security",
}
AGAINST = {
    "email": "example|noreply|no-reply",
    "ip": "version|release|section",
    "card": "order|tracking|serial|isbn",
    "phone": "order|tracking|serial",
    "iban": "example|sample",
    "ssn": "order|tracking|serial",
}
#: The least length of a pattern's match, from which follows how many of them context can reach over.
SHORTEST = {"email": 5, "ip": 7, "card": 2, "phone": 4, "iban": 5, "ssn": 11}
#: Matches that a running sum takes at once.
RUN = 256


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    moved = F.split(F.concat(F.substring(hit, 5, 64), F.substring(hit, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":

        def octet(part: Column) -> Column:
            short = F.regexp_replace(part, "^0+", "")
            return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(hit, r"\."), octet)
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return F.when(F.length(hit).between(15, 34), _mod97(hit) == 1).otherwise(False)
    area = F.substring(hit, 1, 3)
    return (area != "000") & (area != "666") & (area < "900") & (F.substring(hit, 5, 2) != "00") & (F.substring(hit, 8, 4) != "0000")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(values: Column, before: Column) -> Column:
    """Running sums of a short array, after ``before``; each step copies what it has."""
    start = F.struct(before.alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        return F.struct(total.alias("sum"), F.concat(acc["out"], F.array(total)).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def running_sums(values: Column) -> Column:
    """Running sums of an array of int that is not empty: inside runs of ``RUN``, which begin at the sums of whole runs."""

    def cut(v: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        return F.transform(runs, lambda k: F.slice(v, k * RUN + 1, RUN))

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        begins = _let(totals, lambda t: F.transform(F.arrays_zip(t.alias("t"), _sums(t, F.lit(0)).alias("s")), lambda z: z["s"] - z["t"]))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), begins.alias("b")), lambda z: _sums(z["p"], z["b"])))

    return _let(_let(values, cut), summed)


def _spans(kind: str, text: Column) -> Column:
    """Validated matches of one kind: array of (start, rank, end, kind, text, score)."""
    rank, pattern = KINDS.index(kind), PATTERNS[kind]
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,text:string,score:double>>")
    reach = -(-CONTEXT_WIDTH // SHORTEST[kind])
    end_of = lambda c: F.right(c, F.lit(CONTEXT_WIDTH))

    def spans(g: Column) -> Column:
        hits, gaps, ends = g["hits"], g["gaps"], g["ends"]

        def span(i: Column) -> Column:
            hit, end = F.get(hits, i), F.get(ends, i)
            earlier = F.sequence(F.greatest(i - reach, F.lit(0)), i)
            pieces = F.transform(earlier, lambda j: F.concat(end_of(F.get(gaps, j)), F.when(j < i, end_of(F.get(hits, j))).otherwise(F.lit(""))))
            near = F.lower(end_of(F.array_join(pieces, "")))
            score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0)) - F.when(near.rlike(AGAINST[kind]), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
            return F.struct((end - F.length(hit)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("text"), score.alias("score"))

        valid = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: _valid(kind, F.get(hits, i)))
        found = F.transform(valid, span)
        return found if kind in BASE else F.filter(found, lambda s: s["score"] >= THRESHOLD)

    def placed(g: Column) -> Column:
        lengths = F.transform(g["hits"], lambda h, i: F.length(F.get(g["gaps"], i)) + F.length(h))
        return _let(F.struct(g["hits"].alias("hits"), g["gaps"].alias("gaps"), running_sums(lengths).alias("ends")), spans)

    matched = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    found = _let(matched, lambda g: F.when(F.size(g["hits"]) > 0, placed(g)).otherwise(none))
    wanted = text.rlike("[0-9]") if kind != "email" else F.lit(True)
    if NEEDS[kind]:
        wanted = F.contains(text, F.lit(NEEDS[kind])) & wanted
    return F.when(wanted, found).otherwise(none)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each row's id and its spans: (start, end, kind, text, score) by start, then kind."""
    rows = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("__fl_text"))
    found = F.array_sort(F.concat(*[_spans(k, F.col("__fl_text")) for k in KINDS]))
    return rows.select(doc_id, F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"), s["score"].alias("score"))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The contract's counts, hash of the base spans and list of all spans, and their scores in the same order, in per cent."""
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    kept = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select(doc_id, *counts, F.sha2(_listed(kept).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), scores.alias("scores"))
