"""Secret scans: multipart credential linking by an interval join inside scopes.

Method.  A text is scanned for parts in three roles: access identifiers,
secrets and endpoints.  Strong kinds (assign, access, hex) are reported as
found.  Weak kinds (id, key, endpoint) are only proposals: a sweep over the
sorted parts joins each with the nearest part of a complementary role, in the
same scope (a paragraph) and within ``WINDOW`` code points, and a weak part is
reported only when that join finds one.  id needs a secret near, key needs an
identifier or an endpoint, endpoint needs a secret.  A weak part that overlaps a
strong one is not proposed, nor is a key that overlaps an id or an endpoint.

All work is inside one text, so nothing is shuffled and memory follows the text.

Defined results: a null text is empty and has no spans; repeated rows give
repeated results; positions count code points, the end is exclusive; extra
columns are left out, whatever their names; a very long text is scanned whole by
one task; ids are cast to long.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import sized_slices

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
STRONG = KINDS[:3]
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "access", "id": "access", "endpoint": "endpoint"}
COMPLEMENT = {"id": ("secret",), "key": ("access", "endpoint"), "endpoint": ("secret",)}
WINDOW = 200


def either_case(names: str) -> str:
    """ASCII letters of a pattern in either case, spelled out (no Unicode folding)."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", names)


ASSIGN = "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run of 16 or more is found from the run's start
ID = "(" + either_case("client_id|access_id|key_id|username|login") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)"""
KEY = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"https?://[A-Za-z0-9./_:?&=%#@-]+"

_ASSIGN, _ACCESS, _HEX, _ID, _KEY, _ENDPOINT = map(re.compile, (ASSIGN, ACCESS, HEX, ID, KEY, ENDPOINT))
_LOWER, _UPPER, _DIGIT = map(re.compile, ("[a-z]", "[A-Z]", "[0-9]"))

Span = tuple[int, int, str]


def _strong(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


class _Cover:
    """Whether a span overlaps any of some spans."""

    def __init__(self, spans: list[Span]):
        self._spans = sorted((s, e) for s, e, _ in spans)
        self._starts = [s for s, _ in self._spans]
        self._reach, top = [], 0
        for _, e in self._spans:
            top = max(top, e)
            self._reach.append(top)

    def hit(self, start: int, end: int) -> bool:
        k = bisect_left(self._starts, end)
        return k > 0 and self._reach[k - 1] > start


class _Nearest:
    """The nearest of some sorted spans, whatever their lengths: the earliest of those at the least distance."""

    def __init__(self, spans: list[Span]):
        self._spans, self._starts = spans, [s for s, _, _ in spans]
        self._reach, top = [], 0
        for _, e, _ in spans:
            top = max(top, e)
            self._reach.append(top)

    def of(self, part: Span) -> tuple[int, Span]:
        """Its distance from ``part`` and the span."""
        k = bisect_right(self._starts, part[1])  # so many begin before the part ends
        gap = max(part[0] - self._reach[k - 1], 0) if k else None
        if gap is None or k < len(self._spans) and self._starts[k] - part[1] < gap:
            return self._starts[k] - part[1], self._spans[k]
        return gap, self._spans[bisect_left(self._reach, min(self._reach[k - 1], part[0]))]


def _proposed(text: str, strong: list[Span]) -> list[Span]:
    cover = _Cover(strong)
    out = [(m.start(), m.end(), "id") for m in _ID.finditer(text) if len(m[2]) >= 4 and not cover.hit(m.start(), m.end())]
    if "http" in text:
        out += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text) if not cover.hit(m.start(), m.end())]
    if out or any(kind == "access" for _, _, kind in strong):  # a key counts only beside one of these
        cover = _Cover(strong + out)
        for m in _KEY.finditer(text):
            value = m[0]
            if not cover.hit(m.start(), m.end()) and _LOWER.search(value) and _UPPER.search(value) and _DIGIT.search(value):
                out.append((m.start(), m.end(), "key"))
    return out


def scan(text: str) -> tuple[list[Span], list[tuple[Span, Span]]]:
    """All reported spans by (start, kind), and each weak span with its nearest complement."""
    strong = _strong(text)
    weak = _proposed(text, strong)
    order = {k: i for i, k in enumerate(KINDS)}
    if not weak:
        return sorted(strong, key=lambda s: (s[0], order[s[2]])), []
    breaks = [m.start() for m in re.finditer("\n\n", text)]
    scope = lambda at: bisect_left(breaks, at - 1)  # noqa: E731  blank lines wholly before the part
    by_role: dict[tuple[str, int], list[Span]] = {}
    for part in sorted(strong + weak):
        by_role.setdefault((ROLE[part[2]], scope(part[0])), []).append(part)
    near_by = {k: _Nearest(v) for k, v in by_role.items()}
    links = []
    for part in weak:
        near = None
        for role in COMPLEMENT[part[2]]:
            found = (role, scope(part[0])) in near_by and near_by[role, scope(part[0])].of(part)
            if found and found[0] <= WINDOW and (near is None or found[0] < near[0]):
                near = found
        if near:
            links.append((part, near[1]))
    found = strong + [part for part, _ in links]
    return sorted(found, key=lambda s: (s[0], order[s[2]])), sorted(links)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("text", pa.string())])
_LINK = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("with_start", pa.int32()), ("with_kind", pa.string())])
SCHEMA = "doc_id long, spans array<struct<start:int,end:int,kind:string,text:string>>, links array<struct<start:int,kind:string,with_start:int,with_kind:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sized_slices(batch, "text"):
            spans, links = [], []
            for text in part.column(1).to_pylist():
                found, joined = scan(text or "")
                spans.append([{"start": s, "end": e, "kind": k, "text": text[s:e]} for s, e, k in found])
                links.append([{"start": a[0], "kind": a[2], "with_start": b[0], "with_kind": b[2]} for a, b in joined])
            yield pa.record_batch([part.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(links, pa.list_(_LINK))], names=["doc_id", "spans", "links"])


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each row's id, spans (start, end, kind, text) and links of weak parts."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan, SCHEMA)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    """The contract's counts, hash of the base spans and list of all spans."""
    counts = [_count(k).alias(f"n_{k}") for k in STRONG]
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
