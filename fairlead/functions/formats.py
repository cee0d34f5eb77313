"""Composite keys, titles, dates and other text for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "dd/MM/yyyy HH:mm"


def pack_key(k1: Column, k2: Column, k3: Column, d2: int, d3: int) -> Column:
    return k1 * d2 * d3 + k2 * d3 + k3


def unpack_key(key: Column, d2: int, d3: int) -> tuple[Column, Column, Column]:
    return F.floor(key / (d2 * d3)).cast("int"), F.floor(F.pmod(key, F.lit(d2 * d3)) / d3).cast("int"), F.pmod(key, F.lit(d3)).cast("int")


def checked_key(k1: Column, k2: Column, k3: Column, top1: int, top2: int, top3: int) -> Column:
    """The packed key; a part above its top fails the query."""
    good = (k1 <= top1) & (k2 <= top2) & (k3 <= top3)
    return F.when(good, pack_key(k1, k2, k3, top2 + 1, top3 + 1)).otherwise(F.raise_error(F.lit("a key part is out of range")).cast("int"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def from_millis(ms: Column) -> Column:
    """UTC wall time of epoch milliseconds (the session's zone is UTC)."""
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def position(lat: Column, lon: Column) -> Column:
    """Degrees and minutes, as ``(55 30.000N, 11 00.000E)``."""

    def part(x: Column, plus: str, minus: str, width: int) -> Column:
        thousandths = F.floor(F.abs(x) * 60_000 + 0.5).cast("long")
        degrees = F.floor(thousandths / 60_000).cast("long")
        rest = thousandths - degrees * 60_000
        text = F.format_string(f"%0{width}d %02d.%03d", degrees, F.floor(rest / 1000).cast("long"), (rest % 1000).cast("long"))
        return F.concat(text, F.when(x < 0, minus).otherwise(plus))

    return F.concat(F.lit("("), part(lat, "N", "S", 2), F.lit(", "), part(lon, "E", "W", 3), F.lit(")"))


def _printable(x: Column, digits: int) -> Column:
    """The double with ``digits`` decimals that is nearest to ``x`` as it is stored, and not to its shortest decimal text.

    What the product with 10**digits loses is worked out in halves of ``x``, and decides where the product is a tie.
    """
    scale = float(10**digits)
    split = x * 134217729.0
    high = split - (split - x)
    product = x * scale
    lost = (high * scale - product) + (x - high) * scale
    tie = product - F.floor(product) == 0.5
    whole = F.when(tie & (lost > 0), F.rint(product + 0.25)).when(tie & (lost < 0), F.rint(product - 0.25)).otherwise(F.rint(product))
    return F.when(F.abs(x) < 1e9, whole / scale).otherwise(x)


def fixed(x: Column, digits: int) -> Column:
    """``x`` with so many decimals; with any, the stored binary value is rounded as C's printf does."""
    x = x.cast("double")
    return F.format_string(f"%.{digits}f", _printable(x, digits) if digits else x)


def parse_date(text: Column) -> Column:
    """``dd/MM/yyyy HH:mm``; without a time it is midnight; anything else is null."""
    clean = F.trim(text)
    return F.coalesce(F.try_to_timestamp(clean, F.lit(STAMP)), F.try_to_timestamp(F.concat(clean, F.lit(" 00:00")), F.lit(STAMP))).cast("timestamp_ntz")


def percent(part: Column, whole: Column) -> Column:
    """A share in percent with two decimals, halves up."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole * 100.0 + 0.5) / 100.0)


def filter_suggestion(start: Column, end: Column, lat: Column, lon: Column) -> Column:
    """A replay filter around an event: 10 minutes before to 10 after (20 after the start if it has no end)."""
    form = "yyyy-MM-dd-HH:mm"
    last = F.coalesce(end + F.expr("INTERVAL 10 MINUTES"), start + F.expr("INTERVAL 20 MINUTES"))
    first = start - F.expr("INTERVAL 10 MINUTES")
    return F.concat(
        F.lit('-start "'), F.date_format(first, form), F.lit('" -end "'), F.date_format(last, form),
        F.lit('" -exp "m.pos within circle('), fixed(lat, 4), F.lit(","), fixed(lon, 4), F.lit(',1000)"'),
    )


def sentence(camel: Column) -> Column:
    """``SuddenSpeedChangeEvent`` as ``Sudden speed change event``."""
    words = F.lower(F.trim(F.regexp_replace(camel, "([A-Z])", " $1")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000))


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 10_000))
