"""URL filters: dated list entries become validity intervals, captures are judged as of their fetch day.

Native: Spark SQL functions only.  Entries are events (name, list, action, day,
event add/remove).  Names are brought to the form of hosts first; the events of a
name, list and day become one, and ``lead`` over those days turns them into
intervals [from, to).  A capture's host asks for its own name and every parent
domain; that is decided once for each distinct host, whose few intervals are
kept as one array, and captures meet their host's array by host.  The as-of
choice inside the array is an expression, so a capture never multiplies.  The
host side is aggregated under another key than the join's, which leaves both
join sides as plain exchanges that Spark splits where one host is very common.

Of the entries active on the day the most specific name decides; at equal names
allow goes before block, then the later ``from``, then the list's name.

Defined results: a null or unusable URL has a null host and verdict ``none``, and
so has one whose host is over ``LONGEST`` characters, as no domain name is; a
null fetch day has verdict ``none``; what comes before a host's last ``@`` is a
user, also with an ``@`` of its own; an address in brackets is a host with them
and has no parents; events without name, list or day are left out; a day with
several events of one list and name counts as the removal if there is one, else as
the last action by name; a name listed twice without removal is one interval that
starts anew; an empty list leaves all captures ``none``; repeated captures give
repeated rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Characters of the longest domain name.
LONGEST = 253


def _plain(name: Column) -> Column:
    """A name in lower case without ``www.`` and closing dot; null if nothing is left or it is too long."""
    found = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\.$", ""), r"^www\.", "")
    return F.when((found != "") & (F.length(found) <= LONGEST), found)


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port, ``www.`` and closing dot; null if there is none."""
    return _plain(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)(?:[:/?#]|$)", 1))


def intervals(events: DataFrame) -> DataFrame:
    """name, list, action, valid_from and valid_to (exclusive; null: still listed)."""
    known = events.select(_plain(F.col("name")).alias("name"), "list", "action", "day", "event").where("name is not null and list is not null and day is not null")
    added = F.col("event").eqNullSafe("add")
    days = known.groupBy("name", "list", "day").agg(F.bool_and(added).alias("listed"), F.max(F.when(added, F.col("action"))).alias("action"))
    order = Window.partitionBy("name", "list").orderBy("day")
    return days.withColumn("valid_to", F.lead("day").over(order)).where("listed").select("name", "list", "action", F.col("day").alias("valid_from"), "valid_to")


def _names(of: Column) -> Column:
    """A host and its parent domains, the host first."""
    parts = F.split(of, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.startswith(of, F.lit("[")), F.array(of)).otherwise(every)


def judge(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "day", key: str = "page_id") -> DataFrame:
    """key, host, day, verdict (block, allow, none), and the name, list and start of the deciding entry."""
    rows = captures.select(F.col(key), host(F.col(url)).alias("host"), F.col(day).alias("day"))
    names = rows.where("host is not null").select("host").distinct().select("host", F.explode(_names(F.col("host"))).alias("name"))
    found = names.join(intervals(events), "name")
    entry = F.struct(
        (-F.length("name")).alias("rank"),
        F.when(F.col("action") == "allow", 0).otherwise(1).alias("order"),
        (-F.col("valid_from")).alias("latest"),
        F.col("list"), F.col("name"), F.col("action"), F.col("valid_from"), F.col("valid_to"),
    )
    listed = found.groupBy(F.reverse("host").alias("tsoh")).agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(F.reverse("tsoh").alias("host"), "entries")
    active = F.filter("entries", lambda e: (e["valid_from"] <= F.col("day")) & (e["valid_to"].isNull() | (e["valid_to"] > F.col("day"))))
    joined = rows.join(listed, "host", "left").withColumn("entry", F.try_element_at(active, F.lit(1)))
    return joined.select(
        key,
        "host",
        "day",
        F.coalesce("entry.action", F.lit("none")).alias("verdict"),
        F.col("entry.name").alias("matched"),
        F.col("entry.list").alias("list"),
        F.col("entry.valid_from").alias("listed_on"),
    )


def kept(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "day", key: str = "page_id") -> DataFrame:
    """Verdicts of the captures that no active entry blocks."""
    return judge(captures, events, url, day, key).where("verdict <> 'block'")
