"""Connected components of links by alternating large-star and small-star rounds.

Each round is a ``min`` aggregate (combined in the map tasks) and a join whose
large side Spark can split, so a hub with very many links is no single task.
Rounds grow with the logarithm of a component's size; each writes its links to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import materialize, release


def _star(links: DataFrame, keep_larger: bool) -> DataFrame:
    """Point neighbours (the larger ones, or the smaller ones and the node) at the least neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    if not keep_larger:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if keep_larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _is_stars(links: DataFrame) -> bool:
    """Whether every link ends at a node that begins none, and every node begins one at most."""
    least = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    if not least.where("n > 1").isEmpty():
        return False
    return links.join(least.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``, as a table; the component is its smallest node."""
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _is_stars(now):
        after = materialize(_star(_star(now, True), False), "links")
        release(now)
        now = after
    out = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "groups")
    release(now)
    return out
