"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes.

Method.  The normalised text (each run of space, tab, LF, VT, FF, CR is one
space) is hashed to 128 bits.  Rows are grouped by (hash, text): the aggregate's
key equality *is* the byte comparison, so two texts that share a hash form two
groups.  Copies meet first inside each map task, so a group that holds a third
of all rows crosses the shuffle as one row for each map task and never gathers.
Members then find their group by (hash, SHA-256), fixed-width keys, in a join of
two plain exchanges, so that Spark splits a group with very many members; a pair
of different texts agreeing on both would show as a second row, never merge.

Defined results: a null text is an empty text; null ids come last, and a group
with only null ids keeps the null id; rows repeating the kept id are all marked
kept by :func:`mark` while :func:`dedup` leaves one row of them; extra columns
stay untouched, whatever their names and types; a very long text is one row; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.md5(norm.cast("binary"))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row for each distinct normalised text: hash, sha, keep_id, group_size."""
    norm = normalized(F.col(text))
    rows = docs.select(F.col(doc_id).alias("__fl_id"), norm.alias("__fl_norm"))
    rows = rows.withColumn("__fl_hash", hash_fn(F.col("__fl_norm")))
    found = rows.groupBy("__fl_hash", "__fl_norm").agg(F.min("__fl_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return found.select("__fl_hash", F.sha2(F.col("__fl_norm").cast("binary"), 256).alias("__fl_sha"), "keep_id", "group_size")


def mark(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Every row's id with keep_id, group_size, kept and text_sha256."""
    norm = normalized(F.col(text))
    rows = docs.select(F.col(doc_id), norm.alias("__fl_norm"))
    rows = rows.select(doc_id, hash_fn(F.col("__fl_norm")).alias("__fl_hash"), F.sha2(F.col("__fl_norm").cast("binary"), 256).alias("__fl_sha"))
    out = rows.join(groups(docs, text, doc_id, hash_fn), ["__fl_hash", "__fl_sha"])
    return out.select(
        doc_id,
        F.col("keep_id").cast("long").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col(doc_id).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("__fl_sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One whole row of each group of equal texts, the one with the smallest id.

    One shuffle: rows travel inside the aggregate, reduced in each map task.
    Ties on the id are broken by hashes of the text and of the other columns as
    JSON, so any type of column can be beside the text and the result is stable.
    """
    norm = normalized(F.col(text))
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    others = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in rest]))) if rest else F.lit(0).cast("long")
    order = F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"), F.xxhash64(F.col(text)).alias("c"), others.alias("d"))
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(norm.alias("__fl_norm"), whole.alias("__fl_row"), order.alias("__fl_order")).withColumn("__fl_hash", hash_fn(F.col("__fl_norm")))
    best = rows.groupBy("__fl_hash", "__fl_norm").agg(F.min_by("__fl_row", "__fl_order").alias("__fl_row"))
    return best.select(*[F.col("__fl_row")[c].alias(c) for c in docs.columns])
