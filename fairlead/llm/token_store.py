"""Token-id output: ORC files of whole documents' ids, in ascending id order.

Method.  Documents are range-partitioned by id and sorted, tokenised in that
order, and written as ORC: integers in run-length encoding v2, a row index, and
a Bloom filter on the id column.  The number of files follows the bytes of text.
A row's number before the exchange is the second key, so that rows of one id, or
without id, are dealt to several files where there are very many.  Readers take
stripes in parallel, and :func:`lookup` lets stripe statistics and Bloom filters
rule stripes out.

Defined results: a null text is an empty text and holds the end id alone; null
ids sort first; rows repeating an id are next to each other in no fixed order;
other ids are cast to long; a very long text is one row; an empty table writes no
rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.llm.common import sized_slices, text_buffers
from fairlead.llm.tokens import END_ID, default_tokenizer, encoder

#: Text bytes of a file at most, and at least where there are enough cores for more files.
MOST_BYTES, LEAST_BYTES = 1 << 30, 4 << 20
FILE_SCHEMA = "doc_id long, row long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = encoder(tokenizer), 0
        for batch in batches:
            for part in sized_slices(batch, "text"):
                ids, edge = model.encode_buffers(*text_buffers(part.column(1)), end=END_ID)
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.record_batch([part.column(0), pa.array(np.arange(row, row + part.num_rows)), lists], names=["doc_id", "row", "ids"])
                row += part.num_rows

    return run


def _files(rows: DataFrame) -> int:
    """How many files: enough for all cores, none over ``MOST_BYTES`` of text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // MOST_BYTES), min(4 * cores, -(-size // LEAST_BYTES)))


def write(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, partitions: int | None = None) -> None:
    """Write every document's ids, each document ending with ``END_ID``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.withColumn("turn", F.monotonically_increasing_id())
    ordered = dealt.repartitionByRange(partitions or _files(rows), "doc_id", "turn").sortWithinPartitions("doc_id", "turn").drop("turn")
    ordered.mapInArrow(_encode(tokenizer or default_tokenizer()), FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Some documents' ids; the filter reaches stripe statistics and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets = ids.offsets.to_numpy()
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "row", "file", "n_tokens", "ids_crc32"])


def _part() -> Column:
    """A file's number, by which files are in the order of ids."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^part-([0-9]+)", 1).cast("long")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start (ids of all documents before it), n_tokens, ids_crc32.

    The running sum has two levels: inside a file, and over one row for each file.
    """
    stored = read(spark, path).select("doc_id", "row", _part().alias("file"), "ids")
    rows = stored.mapInArrow(_digest, "doc_id long, row long, file long, n_tokens long, ids_crc32 long")
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    sizes = read(spark, path).select(_part().alias("file"), F.size("ids").cast("long").alias("n"))
    sizes = sizes.groupBy("file").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
