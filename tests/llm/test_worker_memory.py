"""What workers hold after a task, and how much of a table a task holds at once."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from fairlead.llm import common, ngram_join, tokens


def test_a_join_drops_the_tokenizers_of_an_earlier_stage(spark):
    docs = spark.createDataFrame([(k, f"one two three four five {k}") for k in range(40)], "doc_id long, text string").repartition(4)
    survey = common.lean(ngram_join._survey)

    def held(batches):
        tokens.encoder(tokens.default_tokenizer())
        before = len(common.KEPT)
        rows = sum(b.num_rows for b in survey(batches))
        yield pa.record_batch([pa.array([x]) for x in (before, len(common.KEPT), rows)], names=["before", "after", "rows"])

    found = docs.mapInArrow(held, "before long, after long, rows long").collect()
    assert {(r["before"], r["after"]) for r in found} == {(1, 0)}
    assert sum(r["rows"] for r in found) >= 40


def test_a_tokenizer_stays_for_tasks_that_use_it():
    common.KEPT["tokenizer"] = 1
    assert list(common.lean(iter, keep=True)(iter("ab"))) == ["a", "b"]
    assert common.KEPT.pop("tokenizer") == 1


def test_free_memory_goes_back_to_the_system():
    def resident() -> int:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())))

    def run(batches):
        parts = [b"%d" % k * 10_000 for k in range(2000)]  # each too small for pages of its own
        yield len(parts)
        held.append(parts[-1])

    held, base = [], resident()
    assert list(common.lean(run)(iter(()))) == [2000]
    assert resident() - base < 20_000  # KiB; some 67,000 were in use


def test_batches_are_bounded_by_bytes_and_hold_every_row(spark):
    docs = spark.range(6000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words of a text "), 128).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    before = spark.conf.get(common.BATCHES)
    found = common.materialize(docs.mapInArrow(sizes, "rows long, bytes long"), "sizes", common.BATCH_BYTES)
    assert spark.conf.get(common.BATCHES) == before
    rows = found.collect()
    assert sum(r["rows"] for r in rows) == 6000
    assert max(r["bytes"] for r in rows) < 1.1 * common.BATCH_BYTES
    common.release(found)
