"""The pipeline against plain versions of its stages, and its stages on awkward tables."""

import duckdb
import pytest

import corpus_pipeline
from fairlead.llm import quality
from fairlead.llm.common import table
from fairlead.llm.sql import ORACLES
from comparison import connection
from support import AWKWARD, docs, near_components


def test_rows_against_plain_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    documents = table(spark, sf_dir, "documents")
    model = quality.learn(documents, table(spark, sf_dir, "labels")).scorer()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    good = {i: t for i, t in texts.items() if model.score((t or "").encode()) >= quality.ACCEPT}
    con = connection(sf_dir)
    keep = {i: k for i, k, *_ in con.execute("SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') FROM documents").fetchall()}
    first = {}
    for i in sorted(good):
        first.setdefault(keep[i], i)
    single = {i: good[i] for i in first.values()}
    near = near_components(list(single.items()))
    single = {i: t for i, t in single.items() if near[i][1] == i}
    bad = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op4_decontaminate']}) WHERE contaminated").fetchall()}
    assert {r["doc_id"] for r in rows} == set(single) - bad
    assert len(single) < len(good) < len(texts)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(name, stage, spark, sf_dir):
    frame = docs(spark, AWKWARD, extra=True)
    out = stage(spark, frame, sf_dir)
    assert name == "pack" or out.columns == frame.columns
    out.collect()
    assert stage(spark, frame.limit(0), sf_dir).count() == 0
