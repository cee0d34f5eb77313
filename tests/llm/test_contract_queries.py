"""The contract queries against SQL, brute force, round trips and held-out rows."""

import zlib

import duckdb
import pytest

from comparison import connection, same
from fairlead.llm.common import crc_fold
from fairlead.llm.queries import QUERIES
from fairlead.llm.sql import ORACLES
from support import near_components, spelling_variants


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.fixture(scope="module")
def texts(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf_dir}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def encoded(texts):
    from tokenizers import Tokenizer

    from fairlead.llm.tokens import default_tokenizer

    model = Tokenizer.from_file(default_tokenizer())
    return {i: [*e.ids, 2] for (i, _, _), e in zip(texts, model.encode_batch([t or "" for _, t, _ in texts], add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf_dir, con):
    same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_op5_against_brute_force(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_ngram_join"](spark, sf_dir).collect()}
    assert got == near_components([(i, t) for i, t, _ in texts])


def test_op6_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, sf).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (not crc_fold(i)) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in rows.items())
    held = [(rows[i]["predicted"], q) for i, q in labels.items() if rows[i]["held_out"]]
    assert sum(p == q for p, q in held) / len(held) > 0.9


def test_op8_knows_held_out_languages(spark, texts):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_language_id"](spark, sf).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    held = [(r["lang_pred"], lang[r["doc_id"]]) for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert len(rows) == len(lang) and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_op9_is_a_packing_of_all_ids(spark, sf_dir, encoded):
    rows = QUERIES["op9_best_fit_packing"](spark, sf_dir).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == encoded.keys()
    for doc, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        ids = encoded[doc]
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:])
        assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)
        assert len(own) == 1 or len(ids) > 1024
    total = sum(map(len, encoded.values()))
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= 1024
    assert len(sequences) <= -(-total // 1024) * 1.02 + 1


def test_op10_round_trip(spark, sf_dir, encoded):
    rows = sorted(QUERIES["op10_token_ids"](spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r in rows:
        ids = encoded[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == len(encoded)


def test_op12_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in QUERIES["op12_spelling_variants"](spark, sf).collect()}
    assert got == spelling_variants(rows)
    assert any(v[2] for v in got.values())


def test_op13_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op13_toxicity"](spark, sf).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchone()[0]
    assert all(r["held_out"] == (not crc_fold(i)) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    bad = [rows[i]["predicted"] for i, t in labels.items() if rows[i]["held_out"] and t == 1]
    fine = [rows[i]["predicted"] for i, t in labels.items() if rows[i]["held_out"] and t == 0]
    # 0.70 and 0.024 as measured: this table has some 300 toxic rows to learn from, in four languages
    assert sum(bad) / len(bad) >= 0.65 and sum(fine) / len(fine) < 0.05
