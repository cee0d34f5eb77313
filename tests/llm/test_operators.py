"""Operators on awkward rows, planted cases and parts of their methods."""

import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairlead.llm import collocations, decontaminate, exact_dedup, language_id, ngram_join, packing, pii, quality, secrets, spelling, token_store, toxicity, url_filter
from fairlead.llm.common import Words, char_class, crc_fold, in_fold, scratch_path, text_buffers
from fairlead.llm.components import components
from fairlead.llm.fm_index import Bits, FMIndex, WaveletMatrix, suffix_array
from fairlead.llm.tokens import Encoder, default_tokenizer
from support import AWKWARD, LONG, LOWER, SCHEMA, docs, near_components, spelling_variants


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD, extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fold_twins(spark):
    ids = [*range(50), 10**12]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert [r[0] for r in frame.select(in_fold(F.col("doc_id"))).collect()] == [crc_fold(i) for i in ids]


# --- exact dedup


def test_dedup_awkward(awkward, empty):
    rows = exact_dedup.mark(awkward).collect()
    got = [(r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in rows]
    assert len(rows) == len(AWKWARD)
    assert (4, 4, 3, True) in got and got.count((5, 4, 3, False)) == 2 and (6, 6, 1, True) in got
    assert (1, 1, 3, True) in got and (2, 1, 3, False) in got and (-1, 1, 3, False) in got and (3, 3, 1, True) in got
    kept = exact_dedup.dedup(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 5").count() == 0 and kept.count() == 9
    assert exact_dedup.mark(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def test_equal_hashes_do_not_merge_different_texts(spark):
    frame = docs(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "b ")])
    same_hash = lambda norm: F.lit("same")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.mark(frame, hash_fn=same_hash).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}
    assert {r["doc_id"] for r in exact_dedup.dedup(frame, hash_fn=same_hash).collect()} == {1, 2, 4}


def test_dedup_carries_any_column(spark):
    frame = docs(spark, [(1, "a"), (1, "a"), (2, "a"), (None, "b")]).withColumn("m", F.create_map(F.lit("k"), F.col("n_chars"))).withColumn("__fl_norm", F.lit("clash")).withColumn("__fl_row", F.lit(1))
    kept = exact_dedup.dedup(frame)
    assert kept.dtypes == frame.dtypes and sorted((r["doc_id"] or 0, r["m"]["k"]) for r in kept.collect()) == [(0, 1), (1, 1)]


def test_repeated_rows_are_learned_once(spark):
    base = [(k, f"good words number {k} of many" if k % 2 else "zz" * (5 + k)) for k in range(60)]
    labels = [(k, k % 2) for k in range(60)]
    schema = "doc_id long, quality int"
    one = quality.learn(docs(spark, base), spark.createDataFrame(labels, schema))
    many = quality.learn(docs(spark, base + base[:5] * 50), spark.createDataFrame(labels + labels[:3] * 40, schema))
    assert (one.good, one.bad) == (many.good, many.bad)
    learned = [language_id.learn(docs(spark, rows)) for rows in ([(k, f"the cat {k}") for k in range(8)], [(k, f"the cat {k}") for k in range(8)] * 3)]
    assert all(np.allclose(learned[0][k], learned[1][k]) for k in learned[0])


def test_repeated_rows_leave_one(spark):
    frame = docs(spark, [(1, "a")] * 5 + [(None, "q"), (None, "q")])
    assert sorted((r["doc_id"] or 0) for r in exact_dedup.dedup(frame).collect()) == [0, 1]


# --- PII


def test_pii_spans(spark):
    texts = [
        (1, "mail a@b.example.com now"),
        (2, "😀 x.y+z@d-e.fr_q@r.st"),
        (3, "host 10.0.0.1 and 1.2.3.456 and 1.2.3.4.5.6.7.8"),
        (4, "card 4111 1111 1111 1111 or 4111 1111 1111 1112"),
        (5, "call +45 (12) 34-56-78 or +1 2"),
        (6, "iban GB82WEST12345698765432 not GB82WEST12345698765431"),
        (7, "ssn 123-45-6789; bare text of more than forty letters before 123-45-6789"),
        (8, "a@b" + "@" * 1000 + "c.d"),
        (9, "z" * 60_000 + "@"),
        (10, "a@b" + ".c" * 20_000),
        (11, "0001.002.003.255 256.1.1.1"),
    ]
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["text"]) for s in r["spans"]] for r in pii.find(docs(spark, texts)).collect()}
    assert rows[1] == [("email", 5, 20, "a@b.example.com")]
    assert rows[2] == [("email", 2, 14, "x.y+z@d-e.fr"), ("email", 14, 21, "_q@r.st")]
    assert [x[3] for x in rows[3]] == ["10.0.0.1", "1.2.3.4", "5.6.7.8"]
    assert rows[4] == [("card", 5, 24, "4111 1111 1111 1111")]
    assert rows[5] == [("phone", 5, 22, "+45 (12) 34-56-78")]
    assert [(k, t) for k, _, _, t in rows[6]] == [("iban", "GB82WEST12345698765432")]
    assert rows[7][0] == ("ssn", 4, 15, "123-45-6789") and len(rows[7]) == 1
    assert rows[9] == [] and rows[10][0][2] == 3 + 40_000 and [x[3] for x in rows[11]] == ["0001.002.003.255"]


def test_pii_scores_follow_context(spark):
    texts = [
        (1, "Send mail to a@b.cd or noreply example a@b.cd"),
        (2, "card 4111 1111 1111 1111" + " x" * 40 + " order 4111 1111 1111 1111" + " y" * 40 + " 4111 1111 1111 1111"),
        (3, "ssn 123-45-6789 123-45-6789 123-45-6789 123-45-6789 123-45-6789, order ssn 123-45-6789"),
        (4, "example GB82WEST12345698765432 bank account" + " z" * 30 + "GB82WEST12345698765432"),
        (5, "phone +45 12 34 56 78, tracking +45 12 34 56 78 host 10.0.0.1" + " q" * 30 + " version 10.0.0.1"),
    ]
    got = {r["doc_id"]: [(s["kind"], round(s["score"], 2)) for s in r["spans"]] for r in pii.find(docs(spark, texts)).collect()}
    assert got[1] == [("email", 0.95), ("email", 0.7)]
    assert got[2] == [("card", 0.95), ("card", 0.45), ("card", 0.7)]
    assert got[3] == [("ssn", 0.55)] * 4  # the fifth lies over 40 characters behind the word, the sixth has a word against it
    assert got[4] == [("iban", 0.55), ("iban", 0.8)]
    assert [s for k, s in got[5] if k == "phone"] == [0.75, 0.5] and [s for k, s in got[5] if k == "ip"] == [0.85, 0.35]
    row = pii.digest(pii.find(docs(spark, texts[:1]))).first()
    assert row["scores"] == "95,70" and row["spans"] == "email:13:19,email:39:45"


def test_running_sums(spark):
    for n in (1, 2, 255, 256, 257, 512, 513, 3000):
        frame = spark.createDataFrame([([k % 7 for k in range(n)],)], "v array<int>")
        got = frame.select(pii.running_sums(F.col("v")).alias("s")).first()["s"]
        assert got == np.cumsum([k % 7 for k in range(n)]).tolist()


def test_pii_cost_follows_the_number_of_spans(spark):
    import time

    def seconds(n):
        frame = docs(spark, [(1, " ".join(f"user{k}@mail.example.com" for k in range(n)))])
        began = time.time()
        assert len(pii.find(frame).first()["spans"]) == n
        return time.time() - began

    seconds(100)
    assert seconds(64_000) < 20


def test_pii_awkward(awkward, empty):
    assert pii.digest(pii.find(awkward)).count() == len(AWKWARD) and pii.find(empty).count() == 0


# --- secrets


def test_secrets_link_parts():
    key = "aB3dE5gH7jK9mN1pQ3rS"
    assert secrets.scan(f"lonely {key} here") == ([], [])
    found, links = secrets.scan(f"login=alice then {key}")
    assert [s[2] for s in found] == ["id", "key"] and len(links) == 2
    found, _ = secrets.scan(f"login=alice\n\n{key}")
    assert found == []
    found, _ = secrets.scan("login=alice" + " " * 300 + key)
    assert found == []
    found, _ = secrets.scan("password = abcdefghijkl at https://x.example/y")
    assert [s[2] for s in found] == ["assign", "endpoint"]
    assert [s[2] for s in secrets.scan("AKIA" + "A" * 14 + " AKIA12 " + "0123456789abcdef deadbeef")[0]] == ["access", "hex"]
    assert secrets.scan("paſſword=abcdefghijklmnop")[0] == [] and secrets.scan("token:secret=short")[0] == [(0, 18, "assign")]


def test_nearest_parts_against_all_parts():
    rng = random.Random(4)
    for _ in range(300):
        spans = sorted((s, s + rng.choice([1, 3, 60]), "x") for s in (rng.randint(0, 200) for _ in range(rng.randint(1, 12))))
        part = (s := rng.randint(0, 220), s + rng.randint(1, 9), "y")
        gap = lambda o: max(o[0] - part[1], part[0] - o[1], 0)
        least = min(map(gap, spans))
        assert secrets._Nearest(spans).of(part) == (least, next(o for o in spans if gap(o) == least))


def test_secrets_cost_follows_the_number_of_parts():
    import time

    text = lambda n: "token=" + "A1" * 20 * n + " " + " ".join(f"login=abcd{k} {k:016x}" for k in range(n))
    began = time.process_time()
    spans, links = secrets.scan(text(32_000))
    assert time.process_time() - began < 30 and len(links) == 32_000 and len(spans) == 64_001


def test_secrets_awkward(awkward, empty):
    assert secrets.digest(secrets.find(awkward)).count() == len(AWKWARD) and secrets.find(empty).count() == 0


# --- FM-index and decontamination


def test_suffix_array_and_index_against_search():
    rng = np.random.default_rng(1)
    for symbols in (3, 6):
        text = rng.integers(1, symbols, 400)
        full = np.append(text, 0)
        assert suffix_array(full).tolist() == sorted(range(401), key=lambda k: full[k:].tolist())
        index = FMIndex(text, symbols)
        patterns = np.array([[0] * (5 - n) + rng.integers(1, symbols, n).tolist() for n in (1, 2, 3, 4, 5) for _ in range(20)])
        first, last = index.search(patterns)
        for p, a, b in zip(patterns, first, last, strict=True):
            word = p[p > 0]
            want = [k for k in range(400 - len(word) + 1) if (text[k : k + len(word)] == word).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_ranks_of_packed_bits():
    rng = np.random.default_rng(9)
    for n in (0, 1, 63, 64, 65, 128, 1000):
        bits = rng.random(n) < 0.3
        packed = Bits(bits)
        assert packed.rank(np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
        assert packed.get(np.arange(n)).tolist() == bits.tolist()
    values = rng.integers(0, 9, 500)
    symbol, rank = WaveletMatrix(values, 9).symbol_and_rank(np.arange(500))
    assert symbol.tolist() == values.tolist() and rank.tolist() == [int((values[:k] == v).sum()) for k, v in enumerate(values)]
    index = FMIndex(np.tile([1, 2, 3], 1000), 4)
    assert len(index.positions) == 188 and index.marked.words.nbytes < 1000


def test_phrases_are_small_and_name_their_items():
    items = [("a", "x y z"), ("b", "x y z"), ("a", " ".join(f"w{k}" for k in range(20)) + " " + " ".join(f"w{k}" for k in range(20))), ("c", "..."), ("d", None)]
    phrases = decontaminate.Phrases(sorted(items, key=lambda x: (x[0], x[1] or "")))
    assert len(phrases.start) == 1 + 20 and phrases.shortest == 3 and phrases.items_of(np.flatnonzero(phrases.length == 3)) == {"a", "b"}
    many = decontaminate.Phrases([(str(i), " ".join(f"t{(i * 97 + k * k) % 50_000}" for k in range(400))) for i in range(1000)])
    assert sum(v.nbytes for v in vars(many).values() if isinstance(v, np.ndarray)) < 24 * 400_000
    assert decontaminate.Phrases([]).shortest == 0


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    """Several blocks, several held shards, an item in each and texts over many slices."""
    rng = random.Random(3)
    words = [f"b{k}" for k in range(400)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.choice((3, 12, 13, 40))))) for k in range(60)]
    benchmark = spark.createDataFrame(items + items[:5], "item_id string, text string")
    texts = []
    for i in range(200):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(3)] + [rng.choice(items)[1] for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        texts.append((i, " ! ".join(parts)))
    frame = docs(spark, texts)
    want = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in decontaminate.find(frame, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "HELD", 3)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in decontaminate.find(frame, benchmark, block_bytes=500).collect()} == want
    assert sum(bool(v[1]) for v in want.values()) > 100


def test_decontamination_spans(spark):
    item = " ".join(f"w{k}" for k in range(20))
    benchmark = spark.createDataFrame([("q", item), ("short", "Tiny item"), (None, "x y"), ("none", None), ("blank", "...")], "item_id string, text string")
    hit = " ".join(f"w{k}" for k in range(3, 17))
    texts = [(1, f"é start, {hit.upper()}! end"), (2, " ".join(f"w{k}" for k in range(12))), (3, "a TINY, item b"), (4, None), (5, hit + " filler" * 300), (6, item + " " + item)]
    rows = {r["doc_id"]: r for r in decontaminate.find(docs(spark, texts), benchmark).collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [(9, 9 + len(hit))] and rows[1]["items"] == ["q"] and rows[1]["n_hit"] == 14
    assert rows[2]["n_hit"] == 0 and rows[3]["items"] == ["short"] and rows[4]["n_words"] == 0 and rows[6]["n_hit"] == 40
    verdict = {r["doc_id"]: r["contaminated"] for r in decontaminate.digest(decontaminate.find(docs(spark, texts), benchmark)).collect()}
    assert verdict == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True}
    kept = decontaminate.clean(docs(spark, texts, extra=True), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {2, 4, 5} and "token" in kept.columns
    assert decontaminate.without_spans("abcdef", [(1, 3), (4, 5)]) == "adf"
    blocks = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find(docs(spark, texts), benchmark, block_bytes=20).collect()}
    assert blocks == {i: (r["n_hit"], r["items"]) for i, r in rows.items()}


def test_decontamination_judges_rows_without_id(spark):
    item = " ".join(f"w{k}" for k in range(20))
    benchmark = spark.createDataFrame([("q", item), ("r", "tiny item")], "item_id string, text string")
    frame = docs(spark, [(None, f"start {item} end"), (None, "tiny item"), (None, "nothing of it"), (None, None), (1, item), (1, "clean"), (2, "")])
    for size in (decontaminate.BLOCK_BYTES, 20):
        kept = decontaminate.clean(frame, benchmark, block_bytes=size)
        assert kept.schema == frame.schema
        assert sorted(map(str, kept.collect())) == sorted(str(r) for r in frame.collect() if r["text"] in ("nothing of it", None, "clean", ""))


def test_decontamination_awkward(spark, awkward, empty):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.find(awkward, benchmark).where("n_hit > 0").count() == 5
    assert decontaminate.find(empty, benchmark).count() == 0 and decontaminate.find(awkward, benchmark.limit(0)).where("n_hit > 0").count() == 0


# --- n-gram join


def test_components_of_chains(spark):
    rng = random.Random(2)
    chain = list(range(1, 60))
    edges = [(a, b) for a, b in zip(chain[:-1], chain[1:], strict=True)] + [(100, 101), (102, 101), (200, 200)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in chain} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("small, delegates, salts", [(64, 4, ngram_join.SALTS), (0, 1, (3,) * 8)])
def test_join_planted(spark, monkeypatch, small, delegates, salts):
    """Also with every opened group taken as large, and every shingle dealt in parts."""
    large = []
    links = ngram_join._large_group_links
    monkeypatch.setattr(ngram_join, "_large_group_links", lambda *a: large.append(1) or links(*a))
    for name, value in (("SMALL", small), ("DELEGATES", delegates), ("SALTS", salts)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(3000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, texts = make(60), []
    base = make(200)
    for i in range(120):  # a cluster of near copies, some too far apart
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        texts.append((1000 - i, " ".join(words)))
    for i in range(80):  # a passage that many documents share
        texts.append((2000 + i, " ".join(make(rng.randrange(5, 250)) + common + make(rng.randrange(5, 250)))))
    for i in range(40):  # pairs around the threshold
        words = make(rng.randrange(8, 90))
        other = list(words)
        for _ in range(rng.randrange(0, 3)):
            other[rng.randrange(len(other))] = "edit"
        texts += [(3000 + 2 * i, " ".join(words)), (3001 + 2 * i, " ".join(other) + ("" if i % 3 else " tail words of some length"))]
    texts += [(4000, "a b c"), (4001, "A  b\nC"), (4002, "a b"), (4003, None), (4004, " ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs(spark, texts)).collect()}
    assert got == near_components(texts) and (large or small)
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs(spark, texts, extra=True)).collect()}
    assert kept == {c for _, c in got.values()}


def test_join_of_texts_around_one_passage(spark):
    """Texts of many sizes around a passage: it alone links the short ones, and only those."""
    rng = random.Random(6)
    passage, texts = [f"p{k}" for k in range(64)], []
    for i in range(150):
        own = [f"u{rng.randrange(10**9)}" for _ in range(rng.choice((0, 2, 5, 8, 10, 14, 30, 200)))]
        cut = rng.randrange(len(own) + 1)
        texts.append((i, " ".join(own[:cut] + passage + own[cut:])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs(spark, texts, extra=True)).collect()}
    want = near_components(texts)
    assert got == want and 1 < len({c for _, c in want.values()}) < 140


def test_scratch_tables_of_the_join_go(spark):
    import os

    from fairlead.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert ngram_join.join(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f g"), (3, "z")])).count() == 3
    assert len(set(os.listdir(folder)) - before) == 1  # the result


def test_counters_add_up_in_two_steps():
    rng = np.random.default_rng(5)
    some = [rng.integers(0, 70_000, ngram_join.BUCKETS // 64).astype("<u2") for _ in range(5)]
    batch = lambda blobs: pa.record_batch([pa.array([3] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])
    halves = [next(ngram_join._added(None)(iter([batch([ngram_join._packed(c) for c in part])]))).column(1)[0].as_py() for part in (some[:2], some[2:])]
    total = sum(c.astype(np.int64) for c in some)
    assert (ngram_join._unpacked(halves[0]).astype(np.int64) + ngram_join._unpacked(halves[1]).astype(np.int64) == total).all()
    out = next(ngram_join._added(1000.0)(iter([batch(halves)])))
    kinds = np.frombuffer(out.column(1)[0].as_py(), np.uint8)
    kinds = np.stack([kinds >> 4, kinds & 15], 1).ravel()
    assert (kinds == sum((total > 1000 * 8**k).astype(int) for k in range(7))).all()


def test_join_awkward(awkward, empty):
    rows = ngram_join.join(awkward).collect()
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] != 7 and r["doc_id"] != 8 and r["doc_id"])
    assert len(rows) == len(AWKWARD) and (4, 1, 4) in got and got.count((5, 1, 4)) == 2 and (6, 1, 4) in got and (2, 0, 2) in got
    assert {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert ngram_join.join(empty).count() == 0


# --- quality and language


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 11)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.learn(awkward, labels)
    rows = quality.score(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and {r["score"] for r in rows if r["doc_id"] in (1, 2)} == {quality.EMPTY_SCORE}
    kept = quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns
    blank = quality.learn(empty, labels.limit(0))
    assert quality.score(awkward, blank).count() == len(AWKWARD) and quality.score(empty, model).count() == 0


def test_language_awkward(spark, awkward, empty):
    learned = language_id.learn(docs(spark, [(k, f"the cat {k} and the dog") for k in range(30)]))
    rows = language_id.predict(awkward, learned).collect()
    assert len(rows) == len(AWKWARD) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (4, 9)} == {"en"}
    assert language_id.learn(empty) == {} and {r["lang_pred"] for r in language_id.predict(awkward, {}).collect()} == {"und"}


def plain_profile(text):
    """A text's vector from its definition, letter by letter."""
    vectors = {}
    symbols, out = [0], np.zeros(language_id.DIMENSIONS)
    for c in unicodedata.normalize("NFC", text) + " ":
        s = ord(c.lower()[0]) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    for s in set(symbols):
        bits = np.unpackbits(np.frombuffer(np.random.default_rng([language_id.SEED, s]).bytes(language_id.DIMENSIONS // 8), np.uint8))
        vectors[s] = bits.astype(float) * 2 - 1
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        out += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    length = np.linalg.norm(out)
    return out / length if length else out


def test_profiles_match_their_definition(monkeypatch):
    texts = ["Ab, c", "", "xyz " * 3, "\u0416\u0443\u043a \u00e9t\u00e9 e\u0301", "\ud55c\uad6d\uc5b4", "12 3", "\u4e2d\u6587" * 50]
    for grams in (language_id._GRAMS, 3):
        monkeypatch.setattr(language_id, "_GRAMS", grams)
        got, letters = language_id.profiles(texts)
        assert letters.tolist() == [True, False, True, True, True, False, True]
        for text, vector in zip(texts, got, strict=True):
            assert np.allclose(vector, plain_profile(text), atol=1e-5)


def test_languages_of_all_scripts_are_told_apart(spark):
    """Two languages of each script, by texts of made-up words from letters that both have and a few of their own."""
    rng, rows = np.random.default_rng(11), []
    scripts = {"cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3C2), "hangul": range(0xAC00, 0xAC40), "kana": range(0x3041, 0x3080), "han": range(0x4E00, 0x4E80), "arabic": range(0x627, 0x63B), "latin": range(0xE0, 0xF7)}
    words = {}
    for script, points in scripts.items():
        for k in "ab":  # the same letters, other words
            words[f"{script}-{k}"] = ["".join(chr(x) for x in rng.choice(list(points), rng.integers(3, 8))) for _ in range(60)]
    for i in range(1400):
        lang = sorted(words)[i % len(words)]
        rows.append((i, " ".join(rng.choice(words[lang], 25)), lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learn(table)
    found = language_id.predict(table, learned).join(table, "doc_id").where("pmod(crc32(cast(doc_id as string)), 4) = 2").collect()
    assert set(learned) == set(words) and len(found) > 250 and all(r["lang_pred"] == r["lang"] for r in found)


def test_predictions_match_their_definition(spark):
    """Prototypes and predictions of a table by plain sums over texts."""
    rng = np.random.default_rng(5)
    words = {"x": ["ola", "meu", "não", "isto"], "y": ["the", "and", "over", "dog"], "z": ["το", "και", "ναι", "δεν"]}
    rows = [(i, " ".join(rng.choice(words[k], 12)), k) for i, k in enumerate(list("xyz") * 40)] + [(900, None, "x"), (901, "12 34", "y"), (902, "and", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = {}
    for k in "xyz":  # equal texts are learned once for each id, as their order holds the id
        total = sum(plain_profile(t) for i, t, lang in rows if lang == k and t and zlib.crc32(str(i).encode()) % 4 != 2)
        prototypes[k] = total / np.linalg.norm(total)
    learned = language_id.learn(table)
    assert sorted(learned) == ["x", "y", "z"] and all(np.allclose(learned[k], prototypes[k], atol=1e-5) for k in learned)
    for r in language_id.predict(table, learned).collect():
        vector = plain_profile({i: t for i, t, _ in rows}[r["doc_id"]] or "")
        cosine = {k: float(v @ vector) for k, v in prototypes.items()}
        best = max(cosine, key=cosine.get)
        if not vector.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        share = 1 / sum(np.exp(language_id.SHARPNESS * (v - cosine[best])) for v in cosine.values())
        assert r["lang_pred"] == best and abs(r["score"] - share) < 1e-4 and abs(r["cosine"] - cosine[best]) < 1e-5


# --- URL lists


def test_url_intervals(spark):
    events = spark.createDataFrame(
        [("bad.example.com", "x", "block", 10, "add"), ("bad.example.com", "x", "block", 20, "remove"), ("bad.example.com", "x", "block", 30, "add"), ("example.com", "y", "allow", 0, "add"), ("com", "z", "block", 35, "add"), (None, "z", "block", 1, "add")],
        "name string, list string, action string, day int, event string",
    )
    captures = [(1, "http://www.BAD.example.com:80/x", 10), (2, "https://u@bad.example.com", 20), (3, "ftp://a.bad.example.com/?q=http://z", 31), (4, "http://other.com", 34), (5, "http://other.com.", 35), (6, None, 5), (7, "no url", 5), (8, "http://example.com", None), (1, "http://www.BAD.example.com:80/x", 10)]
    frame = spark.createDataFrame(captures, "page_id long, url string, day int")
    rows = url_filter.judge(frame, events).collect()
    got = {r["page_id"]: (r["verdict"], r["matched"]) for r in rows}
    assert got == {1: ("block", "bad.example.com"), 2: ("allow", "example.com"), 3: ("block", "bad.example.com"), 4: ("none", None), 5: ("block", "com"), 6: ("none", None), 7: ("none", None), 8: ("none", None)}
    assert len(rows) == 9 and url_filter.judge(frame, events.limit(0)).where("verdict <> 'none'").count() == 0
    assert url_filter.kept(frame.limit(0), events).count() == 0


def test_url_names_and_hosts_in_any_form(spark):
    events = spark.createDataFrame(
        [("Bad.com", "x", "block", 0, "add"), ("bad.com ", "x", "block", 10, "remove"), ("www.Site.com", "x", "block", 0, "add"), ("dot.com.", "x", "block", 0, "add"), ("u.com", "x", "block", 0, "add"), ("[::1]", "x", "block", 0, "add")]
        + [("same.com", "x", "block", 5, e) for e in ("remove", "add", "add")] + [("turn.com", "x", "block", 1, "add"), ("turn.com", "x", "allow", 1, "add"), ("turn.com", "x", "allow", 3, "add"), ("www.", "x", "block", 0, "add"), (".", "x", "block", 0, "add"), ("odd.com", "x", "block", 0, None)],
        "name string, list string, action string, day int, event string",
    )
    captures = [(1, "http://bad.com/", 5), (2, "http://BAD.com/", 20), (3, "http://site.com", 1), (4, "http://a.dot.com./x", 1), (5, "http://v@w@u.com/", 1), (6, "http://[::1]/", 1), (7, "http://[::1]:80", 1), (8, "http://same.com", 6), (9, "http://turn.com", 2)]
    captures += [(10, "http://turn.com", 4), (11, "http://" + "a." * 126 + "com", 1), (12, "http://" + "a." * 200_000 + "com/", 1), (13, "http://u.com/" + "x@" * 100_000, 1), (14, "http://odd.com", 1), (15, "http://@/", 1), (16, "http://u.com@", 1)]
    frame = spark.createDataFrame(captures, "page_id long, url string, day int")
    for name in ("host", "name", "list", "entries", "entry", "verdict", "matched", "tsoh", "listed_on"):
        frame = frame.withColumn(name, F.lit("clash"))
        events = events.withColumn(f"{name}_", F.lit("clash"))
    events = events.withColumn("valid_to", F.lit("clash")).withColumn("listed", F.lit("clash"))
    rows = {r["page_id"]: r for r in url_filter.judge(frame, events).collect()}
    assert {k: r["verdict"] for k, r in rows.items()} == {1: "block", 2: "none", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "none", 9: "block", 10: "allow", 11: "none", 12: "none", 13: "block", 14: "none", 15: "none", 16: "none"}
    assert rows[5]["host"] == "u.com" and rows[6]["host"] == "[::1]" and rows[12]["host"] is None and rows[15]["host"] is None and rows[16]["host"] is None and rows[10]["listed_on"] == 3


# --- tokens, packing, files

ODD = ["", " ", "  a  b", "a\n\n b \n c", "it's 'tis I'll’s don't,", "\x1c x\x1cy   z 　 q", "tab\t x", "<|endoftext|> a", "ab,'s x.", " " * 50 + "x", "é" * 200 + " " + "x" * 300 + " y,,,'", "a\nb", "a.\nb", ".\n", "\n", "x ", "y", " z", "a-b_c (d)e", "don't.\nIt", "naïve,\nx", "😀 😀", "1,000.50 $5"]


def test_segments_give_the_whole_texts_ids():
    model = Encoder(default_tokenizer())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab .,\n'é1 !") for _ in range(rng.randrange(60))) for _ in range(400)]
    want = [e.ids for e in model._model.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert model.encode(texts) == want


def test_added_tokens_inside_beside_and_between_words():
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    rng = random.Random(2)
    parts = [end, "<|", "endoftext", "|>", "a", "b", " ", ".", ",", "\n", "'s", "é", "1", "<|endo", "ftext|>", "  "]
    texts = [f"end of one{end}start of two", f"in{end}side", f"beside {end} a", f"{end}", f"{end}{end}", f"<{end}>", f"a  {end}  b", f"a\n{end}\nb", f"x.{end}.y", f"{end} a", "one <|endo", "ftext|> two", f"{end[:-1]} >"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)]
    want = [e.ids for e in Tokenizer.from_file(default_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    assert want[0].count(50256) == 1 and len(want[0]) == 7
    model = Encoder(default_tokenizer())
    for _ in range(2):
        assert model.encode(texts) == want


def test_packing_awkward(awkward, empty):
    rows = packing.pack(awkward, block=6).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in AWKWARD} and sum(r["doc_id"] == 5 for r in rows) == 2
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024 and packing.pack(empty).count() == 0


def test_cut_points():
    assert packing.cut_points(1024, 1024) == [0, 1024] and packing.cut_points(2048, 1024) == [0, 1024, 2048]
    assert packing.cut_points(2500, 1024) == [0, 452, 1476, 2500] and packing.cut_points(1, 1024) == [0, 1]


def planted_lengths(rng, bins, parts):
    """Pieces that fill ``bins`` bins of 1,024 to the last id."""
    out = []
    for _ in range(bins):
        cuts = np.sort(rng.choice(np.arange(1, 1024), parts - 1, replace=False))
        out += np.diff(np.concatenate([[0], cuts, [1024]])).tolist()
    return np.sort(np.array(out))[::-1].copy()


def test_genetic_packing_beats_best_fit_on_planted_blocks():
    rng = np.random.default_rng(3)
    for bins, parts in ((300, 4), (200, 6), (300, 8)):
        lengths = planted_lengths(rng, bins, parts)
        plain = packing.best_fit(lengths, np.full(len(lengths), -1), np.arange(len(lengths)), 1024)
        best = packing.evolve(lengths, [], 1024, 5)
        assert np.bincount(best, lengths).max() <= 1024 and sorted(np.unique(best)) == list(range(best.max() + 1)) and len(best) == len(lengths)
        assert bins <= best.max() + 1 < plain.max() + 1
        child = packing.crossover(lengths, plain, best, 1024, rng)
        assert (child >= 0).all() and np.bincount(child, lengths).max() <= 1024


def triplets(rng, bins):
    """Pieces of which only exact triples fill bins: best fit wastes a sixth."""
    a = rng.integers(390, 500, bins)
    b = rng.integers(256, (1024 - a) // 2 + 1)
    return np.sort(np.concatenate([a, b, 1024 - a - b]))[::-1].copy()


def test_crossover_decides_the_packing(monkeypatch):
    bins = lambda: [int(packing.evolve(lengths, [], 1024, 5).max()) + 1 for lengths in blocks]
    rng = np.random.default_rng(3)
    planted = ((300, 4), (200, 6), (300, 8), (200, 5), (200, 3))
    blocks = [triplets(np.random.default_rng(seed), 600) for seed in (1, 2)] + [planted_lengths(rng, n, parts) for n, parts in planted]
    with_it = bins()
    monkeypatch.setattr(packing, "crossover", lambda lengths, first, second, capacity, rng: first)
    without = bins()
    assert all(a < b for a, b in zip(with_it[:2], without[:2], strict=True)) and max(with_it[:2]) <= 610
    assert sum(with_it[2:]) < sum(without[2:]) and all(a <= n + 1 for a, (n, _) in zip(with_it[2:], planted, strict=True))


def test_children_keep_the_full_bins_of_both_parents():
    lengths = np.array([600, 424, 700, 324, 500, 524, 10, 20])
    first, second = np.array([0, 0, 1, 2, 2, 3, 1, 2]), np.array([0, 1, 2, 2, 3, 3, 0, 1])
    child = packing.crossover(lengths, first, second, 1024, np.random.default_rng(1))
    assert child[0] == child[1] and child[2] == child[3] and child[4] == child[5] and np.bincount(child, lengths).max() <= 1024


def test_migrants_and_patience():
    rng = np.random.default_rng(4)
    lengths = planted_lengths(rng, 60, 3)
    first = packing.evolve(lengths, [], 1024, 1, packing.Search(generations=0))
    after = packing.evolve(lengths, [first], 1024, 2)
    assert packing.fitness(lengths, after, 1024) >= packing.fitness(lengths, first, 1024)
    whole = packing.evolve(np.array([600] * 50), [], 1024, 1)
    assert whole.max() + 1 == 50 and packing.evolve(np.array([1]), [], 1024, 1).tolist() == [0]


def test_refilled_bins_hold_what_fits_best():
    lengths = np.array([700, 500, 324, 300, 24, 20])
    out = packing.refilled(lengths, np.full(6, -1), np.arange(6), 1024)
    assert out[0] == out[2] and np.bincount(out, lengths).tolist() == [1024, 844]


def test_equal_rows_are_dealt_to_all_blocks(spark):
    rows = packing.pack(docs(spark, [(1, "a few words")] * 300), block=50).collect()
    assert len(rows) == 300 and len({r["sequence_id"] >> 32 for r in rows}) > 3


def test_token_files(spark, awkward, empty):
    path = scratch_path(spark, "tokens")
    token_store.write(awkward, path)
    rows = token_store.digest(spark, path).orderBy("start").collect()
    assert len(rows) == len(AWKWARD) and rows[0]["doc_id"] is None
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    assert [len(r["ids"]) for r in token_store.lookup(spark, path, [2, 4]).orderBy("doc_id").collect()][0] == 1
    plan = token_store.lookup(spark, path, [4])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters")[1]
    void = scratch_path(spark, "tokens")
    token_store.write(empty, void)
    assert token_store.digest(spark, void).count() == 0


def test_rows_of_one_id_are_dealt_to_several_files(spark):
    path = scratch_path(spark, "tokens")
    token_store.write(docs(spark, [(7, f"text {k}") for k in range(400)] + [(None, "x")] * 400 + [(9, "last")]), path, partitions=8)
    rows = token_store.digest(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 400 + [7] * 400 + [9]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    sizes = token_store.read(spark, path).groupBy(F.input_file_name()).count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < 300


def test_words_of_texts():
    texts = ["", "Ab c", "x", None, " é,Z9 ", LONG[:100]]
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    words = Words(data, offsets, char_class("alnum"))
    assert np.diff(words.offsets).tolist()[:5] == [0, 2, 1, 0, 2]
    raw = data.tobytes()
    assert raw[words.start[0] : words.end[0]] == b"Ab" and Words(*text_buffers(pa.array(["aB"])), char_class("alnum")).hash[0] == words.hash[0]


# --- collocations


def _phrases(texts, depth=3):
    found = Counter()
    for text in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for d in range(1, depth + 1):
                found.update(" ".join(words[i : i + d]) for i in range(len(words) - d + 1))
    return found


def test_automaton_has_the_phrases_and_links_of_its_pieces():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "C ", "a\t ", "é ", ". ", "rare%d " % rng.randint(0, 99), "", "\n", "ab "]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    pieces = collocations.Pieces(*text_buffers(pa.array([*texts, None, ""])))
    states = collocations.Automaton(pieces.ids, pieces.before)
    end, words, count = states.phrases()
    text, length = pieces.phrases(end, words)
    assert Counter(dict(zip(bytes(text).decode().split("\n")[:-1], count.tolist(), strict=True))) == _phrases(texts)
    linked = states.link >= 0
    assert len(states.end) < len(end) and (states.shortest[~linked] == 1).all()
    assert (states.count[states.link[linked]] > states.count[linked]).all() and (states.longest[states.link[linked]] + 1 == states.shortest[linked]).all()
    # a state's phrases end where its link's do
    for k in np.flatnonzero(linked)[:200]:
        up = states.link[k]
        at, n = states.end[k], states.longest[up]
        assert (pieces.ids[at - n + 1 : at + 1] == pieces.ids[states.end[up] - n + 1 : states.end[up] + 1]).all()


def test_collocations_do_not_depend_on_shards(spark):
    texts = [(k, "new york city is in new york. new york city hall, " * (1 + k % 3)) for k in range(12)]
    frame = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    small = collocations.counts(frame, shard_bytes=100, least=3)
    whole = collocations.counts(frame, least=3)
    rows = lambda f: Counter((r["lang"], r["words"], r["phrase"], r["f"]) for r in f.where("words > 0").collect())
    assert rows(small) == rows(whole) and whole.where("lang = 'und'").count() > 0
    want = _phrases([t for k, t in texts if k % 2 == 0])
    got = {r["phrase"]: r["f"] for r in whole.where("lang = 'en' and words > 0").collect()}
    assert got == {p: n for p, n in want.items() if n >= 3}


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10, 10, 10), (3 * 10**12, 4 * 10**12 + 7, 5 * 10**12 + 11), (9 * 10**14 + 1, 9 * 10**14 + 2, 9 * 10**14 + 3), (10, 10**9, 10**9)]
    frame = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r[0] for r in frame.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in cases]


def test_collocations_drop_what_longer_ones_hold(spark):
    frame = docs(spark, [(k, "aa bb cc. " + ("aa bb. " if k < 3 else "") + "dd ee. " * (k % 2) + "dd ee ff. " * (k % 4 == 0)) for k in range(40)]).withColumn("lang", F.lit("xx"))
    rows = {r["phrase"]: r for r in collocations.mine(frame).collect()}
    assert {p: r["a"] for p, r in rows.items()} == {"aa bb cc": 40, "dd ee ff": 10, "dd ee": 30}
    assert rows["dd ee"]["score"] == 1_000_000 and rows["aa bb cc"]["l"] == 43 and rows["aa bb cc"]["r"] == 40
    assert sorted(r["rank"] for r in rows.values()) == [1, 2, 3]


def test_collocations_awkward(awkward, empty):
    assert collocations.mine(awkward, least=2).count() > 0
    assert collocations.mine(empty).count() == 0


# --- spelling variants


def _edit(x, y):
    x, y = sorted((x, y), key=len)
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


@pytest.mark.parametrize("largest", [4096, 3])
def test_near_words_against_all_pairs(spark, largest):
    rng = random.Random(largest)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(250)} | {"x" * 300, "x" * 301, "x" * 299 + "y"})
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = [tuple(sorted(r)) for r in spelling.near_words(frame, largest=largest).collect()]
    want = {tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if _edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_are_followed_to_the_root(spark):
    counts = {"mississippi": 3000, "mississipp": 200, "missisipp": 15, "alphabet": 5, "alphabets": 50, "alphabeta": 50, "lonesome": 2}
    frame = docs(spark, [(k, (w + " ") * n) for k, (w, n) in enumerate(counts.items(), 1)])
    rows = {r["word"]: r for r in spelling.group(frame).collect()}
    want = spelling_variants([(k, (w + " ") * n) for k, (w, n) in enumerate(counts.items(), 1)])
    assert {w: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for w, r in rows.items()} == want
    assert rows["missisipp"]["form"] == "mississipp" and rows["missisipp"]["root"] == "mississippi"
    assert rows["alphabet"]["form"] == "alphabeta" and rows["lonesome"]["root"] == "lonesome" and rows["lonesome"]["n_near"] == 0


def test_spelling_awkward(awkward, empty):
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.group(awkward).collect()}
    assert got == spelling_variants(AWKWARD)
    assert spelling.group(empty).count() == 0


# --- toxicity


def test_subwords_of_words():
    rows, first = toxicity.subwords(["ab", "abc", "ab", "é"])
    parts = [rows[a:b].tolist() for a, b in zip(first, [*first[1:], len(rows)], strict=True)]
    assert parts[0] == parts[2] and [len(p) for p in parts] == [3, 6, 3, 1]
    assert set(parts[0]) & set(parts[1])


def test_windows_cover_all_words():
    counts = np.array([0, 1, 15, 16, 17, 24, 25, 100])
    begin, end, text = toxicity._windows(counts)
    base = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        own = text == k
        assert set(x for a, b in zip(begin[own], end[own], strict=True) for x in range(a, b)) == set(range(base[k], base[k] + n))
        assert ((end - begin)[own] <= toxicity.WINDOW).all()


def test_toxicity_finds_unseen_misspellings_in_long_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "bel", "um", "sha"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    foul = ["dreckwurm", "dreckwurmer", "grobzak", "grobzaks"]
    texts, labels = [], []
    for k in range(1000):
        words = prose(rng.randint(20, 120))
        if k % 4 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(foul))
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    scorer = toxicity.fit(texts, np.array(labels), 0.25).scorer()
    fresh = [" ".join(prose(300)) for _ in range(40)]
    bad = [t + " drekwurm " + t for t in fresh[:10]] + [t + " GROBZAKK, " + t for t in fresh[10:20]]
    score = lambda some: scorer.score(*text_buffers(pa.array(some)))
    assert (score(bad) >= toxicity.THRESHOLD).mean() >= 0.9 and (score(fresh) >= toxicity.THRESHOLD).mean() <= 0.1


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (7, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.score(awkward, toxicity.learn(awkward, known)).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0
