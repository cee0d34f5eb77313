"""The contract queries: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import collocations, decontaminate, exact_dedup, language_id, ngram_join, packing, pii, quality, secrets, spelling, token_store, toxicity, url_filter
from fairlead.llm.common import in_fold, materialize, remove, scratch_path, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~in_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list events for the hosts of ``pages``, by a fixed rule on each name's MD5.

    Hosts with ``spam`` are blocked from day 0.  A third of all hosts are blocked on
    a day of their own for 90 days, and again 90 days later.  One parent domain is
    allowed for part of the year and one is blocked late in it; their names are written in several forms.
    """
    hosts = pages.select(url_filter.host(F.col("url")).alias("name")).where("name is not null").distinct()
    number = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 4), 16, 10).cast("int")
    add = lambda day, event: F.struct(day.cast("int").alias("day"), F.lit(event).alias("event"))
    dated = hosts.withColumn("n", number).where("n % 3 = 0").withColumn("e", F.explode(F.array(add(F.col("n") % 150, "add"), add(F.col("n") % 150 + 90, "remove"), add(F.col("n") % 150 + 180, "add"))))
    rows = dated.select("name", F.lit("hosts").alias("list"), F.lit("block").alias("action"), "e.day", "e.event")
    spam = hosts.where(F.contains("name", F.lit("spam"))).select("name", F.lit("spam").alias("list"), F.lit("block").alias("action"), F.lit(0).alias("day"), F.lit("add").alias("event"))
    fixed = [("Example.ORG", "domains", "allow", 100, "add"), ("www.example.org", "domains", "allow", 250, "remove"), ("example.net.", "domains", "block", 300, "add")]
    parents = pages.sparkSession.createDataFrame(fixed, "name string, list string, action string, day int, event string")
    return rows.union(spam).union(parents)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", (F.col("page_id") * 37 % 365).cast("int"))
    return url_filter.judge(captures, list_events(pages))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.learn(docs))
    return found.select("doc_id", (~in_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    token_store.write(table(spark, sf_dir, "documents"), path)
    found = materialize(token_store.digest(spark, path), "token-digest")
    remove(spark, path)
    return found


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~in_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pii": op2_pii,
    "op3_secrets": op3_secrets,
    "op4_decontaminate": op4_decontaminate,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_ids": op10_token_ids,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_toxicity": op13_toxicity,
}
