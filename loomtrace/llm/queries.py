"""One query for each operator over its whole table; SQL where SQL can say the same is in ``oracles``.

A row without doc_id has no fold: its ``held_out`` is null, and it is used for no fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, jaccard, langid, licenses, mixing, pii, toxicity, vectors, warc
from .common import cut


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found, leaks = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    f = F.col(leaks)
    hit = decontaminate.hit_words(f)
    return found.select("doc_id", f["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(f["items"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (F.size(f["runs"]) > 0).alias("contaminated"))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", mixing.word_count("text").alias("size")))
    mixed, name = mixing.plan(sized, sized=sized)
    return mixed.select("doc_id", F.col(name)["size"].alias("size"), F.col(name)["source_size"].alias("source_size"), F.col(name)["target"].alias("target"), F.col(name)["taken"].alias("taken"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.train(docs.where(langid.fold("doc_id") != 2))
    found, name = langid.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (langid.fold("doc_id") == 2).alias("held_out"), F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("score"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    f = F.col(name)
    return found.select("doc_id", *(f[f"n_{k}"].alias(f"n_{k}") for k in pii.BASE), f["base_sha256"].alias("base_sha256"), pii.spans_text(f["spans"]).alias("spans"))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = htmltext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.col(name)["text"]
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    models = toxicity.train(docs.where(langid.fold("doc_id") != 2), _table(spark, sf_dir, "labels").where(langid.fold("doc_id") != 2))
    found, name = toxicity.score(docs, models)
    score = F.col(name)["score"]
    return found.select("doc_id", (langid.fold("doc_id") == 2).alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col(f"{name}.license"), F.col(f"{name}.dice"), F.col(f"{name}.licenses"))


def license_scan_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with notices inside longer lines and paragraphs; the SQL has whole lines and paragraphs only."""
    found, name = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), inline=True)
    return found.select("doc_id", F.col(f"{name}.license"), F.col(f"{name}.dice"), F.col(f"{name}.licenses"))


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")


QUERIES = {
    "op1_benchmark_decontamination": decontamination,
    "op2_source_mixing": mix,
    "op3_language_id": language_id,
    "op4_personal_data": personal_data,
    "op5_embedding_near_dedup": embedding_near_dedup,
    "op6_jaccard_join": jaccard_join,
    "op7_html_extraction": html_extraction,
    "op8_toxicity": toxic,
    "op9_license_scan": license_scan,
    "op9_license_scan_inline": license_scan_inline,
    "op10_warc_archive": warc_archive,
}
