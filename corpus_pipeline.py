"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from loomtrace.llm import decontaminate, jaccard, langid, mixing, pii
from loomtrace.llm.common import checkpoint_dir, cut, free_name, maybe_broadcast

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without letters or without a likely language go."""
    net = langid.train(docs.where(langid.fold("doc_id") != 2))
    found, name = langid.identify(docs, net)
    return found.where((F.col(name)["lang_pred"] != langid.UNKNOWN) & (F.col(name)["score"] >= LEAST_SCORE)).drop(name)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest doc_id (null ids last, then by a hash of the row).  Rows are
    told apart by that hash, so that a doc_id may be null or repeat; of rows that are equal in everything one stays."""
    row = free_name(docs, "row")
    marked = docs.withColumn(row, F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType)))))
    groups = jaccard.near_duplicates(marked, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    ids = marked.groupBy(row).agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    known = cut(ids.join(groups.distinct(), row))
    first = known.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", row)).alias("first"))
    # who stays is known by row, so that no task gathers a large group
    gone = cut(known.select(row).join(first.select(F.col(f"first.{row}").alias(row)), row, "left_anti"))
    kept = marked.join(maybe_broadcast(gone, 16), row, "left_anti")
    twice = maybe_broadcast(cut(known.where("rows > 1").select(row)), 16)
    once = kept.join(twice, row, "left_anti").unionByName(kept.join(twice, row, "left_semi").dropDuplicates([row]))
    return once.select(docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the personal data in its text replaced by its kind and n_chars following the text."""
    found, name = pii.detect(docs)
    text = F.coalesce(F.col(name)["redacted"], F.col("text"))
    changed = F.col(name)["redacted"].isNotNull()
    return found.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document, numbered by ``copy``."""
    mixed, name = mixing.plan(docs)
    return mixed.where(F.col(name)["copies"] > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(name)["copies"])).alias("copy"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("personal_data", redact_personal_data),
    ("source_mixing", mix_sources),
]

#: Trained and iterative stages have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/loomtrace-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
