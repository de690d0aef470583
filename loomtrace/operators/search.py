"""Ranked full-text search over a postings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens

#: BM25's usual constants.
K1, B = 1.2, 0.75


def postings(df: DataFrame, *, key: str = "id", text: str = "text") -> DataFrame:
    """word, key, tf: how often each word occurs in each text."""
    return df.select(F.col(key).alias("key"), F.explode(word_tokens(F.col(text))).alias("word")).groupBy("word", "key").agg(F.count("*").alias("tf"))


def bm25(df: DataFrame, words: list[str], *, key: str = "id", text: str = "text") -> DataFrame:
    """``key`` and BM25 ``score`` (higher is better) of the texts that hold any of the words; no word below 1e-6."""
    wanted = sorted(set(words))
    tokens = df.where(F.col(text).isNotNull()).select(F.col(key), word_tokens(F.col(text)).alias("w"))
    facts = tokens.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"), *(F.count(F.when(F.array_contains("w", w), 1)).alias(f"df{i}") for i, w in enumerate(wanted)))
    rows = tokens.where(F.arrays_overlap("w", F.array(*map(F.lit, wanted)))).crossJoin(F.broadcast(facts))  # one row of totals
    score = F.lit(0.0)
    for i, w in enumerate(wanted):
        tf = F.size("w") - F.size(F.array_remove("w", w))
        idf = F.greatest(F.ln((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        score = score + words.count(w) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("w") / F.col("mean")))
    return rows.select(key, score.alias("score"))
