"""Sinks: event logs and tables of cases, failure templates, evidence as Markdown, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mining import transitions


def event_log(steps: DataFrame, path: str) -> None:
    """The usual columns of process-mining tools, as CSV."""
    steps.select(F.col("case_id").alias("case:concept:name"), F.col("label").alias("concept:name"), F.col("start").alias("time:timestamp"), F.col("outcome")).write.mode("overwrite").option("header", True).csv(path)


def tables(folder: str, **frames: DataFrame) -> None:
    """Each frame as Parquet in ``folder/name``."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def gold_template(results: DataFrame, critical: DataFrame, path: str) -> None:
    """Failed cases with what the rules say and empty columns for a reader."""
    rows = results.where("outcome <> 'completed'").join(critical.select("case_id", "idx", "category"), "case_id", "left")
    rows.select("case_id", "outcome", "idx", "category", F.lit("").alias("gold_step"), F.lit("").alias("gold_category")).write.mode("overwrite").option("header", True).csv(path)


def evaluate_gold(gold: DataFrame) -> DataFrame:
    """How often rules meet the reader's step, exactly and within one and three, and the reader's category."""
    judged = gold.where("gold_step <> ''").withColumn("d", F.abs(F.col("idx").cast("int") - F.col("gold_step").cast("int")))
    share = lambda c: F.avg(c.cast("double"))
    return judged.agg(F.count("*").alias("n"), share(F.col("d") == 0).alias("exact"), share(F.col("d") <= 1).alias("within_1"), share(F.col("d") <= 3).alias("within_3"), share(F.col("category") == F.col("gold_category")).alias("category"))


def flows(seqs: DataFrame, steps: int = 6) -> DataFrame:
    """How many cases go from state to state at each of the first steps."""
    t = transitions(seqs).where(F.col("pos") < steps)
    return t.groupBy("pos", "source", "target").agg(F.count("*").alias("cases"))


def mermaid(edges: DataFrame, most: int = 40) -> str:
    """The strongest transitions as a Mermaid graph (a report of ``most`` rows)."""
    rows = edges.orderBy(F.desc("count"), "source", "target").limit(most).collect()
    ids = {n: f"n{k}" for k, n in enumerate(sorted({x for r in rows for x in (r.source, r.target)}))}
    quote = lambda s: s.replace('"', "'").replace("\n", " ")
    return "\n".join(["graph LR", *(f'  {i}["{quote(n)}"]' for n, i in ids.items()), *(f"  {ids[r.source]} -->|{r['count']}| {ids[r.target]}" for r in rows)])


def markdown(events: DataFrame) -> DataFrame:
    """``session_id, markdown``: a session's events in order, results naming their calls."""
    title = F.concat_ws(" ", F.concat(F.lit("## "), F.coalesce("role", "kind")), "tool_name", F.when(F.col("kind") == "tool_result", F.concat(F.lit("(result of "), F.coalesce("call_id", F.lit("?")), F.lit(")"))))
    block = F.concat(title, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows = events.select("session_id", F.struct("path", "byte_offset", "subrecord", "id", block.alias("block")).alias("x"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["block"]), "\n\n").alias("markdown"))  # one session is one document
