"""Reflections on sessions: flattening, binding to sessions, judged segments, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ORDER

SCHEMA = "id string, session string, thread string, at string, revision string, mode string, trigger string, marker string, prompt struct<name:string,version:string,hash:string>, schema string, asked string, reflector struct<harness:string,model:string>, items array<struct<path:string,ref:string,scale:string,rating:string>>"


def coarse_target(ref: Column) -> Column:
    """What a reference is about: skill files count for their skill, line ranges for their file."""
    base = F.split_part(ref, F.lit("#"), F.lit(1))
    return F.when(base.rlike("^skill(_file)?:"), F.concat(F.lit("skill:"), F.regexp_extract(base, "^skill(?:_file)?:([^/]+)", 1))).otherwise(base)


def flatten(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reflections, ratings) of records of ``SCHEMA``; a record that comes twice counts once."""
    one = records.dropDuplicates(["id"])
    reflections = one.select("id", F.col("session").alias("session_ref"), F.col("thread").alias("thread_id"), "at", F.col("prompt.name").alias("prompt_name"), F.col("prompt.version").alias("prompt_version"), F.col("prompt.hash").alias("prompt_hash"), F.col("schema").alias("schema_hash"), "asked", "revision", "mode", "trigger", F.col("reflector.harness").alias("reflector_harness"), F.col("reflector.model").alias("model"), "marker")
    items = one.select(F.col("id").alias("reflection_id"), F.inline("items"))
    return reflections, items.select("reflection_id", F.col("path").alias("item"), "ref", coarse_target(F.col("ref")).alias("target"), "scale", "rating")


def conflicting(records: DataFrame) -> DataFrame:
    """Ids that stand for different records."""
    return records.groupBy("id").agg(F.countDistinct(F.to_json(F.struct("*"))).alias("n")).where("n > 1").select("id")


def bind(reflections: DataFrame, sessions: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """``session_id`` of each reflection: by id, else by native id, else the session in which its marker occurs most.

    Markers are taken out of the events' text and joined by equality; no text is searched for every marker."""
    by_id = sessions.select(F.col("id").alias("session_ref"), F.col("id").alias("a"))
    native = sessions.where("native_id IS NOT NULL").groupBy(F.col("native_id").alias("session_ref")).agg(F.min("id").alias("b"))
    out = reflections.join(by_id, "session_ref", "left").join(native, "session_ref", "left").withColumn("session_id", F.coalesce("a", "b")).drop("a", "b")
    if events is None:
        return out
    marks = events.where("kind IN ('tool_call', 'tool_result')").select("session_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z]+_[0-9A-Za-z]{8,})"), F.lit(1)))).alias("marker"))
    most = marks.join(reflections.select("marker").where("marker IS NOT NULL").distinct(), "marker").groupBy("marker", "session_id").agg(F.count("*").alias("n")).groupBy("marker").agg(F.max_by("session_id", F.struct("n", "session_id")).alias("found"))
    return out.join(most, "marker", "left").withColumn("session_id", F.coalesce("session_id", "found")).drop("found")


def turns(bound: DataFrame, events: DataFrame) -> DataFrame:
    """``event_id, tag, ref``: the events between a reflection's first and last marker, with the calls and results that
    belong to them."""
    w = Window.partitionBy("session_id", "run_id").orderBy(*ORDER)
    rows = events.withColumn("i", F.row_number().over(w))
    marked = rows.join(bound.where("marker IS NOT NULL").select("session_id", "marker", F.col("id").alias("ref")), "session_id").where(F.contains("text", F.col("marker")) & F.col("kind").isin("tool_call", "tool_result"))
    calls = rows.where("call_id IS NOT NULL").groupBy("session_id", "run_id", "call_id").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    spans = marked.join(calls, ["session_id", "run_id", "call_id"], "left").groupBy("session_id", "run_id", "ref").agg(F.min(F.least("i", F.coalesce("first", "i"))).alias("a"), F.max(F.greatest("i", F.coalesce("last", "i"))).alias("b"))
    inside = spans.select("session_id", "run_id", "ref", F.explode(F.sequence("a", "b")).alias("i"))
    return rows.join(inside, ["session_id", "run_id", "i"]).select(F.col("id").alias("event_id"), F.concat(F.lit("reflection:"), "ref").alias("tag"), "ref")


def coverage(bound: DataFrame, events: DataFrame, tags: DataFrame) -> DataFrame:
    """How far reflections on each question and revision reach into a session: ``covered_to``, the ``tail`` of events
    after it, and full or partial.  A reflection judges what comes before its own turns; without turns, everything.

    If every reflection of a group names the same thread, only that thread's events count."""
    own = events.join(tags.select(F.col("event_id").alias("id")).distinct(), "id", "left_anti")
    threads = bound.groupBy("session_id", "asked", "revision").agg(F.when((F.countDistinct("thread_id") == 1) & (F.count_if(F.coalesce("thread_id", F.lit("")) == "") == 0), F.max("thread_id")).alias("only"))
    domain = own.join(threads, "session_id").where("only IS NULL OR only = run_id").withColumn("i", F.row_number().over(Window.partitionBy("session_id", "asked", "revision").orderBy("path", *ORDER)))
    first = tags.join(events.select(F.col("id").alias("event_id"), "session_id", "path", "byte_offset"), "event_id").groupBy(F.col("ref").alias("id"), "session_id").agg(F.min(F.struct("path", "byte_offset")).alias("start"))
    stops = bound.select("id", "session_id", "asked", "revision").join(first, ["id", "session_id"], "left")
    reach = domain.join(stops.select("session_id", "asked", "revision", "start"), ["session_id", "asked", "revision"]).where(F.col("start").isNull() | (F.struct("path", "byte_offset") < F.col("start")))
    far = reach.groupBy("session_id", "asked", "revision").agg(F.max("i").alias("covered_to"))
    size = domain.groupBy("session_id", "asked", "revision").agg(F.max("i").alias("size"))
    out = size.join(far, ["session_id", "asked", "revision"], "left").withColumn("covered_to", F.coalesce("covered_to", F.lit(0)).cast("bigint"))
    return out.select("session_id", "asked", "revision", "covered_to", (F.col("size") - F.col("covered_to")).cast("bigint").alias("tail")).withColumn("state", F.when(F.col("tail") == 0, "full").otherwise("partial"))


def remembered(bound: DataFrame) -> DataFrame:
    """The newest reflection of each session, question and revision."""
    w = Window.partitionBy("session_id", "asked", "revision").orderBy(F.desc("at"), "id")
    return bound.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def partition(sessions: DataFrame, covered: DataFrame, asked: str, revision: str | None = None) -> DataFrame:
    """``id, state``: full, partial or unreflected on a question."""
    c = covered.where(F.col("asked") == asked)
    c = c if revision is None else c.where((F.col("revision") == revision) | F.startswith("revision", F.lit(f"{revision}@")))
    best = c.groupBy(F.col("session_id").alias("id")).agg(F.min("state").alias("state"))
    return sessions.select("id").join(best, "id", "left").withColumn("state", F.coalesce("state", F.lit("unreflected")))
