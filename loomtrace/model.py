"""The normalized session model: events, and the sessions and runs projected from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "id string, source_id string, harness string, session_id string, run_id string, parent_run_id string, path string, generation int, byte_offset bigint, subrecord int, line bigint, kind string, role string, action_kind string, tool_name string, status string, call_id string, native_id string, parent_native_id string, native_type string, cwd string, ts_text string, text string, arguments string, raw string"
REFLECTION = "id string, session_id string, thread_id string, at string, prompt_name string, prompt_version string, prompt_hash string, schema_hash string, asked string, revision string, mode string, trigger string, reflector_harness string, model string"
RATING = "reflection_id string, item string, ref string, target string, scale string, rating string"
COVERAGE = "session_id string, asked string, revision string, covered_to bigint, tail bigint, state string"
TAG = "event_id string, tag string, ref string"
#: Order is defined within a stream only.
STREAM = ("source_id", "session_id", "run_id", "path", "generation")
ORDER = ("byte_offset", "subrecord", "id")


def utc(c):
    """A UTC timestamp from ISO text; text without a zone is rejected, never localised."""
    return F.when(c.rlike(r"[Tt ]\d\d:?\d\d.*(?:[Zz]|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(c))


@dataclass
class Store:
    """The tables that queries run on.  Empty ones may be left out."""

    events: DataFrame
    sessions: DataFrame
    runs: DataFrame
    reflections: DataFrame | None = None
    ratings: DataFrame | None = None
    coverage: DataFrame | None = None
    tags: DataFrame | None = None

    @classmethod
    def of(cls, events: DataFrame, **tables) -> Store:
        """A store with sessions and runs projected from the events."""
        return cls(events, session_projection(events), run_projection(events), **tables)

    def table(self, name: str) -> DataFrame:
        found = getattr(self, name)
        ddl = {"reflections": REFLECTION, "ratings": RATING, "coverage": COVERAGE, "tags": TAG}.get(name)
        return found if found is not None else self.events.sparkSession.createDataFrame([], ddl)


def _with_time(events: DataFrame) -> DataFrame:
    return events if "ts" in events.columns else events.withColumn("ts", utc(F.col("ts_text")))


def session_projection(events: DataFrame) -> DataFrame:
    """One row per session: first and last time, counts of events and runs."""
    e = _with_time(events)
    return e.groupBy(F.col("session_id").alias("id"), "source_id", "harness").agg(
        F.max("native_id").alias("native_id") if "session_native_id" not in e.columns else F.max("session_native_id").alias("native_id"),
        F.max("cwd").alias("cwd"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("event_count"), F.countDistinct("run_id").alias("run_count"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("parent_session_id"))


def run_projection(events: DataFrame) -> DataFrame:
    """One row per run (thread) with its parent."""
    e = _with_time(events)
    return e.groupBy(F.col("run_id").alias("id"), "session_id", "source_id", "harness").agg(
        F.max(F.nullif("parent_run_id", F.lit(""))).alias("parent_run_id"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("event_count"))
