"""Decision traces: events in which each call and its result are one action; and a stream's first and last words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import STREAM
from .sequence import positions

#: Roles whose records aren't part of what happened.
HIDDEN = ("system", "developer")


def excerpt(text, chars: int = 160):
    """A text on one line, cut to ``chars`` characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars - 1), F.lit("…"))).otherwise(flat)


def decision_trace(events: DataFrame, *, chars: int = 160) -> tuple[DataFrame, DataFrame]:
    """(episodes, edges).  Episodes: stream columns, ``id, kind, summary, event_ids, status, i``; a call has its result's
    status and both ids, the last of several results counting; a result without a call is an observation.  Edges:
    ``source, target, relation``: ``then`` along a stream, ``parent`` along native ids."""
    rows = positions(events).where(~F.coalesce(F.col("role").isin(*HIDDEN), F.lit(False)))
    run = ["source_id", "session_id", "run_id", "call_id"]
    named = rows.where("coalesce(call_id, '') <> ''")
    pairs = named.groupBy(*run).agg(F.max_by("id", F.when(F.col("kind") == "tool_call", F.struct("path", "i"))).alias("call"), F.max_by(F.struct("id", "status", "text"), F.when(F.col("kind") == "tool_result", F.struct("path", "i"))).alias("result")).where("call IS NOT NULL AND result.id IS NOT NULL")
    calls = pairs.select(F.col("call").alias("id"), "result")
    fused = pairs.select(F.col("result.id").alias("id"))
    left = rows.join(fused, "id", "left_anti").join(calls, "id", "left")
    kind = (F.when((F.col("kind") == "message") & (F.col("role") == "user"), "request").when((F.col("kind") == "message") & (F.col("role") == "assistant"), "response").when(F.col("kind") == "thinking", "recorded_note")
            .when(F.col("kind") == "tool_call", "action").when(F.col("kind") == "tool_result", "observation").otherwise("event"))
    done = F.col("result").isNotNull()
    summary = F.concat(excerpt(F.concat_ws(" ", "tool_name", "text"), chars), F.when(done, F.concat(F.lit(" → "), excerpt(F.col("result.text"), chars))).otherwise(""))
    status = F.when(F.col("kind") == "tool_call", F.col("result.status")).otherwise(F.col("status"))
    out = left.select(*STREAM, F.col("id"), kind.alias("kind"), summary.alias("summary"), F.when(done, F.array("id", "result.id")).otherwise(F.array("id")).alias("event_ids"), status.alias("status"), "i", "native_id", "parent_native_id")
    w = Window.partitionBy(*STREAM).orderBy("i")
    then = out.select(F.col("id").alias("source"), F.lead("id").over(w).alias("target")).where("target IS NOT NULL").withColumn("relation", F.lit("then"))
    own = out.where("native_id IS NOT NULL").groupBy("run_id", "native_id").agg(F.min_by("id", "i").alias("source"))
    parent = out.where("parent_native_id IS NOT NULL").select("run_id", F.col("parent_native_id").alias("native_id"), F.col("id").alias("target")).join(own, ["run_id", "native_id"]).where("source <> target").select("source", "target", F.lit("parent").alias("relation"))
    return out.drop("native_id", "parent_native_id"), then.unionByName(parent)


def overview(events: DataFrame, *, chars: int = 160) -> DataFrame:
    """``session_id, first_prompt, first_reply, last_reply`` of the sessions that are a single stream; others have no order
    of their own, and get nulls."""
    rows = positions(events).withColumn("said", (F.col("kind") == "message") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    at = lambda role: F.when(F.col("said") & (F.col("role") == role), F.col("i"))
    text = excerpt(F.col("text"), chars)
    single = F.countDistinct(F.struct(*STREAM)) == 1
    out = rows.groupBy("session_id").agg(single.alias("single"), F.min_by(text, at("user")).alias("first_prompt"), F.min_by(text, at("assistant")).alias("first_reply"), F.max_by(text, at("assistant")).alias("last_reply"))
    return out.select("session_id", *(F.when(F.col("single"), F.col(c)).alias(c) for c in ("first_prompt", "first_reply", "last_reply")))


def expand(events: DataFrame, ids: list[str], *, most_chars: int = 6000) -> list[dict]:
    """The one to eight events of ``ids``, redacted, their texts cut alike so that all together fit."""
    from ..functions.redaction import redacted

    if not 1 <= len(ids) <= 8:
        raise ValueError("ask for one to eight events")
    rows = {r.id: r for r in events.where(F.col("id").isin(*ids)).where(~F.coalesce(F.col("role").isin(*HIDDEN), F.lit(False))).select("id", "kind", "role", "tool_name", "status", redacted(F.col("text")).alias("text")).collect()}
    missing = [x for x in ids if x not in rows]
    if missing:
        raise KeyError(f"no visible event {missing[0]}")
    share = most_chars // len(ids)
    return [{**rows[x].asDict(), "text": (rows[x].text or "")[:share], "cut": len(rows[x].text or "") > share} for x in ids]
