"""Events as transcripts again: canonical JSON Lines, or the records of one of five harnesses.

Events become blocks by columns and windows over their session; each format is one expression from a block to a JSON
record, so that sessions of any length are exported without being held in memory (one harness keeps a session in one
document, which is gathered).  What a format can't say is an error when strict, else it is kept as labelled text and
noted on its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ORDER

#: Formats, roles that their messages may have, and formats that hold a reader's thinking as such.
FORMATS = ("canonical", "claude", "codex", "pi", "opencode", "antigravity")
ROLES = {"claude": ("user", "assistant"), "codex": ("user", "assistant", "developer", "system"), "pi": ("user", "assistant", "system"), "opencode": ("user", "assistant", "system"), "antigravity": ("user", "assistant", "system")}
THINKERS = ("pi", "opencode", "antigravity")


class UnsupportedConversion(ValueError):
    """A format can't say what an event holds."""


def blocks(events: DataFrame, target: str) -> DataFrame:
    """``session_id, n, id, role, kind, text, call_id, name, input, failed, cwd, at, note``: one block for each event but
    metadata, numbered within its session.  A second call of one id, a result without an earlier call, a role or kind that
    the format doesn't have become labelled text with a note."""
    w = Window.partitionBy("session_id").orderBy("path", *ORDER)
    rows = events.where("kind <> 'metadata'").withColumn("n", F.row_number().over(w))
    of_call = Window.partitionBy("session_id", "call_id")
    call = F.when(F.col("kind") == "tool_call", F.col("n"))
    rows = rows.withColumn("first_call", F.when(F.coalesce("call_id", F.lit("")) != "", F.min(call).over(of_call)))
    text, kind, role = F.coalesce("text", F.lit("")), F.col("kind"), F.coalesce("role", F.lit(""))
    named = (F.coalesce("call_id", F.lit("")) != "") & (F.coalesce("tool_name", F.lit("")) != "")
    why = (F.when((kind == "tool_call") & ~named, "a call without id or name").when((kind == "tool_call") & (F.col("n") > F.col("first_call")), "a call id that is used again")
           .when((kind == "tool_result") & ~F.coalesce(F.col("first_call") < F.col("n"), F.lit(False)), "a result without its call")
           .when((kind == "thinking") & F.lit(target not in THINKERS), "thinking").when((kind == "message") & ~role.isin(*ROLES[target]), F.concat(role, F.lit(" message")))
           .when(~kind.isin("message", "thinking", "tool_call", "tool_result", "compaction"), F.concat(kind, F.lit(" record"))))
    told = F.when(why.isNotNull(), F.concat(F.lit("["), why, F.lit("]\n"), text)).otherwise(text)
    shown = F.when(why.isNotNull(), "text").when(kind == "message", "text").otherwise(kind)
    speaker = F.when(kind == "tool_result", F.when(why.isNotNull(), "user").otherwise("tool")).when(kind == "message", F.when(role.isin(*ROLES[target]), role).otherwise("user")).when(kind == "compaction", "system").otherwise("assistant")
    return rows.select("session_id", "n", "id", speaker.alias("role"), shown.alias("kind"), told.alias("text"), "call_id", F.col("tool_name").alias("name"), F.col("arguments").alias("input"), F.col("status").isin("failure", "error").alias("failed"), "cwd", F.col("ts_text").alias("at"), why.alias("note"))


def _json(**fields) -> Column:
    """A JSON object of columns; nulls are left out."""
    return F.to_json(F.struct(*(x.alias(n) for n, x in fields.items())))


def _uuid(c: Column) -> Column:
    h = F.sha2(c, 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _given() -> Column:
    """A call's arguments as an object."""
    held = F.try_parse_json("input")
    return F.when(F.startswith(F.schema_of_variant(held), F.lit("OBJECT")), held).otherwise(F.parse_json(_json(value=F.coalesce("input", F.lit("")))))


def _records(target: str) -> tuple[Column, Column | None]:
    """(a block's record, the record that opens a session) in a format."""
    kind, text, role, when = F.col("kind"), F.col("text"), F.col("role"), F.col("at")
    is_ = lambda k, v: F.when(kind == k, v)
    own, before = _uuid(F.col("id")), F.when(F.col("n") > 1, _uuid(F.col("previous")))
    if target == "claude":
        side = F.when(role == "assistant", "assistant").otherwise("user")
        item = F.struct(F.when(kind == "tool_call", "tool_use").when(kind == "tool_result", "tool_result").otherwise("text").alias("type"), F.when(~kind.isin("tool_call", "tool_result"), text).alias("text"), is_("tool_call", F.col("call_id")).alias("id"), is_("tool_call", F.col("name")).alias("name"), is_("tool_call", _given()).alias("input"), is_("tool_result", F.col("call_id")).alias("tool_use_id"), is_("tool_result", text).alias("content"), is_("tool_result", F.coalesce("failed", F.lit(False))).alias("is_error"))
        return _json(type=side, uuid=own, parentUuid=before, sessionId=F.col("session_id"), cwd=F.col("cwd"), timestamp=when, isCompactSummary=is_("compaction", F.lit(True)), message=F.struct(side.alias("role"), F.array(item).alias("content"))), None
    if target == "codex":
        content = F.array(F.struct(F.when(role == "assistant", "output_text").otherwise("input_text").alias("type"), text.alias("text")))
        payload = F.struct(F.when(kind == "tool_call", "function_call").when(kind == "tool_result", "function_call_output").when(kind == "text", "message").alias("type"), F.when(kind == "text", role).alias("role"), F.when(kind == "text", content).alias("content"), is_("tool_call", F.col("name")).alias("name"), F.when(kind.isin("tool_call", "tool_result"), F.col("call_id")).alias("call_id"), is_("tool_call", F.coalesce("input", F.lit("{}"))).alias("arguments"), is_("tool_result", F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text")), F.struct(F.lit("input_text").alias("type"), _json(exit_code=F.when(F.col("failed"), 1).otherwise(0)).alias("text")))).alias("output"), is_("compaction", text).alias("message"))
        return _json(timestamp=when, type=F.when(kind == "compaction", "compacted").otherwise("response_item"), payload=payload), _json(timestamp=when, type=F.lit("session_meta"), payload=F.struct(F.col("session_id").alias("id"), F.col("cwd").alias("cwd")))
    if target == "pi":
        item = F.struct(F.when(kind == "tool_call", "toolCall").when(kind == "thinking", "thinking").otherwise("text").alias("type"), F.when(~kind.isin("tool_call", "thinking"), text).alias("text"), is_("thinking", text).alias("thinking"), is_("tool_call", F.col("call_id")).alias("id"), is_("tool_call", F.col("name")).alias("name"), is_("tool_call", _given()).alias("arguments"))
        message = F.struct(F.when(kind == "tool_result", "toolResult").otherwise(role).alias("role"), F.array(item).alias("content"), is_("tool_result", F.col("call_id")).alias("toolCallId"), is_("tool_result", F.col("name")).alias("toolName"), is_("tool_result", F.coalesce("failed", F.lit(False))).alias("isError"))
        compact = kind == "compaction"
        return _json(type=F.when(compact, "compaction").otherwise("message"), id=own, parentId=before, timestamp=when, summary=F.when(compact, text), message=F.when(~compact, message)), _json(type=F.lit("session"), version=F.lit(3), id=F.col("session_id"), timestamp=when, cwd=F.col("cwd"))
    # antigravity: a step each; answers follow their calls in order
    call = F.when(kind == "tool_call", F.array(F.struct(F.col("name").alias("name"), _given().alias("args"), F.col("call_id").alias("id"))))
    step = F.when(kind == "tool_result", "RUN_COMMAND").when(kind == "compaction", "CHECKPOINT").when(role == "user", "USER_INPUT").when(role == "system", "SYSTEM_MESSAGE").otherwise("PLANNER_RESPONSE")
    return _json(step_index=F.col("n"), type=step, status=F.when(F.col("failed"), "ERROR").otherwise("DONE"), created_at=when, conversation_id=F.col("session_id"), cwd=F.col("cwd"), content=F.when(~kind.isin("tool_call", "thinking"), text), thinking=is_("thinking", text), tool_calls=call), None


def _opencode(rows: DataFrame) -> DataFrame:
    """One document for each session."""
    kind = F.col("kind")
    answer = F.first(F.when(kind == "tool_result", F.struct("text", "failed")), ignorenulls=True).over(Window.partitionBy("session_id", "call_id"))
    state = F.struct(F.when(F.col("answer").isNull(), "running").when(F.col("answer.failed"), "error").otherwise("completed").alias("status"), _given().alias("input"), F.when(~F.coalesce("answer.failed", F.lit(False)), F.col("answer.text")).alias("output"), F.when(F.col("answer.failed"), F.col("answer.text")).alias("error"))
    part = F.struct(F.when(kind == "tool_call", "tool").when(kind == "thinking", "reasoning").otherwise("text").alias("type"), F.when(kind != "tool_call", F.col("text")).alias("text"), F.when(kind == "tool_call", F.col("name")).alias("tool"), F.when(kind == "tool_call", F.col("call_id")).alias("callID"), F.when(kind == "tool_call", state).alias("state"))
    shown = rows.withColumn("answer", answer).where("kind <> 'tool_result'")
    message = _json(info=F.struct(F.when(F.col("role") == "user", "user").when(F.col("role") == "system", "system").otherwise("assistant").alias("role")), parts=F.array(part))
    held = shown.groupBy("session_id").agg(F.min("cwd").alias("cwd"), F.array_sort(F.collect_list(F.struct("n", message.alias("m")))).alias("all"))
    info = _json(id=F.col("session_id"), directory=F.col("cwd"))
    return held.select("session_id", F.lit(1).alias("n"), F.concat(F.lit('{"info": '), info, F.lit(', "messages": ['), F.array_join(F.transform("all", lambda x: x["m"]), ", "), F.lit("]}")).alias("value"), F.lit(None).cast("string").alias("note"))


def export(events: DataFrame, target: str = "canonical", *, strict: bool = True) -> DataFrame:
    """``session_id, n, value, note``: the lines of each session's transcript, in order of ``n``."""
    if target not in FORMATS:
        raise UnsupportedConversion(f"unsupported format: {target}")
    w = Window.partitionBy("session_id").orderBy("path", *ORDER)
    if target == "canonical":
        return events.select("session_id", F.row_number().over(w).alias("n"), F.to_json(F.struct(*events.columns)).alias("value"), F.lit(None).cast("string").alias("note"))
    rows = blocks(events, target)
    if strict and (bad := rows.where("note IS NOT NULL").select("id", "note").first()) is not None:
        raise UnsupportedConversion(f"{target} has no {bad.note}: {bad.id}")
    if target == "opencode":
        return _opencode(rows)
    rows = rows.withColumn("previous", F.lag("id").over(Window.partitionBy("session_id").orderBy("n")))
    record, opening = _records(target)
    out = rows.select("session_id", "n", record.alias("value"), "note")
    return out if opening is None else out.unionByName(rows.where("n = 1").select("session_id", F.lit(0).alias("n"), opening.alias("value"), F.lit(None).cast("string").alias("note")))


def write(lines: DataFrame, folder: str) -> None:
    """A folder of JSON Lines for each session, one file with its lines in order.

    Dealt by a hash of the session: by the session itself, Spark leaves the exchange out where both sides of a union are
    dealt by it already, and adaptive execution then merges the partitions of the sides differently."""
    one = lines.repartition(F.xxhash64("session_id")).sortWithinPartitions("session_id", "n")
    one.select("session_id", "value").write.partitionBy("session_id").text(folder)
