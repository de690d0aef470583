"""The driver's tables as sessions: conversations as messages, the event log as tool activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Store


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(df: DataFrame, **columns) -> DataFrame:
    from pyspark.sql.types import StructType

    from .model import EVENT

    return df.select(*((columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(EVENT)), *([columns["ts"].cast("timestamp").alias("ts")] if "ts" in columns else []))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """conversations: a session and run for each conv_id, a message for each turn."""
    c, s = read(spark, folder, "conversations"), F.col("conv_id").cast("string")
    return _events(c, id=F.concat_ws("-", s, F.col("turn")), source_id=F.lit("conversations"), harness=F.lit("chat"), session_id=s, run_id=s, path=s, generation=F.lit(0), byte_offset=F.col("turn"), subrecord=F.lit(0), kind=F.lit("message"), role=F.col("role"), text=F.col("text"), native_id=s)


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """events: a session and run for each user, a tool result for each row; an error is a failure."""
    e, s = read(spark, folder, "events"), F.col("user_id").cast("string")
    return _events(e, id=F.col("event_id"), source_id=F.lit("log"), harness=F.lit("log"), session_id=s, run_id=s, path=s, generation=F.lit(0), byte_offset=F.unix_micros(F.col("ts").cast("timestamp")), subrecord=F.lit(0), kind=F.lit("tool_result"), role=F.lit("tool"), tool_name=F.col("event_type"), action_kind=F.concat(F.lit("log."), F.col("event_type")), status=F.when(F.col("event_type") == "error", "failure").otherwise("success"), native_id=s, text=F.col("props"), arguments=F.col("props"), ts=F.col("ts"))


def chat_store(spark: SparkSession, folder: str) -> Store:
    return Store.of(messages(spark, folder))


def log_store(spark: SparkSession, folder: str) -> Store:
    return Store.of(actions(spark, folder))


def day_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of a case for each user and day: case_id, pos, name, ts, value."""
    e = read(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.concat_ws(":", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), "ts", "value")
