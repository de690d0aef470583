"""Incremental ingestion: append-only tails of JSON Lines files, rewrites, availability, and refreshed projections.

The stream source keeps, per file, how far it has read, its size and time of change, and a digest of the first and last
block of what it has read.  A file whose size and time are as they were isn't opened; one that shrank or whose
blocks changed starts a new generation: a ``rewritten`` row tells downstream to drop the old one.  A batch thus costs
its files' names and what was appended, not their history.  An unfinished last line waits for the next batch.  The
folder must be one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.transcripts import lines

SCHEMA = "path string, generation int, byte_offset bigint, byte_length bigint, line bigint, value string, rewritten boolean"


class Piece(InputPartition):
    """A range of a file: complete lines from ``start`` to ``end``."""

    def __init__(self, path: str, generation: int, start: int, end: int, line: int, rewritten: bool):
        super().__init__(path)
        self.path, self.generation, self.start, self.end, self.line, self.rewritten = path, generation, start, end, line, rewritten


#: Bytes at either end of the part read that a digest covers.
BLOCK = 1 << 16


def digest(path: str, end: int) -> str:
    """Of the first and the last block of a file's first ``end`` bytes."""
    h = hashlib.sha256(str(end).encode())
    with open(path, "rb") as f:
        h.update(f.read(min(BLOCK, end)))
        f.seek(max(0, end - BLOCK))
        h.update(f.read(min(BLOCK, end)))
    return h.hexdigest()


def complete(path: str, start: int) -> tuple[int, int]:
    """(end of the last complete line, number of lines) from ``start`` on."""
    end, count = start, 0
    with open(path, "rb") as f:
        f.seek(start)
        at = start
        while block := f.read(1 << 20):
            if (k := block.rfind(b"\n")) >= 0:
                end = at + k + 1
            count += block.count(b"\n")
            at += len(block)
    return end, count


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix
        self.known: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for folder, _, names in os.walk(self.root):
            for name in sorted(names):
                if not name.endswith(self.suffix):
                    continue
                path = os.path.join(folder, name)
                now = os.stat(path)
                seen = {"size": now.st_size, "changed": now.st_mtime_ns}
                was = self.known.get(path, {"generation": 0, "end": 0, "line": 0, "digest": digest(path, 0)})
                if all(was.get(k) == v for k, v in seen.items()):
                    continue
                if now.st_size < was["end"] or digest(path, was["end"]) != was["digest"]:
                    was = {"generation": was["generation"] + 1, "end": 0, "line": 0}
                end, count = complete(path, was["end"])
                out[path] = {"generation": was["generation"], "end": end, "line": was["line"] + count, "digest": digest(path, end), **seen}
        # a file that is gone keeps its state: history isn't forgotten
        self.known = {**self.known, **out}
        return {p: json.dumps(s, sort_keys=True) for p, s in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, text in end.items():
            now, was = json.loads(text), json.loads(start[path]) if path in start else {"generation": 0, "end": 0, "line": 0}
            new = now["generation"] != was["generation"]
            begin, line = (0, 0) if new else (was["end"], was["line"])
            if now["end"] > begin or new:
                out.append(Piece(path, now["generation"], begin, now["end"], line, new))
            self.known.setdefault(path, now)
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        if partition.rewritten:
            yield partition.path, partition.generation, None, None, None, None, True
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        for offset, length, line, value in lines(data, partition.start, partition.line):
            yield partition.path, partition.generation, offset, length, line, value, False

    def commit(self, end: dict) -> None:
        pass


class JsonlTail(DataSource):
    """``spark.readStream.format("jsonl_tail").load(folder)``; option ``suffix`` (default .jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))


def tail(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    spark.dataSource.register(JsonlTail)
    return spark.readStream.format("jsonl_tail").option("suffix", suffix).load(folder)


def current(rows: DataFrame) -> DataFrame:
    """Of collected rows, those of each file's latest generation."""
    last = rows.groupBy("path").agg(F.max("generation").alias("generation"))
    return rows.where("NOT rewritten").join(last, ["path", "generation"])


def upsert(folder: str):
    """A ``foreachBatch`` sink that keeps one copy of each record: a batch that is tried again overwrites what it wrote,
    and files of an older generation go with ``current``."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return put


def availability(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known paths with whether they are still there; missing ones are marked, never forgotten."""
    return known.join(found.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").withColumn("available", F.coalesce("there", F.lit(False))).drop("there")


def rolling_failures(stream: DataFrame, *, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Failures of each session in event-time windows, for streams of events with ``ts`` and ``status``."""
    return stream.withWatermark("ts", late).groupBy("session_id", F.window("ts", size)).agg(F.count("*").alias("events"), F.count_if(F.col("status") == "failure").alias("failures"))
