"""Where sessions come from: registered sources, collector batches, folders of artifacts, saved sessions, snapshots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT

SOURCE = "id string, harness string, path string, config string"


class Registry:
    """A table of sources in a shared folder; what a source's id stands for never changes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def sources(self) -> DataFrame:
        try:
            return self.spark.read.schema(SOURCE).parquet(self.folder)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SOURCE)

    def register(self, source_id: str, harness: str, path: str, **config) -> None:
        """Add a source; the same again changes nothing, another one under its id is an error."""
        row = (source_id, harness, path, json.dumps(config, sort_keys=True))
        known = self.sources().where(F.col("id") == source_id).first()
        if known is None:
            self.spark.createDataFrame([row], SOURCE).coalesce(1).write.mode("append").parquet(self.folder)
        elif tuple(known) != row:
            raise ValueError(f"source {source_id!r} is registered with another configuration")


def batches(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of collector batches (``runs/*/manifest.json``): batch, path and their fields."""
    rows = spark.read.option("multiLine", True).json(f"{root.rstrip('/')}/runs/*/manifest.json")
    path = F.col("_metadata.file_path")
    return rows.withColumn("path", path).withColumn("batch", F.regexp_extract("path", r"/runs/([^/]+)/manifest\.json$", 1))


def artifacts(spark: SparkSession, root: str, store: str = "walks") -> DataFrame:
    """Folders at or below ``root`` that hold saved graphs: path, and when they were last written."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path", "modificationTime")
    inside = F.regexp_extract("path", rf"^(.*)/{store}/", 1)
    return files.withColumn("folder", inside).where("folder <> ''").groupBy(F.col("folder").alias("path")).agg(F.max("modificationTime").alias("written"))


def save_session(events: DataFrame, folder: str, version: int = 1) -> str:
    """Write a session's events with a digest of their contents, and return it."""
    rows = events.select([f.split()[0] for f in EVENT.split(", ")])
    checksum = digest(rows)
    rows.withColumn("version", F.lit(version)).withColumn("checksum", F.lit(checksum)).write.parquet(folder)
    return checksum


def digest(events: DataFrame) -> str:
    """Of a set of events, whatever their order."""
    names = [f.split()[0] for f in EVENT.split(", ")]
    row = events.agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(k), *names).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2))).first()
    return hashlib.sha256(json.dumps([str(x) for x in row]).encode()).hexdigest()


def open_session(spark: SparkSession, folder: str, version: int = 1) -> DataFrame:
    """A saved session's events; an error if they aren't what was saved, or of another version."""
    rows = spark.read.parquet(folder)
    head = rows.select("version", "checksum").first()
    if head is None or head.version != version:
        raise ValueError(f"not a session of version {version}")
    out = rows.drop("version", "checksum")
    if digest(out) != head.checksum:
        raise ValueError("the session's events aren't those that were saved")
    return out


def snapshot(df: DataFrame, folder: str, revision: str) -> DataFrame:
    """The table as it is now, written once for a revision and read from there by everyone who names it."""
    path, spark = f"{folder.rstrip('/')}/{revision}", df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
