"""Small values as columns: spans of time, months, estimates, ids, mentions, releases in force."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = r"(?:[Zz]|[+-]\d\d:?\d\d)$"


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one ISO text to another, at least 0; null where one can't be read or only one names a zone."""
    zoned = lambda c: c.rlike(r"[Tt ]\d\d:?\d\d.*" + ZONE)
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    gap = (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    return F.when(zoned(start) == zoned(end), F.greatest(gap, F.lit(0.0)))


def month(at: Column) -> Column:
    """``2024-05`` of a time or of ISO text."""
    return F.substring(at.cast("string"), 1, 7)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def mentioned(text: Column, name: str) -> Column:
    """Whether a name occurs in a text, not inside a longer one."""
    import re

    return F.coalesce(F.rlike(text, F.lit(rf"(?<![\w/.-]){re.escape(name)}(?![\w/-])")), F.lit(False))


def target_id(*parts: Column) -> Column:
    """A short stable id of what names a target."""
    return F.substring(F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 256), 1, 16)


def entry_id(at: Column, *parts: Column) -> Column:
    """Ids that sort by time: microseconds in hexadecimal, then a digest of the parts."""
    return F.concat_ws("-", F.lpad(F.lower(F.hex(F.unix_micros(at))), 16, "0"), target_id(*parts))


def fingerprint(prompt: str, schema: dict | None = None) -> str:
    """Of a prompt and the schema of its answers, whatever the order of the schema's keys."""
    return hashlib.sha256(json.dumps([prompt, schema], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def pointer(record: Column, path: str) -> Column:
    """What a JSON pointer (``/message/content/0``) leads to in JSON text, as JSON text; null if nowhere."""
    steps = [x.replace("~1", "/").replace("~0", "~") for x in path.split("/")[1:]]
    inner = "".join(f"[{x}]" if x.isdigit() else "['" + x.replace("'", "\\'") + "']" for x in steps)
    return F.get_json_object(record, f"${inner}")


#: Types of content blocks that aren't text.
MEDIA = ("image", "input_image", "audio", "input_audio", "video", "file", "document")


def has_media(record: Column) -> Column:
    """Whether JSON text holds a block of media at any depth."""
    return F.coalesce(F.rlike(record, F.lit(r'"type"\s*:\s*"(?:' + "|".join(MEDIA) + r')"')), F.lit(False))


def in_force(rows: DataFrame, releases: DataFrame, *, at: str = "started_at", since: str = "since", name: str = "release") -> DataFrame:
    """``rows`` with the name of the last of ``releases`` (since, release) at or before their time, null before the first.
    Releases are few; they become spans and are joined by range."""
    w = Window.orderBy(since)
    spans = releases.groupBy(since).agg(F.max(name).alias(name)).withColumn("until_", F.lead(since).over(w))
    free = name not in rows.columns
    spans = spans.select(F.col(since).alias("since_"), "until_", F.col(name).alias(name if free else f"{name}_"))
    inside = (F.col(at) >= F.col("since_")) & (F.col("until_").isNull() | (F.col(at) < F.col("until_")))
    return rows.join(F.broadcast(spans) if spans.limit(10_001).count() <= 10_000 else spans, inside, "left").drop("since_", "until_")
