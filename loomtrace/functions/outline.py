"""Markdown outlines: sections with their path, level and lines."""

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
OUTLINE = "array<struct<path:string,level:int,start:int,end:int>>"


def sections(text: str) -> list[dict]:
    """Sections in order; lines count from 1, ``end`` included; a section ends before the next of its level or above."""
    lines, fence, open_, out = text.split("\n"), None, [], []
    for number, line in enumerate(lines, 1):
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            continue
        if mark:
            fence = mark[1]
            continue
        if m := HEADING.match(line):
            level, title = len(m[1]), (m[2] or "").strip()
            while open_ and open_[-1]["level"] >= level:
                open_.pop()["end"] = number - 1
            path = " > ".join([*(x["title"] for x in open_), title])
            open_.append({"path": path, "level": level, "start": number, "end": len(lines), "title": title})
            out.append(open_[-1])
    return [{k: x[k] for k in ("path", "level", "start", "end")} for x in out]


def outline(text: Column) -> Column:
    kind = pa.list_(pa.struct([("path", pa.string()), ("level", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(OUTLINE)
    def found(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else sections(x) for x in v.to_pylist()], kind)

    return found(text)
