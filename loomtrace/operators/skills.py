"""Evidence that a skill was asked for, invoked, read or run, from recorded events alone.

Paths are columns: they are resolved against the recorded folder and matched against the places where harnesses keep
skills; nothing looks at today's files.  Shell text is read literally; what a shell would compute is left out.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shell import commands
from ..model import STREAM
from .sequence import Pattern, positions

#: Where skills are kept, tools that read files or invoke skills, programs that print or run a file.
ROOTS = (".claude/skills", ".codex/skills", ".agents/skills", ".pi/skills", ".pi/agent/skills", ".opencode/skills")
READ_TOOLS, INVOKE_TOOLS = ("read", "read_file", "view_file"), ("skill", "use_skill", "load_skill")
FILE_KEYS = ("file_path", "path", "filePath", "TargetFile", "target_file")
READERS, RUNNERS = ("cat", "head", "tail"), ("bash", "sh", "zsh", "python", "python3", "node", "ruby", "perl")
PLACE = "(?:^skills/|(?:^|/)(?:" + "|".join(re.escape(r) for r in sorted(ROOTS, key=len, reverse=True)) + ")/)"
FOUND_PATHS = "array<struct<usage:string,path:string,cwd:string>>"


def normal(path: Column) -> Column:
    """A path without ``.``, ``..`` and doubled or backward slashes."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(clean, "/"), lambda x: (x != "") & (x != "."))
    up = lambda a: (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != "..")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & up(a), F.slice(a, 1, F.size(a) - 1)).otherwise(F.array_append(a, x)))
    return F.concat(F.when(F.startswith(clean, F.lit("/")), "/").otherwise(""), F.array_join(walked, "/"))


def resolved(path: Column, cwd: Column) -> Column:
    """A path as seen from a folder, if there is one."""
    whole = F.startswith(path, F.lit("/")) | path.rlike(r"^[A-Za-z]:[/\\]")
    return normal(F.when(whole | cwd.isNull(), path).otherwise(F.concat(cwd, F.lit("/"), path)))


def skill_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, rf".*{PLACE}([^/]+)(?:/.*)?$", 1), F.lit(""))


def skill_file(path: Column) -> Column:
    """What lies below a skill's folder."""
    return F.nullif(F.regexp_extract(path, rf".*{PLACE}[^/]+/(.*)$", 1), F.lit(""))


def literal_paths(command: Column, cwd: Column) -> Column:
    """The files that a shell text names literally, as (usage, path, folder): read by a printing program, or run.  Text with
    substitutions or here-documents gives none; ``cd`` moves the commands after it."""
    word = r"""(?:[^\s"']|"[^"]*"|'[^']*')+"""
    parts = F.transform(F.split(command, r"&&|\|\||[;|&\n]"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(word), F.lit(0)), lambda x: F.regexp_replace(x, "[\"']", "")))
    plain = lambda x: ~F.startswith(x, F.lit("-")) & ~F.contains(x, F.lit("$"))

    def named(words: Column, here: Column) -> Column:
        head = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
        program, rest = F.element_at(F.split(head, "/"), -1), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        cut = F.array_min(F.array_compact(F.array(*(F.nullif(F.array_position(rest, x), F.lit(0)) for x in (">", ">>", "<", "2>", "2>>")))))
        before = F.when(cut.isNotNull(), F.slice(rest, 1, (cut - 1).cast("int"))).otherwise(rest)
        counted = lambda x, k: F.coalesce(F.get(before, k - 1).isin("-n", "-c", "--lines", "--bytes"), F.lit(False)) & (k > 0)
        files = F.filter(before, lambda x, k: plain(x) & ~((program != "cat") & counted(x, k)))
        printed = F.when(F.get(before, F.lit(0)) == "-n", F.slice(before, 2, F.greatest(F.size(before) - 1, F.lit(0)))).otherwise(before)
        simple = F.coalesce(F.get(printed, F.lit(0)).rlike(r"^\d*(?:,\d+)?p$"), F.lit(False))
        shown = F.when(program.isin(*READERS), files).when((program == "sed") & simple, F.filter(F.slice(printed, 2, F.greatest(F.size(printed) - 1, F.lit(0))), plain)).otherwise(F.array().cast("array<string>"))
        first = F.get(rest, F.lit(0))
        ran = F.when(program.isin(*RUNNERS) & first.isNotNull() & plain(F.coalesce(first, F.lit("-"))), F.array(first)).when(F.contains(head, F.lit("/")) & plain(head) & ~program.isin(*READERS, *RUNNERS, "sed"), F.array(head)).otherwise(F.array().cast("array<string>"))
        as_ = lambda usage, some: F.transform(some, lambda x: F.struct(F.lit(usage).alias("usage"), x.alias("path"), here.alias("cwd")))
        return F.concat(as_("read", shown), as_("executed", ran)).cast(FOUND_PATHS)

    def step(state: Column, words: Column) -> Column:
        moves = (F.get(words, F.lit(0)) == "cd") & (F.size(words) == 2) & plain(F.coalesce(F.get(words, F.lit(1)), F.lit("-")))
        grouped = F.exists(words, lambda x: x.isin("(", ")"))
        cwd_ = F.when(moves, resolved(F.get(words, F.lit(1)), state["cwd"])).otherwise(state["cwd"])
        return F.struct(cwd_.alias("cwd"), F.when(moves | grouped, state["found"]).otherwise(F.concat(state["found"], named(words, state["cwd"]))).alias("found"))

    start = F.struct(cwd.cast("string").alias("cwd"), F.array().cast(FOUND_PATHS).alias("found"))
    computed = F.contains(command, F.lit("<<")) | F.contains(command, F.lit("$(")) | F.contains(command, F.lit("`"))
    return F.when(computed, F.array().cast(FOUND_PATHS)).otherwise(F.aggregate(parts, start, step)["found"])


class SkillUsage(Pattern):
    """``path``: ``skills/name[/file]`` wherever a harness keeps it, or one recorded folder or file; ``files``: the skills of
    a configuration and their files.  Findings hold usage, skill and file as detail."""

    name = "skill_usage"

    def __init__(self, path: str | None = None, files: dict[str, set[str]] | None = None):
        if path is None and files is None:
            raise ValueError("provide path or files")
        if path is not None and not path.strip():
            raise ValueError("path must not be blank")
        self.path, self.files = path.rstrip("/") if path else None, files
        self.portable = bool(path and path.startswith("skills/"))
        if path and path.rstrip("/") == "skills":
            raise ValueError("a portable path selects skills/<name>")

    def matches(self, events: DataFrame) -> DataFrame:
        rows = positions(events)
        last = rows.where("kind = 'tool_result' AND coalesce(call_id, '') <> ''").groupBy(*STREAM, "call_id").agg(F.max("i").alias("answer"))
        get = lambda *names: F.coalesce(*(F.get_json_object("arguments", f"$.{n}") for n in names))
        tool = F.lower(F.element_at(F.split(F.coalesce("tool_name", F.lit("")), r"__|\."), -1))
        call, base = F.col("kind") == "tool_call", [*STREAM, "i", "id", "call_id"]
        cwd = F.coalesce(get("workdir", "cwd", "Cwd"), F.col("cwd"))
        none = F.lit(None).cast("string")
        by_name = [(rows.where((F.col("kind") == "message") & (F.col("role") == "user")), "requested", F.nullif(F.regexp_extract("text", r"^\s*/([\w.-]+)(?=\s|$)", 1), F.lit(""))), (rows.where(call & tool.isin(*INVOKE_TOOLS)), "invoked", get("skill", "name"))]
        seen = [df.select(*base, F.lit(usage).alias("usage"), F.concat(F.lit("skills/"), who, F.lit("/SKILL.md")).alias("seen"), none.alias("at"), F.lit(True).alias("by_name")).where(~F.contains(who, F.lit("/"))) for df, usage, who in by_name]
        reads = rows.where(call & ((F.col("action_kind") == "file.read") | tool.isin(*READ_TOOLS)))
        seen.append(reads.select(*base, F.lit("read").alias("usage"), get(*FILE_KEYS).alias("seen"), cwd.alias("at"), F.lit(False).alias("by_name")))
        shell = rows.where(call).withColumn("c", F.explode(commands(F.col("tool_name"), F.col("action_kind"), F.col("arguments"))))
        shell = shell.withColumn("p", F.explode(literal_paths(F.col("c.command"), cwd)))
        seen.append(shell.select(*base, "p.usage", F.col("p.path").alias("seen"), F.col("p.cwd").alias("at"), F.lit(False).alias("by_name")))
        found = reduce(DataFrame.unionByName, seen).where("seen IS NOT NULL AND NOT contains(seen, '$')").withColumn("whole", resolved(F.col("seen"), F.col("at")))
        skill = F.coalesce(skill_name(F.col("whole")), skill_name(F.col("seen")))
        inner = F.coalesce(skill_file(F.col("whole")), skill_file(F.col("seen")))
        if self.path and not self.portable:
            expected = resolved(F.lit(self.path), F.col("at"))
            found = found.where(~F.col("by_name")).where((F.col("whole") == expected) | F.startswith("whole", F.concat(expected, F.lit("/"))))
            folder = re.sub(r"/SKILL\.md$", "", self.path).rsplit("/", 1)[-1]
            skill, inner = F.coalesce(skill, F.lit(folder)), F.coalesce(inner, F.when(F.col("whole") == expected, F.element_at(F.split("whole", "/"), -1)).otherwise(F.expr("substring(whole, 1)")))
        found = found.withColumn("skill", skill).withColumn("file", inner).where("skill IS NOT NULL AND file IS NOT NULL")
        canonical = F.concat_ws("/", F.lit("skills"), "skill", "file")
        if self.portable:
            found = found.where((canonical == self.path) | F.startswith(canonical, F.lit(f"{self.path}/")))
        if self.files is not None:
            found = found.where(canonical.isin(*(f"skills/{n}/{f}" for n, some in self.files.items() for f in {"SKILL.md", *some})))
        out = found.dropDuplicates([*base, "usage", "skill", "file"]).join(last, [*STREAM, "call_id"], "left")
        end = F.when(F.col("answer") > F.col("i"), F.col("answer")).otherwise(F.col("i"))
        return out.select(F.lit(self.name).alias("pattern"), *STREAM, F.col("i").cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit("info").alias("severity"), F.concat_ws(":", "usage", "skill", "file").alias("detail"))
