"""The journal of changes and ratings: reading, merging, net differences, detected changes, agreement."""

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, kind string, target string, previous string, revision string, at string, commit string, parent string, reason string, content_hash string, before string, after string, scale string, value string, ref string, item_id string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON Lines files, repeated ones once; an unfinished last line is left out."""
    rows = spark.read.schema(f"{SCHEMA}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record").dropDuplicates()


def conflicts(entries: DataFrame) -> DataFrame:
    """Ids with more than one content: an error in a journal."""
    return entries.groupBy("id").agg(F.countDistinct(F.to_json(F.struct("*"))).alias("n")).where("n > 1").select("id")


def merge(*journals: DataFrame) -> DataFrame:
    """The union of journals by id."""
    out = journals[0]
    for j in journals[1:]:
        out = out.unionByName(j)
    return out.dropDuplicates()


def write(entries: DataFrame, path: str) -> None:
    """Entries sorted by id (ids grow with time)."""
    entries.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


def matches(target: Column, pattern: str) -> Column:
    """A target address against ``kind:name#section`` with shell wildcards: a skill covers its files, a section what is
    below it."""
    glob = lambda t: "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() else f"\\{c}") for c in t)
    resource, _, section = pattern.partition("#")
    kind, _, name = resource.partition(":")
    whole = f"^{glob(resource)}" + (f"#{glob(section)}( > .*)?$" if section else "(#.*)?$")
    found = F.rlike(target, F.lit(whole))
    return found | F.rlike(target, F.lit(f"^skill_file:{glob(name)}/.*$")) if kind == "skill" and not section else found


def unified(before: Column, after: Column) -> Column:
    """A unified diff of two texts."""

    @F.arrow_udf("string")
    def diff(before, after):
        pairs = zip(before.to_pylist(), after.to_pylist(), strict=True)
        return pa.array(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")) for a, b in pairs], pa.string())

    return diff(before, after)


def net_diff(entries: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """``lineage, before, after, diff`` between two entry ids: first before to last after; what was added and removed in
    between is nothing."""
    rows = entries.where(F.col("kind").isin("added", "modified", "moved", "removed"))
    rows = rows if since is None else rows.where(F.col("id") > since)
    rows = rows if until is None else rows.where(F.col("id") <= until)
    ends = rows.groupBy("lineage").agg(F.min_by(F.struct("before"), "id").alias("b"), F.max_by(F.struct("after"), "id").alias("a"))
    out = ends.select("lineage", F.col("b.before").alias("before"), F.col("a.after").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    return out.withColumn("diff", unified(F.col("before"), F.col("after")))


def detect_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``kind, target, previous`` between two revisions (target, content): what is gone and what is new with content
    that occurs once on both sides is moved."""
    gone = before.join(after.select("target"), "target", "left_anti")
    new = after.join(before.select("target"), "target", "left_anti")
    once = lambda d, n: d.groupBy(F.sha2("content", 256).alias("h")).agg(F.min("target").alias(n), F.count("*").alias("c")).where("c = 1").drop("c")
    moved = once(gone, "previous").join(once(new, "target"), "h").select("target", "previous")
    null = F.lit(None).cast("string")
    removed = gone.join(moved.select(F.col("previous").alias("target")), "target", "left_anti").select(F.lit("removed").alias("kind"), "target", null.alias("previous"))
    added = new.join(moved.select("target"), "target", "left_anti").select(F.lit("added").alias("kind"), "target", null.alias("previous"))
    both = before.select("target", F.col("content").alias("x")).join(after, "target").where(~F.col("x").eqNullSafe(F.col("content"))).select(F.lit("modified").alias("kind"), "target", null.alias("previous"))
    return moved.select(F.lit("moved").alias("kind"), "target", "previous").unionByName(removed).unionByName(added).unionByName(both)


def installation_drift(base: DataFrame, copies: DataFrame) -> DataFrame:
    """Three-way comparison of installed copies (holder, target, content) with their base (target, content): an edit
    wins; different edits conflict; a target is removed only if every holder lost it."""
    holders = copies.select("holder").distinct()
    due = base.select("target", F.col("content").alias("original")).crossJoin(holders)  # a row for each holder and target is what is compared
    seen = due.join(copies, ["target", "holder"], "full")
    edited = F.col("content").isNotNull() & ~F.col("content").eqNullSafe(F.col("original"))
    facts = seen.groupBy("target").agg(F.collect_set(F.when(edited, F.col("content"))).alias("edits"), F.count_if(F.col("content").isNull()).alias("lost"), F.count("*").alias("n"), F.max("original").alias("original"))
    kind = F.when(F.size("edits") > 1, "conflict").when(F.size("edits") == 1, F.when(F.col("original").isNull(), "added").otherwise("modified")).when(F.col("lost") == F.col("n"), "removed")
    return facts.withColumn("kind", kind).where("kind IS NOT NULL").select("target", "kind", F.array_sort("edits").alias("contents"))


def agreement(rules: DataFrame, judged: DataFrame) -> DataFrame:
    """Per mode how many cases rules and judge both name, or only one of them."""
    r = rules.select("case_id", "mode").distinct().withColumn("r", F.lit(True))
    j = judged.select("case_id", "mode").distinct().withColumn("j", F.lit(True))
    return r.join(j, ["case_id", "mode"], "full").groupBy("mode").agg(F.count_if(F.col("r") & F.col("j")).alias("both"), F.count_if(F.col("j").isNull()).alias("rules_only"), F.count_if(F.col("r").isNull()).alias("judge_only"))
