"""Files, tools, models and projects across cases: where work piles up, and what gets stuck in loops that fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mining import END, SUCCESS

#: A tool is reported for a model from this many calls on, a project from this many cases on.
LEAST_CALLS, LEAST_CASES = 5, 2
LINK = "case_id string, state int, kind string, entity string, action string, failed boolean"


def failing_steps(instances: DataFrame) -> DataFrame:
    """``case_id, state``: the states inside loops of failed cases, or loops through a failing state."""
    bad = F.col("failed") | F.exists("cycle", lambda x: F.contains(x, F.lit("fail")))
    inside = instances.where((F.col("end") > F.col("start")) & bad)
    return inside.select("case_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("state")).distinct()


def edit_hotspots(links: DataFrame, sessions: DataFrame) -> DataFrame:
    """``file, edits, sessions``: how often each file was edited, and in how many sessions (case_id, session_id)."""
    edits = links.where("kind = 'file' AND action = 'EDIT'").join(sessions.select("case_id", "session_id"), "case_id")
    return edits.groupBy(F.col("entity").alias("file")).agg(F.count("*").alias("edits"), F.countDistinct("session_id").alias("sessions"))


def loop_files(links: DataFrame, instances: DataFrame) -> DataFrame:
    """``file, steps, cases``: files touched inside failing loops."""
    touched = links.where("kind = 'file'").join(failing_steps(instances), ["case_id", "state"], "left_semi")
    return touched.groupBy(F.col("entity").alias("file")).agg(F.count("*").alias("steps"), F.countDistinct("case_id").alias("cases"))


def model_tools(links: DataFrame, instances: DataFrame, least: int = LEAST_CALLS) -> DataFrame:
    """``model, tool, calls, fail_rate, in_failure_loops``: each tool with the models of its step ("unknown" without)."""
    step = ["case_id", "state"]
    tools = links.where("kind = 'tool'").select(*step, F.col("entity").alias("tool"), "failed")
    models = links.where("kind = 'model'").select(*step, F.col("entity").alias("model")).distinct()
    looped = failing_steps(instances).withColumn("looped", F.lit(True))
    rows = tools.join(models, step, "left").join(looped, step, "left").withColumn("model", F.coalesce("model", F.lit("unknown")))
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return rows.groupBy("model", "tool").agg(F.count("*").alias("calls"), rate("failed").alias("fail_rate"), rate("looped").alias("in_failure_loops")).where(F.col("calls") >= least)


def projects(cases: DataFrame, least: int = LEAST_CASES) -> DataFrame:
    """``project, cases, completed``: the share of completed cases by folder (case_id, outcome, cwd)."""
    return cases.groupBy(F.coalesce("cwd", F.lit("unknown")).alias("project")).agg(F.count("*").alias("cases"), F.avg((F.col("outcome") == SUCCESS).cast("double")).alias("completed")).where(F.col("cases") >= least)


def report(links: DataFrame, cases: DataFrame, instances: DataFrame, *, top: int = 15) -> dict[str, DataFrame]:
    """The four tables, the ``top`` rows of each."""
    order = {"edit_hotspots": (F.desc("sessions"), F.desc("edits"), "file"), "failure_loop_files": (F.desc("steps"), "file"), "model_tools": (F.desc("in_failure_loops"), F.desc("fail_rate"), F.desc("calls"), "model", "tool"), "projects": ("completed", F.desc("cases"), "project")}
    found = {"edit_hotspots": edit_hotspots(links, cases), "failure_loop_files": loop_files(links, instances), "model_tools": model_tools(links, instances), "projects": projects(cases)}
    return {n: df.orderBy(*order[n]).limit(top) for n, df in found.items()}


def cost_hotspots(steps: DataFrame, *, case: str = "case_id", order: tuple[str, ...] = ("pos",), name: str = "name", cost: str = "cost") -> DataFrame:
    """``state, cost, share, per_visit``: what each state costs, of everything, and on a visit (a run of equal steps)."""
    from pyspark.sql import Window

    w = Window.partitionBy(case).orderBy(*order)
    fresh = F.when(F.lag(name).over(w) == F.col(name), 0).otherwise(1)
    out = steps.withColumn("fresh_", fresh).groupBy(F.col(name).alias("state")).agg(F.sum(cost).alias("cost"), F.sum("fresh_").alias("visits"))
    total = out.agg(F.sum("cost").alias("total"))  # one row
    return out.crossJoin(F.broadcast(total)).select("state", "cost", (F.col("cost") / F.col("total")).alias("share"), (F.col("cost") / F.col("visits")).alias("per_visit"))


def drift(seqs: DataFrame, key, instances: DataFrame | None = None, *, top: int = 3) -> DataFrame:
    """``key, cases, completed, median_states, loop_share, top_states`` by any key of a case (a month, a model)."""
    rows = seqs.withColumn("key_", F.coalesce(key, F.lit("unknown")))
    base = rows.groupBy(F.col("key_").alias("key")).agg(F.count("*").alias("cases"), F.avg((F.col("outcome") == SUCCESS).cast("double")).alias("completed"), F.median(F.size("names") - 2).alias("median_states"))
    looping = rows.select("case_id", "key_").join(instances.select("case_id").distinct(), "case_id", "left_semi") if instances is not None else rows.where("false")
    loops = looping.groupBy(F.col("key_").alias("key")).agg(F.count("*").alias("looping"))
    states = rows.select(F.col("key_").alias("key"), F.explode(F.slice("names", 2, F.greatest(F.size("names") - 2, F.lit(0)))).alias("state")).groupBy("key", "state").agg(F.count("*").alias("n"))
    most = states.groupBy("key").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "state"))), 1, top), lambda x: x["state"]).alias("top_states"))
    out = base.join(loops, "key", "left").join(most, "key", "left")
    return out.select("key", "cases", "completed", "median_states", (F.coalesce("looping", F.lit(0)) / F.col("cases")).alias("loop_share"), "top_states")


def drift_by(seqs: DataFrame, found: DataFrame, key, *, modes: int = 4) -> DataFrame:
    """``key, mode, cases, completed, share``: by any key of a case, how many cases complete, and in which share of them
    each of the ``modes`` most common failure modes (case_id, mode) was found."""
    rows = seqs.select("case_id", (F.col("outcome") == SUCCESS).cast("double").alias("ok"), F.coalesce(key, F.lit("unknown")).alias("key"))
    common = found.groupBy("mode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mode").limit(modes).select("mode")
    totals = rows.groupBy("key").agg(F.count("*").alias("cases"), F.avg("ok").alias("completed"))
    hits = rows.join(found.select("case_id", "mode").distinct(), "case_id").groupBy("key", "mode").agg(F.count("*").alias("with_mode"))
    grid = totals.crossJoin(F.broadcast(common))  # ``modes`` rows
    return grid.join(hits, ["key", "mode"], "left").select("key", "mode", "cases", "completed", (F.coalesce("with_mode", F.lit(0)) / F.col("cases")).alias("share"))


def counters(seqs: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """One row: cases, states (all visits), labels (different states), completed, loops."""
    states = F.slice("names", 2, F.greatest(F.size("names") - 2, F.lit(0)))
    base = seqs.agg(F.count("*").alias("cases"), F.sum(F.size(states)).alias("states"), F.count_if(F.col("outcome") == SUCCESS).alias("completed"))
    labels = seqs.select(F.explode(states).alias("state")).agg(F.countDistinct("state").alias("labels"))
    loops = instances.agg(F.count("*").alias("loops")) if instances is not None else seqs.agg(F.lit(0).alias("loops"))
    return base.crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(loops))  # three single rows


def sample(seqs: DataFrame, size: int = 50, seed: int = 0) -> DataFrame:
    """``size`` cases in an order that the seed fixes, whatever the order of the rows."""
    return seqs.orderBy(F.xxhash64("case_id", F.lit(seed)), "case_id").limit(size)


def ends(seqs: DataFrame) -> DataFrame:
    """``outcome, cases``: how cases end, by their last state."""
    last = F.element_at("names", -1)
    return seqs.groupBy(F.replace(last, F.lit(END), F.lit("")).alias("outcome")).agg(F.count("*").alias("cases"))
