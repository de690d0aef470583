"""Process mining over case sequences.

A case is a row of ``sequences``: case_id, outcome, names (its states from START to END:<outcome>), and optionally
``states`` (structs name, repeat, tokens, seconds ...).  Cases are independent until the small aggregates, so
everything up to them is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, SUCCESS = "START", "END:", "completed"


def collapse(steps: DataFrame, *, case: str = "case_id", order: tuple[str, ...] = ("pos",), name: str = "name") -> DataFrame:
    """Runs of equal neighbours as one state: case, pos (from 0), name, repeat, and the first step's other columns."""
    w = Window.partitionBy(case).orderBy(*order)
    fresh = F.when(F.lag(name).over(w).eqNullSafe(F.col(name)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = steps.withColumn("fresh_", fresh).withColumn("pos_", F.sum("fresh_").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    others = [c for c in steps.columns if c not in (case, name)]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return marked.groupBy(case, F.col("pos_").alias("pos")).agg(F.min(name).alias("name"), F.count("*").alias("repeat"), first.alias("first"))


def tails(states: DataFrame, k: int, *, case: str = "case_id") -> DataFrame:
    """Each state named with the k-1 before it."""
    if not 1 <= k <= 5:
        raise ValueError("a tail has 1 to 5 states")
    w = Window.partitionBy(case).orderBy("pos").rowsBetween(1 - k, 0)
    return states.withColumn("name", F.array_join(F.collect_list("name").over(w), " > "))


def sequences(states: DataFrame, outcomes: DataFrame, *, case: str = "case_id") -> DataFrame:
    """``case_id, outcome, names, repeats`` of each case, START and END included."""
    each = F.array_sort(F.collect_list(F.struct("pos", "name", "repeat")))
    rows = states.groupBy(case).agg(each.alias("s")).join(outcomes, case, "right")
    names = F.concat(F.array(F.lit(START)), F.coalesce(F.col("s.name"), F.array().cast("array<string>")), F.array(F.concat(F.lit(END), F.col("outcome"))))
    return rows.select(F.col(case).alias("case_id"), "outcome", names.alias("names"), F.coalesce(F.col("s.repeat"), F.array().cast("array<bigint>")).alias("repeats"))


def transitions(seqs: DataFrame) -> DataFrame:
    """case_id, outcome, pos, source, target, back (the target was visited before)."""
    n = F.size("names")
    pair = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(i.alias("pos"), F.get("names", i).alias("source"), F.get("names", i + 1).alias("target"), F.array_contains(F.slice("names", 1, i + 1), F.get("names", i + 1)).alias("back")))
    return seqs.select("case_id", "outcome", F.inline(pair))


def nodes(seqs: DataFrame) -> DataFrame:
    """name, visits, cases, mean repeat of every state."""
    rows = seqs.select("case_id", F.posexplode("names").alias("pos", "name"), "repeats")
    rep = F.get("repeats", F.col("pos") - 1)
    return rows.withColumn("repeat", F.when(F.col("pos") > 0, rep)).groupBy("name").agg(F.count("*").alias("visits"), F.countDistinct("case_id").alias("cases"), F.avg("repeat").alias("mean_repeat"))


def edges(seqs: DataFrame) -> DataFrame:
    """source, target, count, probability, success_rate (of the distinct cases), loop_back (most traversals return)."""
    t = transitions(seqs)
    per_case = t.groupBy("source", "target", "case_id").agg(F.count("*").alias("n"), F.sum(F.col("back").cast("int")).alias("back"), F.max((F.col("outcome") == SUCCESS).cast("double")).alias("success"))
    e = per_case.groupBy("source", "target").agg(F.sum("n").alias("count"), F.avg("success").alias("success_rate"), F.sum("back").alias("back"), F.avg(F.when(F.col("n") > 1, F.col("n"))).alias("mean_iterations"))
    total = F.sum("count").over(Window.partitionBy("source"))
    return e.select("source", "target", "count", (F.col("count") / total).alias("probability"), "success_rate", (F.col("back") * 2 > F.col("count")).alias("loop_back"), F.when(F.col("back") > 0, F.col("mean_iterations")).alias("mean_iterations"))


def variants(seqs: DataFrame, top: int | None = 15) -> DataFrame:
    """The most common whole sequences with share and cumulative share; ties by sequence."""
    rows = seqs.groupBy("names").agg(F.count("*").alias("cases"))
    totals = rows.agg(F.sum("cases").alias("total"))
    best = rows.orderBy(F.desc("cases"), "names")
    best = best.limit(top) if top else best
    w = Window.orderBy(F.desc("cases"), "names")  # a top-k report
    return best.crossJoin(F.broadcast(totals)).select("names", "cases", (F.col("cases") / F.col("total")).alias("share"), (F.sum("cases").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")).alias("cumulative"), F.row_number().over(w).alias("rank"))


def ngrams(names: Column, n: int) -> Column:
    """Windows of n neighbours, in order."""
    return F.when(F.size(names) >= n, F.transform(F.sequence(F.lit(1), F.size(names) - n + 1), lambda i: F.slice(names, i, n))).otherwise(F.array().cast("array<array<string>>"))


def weighted_ngrams(steps: DataFrame, n: int, *, case: str = "case_id", order: tuple[str, ...] = ("pos",), name: str = "name") -> DataFrame:
    """Windows of n steps: occurrences, distinct cases."""
    w = Window.partitionBy(case).orderBy(*order)
    rows = steps.select(case, F.array(*(F.lead(name, k).over(w) if k else F.col(name) for k in range(n))).alias("gram"), F.lead(F.lit(1), n - 1).over(w).alias("whole") if n > 1 else F.lit(1).alias("whole"))
    return rows.where("whole = 1").groupBy("gram").agg(F.count("*").alias("occurrences"), F.countDistinct(case).alias("cases"))


def contrast(seqs: DataFrame, in_group: Column, *, longest: int = 3, least: int = 5) -> DataFrame:
    """Features (windows of 1 to ``longest`` states) by how many cases of each side have them: log-odds with half a
    case added to each cell, z and lift."""
    features = F.array_distinct(F.flatten(F.array(*(ngrams(F.col("names"), k) for k in range(1, longest + 1)))))
    rows = seqs.withColumn("g", in_group)
    sizes = rows.agg(F.count_if("g").alias("n_in"), F.count_if(~F.col("g")).alias("n_out"))
    counts = rows.select("g", F.explode(features).alias("pattern")).groupBy("pattern").agg(F.count_if("g").alias("a"), F.count_if(~F.col("g")).alias("b")).where(F.col("a") + F.col("b") >= least)
    a, b, n, m = (F.col(c) for c in ("a", "b", "n_in", "n_out"))
    h = 0.5
    odds = F.ln((a + h) / (n - a + h)) - F.ln((b + h) / (m - b + h))
    spread = F.sqrt(1 / (a + h) + 1 / (n - a + h) + 1 / (b + h) + 1 / (m - b + h))
    return counts.crossJoin(F.broadcast(sizes)).select("pattern", "a", "b", odds.alias("log_odds"), (odds / spread).alias("z"), ((a / n) / ((a + b) / (n + m))).alias("lift"))


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count("*").alias("successors"))


def branching_entropy(seqs: DataFrame) -> DataFrame:
    """Per state the entropy, in bits, of what follows: over all, completed and failed cases."""
    done = F.col("outcome") == SUCCESS
    steps = transitions(seqs).groupBy("source", "target").agg(F.count("*").alias("whole"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"))
    # of counts n that sum to N, the entropy is log N - sum(n log n) / N
    def bits(c: str) -> Column:
        n, total = F.col(c), F.sum(c)
        return F.when(total > 0, F.log2(total) - F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0)) / total).otherwise(0.0)

    # what leaves a state is as often as it is visited
    out = steps.groupBy(F.col("source").alias("state")).agg(F.sum("whole").alias("visits"), bits("whole").alias("entropy"), bits("completed").alias("entropy_completed"), bits("failed").alias("entropy_failed"), F.count("*").alias("successors"))
    return out.select("state", "visits", "entropy", (F.col("entropy") * F.col("visits")).alias("weighted"), "entropy_completed", "entropy_failed", "successors")


def failure_sinks(seqs: DataFrame, least: int = 5) -> DataFrame:
    """Completion of the cases through each state against the baseline, adjusted for length: cases are compared within
    quarters by number of states (cut at the values at positions n/4, n/2 and 3n/4)."""
    rows = seqs.withColumn("n", F.size("names") - 2).withColumn("ok", (F.col("outcome") == SUCCESS).cast("double"))
    lengths = rows.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n")  # a row for each length
    upto = lengths.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy()))
    cuts = upto.agg(*(F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("n"))).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))))
    rows = rows.crossJoin(F.broadcast(cuts)).withColumn("stratum", sum((F.col("n") > F.col(f"q{i}")).cast("int") for i in range(3)))
    strata = rows.groupBy("stratum").agg(F.count("*").alias("all_cases"), F.sum("ok").alias("all_done"))
    totals = rows.agg(F.avg("ok").alias("baseline"), F.count_if(F.col("ok") == 0).alias("failed"))
    inner = F.array_distinct(F.slice("names", 2, F.greatest(F.size("names") - 2, F.lit(0))))
    through = rows.select("stratum", "ok", F.explode(inner).alias("state")).groupBy("state", "stratum").agg(F.count("*").alias("k"), F.sum("ok").alias("s"))
    delta = F.col("s") / F.col("k") - (F.col("all_done") - F.col("s")) / (F.col("all_cases") - F.col("k"))
    both = F.col("all_cases") > F.col("k")
    out = through.join(F.broadcast(strata), "stratum").groupBy("state").agg(F.sum("k").alias("cases"), F.sum("s").alias("done"), F.sum(F.when(both, delta * F.col("k"))).alias("d"), F.sum(F.when(both, F.col("k"))).alias("weight"))
    last = rows.where((F.col("ok") == 0) & (F.col("n") > 0)).groupBy(F.get("names", F.col("n")).alias("state")).agg(F.count("*").alias("last_in_failed"))
    out = out.where(F.col("cases") >= least).join(last, "state", "left").crossJoin(F.broadcast(totals))
    rate, ends = F.col("done") / F.col("cases"), F.coalesce("last_in_failed", F.lit(0))
    return out.select("state", "cases", rate.alias("completed"), "baseline", (rate - F.col("baseline")).alias("delta"), (F.col("d") / F.col("weight")).alias("adjusted_delta"), ends.alias("last_in_failed"), F.when(F.col("failed") > 0, ends / F.col("failed")).otherwise(0.0).alias("last_share"))


def interventions(seqs: DataFrame, marks: tuple[str, ...] = ("USER_TURN:CORRECTION", "USER_TURN:ABORT")) -> DataFrame:
    """The states just before an intervention, how often, and how often for each visit."""
    t = transitions(seqs).where(F.element_at(F.split("target", " > "), -1).isin(*marks))
    counts = t.groupBy(F.col("source").alias("state"), F.col("target").alias("intervention")).agg(F.count("*").alias("count"), F.slice(F.array_sort(F.collect_set("case_id")), 1, 5).alias("examples"))
    visits = nodes(seqs).select(F.col("name").alias("state"), "visits")
    return counts.join(visits, "state", "left").select("state", "intervention", "count", (F.col("count") / F.col("visits")).alias("rate"), "examples")


def self_loops(seqs: DataFrame, least: int = 2) -> DataFrame:
    """States repeated in place: case_id, state, iterations, start."""
    rows = seqs.select("case_id", "outcome", "names", F.posexplode("repeats").alias("start", "iterations")).where(F.col("iterations") >= least)
    return rows.select("case_id", F.array(F.get("names", F.col("start") + 1)).alias("cycle"), F.col("iterations").cast("bigint").alias("iterations"), F.col("start").cast("bigint").alias("start"), (F.col("start") + 1).cast("bigint").alias("end"), F.get("names", F.col("start") + 2).alias("exit"), (F.col("outcome") != SUCCESS).alias("failed"))


LOOP = "case_id string, cycle array<string>, iterations bigint, start bigint, end bigint, exit string, failed boolean"


def cycles(seqs: DataFrame, least: int = 2) -> DataFrame:
    """Two or three states repeated in turn; greedy from the left, the longest stretch first, named by the smallest
    rotation.  Each case is scanned by itself."""
    import pyarrow as pa

    def scan(names: list[str]) -> list[tuple]:
        inner, out, at = names[1:-1], [], 0
        while at < len(inner):
            options = []
            for size in (2, 3):
                cycle = inner[at : at + size]
                if len(set(cycle)) == size:
                    times = 1
                    while inner[at + times * size : at + (times + 1) * size] == cycle:
                        times += 1
                    if times >= least:
                        options.append((times * size, -size, cycle))
            if not options:
                at += 1
                continue
            length, size, cycle = max(options)
            out.append((min(cycle[k:] + cycle[:k] for k in range(-size)), length // -size, at, at + length, names[at + length + 1]))
            at += length
        return out

    def run(batches):
        for batch in batches:
            rows = [(c, *x, o != SUCCESS) for c, o, names in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for x in scan(names)]
            kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["case_id", "cycle", "iterations", "start", "end", "exit", "failed"])

    return seqs.select("case_id", "outcome", "names").mapInArrow(run, LOOP)


def loop_table(instances: DataFrame) -> DataFrame:
    """Per loop: instances, cases, median and most iterations, shares that fail, and the exit probability at each k."""
    base = instances.groupBy("cycle").agg(F.count("*").alias("instances"), F.countDistinct("case_id").alias("cases"), F.median("iterations").alias("median_iterations"), F.max("iterations").alias("max_iterations"), F.avg((F.col("failed") & F.startswith(F.col("exit"), F.lit(END))).cast("double")).alias("ends_in_failure"), F.avg(F.col("failed").cast("double")).alias("in_failed_cases"))
    reached = instances.select("cycle", "iterations", F.explode(F.sequence(F.lit(2), F.col("iterations"))).alias("k")).groupBy("cycle", "k").agg(F.count("*").alias("reached"), F.count_if(F.col("iterations") == F.col("k")).alias("exits")).where((F.col("k") <= 10) & (F.col("reached") >= 3))
    curve = reached.groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("exits") / F.col("reached")).alias("p")))).alias("curve"))
    later = F.filter("curve", lambda x: x["k"] >= 3)
    slope = F.element_at(later, -1)["p"] - F.get(later, F.lit(0))["p"]
    trend = F.when(F.coalesce(F.size(later), F.lit(0)) < 2, "too few").when(slope > 0.05, "productive retry").when(slope < -0.05, "stuck (falling)").otherwise("stuck (flat)")
    return base.join(curve, "cycle", "left").withColumn("trend", trend)


def prefixspan(seqs: DataFrame, support: float = 0.03, longest: int = 4, limit: int | None = None, cap: int | None = None) -> DataFrame:
    """Frequent subsequences (gaps allowed) of at most ``longest`` states: pattern, support.  ``cap`` looks at the first
    states of each case only, ``limit`` returns the most frequent patterns only; by default neither applies."""
    from pyspark.ml.fpm import PrefixSpan

    names = F.slice("names", 1, cap) if cap else F.col("names")
    items = seqs.select(F.transform(names, lambda x: F.array(x)).alias("sequence"))
    found = PrefixSpan(minSupport=support, maxPatternLength=longest, maxLocalProjDBSize=32_000_000).findFrequentSequentialPatterns(items)
    flat = found.where(F.forall("sequence", lambda s: F.size(s) == 1)).select(F.flatten("sequence").alias("pattern"), F.col("freq").alias("support"))
    return flat.orderBy(F.desc("support"), F.size("pattern"), "pattern").limit(limit) if limit else flat


def closed(patterns: DataFrame) -> DataFrame:
    """Frequent subsequences of two states or more that no longer one of equal support contains."""
    inside = lambda p, q: F.aggregate(q, F.lit(0), lambda k, x: F.when(F.get(p, k).eqNullSafe(x) & (k < F.size(p)), k + 1).otherwise(k)) == F.size(p)
    p, q = patterns.where(F.size("pattern") >= 2).alias("p"), patterns.alias("q")
    wider = (F.col("p.support") == F.col("q.support")) & (F.size("q.pattern") > F.size("p.pattern")) & inside(F.col("p.pattern"), F.col("q.pattern"))
    return p.join(q, wider, "left_anti")
