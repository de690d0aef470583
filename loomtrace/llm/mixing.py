"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

The rates nearest (in relative entropy) to taking every document once, under one word-count constraint per source
and a bound on each rate, are exponentially tilted: ``rate = min(most, exp(lambda_source * size))``.  The dual is
convex and one-dimensional in each source; Newton steps for all sources run as one aggregation over a table of
(source, size, number of documents), so a hot source costs no more than its distinct sizes.  Rates then become whole
copies: a hash of the document rounds them, and a threshold on the rounding remainder takes out what is left of
each source's error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fits_broadcast, free_name

WORD = r"[^\x20\x09-\x0D]+"
#: Steps of the rounding remainder, and how often the remaining error is corrected.
LEVELS, CORRECTIONS = 1024, 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """Give rows (distinct ``source``) their rank by code point, null last, without gathering them in one task."""
    parts = cut(sources.withColumn("isnull", F.col("source").isNull()).repartitionByRange("isnull", "source").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("part").orderBy("isnull", "source"))
    return parts.withColumn("r", within).join(ahead.select("part", "ahead"), "part").withColumn("rank", (F.col("r") + F.col("ahead") - 1).cast("bigint")).drop("isnull", "part", "r", "ahead")


def water_level(sources: DataFrame, most: float) -> float:
    """The level L at which sum(min(most * size, L * weight)) is the sum of all sizes: Newton steps on a concave,
    piecewise linear function, from below; each step reshares by weight what capped sources leave."""
    total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total[0]:
        return 0.0
    size, level = float(total[0]), float(total[0]) / total[1]
    while True:
        capped = F.lit(level) * F.col("weight") >= F.lit(most) * F.col("source_size")
        now, free = sources.agg(F.sum(F.when(capped, F.col("source_size") * most).otherwise(F.col("weight") * level)), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free or size - now <= 1e-12 * size:
            return level
        level += (size - now) / free


def _rate(most: float) -> Column:
    return F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(60.0)))))


def balance(hist: DataFrame, sources: DataFrame, most: float, rounds: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """``sources`` with ``lam`` and ``full``: distributed, bracketed Newton iterations on the dual."""
    state = cut(sources.withColumn("full", F.col("target") >= F.col("source_size") * most * (1 - 1e-9)).withColumn("lam", F.lit(0.0)).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double")))
    small = fits_broadcast(state, 200)
    hint = F.broadcast if small else (lambda x: x)
    for _ in range(rounds):
        w = _rate(most)
        mass = F.col("size") * F.col("docs")
        slope = F.when(w < most, w * mass * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = hist.join(hint(state), "rank").groupBy("rank").agg(F.sum(w * mass).alias("got"), F.sum(slope).alias("slope"))
        step = state.join(hint(sums) if small else sums, "rank", "left")
        under = F.col("got") < F.col("target")
        low, high = F.when(under, F.col("lam")).otherwise(F.col("low")), F.when(under, F.col("high")).otherwise(F.col("lam"))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton - F.col("lam")) < 8)
        apart = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(low.isNotNull(), low + F.greatest(F.lit(1.0), F.abs(low))).otherwise(high - F.greatest(F.lit(1.0), F.abs(high)))
        done = F.col("full") | F.col("got").isNull() | (F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target"))
        state = cut(step.select("rank", "source", "weight", "source_size", "mean", "target", "full", F.when(done, F.col("lam")).when(inside, newton).otherwise(apart).alias("lam"), low.alias("low"), high.alias("high"), done.alias("done")))
        if not state.where(~F.col("done")).limit(1).count():
            break
        state = state.drop("done")
    return state.withColumn("lam", F.round("lam", 9))


def plan(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, sized: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The documents with one struct column added, and its name: ``size, source_size, target, rate, copies, taken``.

    Sources rank by code point (null last) and weigh ``weights`` in turn; targets share the sum of all sizes and
    stop at ``most`` times their source's size, the excess going to the others by weight.  ``copies`` is how often the
    mix takes the document whole, at most ``most``; ``taken = copies * size``.  Null and empty texts have size 0 and
    are never taken.  Rows are kept, repeated ones too (rows with equal doc_id, source and size round alike);
    reruns agree.  A table without rows gives none.  Other columns pass through whatever their names.

    ``sized``: (doc_id, source, size) of the same rows, if they are at hand.
    """
    if sized is None:
        sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean"))
    cycle = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("rank", F.lit(len(weights))).cast("int"))
    sources = cut(ranked(totals).withColumn("weight", cycle))
    level = water_level(sources, most)
    sources = sources.withColumn("target", F.least(F.col("source_size") * float(most), F.col("weight") * level))
    small = fits_broadcast(sources, 200)
    hint = F.broadcast if small else (lambda x: x)
    key = sources.select("rank", F.col("source").alias("key"))
    hist = cut(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")).join(hint(key), F.col("source").eqNullSafe(F.col("key"))).select("rank", "size", "docs"))
    state = balance(hist, sources, most)
    tilt = cut(state.select("rank", F.col("source").alias("key"), "source_size", "mean", "target", "full", "lam"))

    u = F.pmod(F.xxhash64("doc_id", "source", "size"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    raw = F.when(F.col("size") > 0, _rate(most)).otherwise(0.0) + F.when(F.col("size") > 0, u).otherwise(0.0)
    base = F.least(F.floor(raw), F.lit(most)).cast("bigint")
    grade = F.least(F.floor((raw - F.floor(raw)) * LEVELS), F.lit(LEVELS - 1)).cast("int")
    up = lambda sign: sign > 0

    def free(fix, now) -> Column:
        """Whether a correction may change a document: no larger than what is missing, and not changed before."""
        return (F.col("size") > 0) & (F.col("size") <= fix["limit"]) & (now == F.col("base")) & F.when(up(fix["sign"]), F.col("base") < most).otherwise(F.col("base") > 0)

    step = lambda sign: F.when(up(sign), -F.col("grade")).otherwise(F.col("grade"))
    # corrections are rows of an array of each source, so that the expression stays the same for any number of them
    copies = F.aggregate("fixes", F.col("base"), lambda now, fix: now + F.when(free(fix, now) & (step(fix["sign"]) <= fix["to"]), fix["sign"]).otherwise(0))
    fix_type = "array<struct<sign:bigint,limit:double,to:int>>"
    tilt = tilt.withColumn("fixes", F.array().cast(fix_type))
    w = Window.partitionBy("rank")  # LEVELS rows at most
    rounded = cut(sized.join(hint(tilt), F.col("source").eqNullSafe(F.col("key"))).select("rank", "size", base.alias("base"), grade.alias("grade")))
    for _ in range(CORRECTIONS):
        # what a source lacks or has too much goes to or from documents no larger, each changed once, by threshold
        now = rounded.join(hint(tilt.select("rank", "target", "fixes")), "rank").withColumn("copies", copies)
        error = cut(now.groupBy("rank").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("error")).select("rank", F.signum("error").cast("bigint").alias("sign"), F.abs("error").alias("limit")))
        open_ = now.join(hint(error), "rank").where(free({"sign": F.col("sign"), "limit": F.col("limit")}, F.col("copies")))
        mass = open_.groupBy("rank", step(F.col("sign")).alias("step")).agg(F.first("limit").alias("limit"), F.first("sign").alias("sign"), F.sum("size").alias("mass"))
        gap = mass.withColumn("gap", F.abs(F.col("limit") - F.sum("mass").over(w.orderBy("step"))))
        best = gap.groupBy("rank").agg(F.min(F.struct("gap", "step")).alias("b"), F.first("limit").alias("limit"), F.first("sign").alias("sign")).where(F.col("b.gap") < F.col("limit"))
        fix = best.select("rank", F.array(F.struct("sign", "limit", F.col("b.step").cast("int").alias("to"))).cast(fix_type).alias("fix"))
        tilt = cut(tilt.join(hint(fix), "rank", "left").withColumn("fixes", F.concat("fixes", F.coalesce("fix", F.array().cast(fix_type)))).drop("fix"))

    name = free_name(docs, "mix")
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (F.col("size") if text not in docs.columns else word_count(text)).alias("size"))
    joined = inner.join(hint(tilt), F.col("source").eqNullSafe(F.col("key"))).withColumn("base", base).withColumn("grade", grade)
    rate = F.when(F.col("size") > 0, _rate(most)).otherwise(0.0)
    mixed = F.struct("size", "source_size", "target", rate.alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return joined.select("row.*", mixed.alias(name)), name
