"""Ratings: scales, mergeable summaries, policies, roll-up over nested targets, lineage.

Ratings are rows (target, scale, value, item_id, ord ...); targets are addresses ``kind:name#Section > Sub``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels from worst to best.
SENTIMENT = ("harmful", "bad", "negative", "wrong", "neutral", "mixed", "unclear", "helpful", "good", "positive")


def normalized(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(label), r"(?U)\s+", " "))


@dataclass(frozen=True)
class Categorical:
    """Fixed labels; positions as given, or evenly spaced around 0 when ordered."""

    name: str
    values: tuple[str, ...]
    ordered: bool = False
    given: tuple[float, ...] | None = None

    def positions(self) -> dict[str, float]:
        if self.given is not None:
            return dict(zip(self.values, self.given, strict=True))
        return {v: i - (len(self.values) - 1) / 2 for i, v in enumerate(self.values)} if self.ordered else {}

    def valid(self, value: Column) -> Column:
        return value.isin(*self.values)


@dataclass(frozen=True)
class Label:
    """Open labels, normalized, of at most 100 characters."""

    name: str

    def valid(self, value: Column) -> Column:
        return (F.length(normalized(value)) > 0) & (F.length(value) <= 100)


@dataclass(frozen=True)
class Numeric:
    name: str
    low: float | None = None
    high: float | None = None

    def valid(self, value: Column) -> Column:
        v = value.try_cast("double")
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        ok = ok & (v >= self.low) if self.low is not None else ok
        return ok & (v <= self.high) if self.high is not None else ok


def count_summary(ratings: DataFrame, by: list[str], labels: tuple[str, ...] | None = None, *, value: str = "value", weight: Column | None = None) -> DataFrame:
    """Weight of each label in each group; with fixed labels, those that never occur count 0."""
    w = F.lit(1.0) if weight is None else weight
    found = ratings.groupBy(*by, F.col(value).alias("label")).agg(F.sum(w).alias("total"))
    if labels is None:
        return found
    per = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", "total"))).alias("m"))  # a fixed set of labels
    return per.select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("label"), F.coalesce(F.try_element_at("m", F.lit(v)), F.lit(0.0)).alias("total")) for v in labels))).alias("x")).select(*by, "x.label", "x.total")


def numeric_summary(ratings: DataFrame, by: list[str], *, value: str = "value", weight: Column | None = None) -> DataFrame:
    """count, total, min, max, mean; partial sums of any split of the rows add up to the same."""
    w = F.lit(1.0) if weight is None else weight
    out = ratings.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * F.col(value)).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.withColumn("mean", F.col("total") / F.col("n"))


def merge_numeric(parts: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of parts to the summary of the whole."""
    out = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return out.withColumn("mean", F.col("total") / F.col("n"))


def ancestors(target: Column) -> Column:
    """A target and everything that contains it: sections upward, then the resource."""
    resource, path = F.split_part(target, F.lit("#"), F.lit(1)), F.split_part(target, F.lit("#"), F.lit(2))
    parts = F.split(path, " > ")
    sections = F.when(path != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(resource, F.lit("#"), F.array_join(F.slice(parts, 1, k), " > ")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.reverse(sections), F.array(resource))


def roll_up(ratings: DataFrame, *, target: str = "target", item: str = "item_id") -> DataFrame:
    """Every rating at its target and all that contain it; one judgment counts once for each."""
    return ratings.withColumn(target, F.explode(ancestors(F.col(target)))).dropDuplicates([target, item])


def since_last_modification(entries: DataFrame, *, by: str = "lineage", order: str = "ord") -> DataFrame:
    """Rated entries that come after the lineage's last added or modified entry."""
    last = F.max(F.when(F.col("kind").isin("added", "modified"), F.col(order))).over(Window.partitionBy(by))
    return entries.withColumn("last_", last).where((F.col("kind") == "rated") & (F.col("last_").isNull() | (F.col(order) > F.col("last_")))).drop("last_")


def infer_scales(ratings: DataFrame) -> DataFrame:
    """scale, kind (numeric when every value is a number), labels in order of sentiment and then by name."""
    rank = F.array_position(F.array(*map(F.lit, SENTIMENT)), normalized(F.col("value")))
    rows = ratings.withColumn("number", F.col("value").try_cast("double")).withColumn("rank", F.when(rank > 0, rank).otherwise(len(SENTIMENT) + 1))
    labels = F.array_sort(F.collect_set(F.struct("rank", "value")))  # labels of a scale
    return rows.groupBy("scale").agg(F.bool_and(F.col("number").isNotNull()).alias("numeric"), labels.alias("l")).select("scale", F.when(F.col("numeric"), "numeric").otherwise("categorical").alias("kind"), F.when(~F.col("numeric"), F.col("l.value")).alias("labels"))


def lineages(entries: DataFrame) -> DataFrame:
    """Entries with ``lineage``: one target's history through moves (kind, target, previous, ord).

    A target that is added again after its removal starts a new one.  Moves tie targets of one resource family
    together in order, so the entries of a resource kind are folded in one group."""
    import pandas as pd

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("ord").reset_index(drop=True)
        live: dict[str, int] = {}
        number, out = 0, []
        for kind, target, previous in zip(df["kind"], df["target"], df["previous"], strict=True):
            if kind == "moved" and previous in live:
                live[target] = live.pop(previous)
            elif target not in live:
                number += 1
                live[target] = number
            out.append(live[target])
            if kind == "removed":
                live.pop(target, None)
        df["lineage"] = [f"{df['group'].iloc[0]}:{k}" for k in out]
        return df

    grouped = entries.withColumn("group", F.split_part("target", F.lit(":"), F.lit(1)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema.fields) + ", lineage string"
    return grouped.groupBy("group").applyInPandas(fold, schema).drop("group")


def kappa(rows: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of two yes-or-no judgments; null where chance alone agrees always."""
    x, y = a.cast("double"), b.cast("double")
    both = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("agree"), F.avg(x).alias("p"), F.avg(y).alias("q"))
    chance = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    return both.select(*(by or []), "n", "agree", F.when(chance != 1, (F.col("agree") - chance) / (1 - chance)).alias("kappa"))
