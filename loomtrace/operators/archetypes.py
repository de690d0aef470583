"""Archetypes: cases clustered by the transitions and states that they are made of."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mining import transitions


def features(seqs: DataFrame, most: int = 60) -> DataFrame:
    """Per case: shares of the ``most`` commonest transitions, and the logarithm of its length."""
    t = transitions(seqs).select("case_id", F.concat_ws(">", "source", "target").alias("t"))
    common = [r.t for r in t.groupBy("t").count().orderBy(F.desc("count"), "t").limit(most).collect()]
    wide = t.groupBy("case_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("t") == c).alias(f"t{i}") for i, c in enumerate(common)))
    return wide.select("case_id", F.log1p("n").alias("length"), *((F.col(f"t{i}") / F.col("n")).alias(f"t{i}") for i in range(len(common))))


def archetypes(seqs: DataFrame, *, least: int = 10, most_clusters: int = 8, seed: int = 0) -> DataFrame:
    """``case_id, cluster``; the number of clusters is the one of best silhouette.  Below ``least`` cases there is one."""
    if seqs.limit(least).count() < least:
        return seqs.select("case_id", F.lit(0).alias("cluster"))
    wide = features(seqs)
    columns = [c for c in wide.columns if c != "case_id"]
    x = VectorAssembler(inputCols=columns, outputCol="raw").transform(wide)
    x = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(x).transform(x)
    x = PCA(k=min(10, len(columns)), inputCol="scaled", outputCol="features").fit(x).transform(x).select("case_id", "features").cache()
    best, judge = None, ClusteringEvaluator()
    try:
        for k in range(2, most_clusters + 1):
            out = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="prediction").fit(x).transform(x)
            if out.select("prediction").distinct().count() < 2:
                continue
            score = judge.evaluate(out)
            if best is None or score > best[0]:
                best = (score, out)
        return best[1].select("case_id", F.col("prediction").alias("cluster")) if best else seqs.select("case_id", F.lit(0).alias("cluster"))
    finally:
        x.unpersist()
