"""Noisy-channel model of names: how often words are added and dropped between linked records."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import text as X


def with_words(groups: DataFrame, records: DataFrame) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(X.clean(F.col("name")), " "), lambda w: w != ""))
    r = records.select("id", "source", words.alias("t"))
    return groups.join(r.filter("source = 1").select(F.col("id").alias("s1"), F.col("t").alias("t1")), "s1").join(r.filter("source <> 1").select(F.col("id").alias("s23"), F.col("t").alias("t2")), "s23")


def learn_channel(groups: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(word, la), (word, pdrop), n from true pairs (t1, t2): log-rates of added words, drop rates of words."""
    n = groups.count()
    add = groups.select(F.explode(F.array_except("t2", "t1")).alias("w")).groupBy("w").count().select("w", F.log((F.col("count") + 0.1) / F.lit(max(n, 1))).alias("la"))
    lost = groups.select(F.explode(F.array_except("t1", "t2")).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    seen = groups.select(F.explode("t1").alias("w")).groupBy("w").agg(F.count("*").alias("occ"))
    rate = (F.coalesce("c", F.lit(0)) + 0.1) / (F.col("occ") + 1)
    return add, seen.join(lost, "w", "left").select("w", F.greatest(F.lit(1e-4), F.least(F.lit(0.999), rate)).alias("pdrop")), n


def channel_scores(groups: DataFrame, add: DataFrame, drop: DataFrame, n: int) -> DataFrame:
    """(s23, s1, k, ll, ll2, margin): each noisy record's most likely reference record, the least of equals, and its
    margin over the second; 99 where the core is unique."""
    a = groups.select("s23", "s1", F.explode(F.array_except("t2", "t1")).alias("w")).join(add, "w", "left").groupBy("s23", "s1").agg(F.sum(F.coalesce("la", F.lit(log(0.1 / max(n, 1))))).alias("sa"))
    d = groups.select("s23", "s1", "t2", F.explode("t1").alias("w")).join(drop, "w", "left").withColumn("p", F.coalesce("pdrop", F.lit(0.05)))
    d = d.groupBy("s23", "s1").agg(F.sum(F.when(F.array_contains("t2", F.col("w")), F.log(1 - F.col("p"))).otherwise(F.log("p"))).alias("sd"))
    g = groups.join(a, ["s23", "s1"], "left").join(d, ["s23", "s1"], "left").select("s23", "s1", "k", F.round(F.coalesce("sa", F.lit(0.0)) + F.coalesce("sd", F.lit(0.0)), 9).alias("ll"))
    o = Window.partitionBy("s23").orderBy(F.desc("ll"), "s1")
    g = g.withColumns({"r": F.row_number().over(o), "ll2": F.lead("ll").over(o)}).filter("r = 1")
    return g.select("s23", "s1", "k", "ll", "ll2", F.when(F.col("k") == 1, 99.0).otherwise(F.col("ll") - F.col("ll2")).alias("margin"))
