"""Metric, decision rules, tuning and the number of links by expected F0.5."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLDS = (0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8)
RELATIVES = (0.0, 0.7, 0.85, 0.95)


def f05(tp: Column, n_true: Column, n_pred: Column) -> Column:
    """F0.5 of counts: 1 of nothing true and nothing predicted, 0 without a hit."""
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when(tp == 0, 0.0).otherwise(F.try_divide(1.25 * tp, 1.25 * tp + 0.25 * (n_true - tp) + (n_pred - tp)))


def per_entity(s1: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1, n_true, n_pred, tp, f05) of every reference record, with or without links."""
    t, p = truth.select("s1", "s23").distinct(), predicted.select("s1", "s23").distinct()
    count = lambda d, name: d.groupBy("s1").agg(F.count("*").alias(name))
    out = s1.select("s1").distinct().join(count(t, "n_true"), "s1", "left").join(count(p, "n_pred"), "s1", "left").join(count(t.join(p, ["s1", "s23"], "left_semi"), "tp"), "s1", "left")
    out = out.na.fill(0, ["n_true", "n_pred", "tp"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("n_true"), F.col("n_pred")))


def macro_f05(s1: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return per_entity(s1, truth, predicted).agg(F.avg("f05").alias("f05"))


def decide(scores: DataFrame, threshold: float, relative: float, partition: bool = False) -> DataFrame:
    """Links (s1, s23, p) at or over the threshold and ``relative`` of their record's best; with ``partition`` only the
    best of a noisy record, equals included."""
    d = scores.withColumns({"m1": F.max("p").over(Window.partitionBy("s1")), "m2": F.max("p").over(Window.partitionBy("s23"))})
    ok = (F.col("p") >= threshold) & (F.col("p") >= relative * F.col("m1"))
    return d.filter(ok & (F.col("p") >= F.col("m2")) if partition else ok).select("s1", "s23", "p")


def tune(spark: SparkSession, scores: DataFrame, s1: DataFrame, truth: DataFrame) -> DataFrame:
    """(partition, threshold, relative, f05): every rule of the grid, in one query over an exploded table of rules."""
    rules = spark.createDataFrame([(p, t, r) for p in (False, True) for t in THRESHOLDS for r in RELATIVES], "partition boolean, threshold double, relative double")
    d = scores.withColumns({"m1": F.max("p").over(Window.partitionBy("s1")), "m2": F.max("p").over(Window.partitionBy("s23"))})
    d = d.join(truth.select("s1", "s23").distinct().withColumn("hit", F.lit(1)), ["s1", "s23"], "left").join(s1.select("s1").distinct(), "s1", "left_semi")
    ok = (F.col("p") >= F.col("threshold")) & (F.col("p") >= F.col("relative") * F.col("m1")) & (~F.col("partition") | (F.col("p") >= F.col("m2")))
    kept = d.join(F.broadcast(rules), F.col("p") >= F.col("threshold")).filter(ok)  # 72 rules
    got = kept.groupBy("partition", "threshold", "relative", "s1").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    n = s1.select("s1").distinct().join(truth.groupBy("s1").agg(F.count_distinct("s23").alias("n_true")), "s1", "left").na.fill(0)
    base = n.agg(F.sum(f05(F.lit(0), F.col("n_true"), F.lit(0))).alias("empty"), F.count("*").alias("n"))
    diff = f05(F.col("tp"), F.col("n_true"), F.col("n_pred")) - f05(F.lit(0), F.col("n_true"), F.lit(0))
    gain = got.join(n, "s1").groupBy("partition", "threshold", "relative").agg(F.sum(diff).alias("gain"))
    out = F.broadcast(rules).join(gain, ["partition", "threshold", "relative"], "left").join(F.broadcast(base))
    return out.select("partition", "threshold", "relative", ((F.col("empty") + F.coalesce("gain", F.lit(0.0))) / F.col("n")).alias("f05"))


def best_rule(tuned: DataFrame) -> DataFrame:
    return tuned.orderBy(F.desc(F.round("f05", 12)), "partition", "threshold", "relative").limit(1)


def decide_by_country(scores: DataFrame, s1: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules``: (country, threshold, relative); countries without a row use the row whose country is null."""
    d = scores.join(s1.select("s1", "country"), "s1").withColumn("m1", F.max("p").over(Window.partitionBy("s1")))
    own = F.broadcast(rules.filter("country is not null").select(F.col("country"), F.struct("threshold", "relative").alias("own")))
    rest = F.broadcast(rules.filter("country is null").select(F.struct("threshold", "relative").alias("rest")).limit(1))
    d = d.join(own, "country", "left").join(rest, F.lit(True), "left").withColumn("rule", F.coalesce("own", "rest"))
    return d.filter((F.col("p") >= F.col("rule.threshold")) & (F.col("p") >= F.col("rule.relative") * F.col("m1"))).select("s1", "s23", "p")


def one_owner(pairs: DataFrame, score: str = "p") -> DataFrame:
    """The best pair of each noisy record, the least s1 of equals."""
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("s23").orderBy(F.desc(score), "s1"))).filter("r = 1").drop("r")


def odds_shift(x: Column, k: float) -> Column:
    return F.try_divide(k * x, k * x + 1 - x)


def _best_count(p: np.ndarray, lam: float, worlds: int = 60) -> int:
    """The number of best candidates to keep for the largest expected F0.5, least of equals: exact over the
    Poisson-binomial counts of true links inside and outside the kept, and Poisson links elsewhere."""
    out = np.exp(-lam) * np.cumprod(np.concatenate([[1.0], lam / np.arange(1, worlds)])) if lam > 0 else np.eye(1, worlds)[0]

    def counts(q: np.ndarray) -> np.ndarray:
        d = np.ones(1)
        for x in q:
            d = np.convolve(d, [1 - x, x])
        return d

    best, at = np.prod(1 - p) * out[0], 0
    for k in range(1, len(p) + 1):
        inside, rest = counts(p[:k]), np.convolve(counts(p[k:]), out)
        tp, fn = np.arange(k + 1)[:, None], np.arange(len(rest))[None]
        f = np.where(tp > 0, 1.25 * tp / (1.25 * tp + 0.25 * fn + (k - tp)), 0.0)
        e = float((inside[:, None] * rest[None] * f).sum())
        if e > best + 1e-12:
            best, at = e, k
    return at


def choose(band: DataFrame, outside: dict[str, float], top: int = 16, low: float = 0.02, high: float = 0.98, elsewhere: float = 0.1) -> DataFrame:
    """Links (s1, s23) of ``band`` (s1, s23, country, x) that maximise each record's expected F0.5. Records whose
    candidates all lie outside [low, high] keep those at 0.5 and over; the others consider their ``top`` best. ``outside``:
    mean number of true links beside the band by country; ``elsewhere``: that of the other countries."""
    w = Window.partitionBy("s1")
    d = band.withColumn("unsure", F.bool_or(F.col("x").between(low, high)).over(w))
    sure = d.filter(~F.col("unsure") & (F.col("x") >= 0.5)).select("s1", "s23")
    r = d.filter("unsure").withColumn("r", F.row_number().over(w.orderBy(F.desc("x"), "s23"))).filter(F.col("r") <= top)
    lists = r.groupBy("s1").agg(F.first("country").alias("country"), F.array_sort(F.collect_list(F.struct("r", "s23", "x"))).alias("c"))

    @F.pandas_udf("int")
    def count(country: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([_best_count(np.asarray(x, float), outside.get(c, elsewhere)) for c, x in zip(country, xs, strict=True)], dtype="int32")

    kept = lists.withColumn("k", count("country", F.transform("c", lambda s: s["x"])))
    return sure.unionByName(kept.select("s1", F.explode(F.slice("c", F.lit(1), F.col("k"))).alias("l")).select("s1", "l.s23"))
