"""Cross-fitted models on MLlib: boosted trees, logistic regression, blending, and rank AUC."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.session import portable_bucket, stored

FOLDS = 5


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    """A fold that depends on the reference record alone, so all of its pairs stay together."""
    return portable_bucket(folds, key, F.lit("fold"))


def imputed(frame: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Features as doubles without nulls: -1 for a null, and a flag for each nullable one."""
    types = dict(frame.dtypes)
    keep = [c for c in frame.columns if c not in features]
    value = [F.coalesce(F.col(c).cast("int").cast("double") if types[c] == "boolean" else F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in features]
    flags = [F.col(c).isNull().cast("double").alias(f"{c}_null") for c in features]
    return frame.select(*keep, *value, *flags), [*features, *[f"{c}_null" for c in features]]


def trees(rounds: int = 20, depth: int = 4, seed: int = 3, validation: str | None = None) -> GBTClassifier:
    """Boosted trees. ``validation``: a boolean column; its rows stop the boosting once they gain no more."""
    m = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, seed=seed)
    return m.setValidationIndicatorCol(validation) if validation else m


def logistic(n_rows: int) -> LogisticRegression:
    """L2 of weight 1 against the summed loss; the intercept is free."""
    return LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False)


def fit(frame: DataFrame, features: list[str], estimator, key: str = "s1"):
    """``frame`` has the label y; rows without a label are left out. An estimator with a validation column gets a tenth of
    the reference records to stop by, chosen by a hash."""
    rows = frame.filter("y is not null")
    if estimator.hasParam("validationIndicatorCol") and estimator.isDefined("validationIndicatorCol"):
        rows = rows.withColumn(estimator.getValidationIndicatorCol(), portable_bucket(10, F.col(key), F.lit("valid")) == 0)
    d, names = imputed(rows, features)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), estimator]).fit(d.withColumn("y", F.col("y").cast("double")))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def gain_shares(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Each feature's share of the trees' gain, null flags counted with their feature, largest first; of a linear model the
    share of the absolute weights."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    share = {f: float(values[i] + values[len(features) + i]) for i, f in enumerate(features)}
    total = sum(share.values()) or 1.0
    return sorted(((f, v / total) for f, v in share.items()), key=lambda x: (-x[1], x[0]))


def sparse_fit(rows: DataFrame, bits: int = 18) -> PipelineModel:
    """L2 logistic regression over hashed, binary keys (an array of strings) with the label y."""
    d = rows.select("keys", F.col("y").cast("double").alias("y"))
    return Pipeline(stages=[HashingTF(inputCol="keys", outputCol="x", numFeatures=1 << bits, binary=True), logistic(d.count())]).fit(d)


def sparse_logit(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """(s1, s23, name): the regression's logit."""
    return model.transform(rows.select("s1", "s23", "keys")).select("s1", "s23", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias(name))


def nested_logits(rows: DataFrame, target: DataFrame, name: str, bits: int = 18) -> tuple[DataFrame, DataFrame]:
    """Logits of labelled ``rows`` and of ``target``: each row by a regression on the other half of the rows' reference
    records, the target by one on all rows. So a model on top never sees a logit that knew its own label."""
    half = portable_bucket(2, F.col("s1"), F.lit("inner"))
    parts = [sparse_logit(sparse_fit(rows.filter(half != k), bits), rows.filter(half == k), name) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), sparse_logit(sparse_fit(rows, bits), target, name)


def score(model, frame: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    d, names = imputed(frame, features)
    out = model.transform(d)
    return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("x", "rawPrediction", "probability", "prediction", *names)


def cross_fit(frame: DataFrame, features: list[str], estimator_of, key: str = "s1", folds: int = FOLDS) -> DataFrame:
    """Out-of-fold scores of all rows: each fold by a model of the others. ``estimator_of`` makes a fresh estimator. A column
    fold of the frame, from 0 to ``folds`` - 1, is taken as it is. A fit reads the frame several times, so write it first if
    it is dear."""
    d = frame if "fold" in frame.columns else frame.withColumn("fold", fold_of(F.col(key), folds))
    out = None
    for k in range(folds):
        model = fit(d.filter(F.col("fold") != k), features, estimator_of())
        part = score(model, d.filter(F.col("fold") == k), features)
        out = part if out is None else out.unionByName(part)
    return out


def blend(*scored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The mean of scores over the pairs that all have, with the columns ``keep`` of the first."""
    d = scored[0].select("s1", "s23", *keep, F.col("p").alias("p0"))
    for i, s in enumerate(scored[1:], 1):
        d = d.join(s.select("s1", "s23", F.col("p").alias(f"p{i}")), ["s1", "s23"])
    total = sum((F.col(f"p{i}") for i in range(1, len(scored))), F.col("p0"))
    return d.select("s1", "s23", *keep, (total / len(scored)).alias("p"))


def refit(base: DataFrame, scored: DataFrame) -> DataFrame:
    """New scores where there are any - countries without labels have none - else the old ones."""
    return base.join(scored.select("s1", "s23", F.col("p").alias("q")), ["s1", "s23"], "left").withColumn("p", F.coalesce("q", "p")).drop("q")


def rank_auc(scored: DataFrame, score_col: str = "p", label_col: str = "y", ranges: int = 256) -> DataFrame:
    """Area under the ROC curve by average ranks. Distinct scores are counted first and ranked within ``ranges`` of about
    equal size; only the ranges' totals meet in one task."""
    g = scored.filter(F.col(score_col).isNotNull()).groupBy(F.col(score_col).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label_col).cast("long")).alias("good"))
    g = stored(g)
    cuts = sorted(set(g.approxQuantile("s", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    d = g.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("s"))) if cuts else F.lit(0))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = d.groupBy("range").agg(F.sum("n").alias("n")).select("range", ahead(Window.orderBy("range")).alias("start"))
    r = d.withColumn("within", ahead(Window.partitionBy("range").orderBy("s"))).join(F.broadcast(start), "range").withColumn("rank", F.col("start") + F.col("within") + (F.col("n") + 1) / 2)
    n, good = F.sum("n"), F.sum("good")
    return r.agg(F.try_divide(F.sum(F.col("good") * F.col("rank")) - good * (good + 1) / 2, (good * (n - good)).cast("double")).alias("auc"))
