import re

from pyspark.sql import functions as F

from weftlink.operators import models as M
from weftlink.plans import linkage_queries as L
from weftlink.plans.fixture import documents_as_records


def test_fits_read_features_from_files(spark, monkeypatch):
    """Every fit and score reads its frame anew, so the kernels that made it must not hang on its plan."""
    seen = []

    def cross_fit(frame, features, estimator_of, **more):
        seen.append(frame)
        return frame.withColumn("p", F.rand(1))

    monkeypatch.setattr(M, "cross_fit", cross_fit)
    assert L.gbt_blend(spark, "/root/testdata/sf0.001").count() == 1
    assert len(seen) == 2
    for frame in seen:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "Join" not in plan
        assert frame.count() == L.scored(spark, "/root/testdata/sf0.001")[1].count()
        assert frame.filter(F.col("fold") != M.fold_of(F.col("s1"), 3)).count() == 0


def test_cross_fit_takes_the_frames_folds_and_blend_keeps_columns(spark):
    d = spark.range(200).selectExpr("id AS s1", "id + 1000 AS s23", "cast(id % 2 AS int) AS y", "cast(id % 2 AS double) + rand(1) / 4 AS a").cache()
    given = M.cross_fit(d.withColumn("fold", (F.col("s1") >= 100).cast("long")), ["a"], lambda: M.logistic(200), folds=2)
    assert given.filter(F.col("fold") != (F.col("s1") >= 100).cast("long")).count() == 0
    made = M.cross_fit(d, ["a"], lambda: M.logistic(200), folds=2)
    assert made.filter(F.col("fold") != M.fold_of(F.col("s1"), 2)).count() == 0
    b = M.blend(given, made, keep=("y",))
    assert b.columns == ["s1", "s23", "y", "p"] and b.count() == 200
    assert b.filter(F.col("y") != F.col("s1") % 2).count() == 0


def test_fields_come_from_the_first_words(spark, tmp_path):
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    texts = ["", "  ,; ", "One", "--One two", "One two--", " ".join(f"W{i}" for i in range(40)), "--" + "; ".join(f"É{i}" for i in range(15)), "ÀB\nC\t" * 30, "." * 5000 + "a" * 5000 + " b", "a " * 14 + "!", "ΑΣ ΣΑΣ ΟΔΟΣ x"]
    spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(texts)] + [(99, None, "en", 7)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in documents_as_records(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        assert (got[i].name, got[i].address, got[i].decoy) == (" ".join(w[:6]), "7 " + " ".join(w[6:14]), "8 " + " ".join(w[6:14])), t
    assert got[99].name is None and got[99].address is None
