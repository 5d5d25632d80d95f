import contextlib
import io
import math
from collections import Counter

from pyspark.sql import functions as F

from weftlink.operators import retrieval as R
from weftlink.plans import linkage_queries as L


def _trigrams_by_hand(reference, queries, k):
    """Every query against every reference text of its country, ids and copies one by one."""
    grams = lambda t: {p[i : i + 3] for w in t.split(" ") if w for p in [f" {w} "] for i in range(len(p) - 2)}
    out = []
    for qid, qc, qt in queries:
        texts = [(i, grams(t)) for i, c, t in reference if c == qc and t is not None]
        idf = lambda g: math.log((len(texts) + 1) / (sum(g in x for _, x in texts) + 1)) + 1
        norm = lambda x: math.sqrt(sum(idf(g) ** 2 for g in x))
        known = {g for _, x in texts for g in x}
        mine = grams(qt) & known if qt is not None else set()
        best = sorted((-round(sum(idf(g) ** 2 for g in mine & x) / (norm(mine) * norm(x)), 6), i) for i, x in texts if mine & x)
        out += [(qid, i, r, -c, -(best[r][0] if r < len(best) else 0.0)) for r, (c, i) in enumerate(best[:k], 1)]
    return sorted(out)


def test_trigrams_of_equal_texts(spark):
    names = ["red bolt", "red ring", "blue bolt", "red bolt", "old plate", "red bolt", None, "", "blue ring"]
    reference = [(i, "AB"[i % 5 == 0], n) for i, n in enumerate(names * 3, 1)]
    queries = [(100 + i, c, n) for i, c, n in reference] + [(200, None, "red bolt"), (201, "A", "xyz"), (202, "C", "red bolt")]
    schema = "id long, country string, text string"
    r, q = spark.createDataFrame(reference, schema).repartition(3), spark.createDataFrame(queries, schema).repartition(3)
    for k in (1, 2, 5):
        got = sorted((x.s23, x.s1, x.rank, x.cos, x.cos_next) for x in R.trigram_top(r, q, k).collect())
        want = _trigrams_by_hand(reference, queries, k)
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert all(abs(a - b) < 1e-5 for x, y in zip(got, want, strict=True) for a, b in zip(x[3:], y[3:], strict=True))


def test_trigram_tables_are_not_broadcast(spark, tmp_path):
    """A file's size tells little of its rows and trigrams, so none of them goes through the driver: sums at most."""
    spark.range(200_000).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "concat('Brand#', id % 5) AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    got = L.trigram_top2(spark, str(tmp_path))
    assert got.count() == 200_000
    rows = got.agg(F.min("s1"), F.max("s1"), F.min("cos"), F.max("cos_next")).first()
    assert tuple(rows) == (0, 4, 1.0, 0.0)  # the least id of each brand
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        got.explain()
    nodes = out.getvalue().splitlines()
    below = [y for x, y in zip(nodes, nodes[1:], strict=False) if "BroadcastExchange" in x]
    assert all("HashAggregate" in y for y in below), below


def test_trigrams_of_very_many_texts_count(spark):
    """Texts that share only trigrams of more than 5,000 texts are neighbours, and such trigrams add to each cosine."""
    names = [f"bolt {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i // 676:02d}" for i in range(5200)]
    queries = [(9000, "bolt"), (9001, "bolt zzzz"), (9002, "bolts ab07"), (9003, names[77])]
    grams = lambda t: {p[i : i + 3] for w in t.split(" ") for p in [f" {w} "] for i in range(len(p) - 2)}
    held = [grams(t) for t in names]
    df = Counter(g for x in held for g in x)
    assert df["bol"] == 5200
    weight = {g: math.log((len(names) + 1) / (c + 1)) + 1 for g, c in df.items()}
    norm = lambda x: math.sqrt(sum(weight.get(g, 0) ** 2 for g in x))
    norms = [norm(x) for x in held]
    r = spark.createDataFrame([(i, "A", t) for i, t in enumerate(names)], "id long, country string, text string")
    q = spark.createDataFrame([(i, "A", t) for i, t in queries], "id long, country string, text string")
    got = {(x.s23, x.rank): (x.s1, x.cos, x.cos_next) for x in R.trigram_top(r, q, 2).collect()}
    assert len(got) == 8
    for i, t in queries:
        mine = grams(t)
        best = sorted((-round(sum(weight[g] ** 2 for g in mine & x) / (norm(mine) * m), 6), j) for j, (x, m) in enumerate(zip(held, norms, strict=True)) if mine & x)
        for rank in (1, 2):
            s1, cos, after = got[i, rank]
            assert s1 == best[rank - 1][1] and abs(cos + best[rank - 1][0]) < 2e-6 and abs(after + best[rank][0]) < 2e-6


def test_trigram_blocks_lose_nothing(spark):
    """However small the blocks, and by matrix or by lists, the outcome is that of all pairs."""
    names = [" ".join(w) for w in zip(["red", "blue", "old", "cold", "new", "rusty", "red"] * 9, ["bolt", "ring", "plate", "gear", "bolts"] * 12 + ["ring"] * 3, strict=True)]
    reference = [(i, "AB"[i % 4 == 0], t + " x" * (i % 3) + f" {i // 7}" * (i % 2)) for i, t in enumerate(names)]
    queries = [(100 + i, "ABC"[i % 3], t) for i, t in enumerate(names)]
    schema = "id long, country string, text string"
    r, q = spark.createDataFrame(reference, schema), spark.createDataFrame(queries, schema)
    want = _trigrams_by_hand(reference, queries, 3)
    for sizes in ({}, {"block_rows": 5}, {"block_grams": 200}):
        got = sorted((x.s23, x.s1, x.rank, x.cos, x.cos_next) for x in R.trigram_top(r, q, 3, **sizes).collect())
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert all(abs(a - b) < 1e-5 for x, y in zip(got, want, strict=True) for a, b in zip(x[3:], y[3:], strict=True))


def test_products_of_rare_trigrams_only_where_asked(spark):
    reference = spark.createDataFrame([(1, "A", "red bolt"), (2, "A", "red ring"), (3, "A", "red gear")], "id long, country string, text string")
    queries = spark.createDataFrame([(7, "A", "red"), (8, "A", "ring")], "id long, country string, text string")
    top = lambda **of: [(x.s23, x.s1) for x in R.trigram_top(reference, queries, 1, **of).orderBy("s23").collect()]
    assert top() == [(7, 1), (8, 2)]
    assert top(most_df=2) == [(8, 2)]
