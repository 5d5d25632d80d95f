from pyspark.sql import functions as F

from weftlink.functions import text as X
from weftlink.operators import blocking as B
from weftlink.operators import decide as D
from weftlink.operators import features as P
from weftlink.operators import models as M
from weftlink.operators import normalise as N
from weftlink.sources import tables as S


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


def test_fold_and_homoglyphs(spark):
    assert one(spark, "Née Ça", X.fold) == "nee ca"
    assert one(spark, None, X.fold) == ""
    for a, b in (("c0uncil", "council"), ("21st", "21st"), ("123", "123")):
        assert one(spark, a, X.unglyph) == b


def test_name_and_address(spark):
    r = spark.createDataFrame([(1, 1, "US", "B A b Inc", "007 Main Road 12, 007, Springfield"), (2, 2, "US", None, None)], "id long, source int, country string, name string, address string")
    n = {x.id: x for x in N.normalise(r).collect()}
    assert (n[1].core, n[1].compact) == (None, None)  # single letters carry no identity
    assert (n[1].numbers, n[1].words, n[1].house) == (["7", "12"], ["main", "springfield"], "7")
    assert n[2].core is None and n[2].numbers == []
    r = spark.createDataFrame([(1, "bb aa bb", None)], "id long, name string, address string")
    f = N.with_fields(r).first()
    assert (f.core, f.compact) == ("aa bb", "bbaabb")
    r = spark.createDataFrame([(i, 1, "US", "aa", f"{i} Grand Avenue Elmhurst{i}") for i in range(600)], "id long, source int, country string, name string, address string")
    assert {x.street for x in N.normalise(r).collect()} == {None}  # words of every address; the numbers are no words


def test_dictionary_and_phrases(spark):
    r = spark.createDataFrame([(1, "नमस्ते दुनिया shop")], "id long, name string")
    d = spark.createDataFrame([("नमस्ते दुनिया", "hello"), ("shop", "store")], "token string, latin string")
    assert sorted(x.token for x in N.name_tokens(r, d).collect()) == ["hello", "store"]
    names = spark.createDataFrame([("sharma", "शर्मा")] * 3, "left string, right string")
    assert [tuple(x) for x in N.learn_transliteration(names).select("latin").collect()] == [("sharma",)]


def test_many_phrases(spark):
    """No phrase of a large dictionary is left out."""
    tokens = [(f"शब्द{i} दो", f"w{i}") for i in range(100_001)]
    d = spark.createDataFrame(tokens, "token string, latin string")
    r = spark.createDataFrame([(i, f"शब्द{i} दो") for i in (0, 50_000, 100_000)], "id long, name string")
    assert {(x.id, x.token) for x in N.name_tokens(r, d).collect()} == {(i, f"w{i}") for i in (0, 50_000, 100_000)}


def test_phrases_are_learned_and_used(spark):
    single = [("sharma", "शर्मा"), ("verma", "वर्मा"), ("mehta", "मेहता")]
    words = N.learn_transliteration(spark.createDataFrame(single, "left string, right string"))
    more = spark.createDataFrame([(f"{a} grandstore", f"{b} बड़ी दुकान") for a, b in single], "left string, right string")
    phrases = N.learn_phrases(more, words)
    assert [tuple(r) for r in phrases.collect()] == [("बड़ी दुकान", "grandstore")]
    r = spark.createDataFrame([(1, "शर्मा बड़ी दुकान"), (2, "plain name"), (3, None)], "id long, name string")
    got = sorted((x.id, x.token) for x in N.name_tokens(r, words.unionByName(phrases)).collect())
    assert got == [(1, "grandstore"), (1, "sharma"), (2, "name"), (2, "plain")]


def test_caps(spark):
    rows = [(i, 1, "US", "k") for i in range(11)] + [(99, 2, "US", "k"), (98, 2, "US", None), (97, 1, None, "k")]
    parts = spark.createDataFrame(rows, "id long, source int, country string, core string")
    for cap, n in ((10, 0), (11, 11)):
        f = (B.Family("core", ("core",), cap, 30),)
        assert B.capped_pairs(B.family_keys(parts, f), f).count() == n


def test_pair_features_of_sides(spark):
    """Reports of the blocking and byte rows, on a few records."""
    r = spark.createDataFrame([(1, 1, "US", "aa bb", "1 x"), (2, 2, "US", "aa bb", None), (3, 3, "US", "zz", None)], "id long, source int, country string, name string, address string")
    n = N.normalise(r)
    pairs = spark.createDataFrame([(1, 2)], "s1 long, s23 long")
    assert {x.s23 for x in P.side_table(n, pairs, "s23").collect()} == {2}
    b = {x.id: bytes(x.bytes) for x in P.text_bytes(n, 8).collect()}
    assert b[1] == b"aa bb | " and b[3] == b"zz |  \x00\x00"


def test_soft_overlap_against_brute_force(spark):
    import random
    from math import log

    from weftlink.functions import kernels as K

    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(2, 5)))
    rows = [(i, 1 + i % 3, "US" if i % 2 else "India", " ".join(sorted({word() for _ in range(r.randint(0, 4))})) or None) for i in range(40)]
    records = spark.createDataFrame([(*x, [], []) for x in rows], "id long, source int, country string, core string, words array<string>, numbers array<string>")
    core = {i: set((c or "").split()) for i, _, _, c in rows}
    idf = {}
    for country in ("US", "India"):
        mine = [core[i] for i, _, c, _ in rows if c == country]
        idf |= {(country, w): log((len(mine) + 1) / (sum(w in m for m in mine) + 1)) for m in mine for w in m}
    where = {i: c for i, _, c, _ in rows}
    pairs = [(a, b) for a, s, c, _ in rows if s == 1 for b, t, d, _ in rows if t != 1 and c == d][:60]
    got = {(x.s1, x.s23): x for x in P.soft_overlap(spark.createDataFrame(pairs, "s1 long, s23 long"), records).collect()}
    for a, b in pairs:
        x = got[a, b]
        for mine, other, tag in ((core[a] - core[b], core[b] - core[a], 1), (core[b] - core[a], core[a] - core[b], 2)):
            best = {w: max([0.0, *K.ratios([w] * len(other), list(other))]) for w in mine}
            weight = {w: idf[where[a], w] for w in mine}
            want = (sum(weight[w] for w in mine if best[w] >= 80), sum(weight[w] * best[w] / 100 for w in mine), max((weight[w] for w in mine if best[w] < 80), default=None))
            assert [v if v is None else round(v, 9) for v in (x[f"soft{tag}"], x[f"softw{tag}"], x[f"soft_miss{tag}"])] == [v if v is None else round(v, 9) for v in want]


def test_models_saved_and_stopped_early(spark, tmp_path):
    rows = [(i, float(i % 2), float(i % 7), i % 2) for i in range(400)]
    f = spark.createDataFrame(rows, "s1 long, a double, b double, y int")
    m = M.fit(f, ["a", "b"], M.trees(rounds=3, depth=2, validation="valid"))
    noise = f.withColumn("y", F.crc32(F.col("s1").cast("string").cast("binary")) % 2)
    assert M.fit(noise, ["a", "b"], M.trees(rounds=30, depth=2, validation="valid")).stages[-1].getNumTrees < 30
    M.save(m, str(tmp_path / "m"))
    again = M.load(str(tmp_path / "m"))
    assert M.score(again, f, ["a", "b"]).select("s1", "p").collect() == M.score(m, f, ["a", "b"]).select("s1", "p").collect()
    assert M.gain_shares(again, ["a", "b"])[0] == ("a", 1.0)
    keys = spark.createDataFrame([(i, i, [f"k{i % 2}", f"n{i}"], i % 2) for i in range(80)], "s1 long, s23 long, keys array<string>, y int")
    inner, target = M.nested_logits(keys, keys.drop("y"), "z", 12)
    assert inner.count() == 80 and all((r.z > 0) == (r.s1 % 2 == 1) for r in inner.collect()) and target.count() == 80


def test_core_keys_and_bigrams(spark):
    assert sorted(k.key for k in one(spark, "aa bb cc", X.core_keys)) == ["aa bb", "aa bb cc", "aa cc", "bb cc"]
    assert [k.key for k in one(spark, "aa", X.core_keys)] == ["aa"]
    assert one(spark, "12th Main St, Texas", lambda c: X.bigrams(X.address_tokens(c))) == ["12 main", "main street", "street tx"]


def test_metric_and_rules(spark):
    s1 = spark.createDataFrame([(1,), (2,), (3,)], "s1 long")
    truth = spark.createDataFrame([(2, 20), (3, 30), (3, 31)], "s1 long, s23 long")
    pred = spark.createDataFrame([(3, 30)], "s1 long, s23 long")
    got = {r.s1: round(r.f05, 4) for r in D.per_entity(s1, truth, pred).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.8333}
    p = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.5)], "s1 long, s23 long, p double")
    assert sorted(r.p for r in D.decide(p, 0.5, 0.85).collect()) == [0.8, 0.9]
    assert round(spark.range(1).select(D.odds_shift(F.lit(0.5), 0.47)).first()[0], 6) == 0.319728
    assert P.side_context(p.filter("s23 = 1"), "s1").first().second == 0


def test_house_edit(spark):
    rows = [(None, "1", 0), ("5", "5", 1), ("12", "1", 3), ("12", "14", 4), ("12", "40", 5), ("120", "980", 2), ("1", "2000", 6)]
    d = spark.createDataFrame(rows, "a string, b string, want int").select(P.house_edit_kind(F.col("a"), F.col("b")).alias("got"), "want")
    assert all(r.got == r.want for r in d.collect())


def test_id_lists_round_trip(spark, tmp_path):
    s1 = spark.createDataFrame([("a",), ("b",)], "s1 string")
    links = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "s1 string, s23 string")
    lists = S.id_lists(s1, links)
    assert {tuple(r) for r in lists.collect()} == {("a", "x,y"), ("b", "")}
    S.write_id_lists(lists, str(tmp_path / "out"))
    back = S.read_tsv(spark, str(tmp_path / "out"), S.TRUTH)
    assert {tuple(r) for r in S.links_of(back.withColumnRenamed("source1_entity_id", "s1")).collect()} == {("a", "x"), ("a", "y")}


def test_models(spark):
    rows = [(i, i % 7, float(i % 2), None if i % 5 == 0 else float(i), i % 2) for i in range(60)]
    f = spark.createDataFrame(rows, "s1 long, s23 long, a double, b double, y int")
    m = M.fit(f, ["a", "b"], M.logistic(60))
    assert M.rank_auc(M.score(m, f, ["a", "b"])).first()[0] > 0.99
    assert {r.fold for r in f.select(M.fold_of(F.col("s1")).alias("fold")).collect()} <= set(range(5))
