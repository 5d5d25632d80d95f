import random

import pytest
from pyspark.sql import functions as F

from weftlink.operators import models as M
from weftlink.operators import rounds as R

RECORD = "id long, source int, country string, name string, address string"


def pairs(spark, *rows, extra=""):
    return spark.createDataFrame(list(rows), f"s1 long, s23 long{extra}")


def test_address_shape(spark):
    r = [
        (1, 1, "US", "Blue River Trading Co", "12 Main St, Springfield, TX"),
        (11, 2, "US", "www.blueriver.com", "12 Main St"),
        (12, 2, "US", "BRTC", "#14 MAIN ST"),
        (13, 2, "US", None, None),
    ]
    got = {x.s23: x for x in R.address_shape(pairs(spark, (1, 11), (1, 12), (1, 13)), spark.createDataFrame(r, RECORD)).collect()}
    assert (got[11].n2_domain, got[11].dom_in, got[11].dom_eq, got[11].num_eq, got[11].a_order, got[11].a2_state_full) == (1, 1, 0, 1, 1, -2)
    assert (got[12].acro_eq, got[12].n2_upper, got[12].a2_hash, got[12].num_eq, got[12].n1_legal, got[12].n1_tokens) == (1, 1, 1, 0, 1, 4)
    assert (got[13].n2_tokens, got[13].num2, got[13].num_eq, got[13].a_len_ratio) == (1, 0, -1, 0.0)


def test_refit_context_second_of_one_is_the_best(spark):
    d = R.refit_context(pairs(spark, (1, 11, 0.9), (1, 12, 0.6), (2, 11, 0.3), extra=", q double"))
    got = {(x.s1, x.s23): x for x in d.collect()}
    assert (got[1, 12].q_s23_second, got[1, 12].q_s1_second, got[1, 12].q_s1_n50, got[2, 11].q_s23_rank) == (0.6, 0.6, 2, 2)


def test_rescue(spark):
    r = [
        (1, 1, "France", "Boulangerie Martin SARL", "12 rue Haute"),
        (2, 1, "France", "Garage Petit", "3 av Foch"),
        (11, 2, "France", "Martin Boulangerie", "012 r Haute"),
        (12, 2, "France", "Martin Boulangerie", "12 4 rue Haute"),
        (13, 2, "France", "Garage Petit", "null"),
    ]
    p = pairs(spark, (1, 11, 0.1), (1, 12, 0.2), (2, 13, 0.1), extra=", p double")
    f = R.rescue_features(p, spark.createDataFrame(r, RECORD))
    assert {(x.s1, x.s23) for x in R.rescue(f).collect()} == {(1, 11), (2, 13)}
    assert {(x.s1, x.s23) for x in R.rescue(f, without_address=False, all_numbers=False).collect()} == {(1, 11), (1, 12)}


def test_links_added_and_compared(spark):
    base = pairs(spark, (1, 11))
    q = pairs(spark, (1, 11, 0.9), (2, 12, 0.9), (3, 12, 0.95), (3, 13, 0.5), (2, 11, 0.99), extra=", p double")
    assert {tuple(x) for x in R.with_links(base, R.accepted(q, 0.8, unlinked=base)).collect()} == {(1, 11), (3, 12)}
    assert R.require_same(base, pairs(spark, (1, 11), (1, 11))) is base
    with pytest.raises(ValueError):
        R.require_same(base, pairs(spark, (1, 12)))
    s1 = spark.createDataFrame([(1, "US"), (2, "US"), (3, "India")], "s1 long, country string")
    got = {tuple(x) for x in R.link_changes(base, pairs(spark, (2, 12), (3, 13)), s1).collect()}
    assert got == {("US", 1, 1, 0), ("India", 1, 0, 0)}
    assert {tuple(x) for x in R.link_report(base, s1).collect()} == {("US", 2, 1, 1, 0.5), ("India", 1, 0, 0, 0.0)}
    assert R.without_outside(q, pairs(spark, (1, 11), (3, 12)), s1.filter("s1 < 3")).filter("s23 = 12").count() == 0


def test_policy_gain_by_hand(spark):
    s1 = spark.createDataFrame([(1, "US"), (2, "US")], "s1 long, country string")
    truth, band = pairs(spark, (1, 11), (2, 12)), pairs(spark, (1, 11, 0.9), extra=", x double")
    new = pairs(spark, (2, 12, 0.9, 1), (1, 13, 0.6, 1), extra=", q double, rank int")
    got = {x.cut: x for x in R.policy_gain(band, new, truth, s1, (0.5, 0.8), (1,)).collect()}
    assert (got[0.8].accepted, got[0.8].gain_add, got[0.8].gain_rule) == (1, 0.5, 0.5)
    assert (got[0.5].accepted, got[0.5].gain_rule) == (2, 0.5)  # 0.6 is under 0.85 of the record's best
    assert round(got[0.5].gain_add, 6) == round((1 + 1.25 / 2.25 - 1) / 2, 6)
    top = R.frontier(new, pairs(spark, (1, 11)), truth, s1, (0.5,)).first()
    assert (top.pairs, top.true_pairs, top.ceiling) == (2, 1, 0.5)


def test_rank_auc_equals_pair_counting(spark):
    r = random.Random(5)
    rows = [(round(r.random(), 2), int(r.random() < 0.4)) for _ in range(500)]
    good, bad = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    d = spark.createDataFrame(rows, "p double, y int")
    for ranges in (1, 7, 256):
        assert abs(M.rank_auc(d, ranges=ranges).first().auc - want) < 1e-12
    assert M.rank_auc(d.filter(F.lit(False))).first().auc is None
