"""Later rounds: shapes of raw fields, rescues, links added to a base, and reports on what rounds gain and miss.

Pairs have the columns s1 and s23; ``records`` are both sides (source 1 is the reference side). No operator collects
rows: reports are aggregates of one row per country, rule or group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import kernels as K
from weftlink.functions import text as X
from weftlink.functions.words import TRADE_FORMS
from weftlink.operators.decide import f05, one_owner, per_entity
from weftlink.operators.features import _sides, with_context
from weftlink.session import div, portable_bucket, same

LINK = ["s1", "s23"]
FORMS = "(?U)" + TRADE_FORMS  # word boundaries of all scripts


def _squeezed(c: Column, gap: str = " ") -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", gap)


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.substring(w, 1, 1)), "")


def _first_number(address: Column) -> Column:
    return F.regexp_extract(address, r"(?:^|[\s,#])(\d+)(?:[\s,-]|$)", 1).try_cast("long")


def _parts(address: Column) -> Column:
    return F.split(address, ",")


def address_shape(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` with 23 columns that compare the shape of raw names and addresses: case, legal forms, domains, digits,
    first numbers (-1 where one is missing), comma parts, and names made of initials or run together. Null counts as
    empty."""
    d = _sides(pairs, records.select("id", "source", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("address", F.lit("")).alias("address")))
    n1, n2, a1, a2 = (F.col(c) for c in ("name_l", "name_r", "address_l", "address_r"))
    plain = F.trim(_squeezed(F.lower(n1)))
    d = d.withColumns({
        "wl_plain": plain, "wl_bare": F.trim(F.regexp_replace(F.regexp_replace(plain, FORMS, " "), r"\s+", " ")), "wl_key": _squeezed(F.lower(n2), ""),
        "wl_stem": _squeezed(F.regexp_replace(F.regexp_replace(F.lower(n2), r"^(https?://)?(www\.)?", ""), r"\.[a-z.]+$", ""), ""), "wl_f1": _first_number(a1), "wl_f2": _first_number(a2),
    })
    key, stem, f1, f2 = (F.col(c) for c in ("wl_key", "wl_stem", "wl_f1", "wl_f2"))
    run, bare_run = F.replace("wl_plain", F.lit(" "), F.lit("")), F.replace("wl_bare", F.lit(" "), F.lit(""))
    head = lambda a: F.trim(F.get(_parts(F.lower(a)), F.lit(0)))
    flags = {
        "n2_upper": n2 == F.upper(n2), "n2_legal": F.lower(n2).rlike(FORMS), "n2_domain": F.lower(n2).rlike(r"\.(com|net|org|in|co|biz|us)\b|www"), "n2_digits": n2.rlike(r"\d"), "n2_ascii": n2.rlike(r"^[\x00-\x7f]*$"),
        "n1_legal": F.lower(n1).rlike(FORMS), "a2_hash": F.contains(a2, F.lit("#")), "a2_null": F.lower(a2).rlike(r"\bnull\b|n/a"), "a2_upper": a2 == F.upper(a2), "num1": f1.isNotNull(), "num2": f2.isNotNull(),
        "acro_eq": (key == _initials(F.col("wl_plain"))) & (F.length(key) >= 2), "acro_core_eq": (key == _initials(F.col("wl_bare"))) & (F.length(key) >= 2), "dom_eq": stem == run, "dom_core_eq": stem == bare_run,
        "dom_in": (F.length(stem) >= 4) & F.contains(run, stem), "stem_eq": key == bare_run, "a_order": head(a1) == head(a2),
    }
    counts = {
        "n2_tokens": F.size(F.split(n2, " ")), "n1_tokens": F.size(F.split(n1, " ")), "num_eq": F.when(f1.isNull() | f2.isNull(), -1).otherwise((f1 == f2).cast("int")),
        "a_len_ratio": F.length(a2) / F.greatest(F.length(a1), F.lit(1)), "a2_state_full": F.size(_parts(a2)) - F.size(_parts(a1)),
    }
    return d.select(*pairs.columns, *[v.cast("int").alias(k) for k, v in flags.items()], *[v.alias(k) for k, v in counts.items()])


def entity_context(pairs: DataFrame, base: DataFrame, scores: DataFrame, country: str = "India") -> DataFrame:
    """``pairs`` (with country) and per reference record: nb base links (0 of none), xmax best score x (null of none), and
    whether it lies in ``country``."""
    nb = base.groupBy("s1").agg(F.count("*").alias("nb"))
    best = scores.groupBy("s1").agg(F.max("x").alias("xmax"))
    return pairs.join(nb, "s1", "left").join(best, "s1", "left").withColumns({"nb": F.coalesce("nb", F.lit(0)), "india": same(F.col("country"), F.lit(country)).cast("int")})


def refit_context(scores: DataFrame) -> DataFrame:
    """(s1, s23, q) with maximum, second best (the best itself of one candidate), candidates at 0.5, rank and ratio of both
    records."""
    out = scores
    for side, other in (("s1", "s23"), ("s23", "s1")):
        w = Window.partitionBy(side)
        rank = F.row_number().over(w.orderBy(F.desc("q"), other))
        out = out.withColumns({f"q_{side}_rank": rank, f"q_{side}_max": F.max("q").over(w), f"q_{side}_n50": F.count_if(F.col("q") >= 0.5).over(w)})
        second = F.max(F.when(F.col(f"q_{side}_rank") == 2, F.col("q"))).over(w)
        out = out.withColumns({f"q_{side}_second": F.coalesce(second, f"q_{side}_max"), f"q_{side}_ratio": div(F.col("q"), F.col(f"q_{side}_max"))})
    return out


def window_of_new(new: DataFrame, known: DataFrame) -> DataFrame:
    """``new`` pairs with the nine per-record columns counted over them and the ``known`` pairs of the same records; both
    have the columns of ``pair_features`` that the nine are made of."""
    cols = ["s1", "name_ratio", "raw_name_ratio", "addr_tset", "core_eq", "strong"]
    old = known.select(*cols).join(new.select("s1").distinct(), "s1", "left_semi")
    base = new.drop(*[c for c in ("s1_candidates", "s1_strong", "s1_hard", "s1_core_eq", "name_rank", "name_gap", "raw_name_rank", "addr_rank", "addr_gap") if c in new.columns])
    both = base.withColumn("wl_new", F.lit(True)).unionByName(old, allowMissingColumns=True)
    return with_context(both).filter("wl_new").drop("wl_new")


def competitors_of_new(new: DataFrame, context: DataFrame) -> DataFrame:
    """``new`` pairs against ``record_context`` of the known ones: each counts as one more candidate of its noisy record, so
    the record's best name ratio is a competitor's."""
    c = context.select("s23", "s23_candidates", F.col("s23_strong").alias("wl_strong"), "top_name")
    d = new.join(c, "s23", "left").withColumns({"s23_candidates": F.coalesce("s23_candidates", F.lit(0)) + 1, "other_strong": F.coalesce("wl_strong", F.lit(0)), "other_best_name": F.col("top_name")})
    return d.withColumn("other_name_gap", F.col("name_ratio") - F.col("other_best_name")).drop("wl_strong", "top_name")


def rescue_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` with name and addr ratios of cores and street words, house_eq, nums_eq, noaddr, and core_n: the reference
    records of the country that share the core."""
    r = records.select("id", "source", "country", X.name_core(F.col("name")).alias("c"), X.address_parts(F.coalesce("address", F.lit(""))).alias("a"), X.clean(F.col("address")).isin("", "none", "null", "nan", "n a").alias("no"))
    core_n = r.filter("source = 1").groupBy(F.col("country").alias("country_l"), F.col("c").alias("c_l")).agg(F.count("*").alias("core_n"))
    d = _sides(pairs, r).join(core_n, ["country_l", "c_l"])
    return d.select(
        *pairs.columns, K.ratio_of(F.col("c_l"), F.col("c_r")).alias("name"), K.token_set_of(F.col("a_l.rest"), F.col("a_r.rest")).alias("addr"), same(F.col("a_l.house"), F.col("a_r.house")).alias("house_eq"),
        same(F.col("a_l.nums"), F.col("a_r.nums")).alias("nums_eq"), F.col("no_r").alias("noaddr"), "core_n",
    )


def rescue(features: DataFrame, name_cut: float = 100, addr_cut: float = 90, without_address: bool = True, all_numbers: bool = True) -> DataFrame:
    """The most probable reference record of each noisy record whose name agrees and whose address agrees with equal
    numbers, or (``without_address``) that has none and whose core is unique."""
    ok = (F.col("name") >= name_cut) & F.col("nums_eq" if all_numbers else "house_eq") & (F.col("addr") >= addr_cut) & ~F.col("noaddr")
    if without_address:
        ok = ok | ((F.col("name") >= 100) & F.col("noaddr") & (F.col("core_n") == 1))
    return one_owner(features.filter(ok))


def accepted(scored: DataFrame, cut: float, score: str = "p", unlinked: DataFrame | None = None) -> DataFrame:
    """Pairs scored at ``cut`` or over. With ``unlinked``, the base links, only records without a base link take part, and
    each goes to its best reference record before the cut."""
    if unlinked is not None:
        scored = one_owner(scored.join(unlinked.select("s23").distinct(), "s23", "left_anti"), score)
    return scored.filter(F.col(score) >= cut)


def with_links(base: DataFrame, *added: DataFrame) -> DataFrame:
    """The distinct links of the base and of all that is added."""
    out = base.select(*LINK)
    for a in added:
        out = out.union(a.select(*LINK))
    return out.distinct()


def replace_links(base: DataFrame, chosen: DataFrame, s1: DataFrame) -> DataFrame:
    """``chosen`` links for the records of ``s1``, base links for all others."""
    return with_links(base.join(s1.select("s1").distinct(), "s1", "left_anti"), chosen.join(s1.select("s1").distinct(), "s1", "left_semi"))


def require_same(rebuilt: DataFrame, base: DataFrame) -> DataFrame:
    """``rebuilt``; an error unless it holds exactly the links of ``base``."""
    a, b = rebuilt.select(*LINK).distinct(), base.select(*LINK).distinct()
    apart = a.withColumn("in_base", F.lit(0)).unionByName(b.withColumn("in_base", F.lit(1))).groupBy(*LINK).count().filter("count = 1").limit(1)
    if not apart.isEmpty():
        raise ValueError("the rebuilt links differ from the base")
    return rebuilt


def without_outside(pairs: DataFrame, truth: DataFrame, inside: DataFrame) -> DataFrame:
    """Pairs whose noisy record isn't owned by a reference record outside ``inside``."""
    return pairs.join(truth.join(inside.select("s1"), "s1", "left_anti").select("s23").distinct(), "s23", "left_anti")


def keep_missed(pairs: DataFrame, truth: DataFrame, inside: DataFrame, linked: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` as in ``without_outside``, but of noisy records owned outside ``inside`` a share stays, chosen by a hash of the
    record: the country's share of true links of ``inside`` that ``linked`` misses (of a country without any, half)."""
    place = records.filter("source <> 1").select(F.col("id").alias("s23"), "country")
    own = truth.select(*LINK).distinct().join(inside.select("s1").distinct(), "s1", "left_semi").join(place, "s23")
    found = linked.select(*LINK).distinct().withColumn("hit", F.lit(1))
    miss = own.join(found, LINK, "left").groupBy("country").agg((1 - F.count("hit") / F.count("*")).alias("wl_miss"))
    owned = truth.join(inside.select("s1"), "s1", "left_anti").select("s23").distinct().withColumn("wl_owned", F.lit(True))
    d = pairs.join(owned, "s23", "left").join(place.select("s23", F.col("country").alias("wl_country")), "s23", "left")
    d = d.join(F.broadcast(miss.withColumnRenamed("country", "wl_country")), "wl_country", "left")  # a row per country
    stays = portable_bucket(1000, F.col("s23"), F.lit("outside")) / 1000 < F.coalesce("wl_miss", F.lit(0.5))
    return d.filter(F.col("wl_owned").isNull() | stays).select(*pairs.columns)


def link_report(links: DataFrame, s1: DataFrame) -> DataFrame:
    """(country, records, linked, links, per_record) over all of ``s1`` (s1, country)."""
    n = links.groupBy("s1").agg(F.count("*").alias("n"))
    g = s1.join(n, "s1", "left").groupBy("country").agg(F.count("*").alias("records"), F.count("n").alias("linked"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"))
    return g.withColumn("per_record", div(F.col("links"), F.col("records")))


def link_changes(before: DataFrame, after: DataFrame, s1: DataFrame) -> DataFrame:
    """(country, added, dropped, kept): one pass over both link lists."""
    m = before.select(*LINK).distinct().withColumn("b", F.lit(1)).unionByName(after.select(*LINK).distinct().withColumn("b", F.lit(2))).groupBy(*LINK).agg(F.sum("b").alias("b"))
    return m.join(s1.select("s1", "country"), "s1").groupBy("country").agg(F.count_if(F.col("b") == 2).alias("added"), F.count_if(F.col("b") == 1).alias("dropped"), F.count_if(F.col("b") == 3).alias("kept"))


def candidates_per_record(pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """(country, p50, p90, p99, most): candidates of a reference record, those without any counted as 0."""
    d = s1.select("s1", "country").join(pairs.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.groupBy("country").agg(*[F.percentile("n", F.lit(q / 100)).alias(f"p{q}") for q in (50, 90, 99)], F.max("n").alias("most"))


def missed_links(truth: DataFrame, scored: DataFrame, records: DataFrame) -> DataFrame:
    """True links that were never scored, with what their records share: house_in, street_eq, word_shared, token, prefix4,
    empty_addr, same_country."""
    lost = truth.select(*LINK).join(scored.select(*LINK), LINK, "left_anti")
    d = _sides(lost, records.select("id", "source", "country", "core", "compact", "numbers", "words", "house", "street"))
    some = lambda a, b: F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0)) > 0
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    return d.select(
        *LINK, F.col("country_l").alias("country"), F.coalesce(F.array_contains("numbers_r", F.col("house_l")), F.lit(False)).alias("house_in"), same(F.col("street_l"), F.col("street_r")).alias("street_eq"), some("words_l", "words_r").alias("word_shared"),
        some(F.split("core_l", " "), F.split("core_r", " ")).alias("token"), (F.substring("compact_l", 1, 4) == F.substring("compact_r", 1, 4)).alias("prefix4"), (none("numbers_r") & none("words_r")).alias("empty_addr"), same(F.col("country_l"), F.col("country_r")).alias("same_country"),
    )


def missed_groups(missed: DataFrame) -> DataFrame:
    return missed.groupBy("country", "token", "house_in", "empty_addr").agg(F.count("*").alias("n"))


def missed_shares(missed: DataFrame) -> DataFrame:
    flags = ("house_in", "street_eq", "word_shared", "token", "prefix4", "empty_addr", "same_country")
    return missed.agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in flags])


def _counts(rows: DataFrame, by: list[str], threshold: float, relative: float) -> DataFrame:
    """Kept and truly kept pairs per ``by`` (the last of it s1) under the rule, over rows (x, t)."""
    d = rows.withColumn("m", F.max("x").over(Window.partitionBy(*by)))
    kept = (F.col("x") >= threshold) & (F.col("x") >= relative * F.col("m"))
    return d.groupBy(*by).agg(F.count_if(kept).alias("kept"), F.count_if(kept & F.col("t")).alias("tp"))


def policy_gain(band: DataFrame, new: DataFrame, truth: DataFrame, s1: DataFrame, cuts: tuple[float, ...], ranks: tuple[int, ...], threshold: float = 0.5, relative: float = 0.85) -> DataFrame:
    """(country, ranks, cut, accepted, true_share, gain_add, gain_rule): what macro F0.5 gains when ``new`` pairs (s1, s23, q,
    rank) at the cut are added to the rule's links, or take part in the rule as candidates. ``band``: (s1, s23, x);
    ``s1``: (s1, country). Cuts and ranks are a constant table of a few rows; only records with accepted pairs are
    counted anew."""
    hit = F.lit(True)
    mark = truth.select(*LINK).distinct().withColumn("hit", hit)
    known = lambda d: d.join(mark, LINK, "left").withColumn("t", F.coalesce("hit", F.lit(False))).drop("hit")
    rules = F.array(*[F.struct(F.lit(int(r)).alias("ranks"), F.lit(float(c)).alias("cut")) for r in ranks for c in cuts])
    band = known(band.select(*LINK, "x"))
    acc = known(new).withColumn("rule", F.explode(rules)).filter("rank <= rule.ranks and q >= rule.cut").select("rule.ranks", "rule.cut", "s1", F.col("q").alias("x"), "t")
    by = ["ranks", "cut", "s1"]
    added = acc.groupBy(*by).agg(F.count("*").alias("a"), F.count_if("t").alias("at"))
    pooled = added.select(*by).join(band.select("s1", "x", "t"), "s1").select(*by, "x", "t").unionByName(acc)
    rule = _counts(pooled, by, threshold, relative).select(*by, F.col("kept").alias("rk"), F.col("tp").alias("rt"))
    n_true = truth.select(*LINK).distinct().groupBy("s1").agg(F.count("*").alias("n_true"))
    d = added.join(rule, by).join(_counts(band, ["s1"], threshold, relative), "s1", "left").join(n_true, "s1", "left").na.fill(0, ["kept", "tp", "n_true"]).join(s1.select("s1", "country"), "s1")
    f = lambda tp, kept: f05(tp, F.col("n_true"), kept)
    before = f(F.col("tp"), F.col("kept"))
    g = d.groupBy("country", "ranks", "cut").agg(
        F.sum("a").alias("accepted"), F.sum("at").alias("good"), F.sum(f(F.col("tp") + F.col("at"), F.col("kept") + F.col("a")) - before).alias("ga"), F.sum(f(F.col("rt"), F.col("rk")) - before).alias("gr"),
    )
    size = s1.groupBy("country").agg(F.count("*").alias("n"))
    return g.join(size, "country").select("country", "ranks", "cut", "accepted", div(F.col("good"), F.col("accepted")).alias("true_share"), div(F.col("ga"), F.col("n")).alias("gain_add"), div(F.col("gr"), F.col("n")).alias("gain_rule"))


def frontier(new: DataFrame, kept: DataFrame, truth: DataFrame, s1: DataFrame, cuts: tuple[float, ...], score: str = "q") -> DataFrame:
    """(country, cut, pairs, true_pairs, true_share, ceiling): new pairs at each cut, and what macro F0.5 would gain were
    exactly the true ones among them added to the ``kept`` links."""
    base = per_entity(s1, truth, kept).join(s1.select("s1", "country"), "s1")
    lost = truth.select(*LINK).distinct().join(kept.select(*LINK), LINK, "left_anti").withColumn("t", F.lit(True))
    d = new.join(truth.select(*LINK).distinct().withColumn("true", F.lit(True)), LINK, "left").join(lost, LINK, "left").withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts]))).filter(F.col(score) >= F.col("cut"))
    per = d.groupBy("cut", "s1").agg(F.count("*").alias("n"), F.count("true").alias("nt"), F.count("t").alias("gain")).join(base, "s1")
    f = f05(F.col("tp") + F.col("gain"), F.col("n_true"), F.col("n_pred") + F.col("gain")) - F.col("f05")
    g = per.groupBy("country", "cut").agg(F.sum("n").alias("pairs"), F.sum("nt").alias("true_pairs"), F.sum(f).alias("up"))
    size = s1.groupBy("country").agg(F.count("*").alias("size"))
    return g.join(size, "country").select("country", "cut", "pairs", "true_pairs", div(F.col("true_pairs"), F.col("pairs")).alias("true_share"), div(F.col("up"), F.col("size")).alias("ceiling"))
