"""Pair features and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import kernels as K
from weftlink.functions import text as X
from weftlink.functions.words import HOMOGLYPH_DIGITS, HOMOGLYPH_LETTERS
from weftlink.session import div, same

STRONG = 85.0


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _overlap(a: str, b: str) -> Column:
    return _size(F.array_intersect(a, b))


def side_table(records: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The records of one side, ids as ``side``, that ``pairs`` have; what is derived from them is derived for these only."""
    own = records.filter("source = 1" if side == "s1" else "source <> 1").withColumnRenamed("id", side)
    return own.join(pairs.select(side).distinct(), side, "left_semi")


def _sides(pairs: DataFrame, records: DataFrame) -> DataFrame:
    cols = [c for c in records.columns if c != "id"]
    left = records.filter("source = 1").select(F.col("id").alias("s1"), *[F.col(c).alias(f"{c}_l") for c in cols])
    right = records.filter("source <> 1").select(F.col("id").alias("s23"), *[F.col(c).alias(f"{c}_r") for c in cols])
    return pairs.join(left, "s1").join(right, "s23")


def house_edit_kind(a: Column, b: Column) -> Column:
    """0 one is missing, 1 equal, 3 a digit dropped at an end, 4 apart by up to 5, 5 by up to 30, 2 same length, 6 other."""
    off = F.abs(a.try_cast("long") - b.try_cast("long"))
    ends = F.startswith(a, b) | F.endswith(a, b) | F.startswith(b, a) | F.endswith(b, a)
    dropped = (F.abs(F.length(a) - F.length(b)) == 1) & ends
    return F.when(a.isNull() | b.isNull(), 0).when(a == b, 1).when(dropped, 3).when(off.between(1, 5), 4).when(off.between(6, 30), 5).when(F.length(a) == F.length(b), 2).otherwise(6)


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Kernel scores, structure and per-record context of normalised pairs; ``pairs`` keeps its columns."""
    keep = pairs.columns
    r = records.select("id", "source", "country", "core", "compact", "numbers", "words", "house", "street", X.fold(F.col("name")).alias("rn"), X.fold(F.col("address")).alias("ra"))
    d = _sides(pairs, r)
    tl, tr = F.split("core_l", " "), F.split("core_r", " ")
    hl, hr = F.col("house_l"), F.col("house_r")
    d = d.select(
        *keep, F.col("country_l").alias("country"), (F.col("source_r") == 3).alias("is_s3"),
        K.ratio_of(F.col("compact_l"), F.col("compact_r")).alias("name_ratio"), K.partial_ratio_of(F.col("compact_l"), F.col("compact_r")).alias("name_partial"),
        K.jaro_winkler_of(F.col("compact_l"), F.col("compact_r")).alias("name_jw"), K.token_set_of(F.col("core_l"), F.col("core_r")).alias("core_tset"),
        K.ratio_of(F.col("rn_l"), F.col("rn_r")).alias("raw_name_ratio"), K.ratio_of(F.col("ra_l"), F.col("ra_r")).alias("addr_ratio"), K.token_set_of(F.col("ra_l"), F.col("ra_r")).alias("addr_tset"),
        F.levenshtein(hl, hr).alias("house_edit"), same(F.col("core_l"), F.col("core_r")).alias("core_eq"), same(F.col("compact_l"), F.col("compact_r")).alias("compact_eq"), (F.col("rn_l") == F.col("rn_r")).alias("raw_name_eq"),
        F.coalesce(F.length("compact_l"), F.lit(0)).alias("len_l"), F.coalesce(F.length("compact_r"), F.lit(0)).alias("len_r"), _size(tl).alias("tokens_l"), _size(tr).alias("tokens_r"), _size(F.array_intersect(tl, tr)).alias("token_overlap"),
        hl.isNull().alias("house_missing_l"), hr.isNull().alias("house_missing_r"), same(hl, hr).alias("house_eq"),
        F.coalesce(F.array_contains("numbers_r", hl), F.lit(False)).alias("house_in"), F.coalesce(F.array_contains("numbers_l", hr), F.lit(False)).alias("house_in_reverse"),
        F.abs(hl.try_cast("long") - hr.try_cast("long")).cast("double").alias("house_diff"), _size(F.col("numbers_l")).alias("numbers_l"), _size(F.col("numbers_r")).alias("numbers_r"),
        _overlap("numbers_l", "numbers_r").alias("number_overlap"), _overlap("words_l", "words_r").alias("word_overlap"), same(F.col("street_l"), F.col("street_r")).alias("street_eq"), F.trim("ra_r").isin("", "null").alias("address_empty_r"),
    )
    return with_context(d.withColumn("strong", (F.col("name_ratio") >= STRONG) & F.col("house_in")))


def with_context(d: DataFrame) -> DataFrame:
    """The nine columns that describe a pair among its reference record's candidates."""
    w = Window.partitionBy("s1")
    rank = lambda c: F.rank().over(w.orderBy(F.desc(c)))
    return d.withColumns(
        {
            "s1_candidates": F.count("*").over(w), "s1_strong": F.count_if("strong").over(w), "s1_hard": F.count_if(F.col("name_ratio") >= STRONG).over(w), "s1_core_eq": F.count_if("core_eq").over(w),
            "name_rank": rank("name_ratio"), "name_gap": F.max("name_ratio").over(w) - F.col("name_ratio"), "raw_name_rank": rank("raw_name_ratio"), "addr_rank": rank("addr_tset"), "addr_gap": F.max("addr_tset").over(w) - F.col("addr_tset"),
        }
    )


def record_context(features: DataFrame) -> DataFrame:
    """Per noisy record: candidates, strong ones, best reference record (the least of equals), its and the second best name
    ratio."""
    best = F.row_number().over(Window.partitionBy("s23").orderBy(F.desc("name_ratio"), "s1"))
    at = lambda r, c: F.max(F.when(F.col("wl_r") == r, F.col(c)))
    g = features.select("s23", "s1", "name_ratio", "strong").withColumn("wl_r", best).groupBy("s23")
    return g.agg(F.count("*").alias("s23_candidates"), F.count_if("strong").alias("s23_strong"), at(1, "s1").alias("top_s1"), at(1, "name_ratio").alias("top_name"), at(2, "name_ratio").alias("second_name"))


def leave_one_out(features: DataFrame) -> DataFrame:
    """Features with the best competing name ratio, strong competitors and the gap, for each pair's noisy record."""
    d = features.join(record_context(features), "s23")
    other = F.when(F.col("top_s1") == F.col("s1"), F.col("second_name")).otherwise(F.col("top_name"))
    return d.withColumns({"other_best_name": other, "other_strong": F.col("s23_strong") - F.col("strong").cast("int"), "other_name_gap": F.col("name_ratio") - other}).drop("top_s1", "top_name", "second_name")


def score_context(scores: DataFrame) -> DataFrame:
    """(s1, s23, p) with sums, maxima, seconds, ranks and ratios over both records."""
    w1, w2 = Window.partitionBy("s1"), Window.partitionBy("s23")
    o1, o2 = w1.orderBy(F.desc("p"), "s23"), w2.orderBy(F.desc("p"), "s1")
    d = scores.withColumns({"rank_s1": F.row_number().over(o1), "rank_s23": F.row_number().over(o2)})
    second = lambda r, w: F.max(F.when(F.col(r) == 2, F.col("p"))).over(w)
    d = d.withColumns(
        {
            "p_s1_max": F.max("p").over(w1), "p_s1_second": second("rank_s1", w1), "p_s1_sum": F.sum("p").over(w1), "n50_s1": F.count_if(F.col("p") >= 0.5).over(w1),
            "p_s23_max": F.max("p").over(w2), "p_s23_second": second("rank_s23", w2), "p_s23_sum": F.sum("p").over(w2), "n50_s23": F.count_if(F.col("p") >= 0.5).over(w2),
        }
    )
    other = F.when(F.col("rank_s23") == 1, F.col("p_s23_second")).otherwise(F.col("p_s23_max"))
    return d.withColumns({"ratio": div(F.col("p"), F.col("p_s1_max")), "other": other, "margin": F.col("p") - F.coalesce(other, F.lit(0.0))})


def side_context(scores: DataFrame, side: str) -> DataFrame:
    """(side, best, second, n50, n): the second best is 0 of a single candidate."""
    d = scores.select(side, "p").withColumn("wl_r", F.row_number().over(Window.partitionBy(side).orderBy(F.desc("p"))))
    second = F.coalesce(F.max(F.when(F.col("wl_r") == 2, F.col("p"))), F.lit(0.0))
    return d.groupBy(side).agg(F.max("p").alias("best"), second.alias("second"), F.count_if(F.col("p") >= 0.5).alias("n50"), F.count("*").alias("n"))


def with_base(pairs: DataFrame, scores: DataFrame, confident: float = 0.5) -> DataFrame:
    """``pairs`` with what ``scores`` (s1, s23, p) say of both records: base_s1_max, base_s1_n50, base_s23_max, base_s23_n50 (null
    of a record never scored), whether the noisy record has a confident link, s23_taken, and for sibling pairs sib_ratio, the
    sibling's score by the reference record's best."""
    out = pairs
    for side in ("s1", "s23"):
        out = out.join(scores.groupBy(side).agg(F.max("p").alias(f"base_{side}_max"), F.count_if(F.col("p") >= confident).alias(f"base_{side}_n50")), side, "left")
    out = out.withColumn("s23_taken", F.coalesce(F.col("base_s23_max") >= confident, F.lit(False)))
    return out.withColumn("sib_ratio", div(F.col("sib_p"), F.col("base_s1_max"))) if "sib_p" in pairs.columns else out


def stack_frame(scores: DataFrame) -> DataFrame:
    """(s1, s23, p, is_s3) with the first stage's probabilities among the candidates of both records: the best other
    reference record's and the sum of the others' for the noisy record; maximum, second best, sum, number at 0.5 and rank
    for the reference record, and its maxima over either noisy source; margin, ratio and best other candidate."""
    w1, w2 = Window.partitionBy("s1"), Window.partitionBy("s23")
    d = scores.select("s1", "s23", "p", "is_s3").withColumns({"p_rank": F.row_number().over(w1.orderBy(F.desc("p"), "s23")), "wl_r": F.row_number().over(w2.orderBy(F.desc("p"), "s1"))})
    second = lambda r, w: F.max(F.when(F.col(r) == 2, F.col("p"))).over(w)
    d = d.withColumns(
        {
            "p_s1_max": F.max("p").over(w1), "p_s1_second": second("p_rank", w1), "p_s1_sum": F.sum("p").over(w1), "p_s1_n50": F.count_if(F.col("p") >= 0.5).over(w1),
            "p_s2_max": F.max(F.when(~F.col("is_s3"), F.col("p"))).over(w1), "p_s3_max": F.max(F.when(F.col("is_s3"), F.col("p"))).over(w1),
            "p_other_s1": F.coalesce(F.when(F.col("wl_r") == 1, second("wl_r", w2)).otherwise(F.max("p").over(w2)), F.lit(0.0)), "p_other_sum": F.sum("p").over(w2) - F.col("p"),
        }
    )
    other = F.when(F.col("p_rank") == 1, F.col("p_s1_second")).otherwise(F.col("p_s1_max"))
    return d.withColumns({"p_margin": F.col("p") - F.col("p_other_s1"), "p_ratio": div(F.col("p"), F.col("p_s1_max")), "p_s1_other": other}).drop("wl_r", "is_s3")


def peers(scores: DataFrame, records: DataFrame, low: float = 0.01, high: float = 0.5) -> DataFrame:
    """What a candidate shares with the confident candidates of the same reference record."""
    r = records.filter("source <> 1").select(F.col("id").alias("s23"), "house", "street", "numbers", "words")
    c = scores.filter(F.col("p") >= low).join(r, "s23")
    o = scores.filter(F.col("p") >= high).join(r, "s23").select("s1", F.col("s23").alias("o"), F.col("p").alias("op"), *[F.col(x).alias(f"o_{x}") for x in ("house", "street", "numbers", "words")])
    d = c.join(o, "s1").filter("s23 <> o")
    eq = same(F.col("house"), F.col("o_house"))
    jac = F.coalesce(div(_overlap("words", "o_words"), _size(F.array_union("words", "o_words"))), F.lit(0.0))
    return d.groupBy("s1", "s23").agg(
        F.count("*").alias("n_peer"), F.count_if(eq).alias("peer_house"), F.sum(F.when(eq, F.col("op")).otherwise(0.0)).alias("peer_house_p"), F.count_if(same(F.col("street"), F.col("o_street"))).alias("peer_street"),
        F.count_if(_overlap("numbers", "o_numbers") > 0).alias("peer_number"), F.max(jac).alias("peer_words_max"), F.avg(jac).alias("peer_words_mean"), F.avg(eq.cast("double")).alias("peer_house_share"),
    )


def _kind_words(kind: str) -> Column:
    """Distinct name words, or address words and numbers, the latter marked."""
    if kind == "name":
        return F.array_distinct(F.filter(F.split(F.coalesce("core", F.lit("")), " "), lambda t: t != ""))
    return F.array_distinct(F.concat(F.coalesce("words", F.array()), F.transform(F.coalesce("numbers", F.array()), lambda n: F.concat(F.lit("#"), n))))


def weighted_words(records: DataFrame, kind: str) -> DataFrame:
    """(id, source, w, idf): IDF is ln((n + 1) / (df + 1)) over a country's records of all sides."""
    r = records.select("id", "source", "country", F.explode(_kind_words(kind)).alias("w"))
    n = records.groupBy("country").agg(F.count("*").alias("n"))
    idf = r.groupBy("country", "w").agg(F.count("*").alias("df")).join(n, "country").select("country", "w", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    return r.join(idf, ["country", "w"]).select("id", "source", "w", "idf")


def _pair_words(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """(s1, s23, w, idf, in): each word of a pair once; in: 1 the reference record has it, 2 the noisy one, 3 both."""
    keys = pairs.select("s1", "s23")
    one = keys.join(weighted.filter("source = 1").select(F.col("id").alias("s1"), "w", "idf"), "s1").withColumn("side", F.lit(1))
    two = keys.join(weighted.filter("source <> 1").select(F.col("id").alias("s23"), "w", "idf"), "s23").withColumn("side", F.lit(2))
    cols = ["s1", "s23", "w", "idf", "side"]
    return one.select(*cols).unionByName(two.select(*cols)).groupBy("s1", "s23", "w").agg(F.max("idf").alias("idf"), F.sum("side").alias("in"))


def idf_overlap(pairs: DataFrame, records: DataFrame, kind: str = "name") -> DataFrame:
    """IDF sums of a pair's words: sum1, sum2, shared, shared_max, miss1, miss2, jaccard, cover1, cover2. ``kind``: name
    words, or address words with numbers marked."""
    total = lambda c: F.sum(F.when(c, F.col("idf")).otherwise(0.0))
    most = lambda c: F.max(F.when(c, F.col("idf")))
    i = F.col("in")
    g = _pair_words(pairs, weighted_words(records, kind)).groupBy("s1", "s23").agg(total(i != 2).alias("sum1"), total(i != 1).alias("sum2"), total(i == 3).alias("shared"), most(i == 3).alias("shared_max"), most(i == 1).alias("miss1"), most(i == 2).alias("miss2"))
    out = pairs.select("s1", "s23").join(g, ["s1", "s23"], "left").na.fill(0.0, ["sum1", "sum2", "shared"])
    s = F.col("shared")
    return out.withColumns({"jaccard": div(s, F.col("sum1") + F.col("sum2") - s), "cover1": div(s, F.col("sum1")), "cover2": div(s, F.col("sum2"))})


def soft_overlap(pairs: DataFrame, records: DataFrame, kind: str = "name", cut: float = 80.0) -> DataFrame:
    """Words of one record that the other lacks, each with its best ratio against the other's words that this one lacks (0
    of none). For the reference record (1) and the noisy one (2): weight matched at ``cut`` and over, weight times ratio,
    rarest unmatched word; for names also the coverages, shared and matched weight by a side's whole weight. Numbers of
    addresses are left out."""
    words = _pair_words(pairs, weighted_words(records, kind).filter(~F.col("w").startswith("#")))
    keys = pairs.select("s1", "s23").distinct()
    out = keys
    for tag, other in ((1, 2), (2, 1)):
        mine = words.filter(F.col("in") == tag)
        theirs = words.filter(F.col("in") == other).groupBy("s1", "s23").agg(F.collect_list("w").alias("o"))
        cross = mine.join(theirs, ["s1", "s23"], "left").select("s1", "s23", "w", "idf", F.explode_outer("o").alias("o"))
        r = F.when(F.col("o").isNull(), F.lit(0.0)).otherwise(K.ratio_of(F.col("w"), F.col("o")))
        best = cross.withColumn("r", r).groupBy("s1", "s23", "w").agg(F.max("idf").alias("idf"), F.max("r").alias("r"))
        side = best.groupBy("s1", "s23").agg(
            F.sum(F.when(F.col("r") >= cut, F.col("idf")).otherwise(0.0)).alias(f"soft{tag}"), F.sum(F.col("idf") * F.col("r") / 100).alias(f"softw{tag}"), F.max(F.when(F.col("r") < cut, F.col("idf"))).alias(f"soft_miss{tag}")
        )
        out = out.join(side, ["s1", "s23"], "left")
    out = out.na.fill(0.0, ["soft1", "softw1", "soft2", "softw2"])
    if kind != "name":
        return out
    sums = idf_overlap(keys, records).select("s1", "s23", "shared", "sum1", "sum2")
    cover = {f"soft_cov{t}": div(F.col("shared") + F.col(f"soft{t}"), F.col(f"sum{t}")) for t in (1, 2)}
    return out.join(sums, ["s1", "s23"]).withColumns(cover).drop("shared", "sum1", "sum2")


def edit_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Raw-text edit features: distances, equality of letters and digits, legal forms, house-number edit."""
    n = X.fold(F.col("name"))
    r = records.select("id", "source", n.alias("n"), X.fold(F.col("address")).alias("a"), "house", "numbers")
    r = r.withColumns({"legal": X.legal_class(F.col("n")), "n_an": X.only_letters_digits(F.col("n")), "a_an": X.only_letters_digits(F.col("a"))})
    d = _sides(pairs.select("s1", "s23"), r)
    glyph = lambda c: F.translate(c, HOMOGLYPH_DIGITS, HOMOGLYPH_LETTERS)
    ll, lr = F.col("legal_l"), F.col("legal_r")
    return d.select(
        "s1", "s23", F.levenshtein("n_l", "n_r").alias("name_lev"), K.normalized_levenshtein(F.col("n_l"), F.col("n_r")).alias("name_norm"), (F.col("n_an_l") == F.col("n_an_r")).cast("int").alias("name_an_eq"),
        (glyph(F.col("n_an_l")) == glyph(F.col("n_an_r"))).cast("int").alias("glyph_eq"), ll.alias("legal_a"), lr.alias("legal_b"), F.when((ll == 0) & (lr == 0), 0).when(ll == lr, 1).when((ll == 0) | (lr == 0), 3).otherwise(2).alias("legal_rel"),
        (F.length("n_l") - F.length("n_r")).alias("len_diff"), K.normalized_levenshtein(F.col("a_l"), F.col("a_r")).alias("addr_norm"), (F.col("a_an_l") == F.col("a_an_r")).cast("int").alias("addr_an_eq"),
        house_edit_kind(F.col("house_l"), F.col("house_r")).alias("house_edit"), F.abs(F.col("house_l").try_cast("long") - F.col("house_r").try_cast("long")).alias("house_offset"),
        _size(F.array_except("numbers_l", "numbers_r")).alias("nums_a_only"), _size(F.array_except("numbers_r", "numbers_l")).alias("nums_b_only"),
    )


def _folded(records: DataFrame) -> DataFrame:
    """(id, source, name, address), folded."""
    return records.select("id", "source", X.fold(F.col("name")).alias("name"), X.fold(F.col("address")).alias("address"))


def _raw_words(field: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.col(field), r"\s+"), lambda w: w != ""))


def _raw_grams(field: str) -> Column:
    return X.padded_grams(F.col(field))


def _tagged(tag: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(tag), w))


def hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """(s1, s23, key) -> (s1, s23, bucket), distinct: CRC32 of the key by the number of buckets."""
    return keys.select("s1", "s23", (F.crc32(F.col("key").cast("binary")) % buckets).alias("bucket")).distinct()


def one_side_keys(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(s1, s23, key): character 3-grams of the whole folded name or address, padded with a space on both sides, that only
    one record has, tagged with field (n, a) and side (1, 2)."""
    d = _sides(pairs.select("s1", "s23"), _folded(records).select("id", "source", _raw_grams("name").alias("n"), _raw_grams("address").alias("a")))
    only = [_tagged(f"{f}{t}", F.array_except(f"{f}_{x}", f"{f}_{y}")) for f in ("n", "a") for t, x, y in ((1, "l", "r"), (2, "r", "l"))]
    return d.select("s1", "s23", F.explode(F.concat(*only)).alias("key"))


def one_side_grams(pairs: DataFrame, records: DataFrame, buckets: int = 1 << 14) -> DataFrame:
    """(s1, s23, bucket) of ``one_side_keys``."""
    return hashed(one_side_keys(pairs, records), buckets)


def word_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Six similarities of folded names and addresses, and of the names' words, weighted by ln(records / records with the word)
    over both sides: shared weight, weight, rarest and number of those that only one record has."""
    r = _folded(records).toDF("id", "source", "n", "a")
    n1, n2, a1, a2 = (F.col(c) for c in ("n_l", "n_r", "a_l", "a_r"))
    d = _sides(pairs.select("s1", "s23"), r)
    dense = d.select(
        "s1", "s23", K.token_set_of(n1, n2).alias("name_token_set_ratio"), K.token_sort_of(n1, n2).alias("name_token_sort_ratio"), K.partial_ratio_of(n1, n2).alias("name_partial_ratio"), K.jaro_winkler_of(n1, n2).alias("name_jw"),
        K.token_set_of(a1, a2).alias("addr_token_set_ratio"), K.partial_ratio_of(a1, a2).alias("addr_partial_ratio"),
    )
    return dense.join(word_weights(pairs, records), ["s1", "s23"])


def word_weights(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(s1, s23, w_shared_idf, w_a_idf, w_b_idf, w_a_max, w_b_max, w_a_n, w_b_n) of ``word_features``."""
    r = _folded(records).select("id", "source", F.explode(_raw_words("name")).alias("w"))
    idf = r.groupBy("w").agg(F.count("*").alias("df")).join(F.broadcast(records.agg(F.count("*").alias("n")))).select("w", F.log(F.col("n") / F.col("df")).alias("idf"))
    words = _pair_words(pairs, r.join(idf, "w"))
    i, x = F.col("in"), F.col("idf")
    total = lambda c: F.sum(F.when(c, x).otherwise(0.0))
    most = lambda c: F.coalesce(F.max(F.when(c, x)), F.lit(0.0))
    g = words.groupBy("s1", "s23").agg(total(i == 3).alias("w_shared_idf"), total(i == 1).alias("w_a_idf"), total(i == 2).alias("w_b_idf"), most(i == 1).alias("w_a_max"), most(i == 2).alias("w_b_max"), F.count_if(i == 1).alias("w_a_n"), F.count_if(i == 2).alias("w_b_n"))
    return pairs.select("s1", "s23").join(g, ["s1", "s23"], "left").na.fill(0)


def one_side_words(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(s1, s23, key): words of the folded name that only one record has, tagged w1 or w2."""
    d = _sides(pairs.select("s1", "s23"), _folded(records).select("id", "source", _raw_words("name").alias("w")))
    return d.select("s1", "s23", F.explode(F.concat(_tagged("w1", F.array_except("w_l", "w_r")), _tagged("w2", F.array_except("w_r", "w_l")))).alias("key"))


CROSSED = {"name_words": ("name", _raw_words), "addr_words": ("address", _raw_words), "name_grams": ("name", _raw_grams)}


def crossed_keys(pairs: DataFrame, records: DataFrame, block: str = "name_words", most: int = 64) -> DataFrame:
    """(s1, s23, key): words or grams of one record only (a, b), and their cross pairs (x) where there are at most ``most``."""
    field, split = CROSSED[block]
    d = _sides(pairs.select("s1", "s23"), _folded(records).select("id", "source", split(field).alias("n")))
    d = d.select("s1", "s23", F.array_except("n_l", "n_r").alias("a"), F.array_except("n_r", "n_l").alias("b"))
    cross = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.concat(F.lit("x"), x, F.lit("|"), y))))
    single = F.concat(_tagged("a", F.col("a")), _tagged("b", F.col("b")))
    return d.select("s1", "s23", F.explode(F.when(F.size("a") * F.size("b") <= most, F.concat(single, cross)).otherwise(single)).alias("key"))


def crossed_words(pairs: DataFrame, records: DataFrame, block: str = "name_words", most: int = 64, buckets: int = 1 << 18) -> DataFrame:
    """(s1, s23, bucket) of ``crossed_keys``."""
    return hashed(crossed_keys(pairs, records, block, most), buckets)


def text_bytes(records: DataFrame, length: int = 96) -> DataFrame:
    """(id, source, bytes): core, a bar, words and numbers in UTF-8, cut or filled with zeros to ``length`` bytes."""
    part = lambda c: F.array_join(F.coalesce(c, F.array()), " ")
    text = F.concat(F.coalesce("core", F.lit("")), F.lit(" | "), part("words"), F.lit(" "), part("numbers"))
    raw = F.substring(F.encode(text, "UTF-8"), 1, length)
    zeros = F.lit(bytes(length))
    return records.select("id", "source", F.substring(F.concat(raw, zeros), 1, length).alias("bytes"))
