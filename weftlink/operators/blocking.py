"""Candidate pairs from capped blocks: key families, siblings, name pairs, address bigrams, word deletion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import kernels as K
from weftlink.functions import text as X

CAP_S1, CAP_S23 = 10, 30


@dataclass(frozen=True)
class Family:
    """A blocking key: parts of a record, single values or one of a list each."""

    name: str
    parts: tuple[str, ...]
    cap_s1: int = CAP_S1
    cap_s23: int = CAP_S23


FAMILIES = (
    Family("core", ("core",)),
    Family("core_house", ("core", "house")),
    Family("compact", ("compact",)),
    Family("token_number", ("token", "number")),
    Family("number_street", ("number", "street")),
    Family("token_street", ("token", "street")),
    Family("prefix_number", ("prefix", "number")),
    Family("core_word", ("core", "word")),
    Family("rare_token_word", ("rare", "word")),
    Family("prefix_word", ("prefix", "word")),
    Family("number_word", ("number", "word"), 3, 8),
)
LISTS = {"token": "tokens", "number": "key_numbers", "word": "words", "rare": "rare"}


def key_parts(records: DataFrame) -> DataFrame:
    """Records with what keys are made of: tokens of three letters and more, the three rarest of a record (counted over
    both sides), long compacts and their first eight letters, numbers (reference records only their first)."""
    tok = F.filter(F.split(F.coalesce("core", F.lit("")), " "), lambda t: F.length(t) >= 3)
    r = records.withColumn("tokens", tok)
    long = r.select("id", "source", "country", F.explode("tokens").alias("token"))
    n = long.groupBy("country", "token").agg(F.count("*").alias("n"))
    three = F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), 1, 3)
    rare = long.join(n, ["country", "token"]).groupBy("id", "source").agg(F.array_sort(F.transform(three, lambda t: t["token"])).alias("rare"))
    six = F.length("compact") >= 6
    return r.join(rare, ["id", "source"], "left").select(
        "id", "source", "country", F.nullif("core", F.lit("")).alias("core"), F.when(six, F.col("compact")).alias("compact"), F.when(six, F.substring("compact", 1, 8)).alias("prefix"),
        "house", "street", F.when(F.col("source") == 1, F.slice("numbers", 1, 1)).otherwise(F.col("numbers")).alias("key_numbers"), "words", "tokens", "rare",
    )


def family_keys(parts: DataFrame, families: tuple[Family, ...]) -> DataFrame:
    """(id, source, country, family, k0, k1): every key of every family, by its place in ``families``; records without one of
    a family's parts have none of its keys. One row of parts gives all of its keys at once."""

    def values(part: str) -> F.Column:
        every = F.coalesce(part, F.array().cast("array<string>")) if part in LISTS.values() else F.array(part)
        return F.filter(every, lambda v: v.isNotNull())

    def keys(i: int, f: Family) -> F.Column:
        first, *more = [values(LISTS.get(p, p)) for p in f.parts]
        second = more[0] if more else F.array(F.lit(""))
        return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.struct(F.lit(i).alias("family"), a.alias("k0"), b.alias("k1")))))

    every = F.array_distinct(F.concat(*[keys(i, f) for i, f in enumerate(families)]))
    return parts.filter("country is not null").select("id", "source", "country", F.explode(every).alias("k")).select("id", "source", "country", "k.*")


def capped_pairs(keys: DataFrame, families: tuple[Family, ...]) -> DataFrame:
    """(family, s1, s23) of all blocks within their family's caps; a pair of several keys comes several times. One aggregate
    counts both sides, so a key that is too frequent is gone before any pair is made; what is left of a block has at most
    its caps' ids."""
    on = ["country", "family", "k0", "k1"]
    cap = lambda name: F.get(F.array(*[F.lit(getattr(f, name)) for f in families]), F.col("family"))
    reference = F.col("source") == 1
    size = keys.groupBy(*on).agg(F.count_if(reference).alias("n1"), F.count_if(~reference).alias("n2"))
    allowed = size.filter((F.col("n1") > 0) & (F.col("n1") <= cap("cap_s1")) & (F.col("n2") > 0) & (F.col("n2") <= cap("cap_s23"))).select(*on)
    blocks = keys.join(allowed, on, "left_semi").groupBy(*on).agg(F.collect_list(F.when(reference, F.col("id"))).alias("a"), F.collect_list(F.when(~reference, F.col("id"))).alias("b"))
    return blocks.select("family", F.explode("a").alias("s1"), "b").select("family", "s1", F.explode("b").alias("s23"))


def block(parts: DataFrame, family: Family) -> DataFrame:
    return capped_pairs(family_keys(parts, (family,)), (family,)).select("s1", "s23").distinct()


def union_with_flags(parts: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """(s1, s23, f_<family> ..., n_families): all families' pairs, which families found each and how many. All families go
    through the same three shuffles: keys counted, keys met, pairs met."""
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(len(families))]), F.col("family"))
    mask = capped_pairs(family_keys(parts, families), families).groupBy("s1", "s23").agg(F.bit_or(bit).alias("mask"))
    flags = [(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0).alias(f"f_{f.name}") for i, f in enumerate(families)]
    return mask.select("s1", "s23", *flags, F.bit_count("mask").alias("n_families"))


def uncapped_reach(parts: DataFrame, truth: DataFrame, families: tuple[Family, ...] = FAMILIES, links: int = 300_000) -> DataFrame:
    """(family, links, reached): of at most ``links`` true links, chosen by a hash, how many share a key of the family whatever
    its block's size."""
    sample = truth.select("s1", "s23").distinct().orderBy(F.xxhash64("s1", "s23"), "s1", "s23").limit(links)
    keys = family_keys(parts, families)
    on = ["family", "k0", "k1"]
    left = sample.join(keys.filter("source = 1").select(F.col("id").alias("s1"), *on), "s1")
    right = sample.join(keys.filter("source <> 1").select(F.col("id").alias("s23"), *on), "s23")
    met = left.join(right, ["s1", "s23", *on]).select("family", "s1", "s23").distinct().groupBy("family").agg(F.count("*").alias("reached"))
    names = F.array(*[F.struct(F.lit(i).alias("family"), F.lit(f.name).alias("name")) for i, f in enumerate(families)])
    return sample.agg(F.count("*").alias("links")).select(F.explode(names).alias("f"), "links").select("f.*", "links").join(met, "family", "left").select(F.col("name").alias("family"), "links", F.coalesce("reached", F.lit(0)).alias("reached"))


def union_growth(flags: DataFrame, truth: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """(step, family, pairs, found): pairs and true links of the first families together, one more at a time."""
    d = flags.join(truth.select("s1", "s23").distinct().withColumn("hit", F.lit(1)), ["s1", "s23"], "left")
    upto = lambda i: F.greatest(*[F.col(f"f_{f.name}") for f in families[: i + 1]], F.lit(False))
    sums = d.agg(*[F.count_if(upto(i)).alias(f"p{i}") for i in range(len(families))], *[F.count_if(upto(i) & F.col("hit").isNotNull()).alias(f"h{i}") for i in range(len(families))])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(f.name).alias("family"), F.col(f"p{i}").alias("pairs"), F.col(f"h{i}").alias("found")) for i, f in enumerate(families)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def recall_report(pairs: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """Per country: links, links found, recall, pairs and the oracle's F0.5 (all found links kept, nothing else)."""
    t = truth.join(s1.select(F.col("id").alias("s1"), "country"), "s1")
    hit = t.join(pairs.withColumn("hit", F.lit(1)), ["s1", "s23"], "left")
    per = hit.groupBy("country", "s1").agg(F.count("*").alias("n"), F.count("hit").alias("tp"))
    every = s1.select(F.col("id").alias("s1"), "country").join(per, ["country", "s1"], "left").na.fill(0, ["n", "tp"])
    f = F.when(F.col("n") == 0, 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (F.col("tp") + 0.25 * F.col("n")))
    return every.groupBy("country").agg(F.sum("n").alias("links"), F.sum("tp").alias("found"), F.round(F.try_divide(F.sum("tp").cast("double"), F.sum("n")), 6).alias("recall"), F.round(F.avg(f), 6).alias("oracle_f05"))


def siblings(confident: DataFrame, records: DataFrame, known: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """Other noisy records of the blocks of confident links (s1, s23, p): (s1, s23, sib_p, sib_n, n_keys, sib_core,
    sib_house_street, sib_first_house). Blocks are country and core, house and street, or first token and house."""
    r = records.filter("source <> 1")
    house = F.coalesce("house", F.lit(""))
    keys = [
        r.filter("core <> ''").select("id", "country", F.lit("core").alias("kind"), F.col("core").alias("key")),
        r.filter("house is not null and street is not null").select("id", "country", F.lit("house_street").alias("kind"), F.concat("house", F.lit("|"), "street").alias("key")),
        r.filter("core <> ''").select("id", "country", F.lit("first_house").alias("kind"), F.concat(F.get(F.split("core", " "), F.lit(0)), F.lit("|"), house).alias("key")),
    ]
    k = keys[0].unionByName(keys[1]).unionByName(keys[2])
    on = ["country", "kind", "key"]
    ok = k.join(k.groupBy(*on).count().filter(F.col("count").between(least, most)).select(*on), on, "left_semi")
    mine = confident.join(ok.withColumnRenamed("id", "s23"), "s23").select("s1", F.col("s23").alias("from"), "p", *on)
    found = mine.join(ok.withColumnRenamed("id", "s23"), on).filter("s23 <> from").join(known.select("s1", "s23"), ["s1", "s23"], "left_anti")
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    return found.groupBy("s1", "s23").agg(
        F.max("p").alias("sib_p"), F.count("*").alias("sib_n"), F.count_distinct("kind").alias("n_keys"), has("core").alias("sib_core"), has("house_street").alias("sib_house_street"), has("first_house").alias("sib_first_house")
    )


def name_pairs(records: DataFrame, known: DataFrame, cap_s1: int = CAP_S1, cap_s23: int = CAP_S23) -> DataFrame:
    """Pairs for noisy records without an address, by any two tokens of the name: (s1, s23, np_keys, np_n1, np_n2)."""
    bare = (F.coalesce(F.size("numbers"), F.lit(0)) == 0) & (F.coalesce(F.size("words"), F.lit(0)) == 0)
    t = F.array_distinct(F.split("core", " "))
    r = records.filter((F.col("core") != "") & ((F.col("source") == 1) | bare) & (F.size(t) <= 6)).select("id", "source", "country", t.alias("t"))
    two = r.select("id", "source", "country", F.explode(F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.concat(a, F.lit(" "), b))))).alias("key"))
    n = two.groupBy("country", "key").agg(F.count_if(F.col("source") == 1).alias("n1"), F.count_if(F.col("source") != 1).alias("n2")).filter(F.col("n1").between(1, cap_s1) & F.col("n2").between(1, cap_s23))
    k = two.join(n, ["country", "key"])
    pairs = k.filter("source = 1").select("country", "key", F.col("id").alias("s1"), "n1", "n2").join(k.filter("source <> 1").select("country", "key", F.col("id").alias("s23")), ["country", "key"])
    return pairs.join(known.select("s1", "s23"), ["s1", "s23"], "left_anti").groupBy("s1", "s23").agg(F.count("*").alias("np_keys"), F.min("n1").alias("np_n1"), F.min("n2").alias("np_n2"))


def address_bigrams(records: DataFrame) -> DataFrame:
    """(id, source, country, key): adjacent address words of records with an address."""
    r = records.filter(~X.has_no_address(F.col("address")))
    return r.select("id", "source", "country", F.explode(X.bigrams(X.address_tokens(F.col("address")))).alias("key"))


def address_only_pairs(records: DataFrame, max_key: int = 30, least: int = 2, top: int = 5) -> DataFrame:
    """(s23, s1, shared, rank): the ``top`` reference records by shared address bigrams whose reference block is small."""
    k = address_bigrams(records)
    k1 = k.filter("source = 1")
    k1 = k1.join(k1.groupBy("country", "key").count().filter(F.col("count") <= max_key).select("country", "key"), ["country", "key"], "left_semi")
    p = k1.select("country", "key", F.col("id").alias("s1")).join(k.filter("source <> 1").select("country", "key", F.col("id").alias("s23")), ["country", "key"])
    p = p.groupBy("s23", "s1").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("s23").orderBy(F.desc("shared"), "s1"))).filter(F.col("rank") <= top)


def address_only_match(records: DataFrame, max_key: int = 30) -> DataFrame:
    """The address-only pairs with similarity scores, context per record, and ``addr`` of at least 60."""
    p = address_only_pairs(records, max_key).drop("rank")
    norm = records.select("id", F.array_join(X.address_tokens(F.col("address")), " ").alias("a"), X.clean(F.col("name")).alias("n"))
    p = p.join(norm.select(F.col("id").alias("s1"), F.col("a").alias("a1"), F.col("n").alias("n1")), "s1").join(norm.select(F.col("id").alias("s23"), F.col("a").alias("a2"), F.col("n").alias("n2")), "s23")
    p = p.select("s23", "s1", "shared", K.token_set_of(F.col("a1"), F.col("a2")).alias("addr"), K.token_sort_of(F.col("a1"), F.col("a2")).alias("addr_sort"), K.token_set_of(F.col("n1"), F.col("n2")).alias("name"))
    w, o = Window.partitionBy("s23"), Window.partitionBy("s23").orderBy(F.desc("addr"), "s1")
    p = p.withColumns({"top_addr": F.max("addr").over(w), "rank": F.row_number().over(o), "n_cand": F.count("*").over(w)})
    p = p.withColumns({"n_close": F.count_if(F.col("addr") >= F.col("top_addr") - 5).over(w), "second_addr": F.max(F.when(F.col("rank") == 2, F.col("addr"))).over(w)})
    return p.filter("addr >= 60")


def word_deletion_pairs(records: DataFrame, max_key: int = 30) -> DataFrame:
    """(s23, s1, exact_key): noisy records and reference records that share a name core, or one without a word."""
    cores = records.select("id", "source", "country", X.name_core(F.col("name")).alias("core"))
    keys = cores.select("id", "source", "country", F.explode(X.core_keys(F.col("core"))).alias("k")).select("id", "source", "country", "k.key", "k.exact")
    keys = keys.groupBy("id", "source", "country", "key").agg(F.bool_or("exact").alias("exact"))
    k1 = keys.filter("source = 1")
    k1 = k1.join(k1.groupBy("country", "key").count().filter(F.col("count") <= max_key).select("country", "key"), ["country", "key"], "left_semi")
    both = k1.select("country", "key", F.col("id").alias("s1"), F.col("exact").alias("e1")).join(keys.filter("source <> 1").select("country", "key", F.col("id").alias("s23"), "exact"), ["country", "key"])
    return both.groupBy("s23", "s1").agg(F.bool_or(F.col("e1") & F.col("exact")).alias("exact_key"))


def word_deletion_match(records: DataFrame, max_key: int = 30, top: int = 3) -> DataFrame:
    """Word-deletion pairs with name scores and context, the ``top`` per record by core ratio and half the name ratio."""
    n = records.select("id", X.name_core(F.col("name")).alias("c"), X.clean(F.col("name")).alias("l"))
    p = word_deletion_pairs(records, max_key).join(n.select(F.col("id").alias("s1"), F.col("c").alias("c1"), F.col("l").alias("l1")), "s1").join(n.select(F.col("id").alias("s23"), F.col("c").alias("c2"), F.col("l").alias("l2")), "s23")
    p = p.withColumns({"core_ratio": K.ratio_of(F.col("c1"), F.col("c2")), "name_ratio": K.ratio_of(F.col("l1"), F.col("l2")), "name_sort": K.token_sort_of(F.col("l1"), F.col("l2")), "w1": F.size(F.split("c1", " ")), "w2": F.size(F.split("c2", " "))})
    p = p.withColumns({"dw": F.col("w2") - F.col("w1"), "s": F.col("core_ratio") + 0.5 * F.col("name_ratio")})
    w, o = Window.partitionBy("s23"), Window.partitionBy("s23").orderBy(F.desc("s"), "s1")
    p = p.withColumns({"rank": F.row_number().over(o), "n_cand": F.count("*").over(w), "core_best": F.max("core_ratio").over(w), "best": F.max("s").over(w)})
    p = p.withColumns({"n_close": F.count_if(F.col("s") >= F.col("best") - 5).over(w), "core_second": F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("core_ratio"))).over(w), F.lit(0.0))})
    return p.filter(F.col("rank") <= top).drop("c1", "c2", "l1", "l2", "s", "best")


def same_core_groups(records: DataFrame, most: int = 50) -> DataFrame:
    """(s23, s1, k): noisy records without an address and the reference records of their country with the same name
    core, where at most ``most`` have it; ``k``: how many."""
    c = records.select("id", "source", "country", "address", X.name_core(F.col("name")).alias("core")).filter("core <> ''")
    k = c.filter("source = 1").withColumn("k", F.count("*").over(Window.partitionBy("country", "core"))).filter(F.col("k") <= most)
    return c.filter((F.col("source") != 1) & X.has_no_address(F.col("address"))).select(F.col("id").alias("s23"), "country", "core").join(k.select("country", "core", F.col("id").alias("s1"), "k"), ["country", "core"]).select("s23", "s1", "k")


