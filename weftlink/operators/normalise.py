"""Records to tokens, name and address features; transliteration learned from links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.functions import text as X

INDIC = r"[ऀ-෿]"


def _words(name: str = "name") -> F.Column:
    return F.transform(X.tokens(X.fold(F.col(name))), X.unglyph)


def _translated(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, words): the words of ``records``, with runs and words of ``dictionary`` (token, latin) replaced. Both are joined:
    a run's entry by its first word, so neither the dictionary nor its phrases travel to every task."""
    words = F.split("token", " ")
    # longest runs first; an entry is the run, a tab and what replaces it, a line each
    entry = F.struct((-F.size(words)).alias("n"), F.concat("token", F.lit("\t"), "latin").alias("line"))
    options = dictionary.select(words[0].alias("word"), entry.alias("o")).groupBy("word").agg(F.array_sort(F.collect_list("o")).alias("o"))
    options = options.select("word", F.array_join(F.transform("o", lambda o: o["line"]), "\n").alias("options"))
    at = records.select("id", F.posexplode(_words()).alias("pos", "word")).join(options, "word", "left")
    g = at.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "options"))).alias("w"))
    return g.select("id", replaced(F.transform("w", lambda x: x["word"]), F.transform("w", lambda x: F.coalesce(x["options"], F.lit("")))).alias("words"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def replaced(words: pd.Series, options: pd.Series) -> pd.Series:
    """Runs of words replaced by one word, longest first from the left. ``options``: for each word the runs that begin with
    it, longest first, as lines of run, tab and replacement."""

    def one(w, o):
        w, out, i = list(w), [], 0
        while i < len(w):
            n, new = 1, w[i]
            for line in filter(None, o[i].split("\n")):
                run, latin = line.split("\t")
                run = run.split(" ")
                if w[i : i + len(run)] == run:
                    n, new = len(run), latin
                    break
            out.append(new)
            i += n
        return out

    return pd.Series([one(w, o) for w, o in zip(words, options, strict=True)])


def with_words(records: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Records with ``name_words``: folded words of the name, digits that stand for letters read as letters, words and runs
    of ``dictionary`` replaced. Only names with a letter of an Indic script meet the dictionary: its tokens are of those."""
    d = records.withColumn("name_words", _words())
    if dictionary is None:
        return d
    other = F.col("name").rlike(INDIC)
    plain, rest = d.filter(~F.coalesce(other, F.lit(False))), records.filter(other)
    return plain.unionByName(rest.join(_translated(rest, dictionary).withColumnRenamed("words", "name_words"), "id", "left"))


def name_tokens(records: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, token, position): the name's words without those that carry no identity; positions count all words."""
    return with_words(records, dictionary).select("id", F.posexplode("name_words").alias("position", "token")).filter(X.meaningful(F.col("token"))).select("id", "token", "position")


def with_fields(records: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Records with core (sorted distinct tokens), compact (all tokens in order run together; both null of no token), numbers,
    words, house and street (the longest word until frequencies are known). All are functions of the row."""
    tokens = F.filter("name_words", X.meaningful)
    some = F.size("wl_t") > 0
    d = with_words(records, dictionary).withColumns({"wl_t": F.coalesce(tokens, F.array().cast("array<string>")), "wl_a": X.fold(F.col("address"))})
    d = d.withColumns({"numbers": X.numbers(F.col("wl_a")), "wl_every": X.street_words(F.col("wl_a"))})
    return d.withColumns({
        "core": F.when(some, F.array_join(F.array_sort(F.array_distinct("wl_t")), " ")), "compact": F.when(some, F.array_join("wl_t", "")),
        "words": F.slice("wl_every", 1, 6), "house": F.get("numbers", F.lit(0)), "street": X.longest(F.col("wl_every")),
    }).drop("name_words", "wl_t", "wl_a", "wl_every")


def frequent_words(records: DataFrame, share: float = 0.002) -> DataFrame:
    """(country, word, share) of address words in at least ``share`` of a country's records, all sides together."""
    n = records.groupBy("country").agg(F.count("*").alias("n"))
    c = records.select("country", F.explode("words").alias("word")).groupBy("country", "word").agg(F.count("*").alias("c"))
    return c.join(n, "country").filter(F.col("c") >= share * F.col("n")).select("country", "word", (F.col("c") / F.col("n")).alias("share"))


def refine_street(records: DataFrame, frequent: DataFrame) -> DataFrame:
    """The street as the longest of the words that isn't frequent, the first of equals; null of none. A word is frequent in
    at least a share of a country's records, so a country has at most the words of a record by that share of them: the
    lists are broadcast."""
    lists = frequent.groupBy("country").agg(F.collect_list("word").alias("wl_frequent"))
    d = records.drop("street").join(F.broadcast(lists), "country", "left")
    rest = F.filter("words", lambda w: ~F.coalesce(F.array_contains("wl_frequent", w), F.lit(False)))
    return d.withColumn("street", X.longest(rest)).drop("wl_frequent")


def normalise(records: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Records (id, source, country, name, address) with core, compact, numbers, words, house and refined street."""
    base = with_fields(records, dictionary)
    return refine_street(base, frequent_words(base))


def learn_transliteration(names: DataFrame) -> DataFrame:
    """(token, latin) from linked names (left, right): right in an Indic script without Latin letters, equally many
    words; each Indic word goes to its most frequent Latin partner, the first by name of equals."""
    both = names.select(X.tokens(X.fold(F.col("left"))).alias("l"), X.tokens(X.fold(F.col("right"))).alias("r"), "right")
    both = both.filter(F.col("right").rlike(INDIC) & ~F.lower("right").rlike("[a-z]") & (F.size("l") == F.size("r")))
    pairs = both.select(F.explode(F.arrays_zip("l", "r")).alias("p")).select(F.col("p.r").alias("token"), F.col("p.l").alias("latin"))
    counts = pairs.filter(F.col("token").rlike(INDIC) & F.col("latin").rlike("^[a-z]+$")).groupBy("token", "latin").count()
    first = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("count"), "latin"))
    return counts.withColumn("r", first).filter("r = 1").select("token", "latin")


def learn_phrases(names: DataFrame, dictionary: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(token, latin): a run of Indic words without a translation, and the one left word no translation covers. Votes
    of links with exactly one such run and word; kept with ``least`` votes and ``share`` of the run's."""
    ids = names.select(F.xxhash64("left", "right").alias("id"), X.tokens(X.fold(F.col("left"))).alias("l"), X.tokens(X.fold(F.col("right"))).alias("r")).dropDuplicates(["id"])
    words = ids.select("id", F.posexplode("r").alias("pos", "token")).join(dictionary, "token", "left")
    free = words.filter(F.col("latin").isNull() & F.col("token").rlike(INDIC))
    run = free.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    runs = run.groupBy("id").agg(F.count_distinct("island").alias("islands"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " ").alias("token"))
    covered = words.groupBy("id").agg(F.collect_set("latin").alias("have"))
    left = ids.join(covered, "id").select("id", F.array_except("l", "have").alias("rest")).filter(F.size("rest") == 1).select("id", F.get("rest", F.lit(0)).alias("latin"))
    votes = runs.filter("islands = 1").join(left, "id").groupBy("token", "latin").count()
    total = F.sum("count").over(Window.partitionBy("token"))
    best = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("count"), "latin"))
    return votes.withColumn("total", total).withColumn("r", best).filter((F.col("r") == 1) & (F.col("count") >= least) & (F.col("count") >= share * F.col("total"))).select("token", "latin")
