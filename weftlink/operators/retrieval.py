"""Nearest reference records: sparse TF-IDF cosine over an inverted index, dense cosine in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import text as X


STRIP = 1024  # queries of a square that are multiplied at a time


def trigram_top(reference: DataFrame, queries: DataFrame, k: int = 1, most_df: int | None = None, block_rows: int = 4096, block_grams: int = 1 << 19) -> DataFrame:
    """(s23, s1, rank, cos, cos_next, gap): the ``k`` reference texts of a query's country with the largest cosine of
    word-bounded trigrams, of equal ones the least id. IDF is ln((n + 1) / (df + 1)) + 1 over the country's reference texts;
    every trigram counts, unless the caller's measure has products only of those in at most ``most_df`` texts (norms still
    count all). Both tables have id, country, text; null texts are out, and ids are unique in a table.
    Equal texts of a country are compared once and their ids joined to the outcome. Texts are cut to blocks of about
    ``block_rows`` and, where they are long, ``block_grams`` trigrams; every block of queries meets every block of its
    country's reference texts in a square of its own, keeps the best there, and a window merges them. So no pair is shuffled
    and a trigram that many texts have is no single task's; the work is that of all pairs of a country's different texts.
    """
    # planned by file sizes, tables of trigrams or of all ids would seem small enough to broadcast, so their joins are sorted
    has_text = lambda d: d.filter("text is not null").select("id", "country", "text")
    reference, queries = has_text(reference), has_text(queries)
    named = lambda d: d.filter("id is not null")
    texts = lambda d, name: d.groupBy("country", "text").agg(F.min("id").alias(name), F.count("*").alias("copies"))
    grams = lambda d, name: d.select(name, "country", "copies", F.explode(X.char_grams(F.col("text"))).alias("g")).hint("merge")
    rt, qt = texts(reference, "s1"), texts(queries, "s23")
    r, q = grams(rt, "s1"), grams(qt, "s23")
    sized = lambda d, of_reference: d.select("country", "copies", F.length("text").alias("long"), F.lit(of_reference).alias("r"))
    blocks = lambda which: F.ceil(F.greatest(F.count(F.when(which, 1)) / block_rows, F.sum(F.when(which, F.col("long"))) / block_grams)).cast("int")
    n = sized(rt, True).unionByName(sized(qt, False)).groupBy("country").agg(F.sum(F.when(F.col("r"), F.col("copies"))).alias("n"), blocks(F.col("r")).alias("nr"), blocks(~F.col("r")).alias("nq"))
    idf = r.groupBy("country", "g").agg(F.sum("copies").alias("df")).join(n, "country").select("country", "g", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("w"), "nr", "nq")
    counts = F.lit(True) if most_df is None else F.col("df") <= most_df

    def vectors(d: DataFrame, name: str) -> DataFrame:
        d = d.filter(F.col(name).isNotNull()).join(idf, ["country", "g"]).groupBy("country", name)
        some = lambda c: F.collect_list(F.when(counts, F.col(c))).alias(c)
        d = d.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), some("g"), some("w"), F.first("nr").alias("nr"), F.first("nq").alias("nq"))
        return d.filter((F.size("g") > 0) & (F.col("nq") > 0))

    mine = lambda name, m: F.pmod(F.xxhash64(name), F.col(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    held = vectors(r, "s1").select(F.col("country").alias("country"), mine("s1", "nr").alias("rb"), all_of("nq").alias("qb"), "s1", "norm", "g", "w")
    asked = vectors(q, "s23").select(F.col("country").alias("country"), all_of("nr").alias("rb"), mine("s23", "nq").alias("qb"), "s23", "norm", "g", "w")
    keys = ["country", "rb", "qb"]
    kinds = f"s23 {asked.schema['s23'].dataType.simpleString()}, s1 {held.schema['s1'].dataType.simpleString()}, cos double"
    cos = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda a, b: _best_of_square(a, b, k + 1), kinds)
    best = Window.partitionBy("s23").orderBy(F.desc("cos"), "s1")
    first = lambda d: d.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
    # a text's least id stands for it, so the best ids are among the least ones of the best texts
    upto = Window.partitionBy("country", "text").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = named(reference).select("id", F.min("id").over(upto).alias("s1"), F.row_number().over(upto).alias("nth")).filter(F.col("nth") <= k + 1).select("id", "s1").hint("merge")
    top = first(first(cos).drop("rank").join(least, "s1").select("s23", F.col("id").alias("s1"), "cos"))
    nxt = F.coalesce(F.lead("cos").over(best), F.lit(0.0))
    top = top.withColumn("cos_next", nxt).filter(F.col("rank") <= k).withColumn("gap", F.round(F.col("cos") - F.col("cos_next"), 6))
    whole = top.join(qt.select("s23", "country", "text").hint("merge"), "s23").drop("s23").join(named(queries).hint("merge"), ["country", "text"])
    return whole.select(F.col("id").alias("s23"), "s1", "cos", "rank", "cos_next", "gap")


def _best_of_square(asked: pd.DataFrame, held: pd.DataFrame, most: int) -> pd.DataFrame:
    """(s23, s1, cos): of each query the ``most`` texts with the largest cosine among those that share a trigram, of equal
    ones the least id. Rows have an id, norm, trigrams g and their weights w, which depend on the trigram only."""
    if not len(asked) or not len(held):
        return pd.DataFrame({"s23": [], "s1": [], "cos": []})
    held = held.sort_values("s1")
    code, names = pd.factorize(np.concatenate([*held["g"], *asked["g"]]))
    weight = np.zeros(len(names))
    weight[code] = np.concatenate([*held["w"], *asked["w"]])
    n, per_text = len(held), held["g"].str.len().to_numpy()

    def postings(code: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by trigram, and where each trigram's begin."""
        row = np.repeat(np.arange(len(per_text)), per_text.astype(int))
        return row[np.argsort(code, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(names)))])

    rows, begin = postings(code[: per_text.sum()], per_text)
    code, per_query = code[per_text.sum() :], asked["g"].str.len().to_numpy()
    ends = np.concatenate([[0], np.cumsum(per_query)])
    norm, norms = asked["norm"].to_numpy(), held["norm"].to_numpy()
    s23, s1, out = asked["s23"].to_numpy(), held["s1"].to_numpy(), []
    for lo in range(0, len(asked), STRIP):
        m = min(STRIP, len(asked) - lo)
        wanted, start = postings(code[ends[lo] : ends[lo + m]], per_query[lo : lo + m])
        dot, pairs = np.zeros((m, n)), np.diff(start) * np.diff(begin)
        often = pairs * 64 > m * n  # those a matrix product adds sooner
        for g in np.flatnonzero((pairs > 0) & ~often):
            dot[wanted[start[g] : start[g + 1], None], rows[begin[g] : begin[g + 1]]] += weight[g] * weight[g]
        often = np.flatnonzero(often)
        for at in range(0, len(often), 256):
            some = often[at : at + 256]
            x, y = np.zeros((m, len(some))), np.zeros((len(some), n))
            for i, g in enumerate(some):
                x[wanted[start[g] : start[g + 1]], i] = y[i, rows[begin[g] : begin[g + 1]]] = weight[g]
            dot += x @ y
        # one number orders a query's texts: millionths of the cosine, one more where a trigram is shared, then the least id
        order = np.rint(dot / (norm[lo : lo + m, None] * norms) * 1e6).astype(np.int64) + (dot > 0)
        order = order * n + np.arange(n)[::-1]
        top = np.partition(order, n - most, axis=1)[:, n - most :] if n > most else order
        who, which = np.nonzero(top >= n)
        top = top[who, which]
        out.append(pd.DataFrame({"s23": s23[lo + who], "s1": s1[n - 1 - top % n], "cos": (top // n - 1) / 1e6}))
    return pd.concat(out)


def _usable(c: str) -> Column:
    """Vectors whose components are all finite, not all of them zero."""
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(c).isNotNull() & finite & F.exists(c, lambda v: v != 0), F.lit(False))


def dense_top(pool: DataFrame, queries: DataFrame, k: int = 3, block_rows: int = 4096) -> DataFrame:
    """(s23, rank, s1, cos): the ``k`` most similar pool vectors of each query's group, of equal ones the least id. Both
    tables have id, grp, vector; vectors that are null, zero or not finite, and those of null groups, are left out, and
    vectors of different lengths aren't compared. Pool and queries are cut to blocks of about ``block_rows``; every block
    of queries meets every block of its group's pool in a square of its own, keeps k there, and a window merges them:
    the work is that of all pairs of a group, the memory that of two blocks. For a large pool take the multi-index of the
    vector deduplication; this search is exact."""
    good = lambda d: d.select("id", F.struct("grp", F.size("vector").alias("dim")).alias("grp"), F.col("vector").cast("array<double>").alias("vector")).filter(F.col("grp.grp").isNotNull() & _usable("vector"))
    p, q = good(pool), good(queries)
    blocks = lambda d, name: d.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    sizes = blocks(p, "np").join(blocks(q, "nq"), "grp")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(sizes, "grp").select("grp", mine("np").alias("pb"), all_of("nq").alias("qb"), F.col("id").alias("pid"), F.col("vector").alias("pv"))
    q = q.join(sizes, "grp").select("grp", all_of("np").alias("pb"), mine("nq").alias("qb"), F.col("id").alias("qid"), F.col("vector").alias("qv"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"s23": [], "s1": [], "cos": []})

        def unit(s: pd.Series) -> np.ndarray:
            m = np.stack(s.to_numpy()).astype(float)
            m /= np.abs(m).max(axis=1, keepdims=True)
            return m / np.linalg.norm(m, axis=1, keepdims=True)

        a = a.sort_values("pid")
        x, y, out = unit(a["pv"]), unit(b["qv"]), []
        pid, qid = a["pid"].to_numpy(), b["qid"].to_numpy()
        for lo in range(0, len(y), 1024):
            c = np.round(y[lo : lo + 1024] @ x.T, 6)
            c[qid[lo : lo + 1024, None] == pid[None]] = -2
            top = np.argsort(-c, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(top)), top.shape[1])
            out.append(pd.DataFrame({"s23": qid[lo + rows], "s1": pid[top.ravel()], "cos": c[rows, top.ravel()]}))
        d = pd.concat(out)
        return d[d["cos"] > -2]

    keys = ["grp", "pb", "qb"]
    found = p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(best, "s23 long, s1 long, cos double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("s23").orderBy(F.desc("cos"), "s1"))).filter(F.col("rank") <= k).select("s23", "rank", "s1", "cos")


def frontier_sizes(found: DataFrame, truth: DataFrame, cuts: tuple[float, ...], score: str = "cos") -> DataFrame:
    """(rank, cut, pairs, true_pairs): the pairs of the first ranks at each cut, and how many of them are links."""
    hit = found.join(truth.select("s1", "s23").distinct().withColumn("hit", F.lit(1)), ["s1", "s23"], "left")
    d = hit.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts]))).filter(F.col(score) >= F.col("cut"))
    d = d.groupBy("cut", "rank").agg(F.count("*").alias("n"), F.count("hit").alias("t"))
    up = Window.partitionBy("cut").orderBy("rank")  # as many rows as ranks
    return d.select("rank", "cut", F.sum("n").over(up).alias("pairs"), F.sum("t").over(up).alias("true_pairs"))
