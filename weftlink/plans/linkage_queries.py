"""Queries over the derived linkage problem, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.functions import kernels as K
from weftlink.functions import text as X
from weftlink.functions.words import ADDRESS_WORDS, NAME_FILLER
from weftlink.operators import blocking as B
from weftlink.operators import channel as C
from weftlink.operators import decide as D
from weftlink.operators import features as P
from weftlink.operators import models as M
from weftlink.operators import normalise as N
from weftlink.operators import retrieval as R
from weftlink.operators import rounds as O
from weftlink.plans.fixture import NORMALISED_SQL, PARTS_SQL, RECORDS_SQL, TOKENS_SQL, family_sql, linkage, normalised
from weftlink.session import settled
from weftlink.sources import tables as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _joined(c: str) -> F.Column:
    return F.array_join(F.coalesce(c, F.array()), " ").alias(c)


@query(f"WITH {RECORDS_SQL} SELECT id, source, country, name, address FROM records")
def linkage_records(spark: SparkSession, d: str) -> DataFrame:
    return linkage(spark, d).records


@query(f"WITH {TOKENS_SQL} SELECT id, source, position, token FROM tokens")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    r = linkage(spark, d).records.withColumn("id", F.struct("id", "source"))
    return N.name_tokens(r).select("id.id", "id.source", F.col("position").cast("long").alias("position"), "token")


@query(f"WITH {NORMALISED_SQL} SELECT id, source, core, compact, array_to_string(coalesce(numbers, []), ' ') AS numbers, array_to_string(coalesce(words, []), ' ') AS words, house, street FROM norm")
def normalised_records(spark: SparkSession, d: str) -> DataFrame:
    return normalised(spark, d).records.select("id", "source", "core", "compact", _joined("numbers"), _joined("words"), "house", "street")


@query(f"WITH {NORMALISED_SQL} SELECT country, word, round(share, 6) AS share FROM freq")
def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    return N.frequent_words(normalised(spark, d).records).withColumn("share", F.round("share", 6))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return settled(B.key_parts(normalised(spark, d).records), f"parts {d}")


for _f in B.FAMILIES:

    def _family(spark: SparkSession, d: str, f=_f) -> DataFrame:
        return B.block(_parts(spark, d), f)

    QUERIES[f"block_{_f.name}"] = _family
    SQL[f"block_{_f.name}"] = f"WITH {PARTS_SQL}, {family_sql(_f.name, _f.parts, _f.cap_s1, _f.cap_s23)} SELECT s1, s23 FROM p_{_f.name}"

_UNION = (
    PARTS_SQL
    + ",\n"
    + ",\n".join(family_sql(f.name, f.parts, f.cap_s1, f.cap_s23) for f in B.FAMILIES)
    + ",\nfound AS ("
    + " UNION ALL ".join(f"SELECT s1, s23, '{f.name}' AS f FROM p_{f.name}" for f in B.FAMILIES)
    + "), pairs AS (SELECT s1, s23, "
    + ", ".join(f"bool_or(f = '{f.name}') AS f_{f.name}" for f in B.FAMILIES)
    + ", CAST(count(*) AS INTEGER) AS n_families FROM found GROUP BY 1, 2)"
)


def _pairs(spark: SparkSession, d: str):
    x = normalised(spark, d)
    return x, B.union_with_flags(_parts(spark, d))


@query(f"WITH {_UNION} SELECT * FROM pairs")
def block_union_flags(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)[1]


@query(f"""WITH {_UNION}, t AS (SELECT country, s1, count(*) AS n, count(p.s1x) AS tp FROM (SELECT r.country, truth.s1, truth.s23 FROM truth JOIN records r ON r.id = truth.s1 AND r.source = 1) q
  LEFT JOIN (SELECT s1 AS s1x, s23 AS s23x FROM pairs) p ON p.s1x = q.s1 AND p.s23x = q.s23 GROUP BY 1, 2),
e AS (SELECT r.country, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM records r LEFT JOIN t ON t.s1 = r.id WHERE r.source = 1)
SELECT country, CAST(sum(n) AS BIGINT) AS links, CAST(sum(tp) AS BIGINT) AS found, round(sum(tp) / sum(n), 6) AS recall, round(avg(CASE WHEN n = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (tp + 0.25 * n) END), 6) AS oracle_f05 FROM e GROUP BY 1""")
def blocking_recall(spark: SparkSession, d: str) -> DataFrame:
    x, pairs = _pairs(spark, d)
    return B.recall_report(pairs.select("s1", "s23"), x.truth, x.s1)


@query(f"""WITH {NORMALISED_SQL}, sc AS (SELECT truth.s1, truth.s23, 1.0 AS p FROM truth JOIN norm a ON a.id = truth.s1 AND a.source = 1 JOIN norm b ON b.id = truth.s23 AND b.source <> 1 WHERE a.core = b.core),
r AS (SELECT * FROM norm WHERE source <> 1), k AS (SELECT id, country, 'core' AS kind, core AS key FROM r WHERE core <> '' UNION ALL SELECT id, country, 'house_street', house || '|' || street FROM r WHERE house IS NOT NULL AND street IS NOT NULL
  UNION ALL SELECT id, country, 'first_house', split_part(core, ' ', 1) || '|' || coalesce(house, '') FROM r WHERE core <> ''),
ok AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY country, kind, key) BETWEEN 2 AND 20),
f AS (SELECT sc.s1, b.id AS s23, p, a.kind FROM sc JOIN ok a ON a.id = sc.s23 JOIN ok b USING (country, kind, key) WHERE a.id <> b.id)
SELECT s1, s23, CAST(max(p) AS DOUBLE) AS sib_p, count(*) AS sib_n, count(DISTINCT kind) AS n_keys, bool_or(kind = 'core') AS sib_core, bool_or(kind = 'house_street') AS sib_house_street, bool_or(kind = 'first_house') AS sib_first_house
FROM f WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.s1 = f.s1 AND sc.s23 = f.s23) GROUP BY 1, 2""")
def sibling_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = normalised(spark, d)
    core = x.records.select("id", "source", "core")
    sure = x.truth.join(core.filter("source = 1").select(F.col("id").alias("s1"), F.col("core").alias("c1")), "s1").join(core.filter("source <> 1").select(F.col("id").alias("s23"), F.col("core").alias("c2")), "s23")
    sure = sure.filter("c1 = c2").select("s1", "s23", F.lit(1.0).alias("p"))
    return B.siblings(sure, x.records, sure)


@query(f"""WITH {NORMALISED_SQL}, r AS (SELECT id, source, country, list_sort(list_distinct(string_split(core, ' '))) AS t FROM norm
  WHERE core <> '' AND (source = 1 OR (coalesce(len(numbers), 0) = 0 AND coalesce(len(words), 0) = 0))), two AS (SELECT id, source, country, a || ' ' || b AS key FROM (SELECT *, unnest(t) AS a FROM r WHERE len(t) <= 6) x, unnest(x.t) AS u(b) WHERE b > a),
n AS (SELECT country, key, count(*) FILTER (source = 1) AS n1, count(*) FILTER (source <> 1) AS n2 FROM two GROUP BY 1, 2 HAVING n1 BETWEEN 1 AND 10 AND n2 BETWEEN 1 AND 30)
SELECT a.id AS s1, b.id AS s23, count(*) AS np_keys, min(n1) AS np_n1, min(n2) AS np_n2 FROM n JOIN two a USING (country, key) JOIN two b USING (country, key) WHERE a.source = 1 AND b.source <> 1 GROUP BY 1, 2""")
def name_pair_candidates(spark: SparkSession, d: str) -> DataFrame:
    x = normalised(spark, d)
    return B.name_pairs(x.records, x.truth.limit(0))


def _supplier_like(spark: SparkSession, d: str):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("country"), F.lower("p_name").alias("text"))
    return p.groupBy("country", "text").agg(F.min("id").alias("id")), p


@query(r"""WITH q AS (SELECT p_partkey AS id, p_brand AS country, lower(p_name) AS text FROM part), r AS (SELECT country, text, min(id) AS id FROM q GROUP BY 1, 2),
g AS (SELECT DISTINCT country, text, p[i:i + 2] AS g FROM (SELECT country, text, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT country, text, ' ' || unnest(string_split(text, ' ')) || ' ' AS p FROM r))),
n AS (SELECT country, count(*) AS n FROM r GROUP BY 1), idf AS (SELECT country, g, ln((n + 1) / (count(*) + 1)) + 1 AS w FROM g JOIN n USING (country) GROUP BY country, g, n),
gw AS (SELECT country, text, g, w, sum(w * w) OVER (PARTITION BY country, text) AS nn FROM g JOIN idf USING (country, g)),
c AS (SELECT a.country, a.text AS x, b.text AS y, round(sum(a.w * b.w) / (sqrt(any_value(a.nn)) * sqrt(any_value(b.nn))), 6) AS cos FROM gw a JOIN gw b USING (country, g) GROUP BY 1, 2, 3)
SELECT s23, s1, rank, cos, nxt AS cos_next, round(cos - nxt, 6) AS gap FROM (SELECT *, coalesce(lead(cos) OVER (PARTITION BY s23 ORDER BY cos DESC, s1), 0) AS nxt, row_number() OVER (PARTITION BY s23 ORDER BY cos DESC, s1) AS rank
  FROM (SELECT q.id AS s23, r.id AS s1, cos FROM q JOIN c ON c.country = q.country AND c.x = q.text JOIN r ON r.country = c.country AND r.text = c.y)) WHERE rank <= 2""")
def trigram_top2(spark: SparkSession, d: str) -> DataFrame:
    r, q = _supplier_like(spark, d)
    return R.trigram_top(r, q, 2)


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS s23, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS rank, b.vec_id AS s1, round(list_cosine_similarity(a.e, b.e), 6) AS cos
FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY rank <= 3""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vector"))
    return R.dense_top(v, v, 3)


_ADDR = r"""adr AS (SELECT id, source, country, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(address), '(\d+)(st|nd|rd|th)\b', '\1', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS l
  FROM records WHERE address IS NOT NULL AND lower(trim(address)) NOT IN ('', 'none', 'null', 'nan', '<null>', 'n/a')),
m AS (SELECT id, source, country, list_filter(list_transform(l, lambda x: coalesce(map_extract(words_map, x)[1], x)), lambda x: x <> '') AS l FROM adr, wm),
big AS (SELECT DISTINCT id, source, country, l[i] || ' ' || l[i + 1] AS key FROM (SELECT *, unnest(range(1, len(l))) AS i FROM m)),
k1 AS (SELECT * FROM big WHERE source = 1 QUALIFY count(*) OVER (PARTITION BY country, key) <= 30)"""


def _map_sql(table: dict[str, str]) -> str:
    return "wm AS (SELECT MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "} AS words_map)"


@query(f"WITH {RECORDS_SQL}, {_map_sql(ADDRESS_WORDS)}, {_ADDR} SELECT id, source, country, key FROM big")
def address_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return B.address_bigrams(linkage(spark, d).records)


@query(f"""WITH {RECORDS_SQL}, {_map_sql(ADDRESS_WORDS)}, {_ADDR}
SELECT b.id AS s23, a.id AS s1, count(*) AS shared, row_number() OVER (PARTITION BY b.id ORDER BY count(*) DESC, a.id) AS rank FROM k1 a JOIN big b USING (country, key) WHERE b.source <> 1 GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY rank <= 5""")
def address_only_pairs(spark: SparkSession, d: str) -> DataFrame:
    return B.address_only_pairs(linkage(spark, d).records)


@query()
def address_only_match(spark: SparkSession, d: str) -> DataFrame:
    return B.address_only_match(linkage(spark, d).records)


_CORE = rf"""nc AS (SELECT id, source, country, address, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(strip_accents(lower(name)), '.', ''), '[^a-z0-9]+', ' ', 'g')), '\b({NAME_FILLER})\b', ' ', 'g'), '\s+', ' ', 'g')), ' '))), ' ') AS core FROM records)"""


@query(f"WITH {RECORDS_SQL}, {_CORE} SELECT id, source, core FROM nc")
def name_cores(spark: SparkSession, d: str) -> DataFrame:
    return linkage(spark, d).records.select("id", "source", X.name_core(F.col("name")).alias("core"))


@query(f"""WITH {RECORDS_SQL}, {_CORE}, ws AS (SELECT id, source, country, core, string_split(core, ' ') AS l FROM nc WHERE core <> ''),
k0 AS (SELECT id, source, country, core AS key, true AS exact FROM ws UNION ALL SELECT id, source, country, array_to_string(list_filter(l, lambda x, j: j <> i), ' '), false FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ws WHERE len(l) >= 2)),
k AS (SELECT id, source, country, key, bool_or(exact) AS exact FROM k0 GROUP BY 1, 2, 3, 4), k1 AS (SELECT * FROM k WHERE source = 1 QUALIFY count(*) OVER (PARTITION BY country, key) <= 30)
SELECT b.id AS s23, a.id AS s1, bool_or(a.exact AND b.exact) AS exact_key FROM k1 a JOIN k b USING (country, key) WHERE b.source <> 1 GROUP BY 1, 2""")
def word_deletion(spark: SparkSession, d: str) -> DataFrame:
    return B.word_deletion_pairs(linkage(spark, d).records)


@query()
def word_deletion_match(spark: SparkSession, d: str) -> DataFrame:
    return B.word_deletion_match(linkage(spark, d).records)


_SCORED = """nz AS (SELECT *, regexp_replace(compact, '[^a-z0-9]', '', 'g') AS c FROM norm), found AS (SELECT * FROM p_core UNION SELECT * FROM p_core_house UNION SELECT * FROM p_token_number),
sc AS (SELECT f.s1, f.s23, a.country, round((CASE WHEN greatest(length(a.c), length(b.c)) = 0 THEN 1 ELSE 1 - levenshtein(a.c, b.c) / greatest(length(a.c), length(b.c)) END) * CASE WHEN a.house = b.house THEN 1 WHEN b.house IS NULL THEN 0.8 ELSE 0.55 END, 6) AS p
  FROM found f JOIN nz a ON a.id = f.s1 AND a.source = 1 JOIN nz b ON b.id = f.s23 AND b.source <> 1)"""
_THREE = [f for f in B.FAMILIES if f.name in ("core", "core_house", "token_number")]
_SC = PARTS_SQL + ", " + ", ".join(family_sql(f.name, f.parts, f.cap_s1, f.cap_s23) for f in _THREE) + ", " + _SCORED


def scored(spark: SparkSession, d: str):
    """The problem and its pairs of three families, scored by edit distance and house numbers."""
    x = normalised(spark, d)
    parts = _parts(spark, d)
    three = tuple(_THREE)
    pairs = B.capped_pairs(B.family_keys(parts, three), three).select("s1", "s23").distinct()
    # DuckDB's edit distance counts bytes, so the shared score is over ASCII
    r = x.records.select("id", "source", "country", F.regexp_replace("compact", "[^a-z0-9]", "").alias("compact"), "house")
    p = pairs.join(r.filter("source = 1").select(F.col("id").alias("s1"), "country", F.col("compact").alias("a"), F.col("house").alias("h")), "s1").join(r.filter("source <> 1").select(F.col("id").alias("s23"), F.col("compact").alias("b"), F.col("house").alias("g")), "s23")
    score = (1 - K.normalized_levenshtein(F.col("a"), F.col("b"))) * F.when(F.col("h") == F.col("g"), 1.0).when(F.col("g").isNull(), 0.8).otherwise(0.55)
    return x, settled(p.select("s1", "s23", "country", F.round(score, 6).alias("p")), f"scored {d}")


@query(f"WITH {_SC} SELECT s1, s23, country, CAST(p AS DOUBLE) AS p FROM sc")
def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d)[1]


_DECIDE = "dec AS (SELECT s1, s23, p FROM (SELECT *, max(p) OVER (PARTITION BY s1) AS m1, max(p) OVER (PARTITION BY s23) AS m2 FROM sc) WHERE p >= 0.5 AND p >= 0.85 * m1 AND p >= m2)"
_PER = """per AS (SELECT r.id AS s1, coalesce(t.n, 0) AS n_true, coalesce(q.n, 0) AS n_pred, coalesce(h.n, 0) AS tp FROM (SELECT id FROM records WHERE source = 1) r LEFT JOIN (SELECT s1, count(*) AS n FROM truth GROUP BY 1) t ON t.s1 = r.id
  LEFT JOIN (SELECT s1, count(*) AS n FROM dec GROUP BY 1) q ON q.s1 = r.id LEFT JOIN (SELECT s1, count(*) AS n FROM dec JOIN truth USING (s1, s23) GROUP BY 1) h ON h.s1 = r.id)"""
_F = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + (n_pred - tp)) END"


@query(f"WITH {_SC}, {_DECIDE} SELECT s1, s23, CAST(p AS DOUBLE) AS p FROM dec")
def decide_rule(spark: SparkSession, d: str) -> DataFrame:
    return D.decide(scored(spark, d)[1], 0.5, 0.85, True)


@query(f"WITH {_SC}, {_DECIDE}, {_PER} SELECT s1, n_true, n_pred, tp, round({_F}, 6) AS f05 FROM per")
def metric_per_entity(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return D.per_entity(x.s1.select(F.col("id").alias("s1")), x.truth, D.decide(s, 0.5, 0.85, True)).withColumn("f05", F.round("f05", 6))


@query(f"WITH {_SC}, {_DECIDE}, {_PER} SELECT round(avg({_F}), 6) AS f05 FROM per")
def metric_f05(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: normalise, block, score, decide, macro F0.5."""
    x, s = scored(spark, d)
    return D.macro_f05(x.s1.select(F.col("id").alias("s1")), x.truth, D.decide(s, 0.5, 0.85, True)).withColumn("f05", F.round("f05", 6))


@query(f"""WITH {_SC}, rules AS (SELECT pa AS partition, t AS threshold, r AS relative FROM (SELECT unnest([false, true]) AS pa), (SELECT unnest({list(D.THRESHOLDS)}) AS t), (SELECT unnest({list(D.RELATIVES)}) AS r)),
m AS (SELECT *, max(p) OVER (PARTITION BY s1) AS m1, max(p) OVER (PARTITION BY s23) AS m2 FROM sc),
dec AS (SELECT partition, threshold, relative, m.s1, count(*) AS n_pred, count(t.s1) AS tp FROM m JOIN rules ON p >= threshold AND p >= relative * m1 AND (NOT partition OR p >= m2) LEFT JOIN truth t ON t.s1 = m.s1 AND t.s23 = m.s23 GROUP BY 1, 2, 3, 4),
n AS (SELECT r.id AS s1, coalesce(c, 0) AS n_true FROM (SELECT id FROM records WHERE source = 1) r LEFT JOIN (SELECT s1, count(*) AS c FROM truth GROUP BY 1) t ON t.s1 = r.id),
x AS (SELECT rules.*, n.n_true, coalesce(dec.n_pred, 0) AS n_pred, coalesce(dec.tp, 0) AS tp FROM rules CROSS JOIN n LEFT JOIN dec ON dec.partition = rules.partition AND dec.threshold = rules.threshold AND dec.relative = rules.relative AND dec.s1 = n.s1)
SELECT partition, CAST(threshold AS DOUBLE) AS threshold, CAST(relative AS DOUBLE) AS relative, round(avg({_F}), 6) AS f05 FROM x GROUP BY 1, 2, 3""")
def tune_grid(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return D.tune(spark, s, x.s1.select(F.col("id").alias("s1")), x.truth).withColumn("f05", F.round("f05", 6))


@query(f"""WITH {_SC}, rules AS (SELECT * FROM (VALUES ('France', 0.7, 0.95), ('US', 0.5, 0.85), (NULL, 0.6, 0.7)) r(country, threshold, relative))
SELECT s1, s23, CAST(p AS DOUBLE) AS p FROM (SELECT sc.*, max(p) OVER (PARTITION BY s1) AS m1 FROM sc) s LEFT JOIN rules r ON r.country = s.country WHERE p >= coalesce(r.threshold, 0.6) AND p >= coalesce(r.relative, 0.7) * m1""")
def rules_by_country(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    rules = spark.createDataFrame([("France", 0.7, 0.95), ("US", 0.5, 0.85), (None, 0.6, 0.7)], "country string, threshold double, relative double")
    return D.decide_by_country(s.drop("country"), x.s1.select(F.col("id").alias("s1"), "country"), rules)


@query(f"WITH {_SC} SELECT s1, s23, country, CAST(p AS DOUBLE) AS p FROM sc QUALIFY row_number() OVER (PARTITION BY s23 ORDER BY p DESC, s1) = 1")
def one_owner(spark: SparkSession, d: str) -> DataFrame:
    return D.one_owner(scored(spark, d)[1])


@query(f"WITH {_SC} SELECT s1, s23, round(0.47 * p / (0.47 * p + 1 - p), 6) AS x FROM sc")
def odds_shifted(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d)[1].select("s1", "s23", F.round(D.odds_shift(F.col("p"), 0.47), 6).alias("x"))


@query()
def expected_f(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)[1].withColumn("x", F.least(F.lit(0.999), D.odds_shift(F.col("p"), 0.47)))
    return D.choose(s, {"US": 0.0811, "India": 0.1195, "France": 0.1})


@query(f"""WITH {_SC}, o AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, s23) AS rank_s1, row_number() OVER (PARTITION BY s23 ORDER BY p DESC, s1) AS rank_s23 FROM sc)
SELECT s1, s23, rank_s1, rank_s23, CAST(max(p) OVER a AS DOUBLE) AS p_s1_max, CAST(max(CASE WHEN rank_s1 = 2 THEN p END) OVER a AS DOUBLE) AS p_s1_second, count(*) FILTER (p >= 0.5) OVER a AS n50_s1, round(sum(p) OVER a, 6) AS p_s1_sum,
  CAST(CASE WHEN rank_s23 = 1 THEN max(CASE WHEN rank_s23 = 2 THEN p END) OVER b ELSE max(p) OVER b END AS DOUBLE) AS other, CAST(max(p) OVER b AS DOUBLE) AS p_s23_max, CAST(max(CASE WHEN rank_s23 = 2 THEN p END) OVER b AS DOUBLE) AS p_s23_second,
  round(sum(p) OVER b, 6) AS p_s23_sum, count(*) FILTER (p >= 0.5) OVER b AS n50_s23, round(p / nullif(max(p) OVER a, 0), 6) AS ratio, round(p - coalesce(CASE WHEN rank_s23 = 1 THEN max(CASE WHEN rank_s23 = 2 THEN p END) OVER b ELSE max(p) OVER b END, 0), 6) AS margin
FROM o WINDOW a AS (PARTITION BY s1), b AS (PARTITION BY s23)""")
def score_context(spark: SparkSession, d: str) -> DataFrame:
    c = P.score_context(scored(spark, d)[1].select("s1", "s23", "p"))
    return c.drop("p").withColumns({n: F.round(n, 6) for n in ("p_s1_sum", "p_s23_sum", "ratio", "margin")})


@query(f"""WITH {_SC}, c AS (SELECT s1, s23, p FROM sc WHERE p >= 0.01), j AS (SELECT c.s1, c.s23, o.p AS op, a.house IS NOT NULL AND b.house IS NOT NULL AND a.house = b.house AS eq, coalesce(a.street = b.street, false) AS st,
  len(list_intersect(a.numbers, b.numbers)) > 0 AS nu, coalesce(len(list_intersect(a.words, b.words)) / nullif(len(list_distinct(list_concat(a.words, b.words))), 0), 0) AS jac
  FROM c JOIN sc o ON o.s1 = c.s1 AND o.s23 <> c.s23 AND o.p >= 0.5 JOIN norm a ON a.id = c.s23 AND a.source <> 1 JOIN norm b ON b.id = o.s23 AND b.source <> 1)
SELECT s1, s23, count(*) AS n_peer, count(*) FILTER (eq) AS peer_house, round(sum(CASE WHEN eq THEN op ELSE 0 END), 6) AS peer_house_p, count(*) FILTER (st) AS peer_street, count(*) FILTER (nu) AS peer_number,
  round(max(jac), 6) AS peer_words_max, round(avg(jac), 6) AS peer_words_mean, round(avg(CASE WHEN eq THEN 1.0 ELSE 0.0 END), 6) AS peer_house_share FROM j GROUP BY 1, 2""")
def peer_features(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    p = P.peers(s.select("s1", "s23", "p"), x.records)
    return p.withColumns({c: F.round(c, 6) for c in ("peer_house_p", "peer_words_max", "peer_words_mean", "peer_house_share")})


@query(f"""WITH {_SC}, ws AS (SELECT id, source, country, unnest(list_distinct(list_filter(string_split(coalesce(core, ''), ' '), lambda x: x <> ''))) AS w FROM norm), n AS (SELECT country, count(*) AS n FROM norm GROUP BY 1),
idf AS (SELECT country, w, ln((n + 1) / (count(*) + 1)) AS idf FROM ws JOIN n USING (country) GROUP BY country, w, n), x AS (SELECT ws.*, idf FROM ws JOIN idf USING (country, w)),
u AS (SELECT s1, s23, w, idf, 1 AS side FROM sc JOIN x ON x.id = s1 AND x.source = 1 UNION ALL SELECT s1, s23, w, idf, 2 FROM sc JOIN x ON x.id = s23 AND x.source <> 1), p AS (SELECT s1, s23, w, max(idf) AS idf, sum(side) AS i FROM u GROUP BY 1, 2, 3)
SELECT sc.s1, sc.s23, round(coalesce(sum(idf) FILTER (i <> 2), 0), 6) AS sum1, round(coalesce(sum(idf) FILTER (i <> 1), 0), 6) AS sum2, round(coalesce(sum(idf) FILTER (i = 3), 0), 6) AS shared, round(max(idf) FILTER (i = 3), 6) AS shared_max, round(max(idf) FILTER (i = 1), 6) AS miss1, round(max(idf) FILTER (i = 2), 6) AS miss2
FROM sc LEFT JOIN p ON p.s1 = sc.s1 AND p.s23 = sc.s23 GROUP BY 1, 2""")
def idf_overlap(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    o = P.idf_overlap(s, x.records)
    return o.select("s1", "s23", *[F.round(c, 6).alias(c) for c in ("sum1", "sum2", "shared", "shared_max", "miss1", "miss2")])


@query()
def soft_overlap(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return P.soft_overlap(s, x.records)


@query()
def soft_overlap_address(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return P.soft_overlap(s, x.records, "address")


@query()
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return P.leave_one_out(P.pair_features(s.select("s1", "s23"), x.records))


@query(f"""WITH {_SC}, f AS (SELECT id, source, regexp_replace(strip_accents(lower(name)), '[^ -~]', '', 'g') AS n, regexp_replace(strip_accents(lower(address)), '[^ -~]', '', 'g') AS a, house, numbers FROM norm)
SELECT s1, s23, levenshtein(x.n, y.n) AS name_lev, round(CASE WHEN greatest(length(x.n), length(y.n)) = 0 THEN 0 ELSE levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n)) END, 6) AS name_norm, length(x.n) - length(y.n) AS len_diff,
  round(CASE WHEN greatest(length(x.a), length(y.a)) = 0 THEN 0 ELSE levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a)) END, 6) AS addr_norm, abs(TRY_CAST(x.house AS BIGINT) - TRY_CAST(y.house AS BIGINT)) AS house_offset,
  len(list_filter(x.numbers, lambda q: NOT list_contains(y.numbers, q))) AS nums_a_only FROM sc JOIN f x ON x.id = s1 AND x.source = 1 JOIN f y ON y.id = s23 AND y.source <> 1""")
def edit_features(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    ascii_only = lambda c: F.regexp_replace(X.fold(F.col(c)), "[^ -~]", "").alias(c)
    e = P.edit_features(s, x.records.select("id", "source", ascii_only("name"), ascii_only("address"), "house", "numbers"))
    return e.select("s1", "s23", "name_lev", F.round("name_norm", 6).alias("name_norm"), "len_diff", F.round("addr_norm", 6).alias("addr_norm"), "house_offset", "nums_a_only")


# Keys over letters that both engines fold alike: fields are cut down to ASCII first.
_ASCII = r"""fa AS (SELECT id, source, regexp_replace(strip_accents(lower(name)), '[^ -~]', '', 'g') AS n, regexp_replace(strip_accents(lower(address)), '[^ -~]', '', 'g') AS a FROM records),
gr AS (SELECT id, source, f, list_distinct(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) AS g FROM (SELECT id, source, unnest(['n', 'a']) AS f, ' ' || regexp_replace(unnest([n, a]), '\s+', ' ', 'g') || ' ' AS t FROM fa)),
wd AS (SELECT id, source, list_distinct(list_filter(string_split(n, ' '), lambda w: w <> '')) AS n, list_distinct(list_filter(string_split(a, ' '), lambda w: w <> '')) AS a FROM fa)"""
_LESS = "list_filter({a}, lambda w: NOT list_contains({b}, w))"


def _ascii(records: DataFrame) -> DataFrame:
    return records.select("id", "source", *[F.regexp_replace(X.fold(F.col(c)), "[^ -~]", "").alias(c) for c in ("name", "address")])


@query(f"""WITH {_SC}, {_ASCII} SELECT s1, s23, unnest(list_concat(list_transform({_LESS.format(a='x.g', b='y.g')}, lambda w: x.f || '1' || w), list_transform({_LESS.format(a='y.g', b='x.g')}, lambda w: x.f || '2' || w))) AS key
FROM sc JOIN gr x ON x.id = s1 AND x.source = 1 JOIN gr y ON y.id = s23 AND y.source <> 1 AND y.f = x.f""")
def one_side_keys(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return P.one_side_keys(s, _ascii(x.records))


@query()
def one_side_grams(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return P.one_side_grams(s, x.records)


def _crossed_sql(c: str, table: str = "wd", on: str = "") -> str:
    a, b = _LESS.format(a=f"x.{c}", b=f"y.{c}"), _LESS.format(a=f"y.{c}", b=f"x.{c}")
    return f"""WITH {_SC}, {_ASCII}, o AS (SELECT s1, s23, {a} AS p, {b} AS q FROM sc JOIN {table} x ON x.id = s1 AND x.source = 1 JOIN {table} y ON y.id = s23 AND y.source <> 1{on}),
single AS (SELECT s1, s23, 'a' || unnest(p) AS key FROM o UNION ALL SELECT s1, s23, 'b' || unnest(q) FROM o), few AS (SELECT s1, s23, unnest(p) AS u, q FROM o WHERE len(p) * len(q) <= 64)
SELECT * FROM single UNION ALL SELECT s1, s23, 'x' || u || '|' || v FROM (SELECT s1, s23, u, unnest(q) AS v FROM few)"""


for _block, _sql in (("name_words", _crossed_sql("n")), ("addr_words", _crossed_sql("a")), ("name_grams", _crossed_sql("g", "gr", " AND x.f = 'n' AND y.f = 'n'"))):

    def _crossed(spark: SparkSession, d: str, block=_block) -> DataFrame:
        x, s = scored(spark, d)
        return P.crossed_keys(s, _ascii(x.records), block)

    QUERIES[f"crossed_{_block}"], SQL[f"crossed_{_block}"] = _crossed, _sql


@query()
def crossed_words(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return P.crossed_words(s, x.records)


@query(f"""WITH {_SC}, {_ASCII}, ww AS (SELECT id, source, unnest(n) AS w FROM wd), idf AS (SELECT w, ln((SELECT count(*) FROM records) / count(*)) AS idf FROM ww GROUP BY 1),
u AS (SELECT s1, s23, w, 1 AS side FROM sc JOIN ww ON ww.id = s1 AND ww.source = 1 UNION ALL SELECT s1, s23, w, 2 FROM sc JOIN ww ON ww.id = s23 AND ww.source <> 1), p AS (SELECT s1, s23, w, sum(side) AS i FROM u GROUP BY 1, 2, 3),
g AS (SELECT s1, s23, sum(idf) FILTER (i = 3) AS sh, sum(idf) FILTER (i = 1) AS a, sum(idf) FILTER (i = 2) AS b, max(idf) FILTER (i = 1) AS am, max(idf) FILTER (i = 2) AS bm, count(*) FILTER (i = 1) AS an, count(*) FILTER (i = 2) AS bn FROM p JOIN idf USING (w) GROUP BY 1, 2)
SELECT sc.s1, sc.s23, round(coalesce(sh, 0), 6) AS w_shared_idf, round(coalesce(a, 0), 6) AS w_a_idf, round(coalesce(b, 0), 6) AS w_b_idf, round(coalesce(am, 0), 6) AS w_a_max, round(coalesce(bm, 0), 6) AS w_b_max, coalesce(an, 0) AS w_a_n, coalesce(bn, 0) AS w_b_n
FROM sc LEFT JOIN g ON g.s1 = sc.s1 AND g.s23 = sc.s23""")
def word_weights(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    w = P.word_weights(s, _ascii(x.records))
    return w.withColumns({c: F.round(c, 6) for c in ("w_shared_idf", "w_a_idf", "w_b_idf", "w_a_max", "w_b_max")})


@query()
def word_features(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return P.word_features(s, x.records)


def _staged(spark: SparkSession, d: str) -> DataFrame:
    """Scores with the noisy record's source."""
    x, s = scored(spark, d)
    return s.join(x.records.filter("source <> 1").select(F.col("id").alias("s23"), (F.col("source") == 3).alias("is_s3")), "s23")


@query(f"""WITH {_SC}, o AS (SELECT sc.*, source = 3 AS is_s3, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, s23) AS r1, row_number() OVER (PARTITION BY s23 ORDER BY p DESC, s1) AS r2 FROM sc JOIN records r ON r.id = s23 AND r.source <> 1),
m AS (SELECT *, max(p) OVER a AS m1, max(CASE WHEN r1 = 2 THEN p END) OVER a AS n1, sum(p) OVER a AS t1, count(*) FILTER (p >= 0.5) OVER a AS c1, max(p) FILTER (NOT is_s3) OVER a AS x2, max(p) FILTER (is_s3) OVER a AS x3,
  coalesce(CASE WHEN r2 = 1 THEN max(CASE WHEN r2 = 2 THEN p END) OVER b ELSE max(p) OVER b END, 0) AS po, sum(p) OVER b AS t2 FROM o WINDOW a AS (PARTITION BY s1), b AS (PARTITION BY s23))
SELECT s1, s23, CAST(p AS DOUBLE) AS p, r1 AS p_rank, CAST(m1 AS DOUBLE) AS p_s1_max, CAST(n1 AS DOUBLE) AS p_s1_second, round(t1, 6) AS p_s1_sum, c1 AS p_s1_n50, CAST(x2 AS DOUBLE) AS p_s2_max, CAST(x3 AS DOUBLE) AS p_s3_max, CAST(po AS DOUBLE) AS p_other_s1,
  round(t2 - p, 6) AS p_other_sum, round(p - po, 6) AS p_margin, round(p / nullif(m1, 0), 6) AS p_ratio, CAST(CASE WHEN r1 = 1 THEN n1 ELSE m1 END AS DOUBLE) AS p_s1_other FROM m""")
def stack_frame(spark: SparkSession, d: str) -> DataFrame:
    f = P.stack_frame(_staged(spark, d))
    return f.withColumns({c: F.round(c, 6) for c in ("p_s1_sum", "p_other_sum", "p_margin", "p_ratio")})


_BASE_SQL = """b1 AS (SELECT s1, max(p) AS m, count(*) FILTER (p >= 0.5) AS c FROM sc GROUP BY 1), b2 AS (SELECT s23, max(p) AS m, count(*) FILTER (p >= 0.5) AS c FROM sc GROUP BY 1)"""
_BASE_COLS = "CAST(b1.m AS DOUBLE) AS base_s1_max, b1.c AS base_s1_n50, CAST(b2.m AS DOUBLE) AS base_s23_max, b2.c AS base_s23_n50, coalesce(b2.m >= 0.5, false) AS s23_taken"


@query(f"""WITH {_SC}, sure AS (SELECT s1, s23, p FROM sc WHERE p >= 0.5), r AS (SELECT * FROM norm WHERE source <> 1), k AS (SELECT id, country, 'core' AS kind, core AS key FROM r WHERE core <> '' UNION ALL SELECT id, country, 'house_street', house || '|' || street FROM r WHERE house IS NOT NULL AND street IS NOT NULL
  UNION ALL SELECT id, country, 'first_house', split_part(core, ' ', 1) || '|' || coalesce(house, '') FROM r WHERE core <> ''),
ok AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY country, kind, key) BETWEEN 2 AND 20),
f AS (SELECT sure.s1, b.id AS s23, p FROM sure JOIN ok a ON a.id = sure.s23 JOIN ok b USING (country, kind, key) WHERE a.id <> b.id), sib AS (SELECT s1, s23, max(p) AS sib_p, count(*) AS sib_n FROM f GROUP BY 1, 2), {_BASE_SQL}
SELECT sib.s1, sib.s23, CAST(sib_p AS DOUBLE) AS sib_p, sib_n, {_BASE_COLS}, round(sib_p / nullif(b1.m, 0), 6) AS sib_ratio FROM sib LEFT JOIN b1 ON b1.s1 = sib.s1 LEFT JOIN b2 ON b2.s23 = sib.s23 WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.s1 = sib.s1 AND sc.s23 = sib.s23)""")
def sibling_features(spark: SparkSession, d: str) -> DataFrame:
    """Siblings of confident pairs, none of them scored before, with the columns of their round."""
    x, s = scored(spark, d)
    f = P.with_base(B.siblings(s.filter("p >= 0.5").select("s1", "s23", "p"), x.records, s), s)
    return f.select("s1", "s23", "sib_p", "sib_n", "base_s1_max", "base_s1_n50", "base_s23_max", "base_s23_n50", "s23_taken", F.round("sib_ratio", 6).alias("sib_ratio"))


@query(f"""WITH {_SC}, r AS (SELECT id, source, country, list_sort(list_distinct(string_split(core, ' '))) AS t FROM norm
  WHERE core <> '' AND (source = 1 OR (coalesce(len(numbers), 0) = 0 AND coalesce(len(words), 0) = 0))), two AS (SELECT id, source, country, a || ' ' || b AS key FROM (SELECT *, unnest(t) AS a FROM r WHERE len(t) <= 6) x, unnest(x.t) AS u(b) WHERE b > a),
n AS (SELECT country, key, count(*) FILTER (source = 1) AS n1, count(*) FILTER (source <> 1) AS n2 FROM two GROUP BY 1, 2 HAVING n1 BETWEEN 1 AND 10 AND n2 BETWEEN 1 AND 30),
np AS (SELECT a.id AS s1, b.id AS s23, count(*) AS np_keys, min(n1) AS np_n1, min(n2) AS np_n2 FROM n JOIN two a USING (country, key) JOIN two b USING (country, key) WHERE a.source = 1 AND b.source <> 1 GROUP BY 1, 2), half AS (SELECT * FROM sc WHERE p >= 0.9), {_BASE_SQL}
SELECT np.*, {_BASE_COLS} FROM np LEFT JOIN b1 ON b1.s1 = np.s1 LEFT JOIN b2 ON b2.s23 = np.s23 WHERE NOT EXISTS (SELECT 1 FROM half WHERE half.s1 = np.s1 AND half.s23 = np.s23)""")
def name_pair_features(spark: SparkSession, d: str) -> DataFrame:
    """Name pairs but for the pairs known at 0.9, with the columns of their round."""
    x, s = scored(spark, d)
    return P.with_base(B.name_pairs(x.records, s.filter("p >= 0.9")), s)


@query(rf"""WITH {NORMALISED_SQL}, t AS (SELECT id, source, encode(coalesce(core, '') || ' | ' || array_to_string(coalesce(words, []), ' ') || ' ' || array_to_string(coalesce(numbers, []), ' ')) AS b FROM norm)
SELECT id, source, lower(rpad(substr(hex(b), 1, 192), 192, '0')) AS bytes FROM t""")
def text_bytes(spark: SparkSession, d: str) -> DataFrame:
    return P.text_bytes(normalised(spark, d).records).withColumn("bytes", F.lower(F.hex("bytes")))


@query(f"""WITH {_UNION}, t AS (SELECT pairs.*, truth.s1 IS NOT NULL AS hit FROM pairs LEFT JOIN truth ON truth.s1 = pairs.s1 AND truth.s23 = pairs.s23) """
       + " UNION ALL ".join(f"SELECT CAST({i + 1} AS INTEGER) AS step, '{f.name}' AS family, count(*) FILTER ({' OR '.join('f_' + g.name for g in B.FAMILIES[: i + 1])}) AS pairs, count(*) FILTER (hit AND ({' OR '.join('f_' + g.name for g in B.FAMILIES[: i + 1])})) AS found FROM t" for i, f in enumerate(B.FAMILIES)))
def union_growth(spark: SparkSession, d: str) -> DataFrame:
    x, pairs = _pairs(spark, d)
    return B.union_growth(pairs, x.truth)


def _reach_sql() -> str:
    one = {"token": "tokens", "number": "key_numbers", "word": "words", "rare": "rare"}
    rows = []
    for f in B.FAMILIES:
        shared = " AND ".join(f"len(list_intersect(a.{one[p]}, b.{one[p]})) > 0" if p in one else f"a.{p} = b.{p}" for p in f.parts)
        rows.append(f"SELECT '{f.name}' AS family, count(*) AS links, count(*) FILTER ({shared}) AS reached FROM l JOIN parts a ON a.id = l.s1 AND a.source = 1 JOIN parts b ON b.id = l.s23 AND b.source <> 1")
    return f"WITH {PARTS_SQL}, l AS (SELECT DISTINCT s1, s23 FROM truth) " + " UNION ALL ".join(rows)


@query()
def uncapped_reach(spark: SparkSession, d: str) -> DataFrame:
    return B.uncapped_reach(_parts(spark, d), normalised(spark, d).truth)


@query()
def noisy_channel(spark: SparkSession, d: str) -> DataFrame:
    x = linkage(spark, d)
    groups = C.with_words(B.same_core_groups(x.records), x.records)
    true = groups.join(x.truth, ["s1", "s23"], "left_semi").filter("k = 1")
    return C.channel_scores(groups, *C.learn_channel(true))


_PARTS = "(SELECT DISTINCT p_name AS a FROM part)"


@query(f"SELECT x.a, y.a AS b, levenshtein(x.a, y.a) AS lev, round(jaro_winkler_similarity(x.a, y.a), 6) AS jw FROM {_PARTS} x JOIN {_PARTS} y ON x.a < y.a AND split_part(x.a, ' ', 1) = split_part(y.a, ' ', 1)")
def edit_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("a")).distinct().withColumn("k", F.split("a", " ")[0])
    j = p.join(p.withColumnRenamed("a", "b"), "k").filter("a < b")
    return j.select("a", "b", F.levenshtein("a", "b").alias("lev"), F.round(K.jaro_winkler_of(F.col("a"), F.col("b")), 6).alias("jw"))


@query()
def ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("a")).distinct().withColumn("k", F.split("a", " ")[0])
    j = p.join(p.withColumnRenamed("a", "b"), "k").filter("a < b")
    a, b = F.col("a"), F.col("b")
    return j.select("a", "b", K.ratio_of(a, b).alias("ratio"), K.partial_ratio_of(a, b).alias("partial"), K.token_set_of(a, b).alias("token_set"), K.token_sort_of(a, b).alias("token_sort"))


@query(f"WITH {RECORDS_SQL}, l AS (SELECT s1, s23 FROM truth UNION SELECT s1, s1 + 7 FROM truth) SELECT r.id AS s1, coalesce(string_agg(CAST(s23 AS VARCHAR), ',' ORDER BY CAST(s23 AS VARCHAR)), '') AS matched_entity_ids FROM records r LEFT JOIN l ON l.s1 = r.id WHERE r.source = 1 GROUP BY 1")
def id_lists(spark: SparkSession, d: str) -> DataFrame:
    """True links as lists, read back, and merged with one more id of every record that has any."""
    x = linkage(spark, d)
    lists = S.id_lists(x.s1.select(F.col("id").alias("s1")), x.truth)
    more = S.links_of(lists).select(F.col("s1").cast("long").alias("s1"), (F.col("s1") + 7).alias("s23")).distinct()
    return S.merge_links(lists, more)


@query(f"WITH {RECORDS_SQL}, r AS (SELECT id AS s1, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR))) AS position FROM records WHERE source = 1) SELECT s1, row_number() OVER (ORDER BY position) AS place, CASE WHEN s1 % 3 = 0 THEN 'new' ELSE 'old' END AS ids FROM r WHERE s1 % 5 <> 0")
def replaced_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of a base file with every third record's replaced, in the base's order."""
    r = linkage(spark, d).s1.select(F.col("id").alias("s1")).withColumn("position", F.row_number().over(Window.orderBy(F.md5(F.col("s1").cast("string"))))).filter("s1 % 5 <> 0")
    out = S.replace_lists(r.withColumn("ids", F.lit("old")), r.filter("s1 % 3 = 0").select("s1", F.lit("new").alias("ids")))
    return out.withColumn("wl_at", F.monotonically_increasing_id()).select("s1", F.row_number().over(Window.orderBy("wl_at")).alias("place"), "ids")


@query(f"WITH {RECORDS_SQL} SELECT s1, s23 FROM truth ORDER BY md5('7|' || s1 || '|' || s23), s1, s23 LIMIT 100")
def sampled_links(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 100 links: the operator's size."""
    return S.sample_rows(linkage(spark, d).truth, 100, 7, "s1", "s23")


@query(f"""WITH {_SC}, ins AS (SELECT id AS s1 FROM records WHERE source = 1 AND id % 2 = 0), place AS (SELECT id AS s23, country FROM records WHERE source <> 1), own AS (SELECT t.s1, t.s23, country FROM truth t JOIN ins USING (s1) JOIN place USING (s23)),
lk AS (SELECT DISTINCT s1, s23 FROM sc WHERE p >= 0.9), miss AS (SELECT country, 1 - count(lk.s1) / count(*) AS m FROM own LEFT JOIN lk ON lk.s1 = own.s1 AND lk.s23 = own.s23 GROUP BY 1), ow AS (SELECT DISTINCT s23 FROM truth WHERE s1 NOT IN (SELECT s1 FROM ins))
SELECT sc.s1, sc.s23 FROM sc JOIN place USING (s23) LEFT JOIN miss ON miss.country = place.country WHERE sc.s23 NOT IN (SELECT s23 FROM ow) OR CAST('0x' || substr(md5(sc.s23 || '|outside'), 1, 8) AS BIGINT) % 1000 / 1000 < coalesce(m, 0.5)""")
def kept_at_miss_rate(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    inside = x.s1.filter("id % 2 = 0").select(F.col("id").alias("s1"))
    return O.keep_missed(s.select("s1", "s23"), x.truth, inside, s.filter("p >= 0.9"), x.records)


FEATURES = ["name_ratio", "name_partial", "name_jw", "core_tset", "addr_ratio", "addr_tset", "house_edit", "core_eq", "house_eq", "house_in", "token_overlap", "number_overlap", "word_overlap", "street_eq", "name_rank", "addr_rank", "name_gap", "addr_gap", "other_name_gap"]


def _labelled(spark: SparkSession, d: str, folds: int):
    """Features, labels and folds of all pairs, written: fits and scores read them many times, and the kernels are dear."""
    x, s = scored(spark, d)
    f = P.pair_features(s.select("s1", "s23"), x.records)
    f = settled(f.select("s1", "s23", "strong", *[c for c in f.columns if c in FEATURES]), f"pair features {d}")
    f = P.leave_one_out(f).select("s1", "s23", *FEATURES, M.fold_of(F.col("s1"), folds).alias("fold"))
    return x, settled(f.join(x.truth.withColumn("y", F.lit(1)), ["s1", "s23"], "left").na.fill(0, ["y"]), f"labelled {folds} {d}")


@query()
def gbt_blend(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold boosted trees and logistic regression, their blend, and its rank AUC."""
    _, f = _labelled(spark, d, folds=3)
    n = f.count()
    g = M.cross_fit(f, FEATURES, lambda: M.trees(rounds=5, depth=3), folds=3)
    lr = M.cross_fit(f, FEATURES, lambda: M.logistic(n), folds=3)
    return M.rank_auc(M.blend(g, lr, keep=("y",))).withColumn("good", F.col("auc") > 0.5)


@query(f"WITH {RECORDS_SQL} SELECT id, CAST('0x' || substr(md5(id || '|fold'), 1, 8) AS BIGINT) % 5 AS fold FROM records WHERE source = 1")
def folds(spark: SparkSession, d: str) -> DataFrame:
    return linkage(spark, d).s1.select("id", M.fold_of(F.col("id")).alias("fold"))
