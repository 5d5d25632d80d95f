"""Queries over the later rounds' operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.functions import text as X
from weftlink.functions.words import TRADE_FORMS
from weftlink.operators import blocking as B
from weftlink.operators import decide as D
from weftlink.operators import features as P
from weftlink.operators import rounds as R
from weftlink.plans.fixture import RECORDS_SQL, linkage
from weftlink.plans.linkage_queries import _CORE, _DECIDE, _F, _PER, _SC, scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _rounded(d: DataFrame, *cols: str) -> DataFrame:
    return d.withColumns({c: F.round(c, 6) for c in cols})


def _s1(x) -> DataFrame:
    return x.s1.select(F.col("id").alias("s1"), "country")


def _kept(s: DataFrame) -> DataFrame:
    return D.decide(s, 0.5, 0.85, True)


_WD = f"""{_CORE}, ws AS (SELECT id, source, country, core, string_split(core, ' ') AS l FROM nc WHERE core <> ''),
wk0 AS (SELECT id, source, country, core AS key, true AS exact FROM ws UNION ALL SELECT id, source, country, array_to_string(list_filter(l, lambda x, j: j <> i), ' '), false FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ws WHERE len(l) >= 2)),
wk AS (SELECT id, source, country, key, bool_or(exact) AS exact FROM wk0 GROUP BY 1, 2, 3, 4), wk1 AS (SELECT * FROM wk WHERE source = 1 QUALIFY count(*) OVER (PARTITION BY country, key) <= 30),
wd AS (SELECT b.id AS s23, a.id AS s1, CASE WHEN bool_or(a.exact AND b.exact) THEN 0.95 ELSE 0.7 END AS q FROM wk1 a JOIN wk b USING (country, key) WHERE b.source <> 1 GROUP BY 1, 2),
new AS (SELECT s1, s23, q, row_number() OVER (PARTITION BY s23 ORDER BY q DESC, s1) AS rank FROM wd WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.s1 = wd.s1 AND sc.s23 = wd.s23))"""


def _new(x, s: DataFrame) -> DataFrame:
    """Word-deletion pairs that the first round didn't score, with a score by kind of key and their rank."""
    w = B.word_deletion_pairs(x.records).withColumn("q", F.when(F.col("exact_key"), 0.95).otherwise(0.7)).join(s.select("s1", "s23"), ["s1", "s23"], "left_anti")
    return w.select("s1", "s23", "q", F.row_number().over(Window.partitionBy("s23").orderBy(F.desc("q"), "s1")).alias("rank"))


# RE2 has ASCII word boundaries, so SQL looks forms up among words.
_FORMS = "[" + ", ".join(f"'{w}'" for w in TRADE_FORMS[3:-3].split("|")) + "]"


def _legal(c: str) -> str:
    w = rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"CAST(len(list_intersect(string_split({w}, ' '), {_FORMS})) > 0 OR contains(' ' || {w} || ' ', ' l l c ') AS INT)"


_SHAPE = rf"""sh1 AS (SELECT sc.s1, sc.s23, coalesce(a.name, '') AS n1, coalesce(b.name, '') AS n2, coalesce(a.address, '') AS a1, coalesce(b.address, '') AS a2 FROM sc JOIN records a ON a.id = s1 AND a.source = 1 JOIN records b ON b.id = s23 AND b.source <> 1),
sh2 AS (SELECT *, trim(regexp_replace(lower(n1), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS w1, regexp_replace(lower(n2), '[^\p{{L}}\p{{N}}]+', '', 'g') AS k,
  regexp_replace(regexp_replace(regexp_replace(lower(n2), '^(https?://)?(www\.)?', ''), '\.[a-z.]+$', ''), '[^\p{{L}}\p{{N}}]+', '', 'g') AS stem,
  TRY_CAST(regexp_extract(a1, '(?:^|[\s,#])(\d+)(?:[\s,-]|$)', 1) AS BIGINT) AS f1, TRY_CAST(regexp_extract(a2, '(?:^|[\s,#])(\d+)(?:[\s,-]|$)', 1) AS BIGINT) AS f2 FROM sh1),
sh3 AS (SELECT *, array_to_string(list_filter(string_split(replace(' ' || w1 || ' ', ' l l c ', ' '), ' '), lambda x: x <> '' AND NOT list_contains({_FORMS}, x)), ' ') AS core FROM sh2),
sh4 AS (SELECT *, array_to_string(list_transform(string_split(w1, ' '), lambda x: x[1:1]), '') AS acro, array_to_string(list_transform(string_split(core, ' '), lambda x: x[1:1]), '') AS acro_core, replace(w1, ' ', '') AS run, replace(core, ' ', '') AS bare FROM sh3)
SELECT s1, s23, CAST(n2 = upper(n2) AS INT) AS n2_upper, {_legal('n2')} AS n2_legal, CAST(regexp_matches(lower(n2), '\.(com|net|org|in|co|biz|us)\b|www') AS INT) AS n2_domain, CAST(regexp_matches(n2, '\d') AS INT) AS n2_digits,
  CAST(regexp_matches(n2, '^[\x00-\x7f]*$') AS INT) AS n2_ascii, {_legal('n1')} AS n1_legal, CAST(contains(a2, '#') AS INT) AS a2_hash, CAST(regexp_matches(lower(a2), '\bnull\b|n/a') AS INT) AS a2_null, CAST(a2 = upper(a2) AS INT) AS a2_upper,
  CAST(f1 IS NOT NULL AS INT) AS num1, CAST(f2 IS NOT NULL AS INT) AS num2, CAST(k = acro AND length(k) >= 2 AS INT) AS acro_eq, CAST(k = acro_core AND length(k) >= 2 AS INT) AS acro_core_eq, CAST(stem = run AS INT) AS dom_eq, CAST(stem = bare AS INT) AS dom_core_eq,
  CAST(length(stem) >= 4 AND contains(run, stem) AS INT) AS dom_in, CAST(k = bare AS INT) AS stem_eq, CAST(trim(string_split(lower(a1), ',')[1]) = trim(string_split(lower(a2), ',')[1]) AS INT) AS a_order, CAST(len(string_split(n2, ' ')) AS INT) AS n2_tokens, CAST(len(string_split(n1, ' ')) AS INT) AS n1_tokens,
  CASE WHEN f1 IS NULL OR f2 IS NULL THEN -1 ELSE CAST(f1 = f2 AS INT) END AS num_eq, round(length(a2) / greatest(length(a1), 1), 6) AS a_len_ratio, CAST(len(string_split(a2, ',')) - len(string_split(a1, ',')) AS INT) AS a2_state_full FROM sh4"""


@query(f"WITH {_SC}, {_SHAPE}")
def address_shape(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return _rounded(R.address_shape(s.select("s1", "s23"), x.records), "a_len_ratio")


@query(f"""WITH {_SC}, {_DECIDE}, nb AS (SELECT s1, count(*) AS nb FROM dec GROUP BY 1), m AS (SELECT s1, CAST(max(p) AS DOUBLE) AS xmax FROM sc GROUP BY 1)
SELECT sc.s1, sc.s23, sc.country, coalesce(nb, 0) AS nb, xmax, CAST(sc.country = 'India' AS INT) AS india FROM sc LEFT JOIN nb ON nb.s1 = sc.s1 LEFT JOIN m ON m.s1 = sc.s1""")
def entity_context(spark: SparkSession, d: str) -> DataFrame:
    _, s = scored(spark, d)
    return R.entity_context(s.select("s1", "s23", "country"), _kept(s), s.withColumnRenamed("p", "x"))


_SIDE = "CAST(max(p) OVER {w} AS DOUBLE) AS q_{s}_max, CAST(coalesce(max(CASE WHEN r_{s} = 2 THEN p END) OVER {w}, max(p) OVER {w}) AS DOUBLE) AS q_{s}_second, count(*) FILTER (p >= 0.5) OVER {w} AS q_{s}_n50, r_{s} AS q_{s}_rank, round(p / max(p) OVER {w}, 6) AS q_{s}_ratio"


@query(f"""WITH {_SC}, o AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, s23) AS r_s1, row_number() OVER (PARTITION BY s23 ORDER BY p DESC, s1) AS r_s23 FROM sc)
SELECT s1, s23, CAST(p AS DOUBLE) AS q, {_SIDE.format(w='a', s='s1')}, {_SIDE.format(w='b', s='s23')} FROM o WINDOW a AS (PARTITION BY s1), b AS (PARTITION BY s23)""")
def refit_context(spark: SparkSession, d: str) -> DataFrame:
    _, s = scored(spark, d)
    return _rounded(R.refit_context(s.select("s1", "s23", F.col("p").alias("q"))), "q_s1_ratio", "q_s23_ratio")


@query(f"""WITH {RECORDS_SQL}, x AS (SELECT id, source, trim(regexp_replace(replace(strip_accents(lower(regexp_replace(coalesce(address, ''), '(?i)n\\s*[°º]|\\bno\\b\\.?|#', ' ', 'g'))), '.', ''), '[^a-z0-9]+', ' ', 'g')) AS t FROM records)
SELECT id, source, nullif(regexp_extract(t, '(?:^|\\s)0*(\\d+)(?:\\s|$)', 1), '') AS house, array_to_string(list_transform(regexp_extract_all(t, '\\d+'), lambda n: regexp_replace(n, '^0+(\\d)', '\\1')), ' ') AS nums FROM x""")
def address_parts(spark: SparkSession, d: str) -> DataFrame:
    r = linkage(spark, d).records.select("id", "source", X.address_parts(F.coalesce("address", F.lit(""))).alias("a"))
    return r.select("id", "source", "a.house", "a.nums")


@query()
def rescue_features(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return _rounded(R.rescue_features(s.select("s1", "s23", "p"), x.records), "name", "addr")


@query()
def rescued_links(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    kept = _kept(s)
    rest = s.filter("p >= 0.05").select("s1", "s23", "p").join(kept.select("s23").distinct(), "s23", "left_anti")
    return R.with_links(kept, R.rescue(R.rescue_features(rest, x.records)))


@query()
def new_pair_windows(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    known = P.pair_features(s.select("s1", "s23"), x.records)
    new = R.window_of_new(P.pair_features(_new(x, s).select("s1", "s23"), x.records), known)
    return R.competitors_of_new(new, P.record_context(known)).select("s1", "s23", "s1_candidates", "s1_strong", "name_rank", "addr_rank", "s23_candidates", "other_strong")


@query(f"WITH {_SC}, {_DECIDE}, {_WD} SELECT s1, s23 FROM dec UNION SELECT s1, s23 FROM new WHERE q >= 0.8")
def added_links(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return R.with_links(_kept(s), R.accepted(_new(x, s), 0.8, "q"))


@query(f"WITH {_SC}, {_DECIDE}, {_WD} SELECT s1, s23 FROM dec UNION SELECT s1, s23 FROM (SELECT * FROM new WHERE s23 NOT IN (SELECT s23 FROM dec) QUALIFY row_number() OVER (PARTITION BY s23 ORDER BY q DESC, s1) = 1) WHERE q >= 0.7")
def added_best_owner(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    kept = _kept(s)
    return R.with_links(kept, R.accepted(_new(x, s), 0.7, "q", unlinked=kept))


@query(f"WITH {_SC}, {_DECIDE}, pick AS (SELECT s1, s23 FROM sc WHERE country = 'US' AND p >= 0.47) SELECT s1, s23 FROM dec WHERE s1 NOT IN (SELECT id FROM records WHERE source = 1 AND country = 'US') UNION SELECT s1, s23 FROM pick")
def replaced_links(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return R.replace_links(_kept(s), s.filter("country = 'US' and p >= 0.47"), _s1(x).filter("country = 'US'"))


@query(f"WITH {_SC}, {_DECIDE} SELECT s1, s23 FROM dec")
def rebuilt_links(spark: SparkSession, d: str) -> DataFrame:
    """A rebuild that must equal the base: the rule for all countries, and the same rule country by country."""
    x, s = scored(spark, d)
    parts = [_kept(s.filter(F.col("country") == c)) for c in ("US", "India", "France")]
    return R.require_same(R.with_links(*parts), _kept(s)).select("s1", "s23")


@query(f"WITH {_SC}, {_DECIDE}, n AS (SELECT s1, count(*) AS n FROM dec GROUP BY 1) SELECT country, count(*) AS records, count(n) AS linked, CAST(coalesce(sum(n), 0) AS BIGINT) AS links, round(coalesce(sum(n), 0) / count(*), 6) AS per_record FROM records LEFT JOIN n ON n.s1 = id WHERE source = 1 GROUP BY 1")
def link_report(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return _rounded(R.link_report(_kept(s), _s1(x)), "per_record")


@query(f"""WITH {_SC}, {_DECIDE}, aft AS (SELECT s1, s23 FROM sc WHERE p >= 0.7), b AS (SELECT s1, s23, 1 AS v FROM dec UNION ALL SELECT s1, s23, 2 FROM aft), g AS (SELECT s1, s23, sum(v) AS v FROM b GROUP BY 1, 2)
SELECT country, count(*) FILTER (v = 2) AS added, count(*) FILTER (v = 1) AS dropped, count(*) FILTER (v = 3) AS kept FROM g JOIN records r ON r.id = g.s1 AND r.source = 1 GROUP BY 1""")
def link_changes(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return R.link_changes(_kept(s), s.filter("p >= 0.7"), _s1(x))


@query(f"WITH {_SC}, n AS (SELECT r.country, (SELECT count(*) FROM sc WHERE sc.s1 = r.id) AS n FROM records r WHERE source = 1) SELECT country, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99, max(n) AS most FROM n GROUP BY 1")
def candidates_per_record(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return _rounded(R.candidates_per_record(s, _s1(x)), "p50", "p90", "p99")


@query(f"WITH {_SC}, out AS (SELECT s23 FROM truth JOIN records r ON r.id = truth.s1 AND r.source = 1 WHERE r.country <> 'US') SELECT s1, s23, CAST(p AS DOUBLE) AS p FROM sc WHERE s23 NOT IN (SELECT s23 FROM out)")
def without_outside(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return R.without_outside(s.select("s1", "s23", "p"), x.truth, _s1(x).filter("country = 'US'"))


_LOST = """lost AS (SELECT a.country, coalesce(list_contains(b.numbers, a.house), false) AS house_in, coalesce(a.street = b.street, false) AS street_eq, coalesce(len(list_intersect(a.words, b.words)), 0) > 0 AS word_shared,
  coalesce(len(list_intersect(string_split(a.core, ' '), string_split(b.core, ' '))), 0) > 0 AS token, a.compact[1:4] = b.compact[1:4] AS prefix4, coalesce(len(b.numbers), 0) = 0 AND coalesce(len(b.words), 0) = 0 AS empty_addr, a.country = b.country AS same_country
  FROM truth t JOIN norm a ON a.id = t.s1 AND a.source = 1 JOIN norm b ON b.id = t.s23 AND b.source <> 1 WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.s1 = t.s1 AND sc.s23 = t.s23))"""
_FLAGS = ("house_in", "street_eq", "word_shared", "token", "prefix4", "empty_addr", "same_country")


@query(f"WITH {_SC}, {_LOST} SELECT country, token, house_in, empty_addr, count(*) AS n FROM lost GROUP BY ALL")
def missed_groups(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return R.missed_groups(R.missed_links(x.truth, s, x.records))


@query(f"WITH {_SC}, {_LOST} SELECT count(*) AS n, " + ", ".join(f"round(avg(CAST({c} AS INT)), 6) AS {c}" for c in _FLAGS) + " FROM lost")
def missed_shares(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return _rounded(R.missed_shares(R.missed_links(x.truth, s, x.records)), *_FLAGS)


def _f(tp: str, kept: str) -> str:
    return _F.replace("n_pred", f"({kept})").replace("tp", f"({tp})")


@query(f"""WITH {_SC}, {_WD}, rules AS (SELECT r AS ranks, c AS cut FROM (SELECT unnest([1, 3]) AS r), (SELECT unnest([0.5, 0.8]) AS c)),
band AS (SELECT sc.s1, sc.s23, CAST(p AS DOUBLE) AS x, t.s1 IS NOT NULL AS t FROM sc LEFT JOIN truth t ON t.s1 = sc.s1 AND t.s23 = sc.s23),
acc AS (SELECT ranks, cut, n.s1, CAST(q AS DOUBLE) AS x, t.s1 IS NOT NULL AS t FROM new n JOIN rules ON rank <= ranks AND q >= cut LEFT JOIN truth t ON t.s1 = n.s1 AND t.s23 = n.s23),
added AS (SELECT ranks, cut, s1, count(*) AS a, count(*) FILTER (t) AS good FROM acc GROUP BY 1, 2, 3),
pool AS (SELECT ranks, cut, band.s1, x, t FROM added JOIN band ON band.s1 = added.s1 UNION ALL SELECT * FROM acc),
rc AS (SELECT ranks, cut, s1, count(*) FILTER (x >= 0.5 AND x >= 0.85 * m) AS rk, count(*) FILTER (t AND x >= 0.5 AND x >= 0.85 * m) AS rt FROM (SELECT *, max(x) OVER (PARTITION BY ranks, cut, s1) AS m FROM pool) GROUP BY 1, 2, 3),
bc AS (SELECT s1, count(*) FILTER (x >= 0.5 AND x >= 0.85 * m) AS kept, count(*) FILTER (t AND x >= 0.5 AND x >= 0.85 * m) AS tpb FROM (SELECT *, max(x) OVER (PARTITION BY s1) AS m FROM band) GROUP BY 1),
nt AS (SELECT s1, count(*) AS n FROM truth GROUP BY 1),
j AS (SELECT r.country, a.ranks, a.cut, a.a, a.good, rk, rt, coalesce(kept, 0) AS kept, coalesce(tpb, 0) AS b, coalesce(nt.n, 0) AS n_true FROM added a JOIN rc ON rc.ranks = a.ranks AND rc.cut = a.cut AND rc.s1 = a.s1 LEFT JOIN bc ON bc.s1 = a.s1 LEFT JOIN nt ON nt.s1 = a.s1 JOIN records r ON r.id = a.s1 AND r.source = 1)
SELECT country, ranks, CAST(cut AS DOUBLE) AS cut, CAST(sum(a) AS BIGINT) AS accepted, round(sum(good) / sum(a), 6) AS true_share, round(sum({_f('b + good', 'kept + a')} - {_f('b', 'kept')}) / (SELECT count(*) FROM records r WHERE r.source = 1 AND r.country = j.country), 6) AS gain_add,
  round(sum({_f('rt', 'rk')} - {_f('b', 'kept')}) / (SELECT count(*) FROM records r WHERE r.source = 1 AND r.country = j.country), 6) AS gain_rule FROM j GROUP BY country, ranks, cut""")
def policy_gain(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return _rounded(R.policy_gain(s.withColumnRenamed("p", "x"), _new(x, s), x.truth, _s1(x), (0.5, 0.8), (1, 3)), "true_share", "gain_add", "gain_rule")


@query(f"""WITH {_SC}, {_DECIDE}, {_PER}, {_WD}, cutoff AS (SELECT cut, n.s1, count(*) AS n, count(t.s1) AS nt, count(t.s1) FILTER (k.s1 IS NULL) AS gain FROM new n JOIN (SELECT unnest([0.5, 0.8]) AS cut) ON q >= cut
  LEFT JOIN truth t ON t.s1 = n.s1 AND t.s23 = n.s23 LEFT JOIN dec k ON k.s1 = n.s1 AND k.s23 = n.s23 GROUP BY 1, 2),
j AS (SELECT r.country, cut, n, nt, gain, tp AS b, n_true, n_pred AS kept FROM cutoff JOIN per USING (s1) JOIN records r ON r.id = cutoff.s1 AND r.source = 1)
SELECT country, CAST(cut AS DOUBLE) AS cut, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(nt) AS BIGINT) AS true_pairs, round(sum(nt) / sum(n), 6) AS true_share,
  round(sum({_f('b + gain', 'kept + gain')} - {_f('b', 'kept')}) / (SELECT count(*) FROM records r WHERE r.source = 1 AND r.country = j.country), 6) AS ceiling FROM j GROUP BY country, cut""")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    x, s = scored(spark, d)
    return _rounded(R.frontier(_new(x, s), _kept(s), x.truth, _s1(x), (0.5, 0.8)), "true_share", "ceiling")
