"""A linkage problem derived from ``documents``, in DataFrames and in DuckDB SQL.

A document's first words are a business name, the next ones an address: fields of a record, taken from every document.
Reference records: the first document of each country and name. Noisy records: other documents of that name, and three
variants of each reference record - verbatim, a name word lost, letters as digits, no address, or a wrong house number,
chosen by md5. Those with a wrong house number are not links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.words import GENERIC_STREET, HOMOGLYPH_DIGITS, HOMOGLYPH_LETTERS, STOP_WORDS
from weftlink.operators.normalise import normalise
from weftlink.session import portable_bucket, settled


WORD, MARK = r"[\p{L}\p{M}\p{N}]", r"[^\p{L}\p{M}\p{N}]"  # what words are of, and what is between them


@dataclass
class Linkage:
    """``records``: (id, source, country, name, address), source 1 is the reference; ``truth``: (s1, s23)."""

    records: DataFrame
    truth: DataFrame

    @property
    def s1(self) -> DataFrame:
        return self.records.filter("source = 1")


def documents_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the fields end with the 14th word, so no more of a text than 16 words is made small or cut; a first piece before a mark is empty
    start = F.regexp_extract("text", rf"^(?:{WORD}*+{MARK}++){{0,16}}+{WORD}*+", 0)
    words = F.slice(F.filter(F.split(F.lower(start), MARK + "+", 16), lambda w: w != ""), 1, 14)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "lang", words.alias("t"))
    country = F.when(F.col("lang") == "en", "US").when(F.col("lang") == "es", "India").otherwise("France")
    address = lambda n: F.concat(n.cast("string"), F.lit(" "), F.array_join(F.slice("t", 7, 8), " "))
    return d.select("doc_id", country.alias("country"), F.array_join(F.slice("t", 1, 6), " ").alias("name"), address(F.col("n_chars")).alias("address"), address(F.col("n_chars") + 1).alias("decoy"))


def linkage(spark: SparkSession, sf_dir: str) -> Linkage:
    # read six times below; the narrow table of fields is written once, so texts are read and split once
    base = settled(documents_as_records(spark, sf_dir), f"document fields {sf_dir}")
    first = base.groupBy("country", "name").agg(F.min("doc_id").alias("s1"))
    d = base.join(first, ["country", "name"])
    ref = d.filter("doc_id = s1")
    again = d.filter("doc_id <> s1").select((F.col("doc_id") * 4 + 3).alias("id"), F.lit(2).alias("source"), "country", "name", "address", "s1", F.lit(True).alias("linked"))
    v = ref.withColumn("v", F.explode(F.array(*map(F.lit, range(3))))).withColumn("b", portable_bucket(5, F.col("doc_id"), F.col("v")))
    name = F.when(F.col("b") == 1, F.regexp_replace("name", " [^ ]*$", "")).when(F.col("b") == 2, F.translate("name", "o", "0")).otherwise(F.col("name"))
    address = F.when(F.col("b") == 3, "").when(F.col("b") == 4, F.col("decoy")).otherwise(F.col("address"))
    made = v.select((F.col("doc_id") * 4 + F.col("v")).alias("id"), F.when(F.col("v") < 2, 2).otherwise(3).alias("source"), "country", name.alias("name"), address.alias("address"), "s1", (F.col("b") != 4).alias("linked"))
    noisy = again.unionByName(made)
    records = ref.select(F.col("s1").alias("id"), F.lit(1).alias("source"), "country", "name", "address").unionByName(noisy.drop("s1", "linked"))
    return Linkage(records, noisy.filter("linked").select("s1", F.col("id").alias("s23")))


def normalised(spark: SparkSession, sf_dir: str) -> Linkage:
    """Ids of sides may be equal, so records are normalised side by side under one key."""
    x = linkage(spark, sf_dir)
    keyed = x.records.withColumn("id", F.col("id") * 2 + F.when(F.col("source") == 1, 0).otherwise(1))
    n = normalise(keyed)
    n = n.withColumn("id", F.floor(F.col("id") / 2).cast("long"))
    return Linkage(settled(n, f"normalised {sf_dir}"), x.truth)


def _list(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


RECORDS_SQL = r"""
tok AS (SELECT doc_id, n_chars, CASE lang WHEN 'en' THEN 'US' WHEN 'es' THEN 'India' ELSE 'France' END AS country, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS t FROM documents),
base AS (SELECT doc_id, country, array_to_string(t[1:6], ' ') AS name, n_chars || ' ' || array_to_string(t[7:14], ' ') AS address, (n_chars + 1) || ' ' || array_to_string(t[7:14], ' ') AS decoy FROM tok),
d AS (SELECT *, min(doc_id) OVER (PARTITION BY country, name) AS s1 FROM base),
v AS (SELECT d.*, v, CAST('0x' || substr(md5(doc_id || '|' || v), 1, 8) AS BIGINT) % 5 AS b FROM d, (SELECT unnest([0, 1, 2]) AS v) WHERE doc_id = s1),
noisy AS (SELECT doc_id * 4 + 3 AS id, 2 AS source, country, name, address, s1, true AS linked FROM d WHERE doc_id <> s1
  UNION ALL SELECT doc_id * 4 + v, CASE WHEN v < 2 THEN 2 ELSE 3 END, country,
    CASE b WHEN 1 THEN regexp_replace(name, ' [^ ]*$', '') WHEN 2 THEN translate(name, 'o', '0') ELSE name END, CASE b WHEN 3 THEN '' WHEN 4 THEN decoy ELSE address END, s1, b <> 4 FROM v),
records AS (SELECT s1 AS id, 1 AS source, country, name, address FROM d WHERE doc_id = s1 UNION ALL SELECT id, source, country, name, address FROM noisy),
truth AS (SELECT s1, id AS s23 FROM noisy WHERE linked)"""

TOKENS_SQL = (
    RECORDS_SQL
    + rf""",
w AS (SELECT id, source, country, regexp_extract_all(strip_accents(lower(name)), '[\p{{L}}\p{{M}}\p{{N}}]+') AS ws FROM records),
t0 AS (SELECT id, source, country, unnest(ws) AS token, unnest(range(len(ws))) AS position FROM w),
t1 AS (SELECT id, source, country, position, CASE WHEN regexp_matches(token, '[a-z]') AND regexp_matches(token, '\d') AND NOT regexp_matches(token, '^\d+(st|nd|rd|th)$')
  THEN translate(token, '{HOMOGLYPH_DIGITS}', '{HOMOGLYPH_LETTERS}') ELSE token END AS token FROM t0),
tokens AS (SELECT * FROM t1 WHERE length(token) > 1 AND token NOT IN ({_list(STOP_WORDS)}))"""
)

NORMALISED_SQL = (
    TOKENS_SQL
    + rf""",
names AS (SELECT id, source, string_agg(DISTINCT token, ' ' ORDER BY token) AS core, string_agg(token, '' ORDER BY position) AS compact FROM tokens GROUP BY id, source),
a0 AS (SELECT id, source, list_filter(list_transform(regexp_extract_all(strip_accents(lower(address)), '\d+'), lambda x: ltrim(x, '0')), lambda x: x <> '') AS n,
  list_filter(regexp_extract_all(strip_accents(lower(address)), '[a-z]{{4,}}'), lambda x: x NOT IN ({_list(GENERIC_STREET)})) AS ws FROM records),
a1 AS (SELECT id, source, list_filter(n, lambda x, i: list_position(n, x) = i)[1:4] AS numbers, list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:6] AS words FROM a0),
freq AS (SELECT country, word, c / n AS share FROM (SELECT r.country, u.word, count(*) AS c FROM (SELECT id, source, unnest(words) AS word FROM a1) u JOIN records r USING (id, source) GROUP BY 1, 2)
  JOIN (SELECT country, count(*) AS n FROM records GROUP BY 1) USING (country) WHERE c >= 0.002 * n),
sw AS (SELECT r.id, r.source, r.country, u.word, u.pos FROM (SELECT id, source, unnest(words) AS word, unnest(range(len(words))) AS pos FROM a1) u JOIN records r USING (id, source)),
street AS (SELECT id, source, word AS street FROM sw WHERE NOT EXISTS (SELECT 1 FROM freq WHERE freq.country = sw.country AND freq.word = sw.word)
  QUALIFY row_number() OVER (PARTITION BY id, source ORDER BY length(word) DESC, pos) = 1),
norm AS (SELECT r.*, core, compact, numbers, words, numbers[1] AS house, street FROM records r LEFT JOIN names USING (id, source) LEFT JOIN a1 USING (id, source) LEFT JOIN street USING (id, source))"""
)

PARTS_SQL = (
    NORMALISED_SQL
    + """,
long AS (SELECT id, source, country, token FROM (SELECT id, source, country, unnest(string_split(core, ' ')) AS token FROM norm) WHERE length(token) >= 3),
rarity AS (SELECT country, token, count(*) AS n FROM long GROUP BY 1, 2),
rares AS (SELECT id, source, list(token) AS rare FROM (SELECT long.*, row_number() OVER (PARTITION BY id, source ORDER BY n, token) AS r FROM long JOIN rarity USING (country, token)) WHERE r <= 3 GROUP BY 1, 2),
parts AS (SELECT id, source, country, nullif(core, '') AS core, CASE WHEN length(compact) >= 6 THEN compact END AS compact, CASE WHEN length(compact) >= 6 THEN compact[1:8] END AS prefix, house, street,
  CASE WHEN source = 1 THEN numbers[1:1] ELSE numbers END AS number, words AS word, list_filter(string_split(core, ' '), lambda x: length(x) >= 3) AS token, rare FROM norm LEFT JOIN rares USING (id, source))"""
)

LISTS = ("number", "word", "token", "rare")


def family_sql(name: str, parts: tuple[str, ...], cap1: int, cap2: int) -> str:
    """CTEs ``k_<name>``, ``p_<name>``: the keys and the pairs of a family."""
    a = parts[0]
    b = parts[1] if len(parts) > 1 else "''"
    x = f"unnest({a})" if a in LISTS else a
    inner = f"SELECT id, source, country, {x} AS k0{', ' + b + ' AS rest' if len(parts) > 1 else ''} FROM parts"
    y = ("unnest(rest)" if b in LISTS else "rest") if len(parts) > 1 else "''"
    keys = f"SELECT DISTINCT * FROM (SELECT id, source, country, k0, {y} AS k1 FROM ({inner})) WHERE country IS NOT NULL AND k0 IS NOT NULL AND k1 IS NOT NULL"
    return (
        f"k_{name} AS ({keys}), z_{name} AS (SELECT country, k0, k1 FROM k_{name} GROUP BY 1, 2, 3 HAVING count(*) FILTER (source = 1) BETWEEN 1 AND {cap1} AND count(*) FILTER (source <> 1) BETWEEN 1 AND {cap2}),\n"
        f"p_{name} AS (SELECT DISTINCT a.id AS s1, b.id AS s23 FROM z_{name} JOIN k_{name} a USING (country, k0, k1) JOIN k_{name} b USING (country, k0, k1) WHERE a.source = 1 AND b.source <> 1)"
    )
