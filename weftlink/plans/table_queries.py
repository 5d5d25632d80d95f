"""Queries that show single relational operators on the star schema, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.sources import tables as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 10 THEN 'middle' ELSE 'small' END AS size FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_returnflag IN ('A', 'R') AND NOT (l_discount = 0)")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").filter(F.col("l_quantity").between(5, 45) & F.col("l_returnflag").isin("A", "R") & ~(F.col("l_discount") == 0))
    size = F.when(F.col("l_quantity") >= 40, "large").when(F.col("l_quantity") >= 10, "middle").otherwise("small")
    return x.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("net"), size.alias("size"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c, unnest(string_split(string_agg(CAST(o_orderkey AS VARCHAR), ','), ',')) AS k FROM orders GROUP BY 1) x JOIN customer ON c_custkey = c JOIN orders ON o_orderkey = CAST(k AS BIGINT)")
def truth_explode_join(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    lists = o.groupBy(F.col("o_custkey").cast("string").alias("source1_entity_id")).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ",").alias("matched_entity_ids"))
    links = S.truth_links(lists, t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity_id")), o.select(F.col("o_orderkey").cast("string").alias("entity_id")))
    return links.select(F.col("s1").cast("long").alias("c_custkey"), F.col("s23").cast("long").alias("o_orderkey"))


@query("SELECT c_custkey AS s1, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)), '') AS matched_entity_ids FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def idlist_codec(spark: SparkSession, d: str) -> DataFrame:
    return S.id_lists(t(spark, d, "customer").select(F.col("c_custkey").alias("s1")), t(spark, d, "orders").select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").alias("s23")))


def _join(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
        o = t(spark, d, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
        j = c.join(o, c.c_custkey == o.o_custkey, kind)
        return j.select("c_custkey", "c_nationkey") if kind in ("left_semi", "left_anti") else j.select("c_custkey", "c_nationkey", "o_orderkey")

    return run


_O = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000) o"
for _kind, _sql in {
    "inner": f"SELECT c_custkey, c_nationkey, o_orderkey FROM customer JOIN {_O} ON c_custkey = o_custkey",
    "left": f"SELECT c_custkey, c_nationkey, o_orderkey FROM customer LEFT JOIN {_O} ON c_custkey = o_custkey",
    "right": f"SELECT c_custkey, c_nationkey, o_orderkey FROM customer RIGHT JOIN {_O} ON c_custkey = o_custkey",
    "left_semi": f"SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_O})",
    "left_anti": f"SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {_O})",
}.items():
    QUERIES[f"join_{_kind}"], SQL[f"join_{_kind}"] = _join(_kind), _sql


@query("WITH a AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer), b AS (SELECT DISTINCT seg FROM a WHERE c_custkey % 7 = 0) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.seg IS NOT DISTINCT FROM a.seg AND length(coalesce(a.seg, '')) < 10)")
def join_nullsafe_anti(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("seg"))
    b = a.filter("c_custkey % 7 = 0").select(F.col("seg").alias("other")).distinct()
    return a.join(b, F.col("seg").eqNullSafe(F.col("other")) & (F.length(F.coalesce("seg", F.lit(""))) < 10), "left_anti")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, min(l_discount) AS lo, max(l_tax) AS hi, round(avg(l_extendedprice), 4) AS mean, count(*) FILTER (l_quantity > 25) AS big, round(coalesce(sum(l_extendedprice) FILTER (l_discount > 0.05), 0), 2) AS cut, count(DISTINCT l_suppkey) AS suppliers, bool_or(l_tax = 0) AS untaxed, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY 1, 2")
def agg_basic(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.count_if(F.col("l_quantity") > 25).alias("big"),
        F.round(F.coalesce(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("cut"), F.count_distinct("l_suppkey").alias("suppliers"), F.bool_or(F.col("l_tax") == 0).alias("untaxed"), F.round(F.percentile("l_quantity", F.lit(0.9)), 6).alias("p90"),
    )


@query("SELECT o_custkey, p[1] AS best, p[2] AS second_or_null, coalesce(p[2], 0) AS second_or_zero, coalesce(p[2], p[1]) AS second_or_best, arg AS best_order FROM (SELECT o_custkey, list_sort(list(o_totalprice), 'DESC') AS p, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS arg FROM orders GROUP BY 1)")
def agg_second_best(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.slice(F.sort_array(F.collect_list("o_totalprice"), False), 1, 2).alias("p"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_order"))
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return g.select("o_custkey", a.alias("best"), b.alias("second_or_null"), F.coalesce(b, F.lit(0.0)).alias("second_or_zero"), F.array_min("p").alias("second_or_best"), "best_order")


@query("SELECT user_id, event_type, n, n >= 0.5 * total AS majority FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def agg_mode(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    g = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    g = g.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "event_type"))})
    return g.filter("r = 1").select("user_id", "event_type", "n", (F.col("n") >= 0.5 * F.col("total")).alias("majority"))


@query("""SELECT o_orderkey, max(o_totalprice) OVER w AS best, rank() OVER o AS rank_min, dense_rank() OVER o AS rank_dense, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank_ordinal,
 rank() OVER o + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2.0 AS rank_average, round(max(o_totalprice) OVER w - o_totalprice, 2) AS gap, round(o_totalprice / max(o_totalprice) OVER w, 6) AS ratio, count(*) OVER w AS size
 FROM orders WINDOW w AS (PARTITION BY o_custkey), o AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
def window_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    o, m = w.orderBy(F.desc("o_totalprice")), F.max("o_totalprice").over(w)
    return t(spark, d, "orders").select(
        "o_orderkey", m.alias("best"), F.rank().over(o).alias("rank_min"), F.dense_rank().over(o).alias("rank_dense"), F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank_ordinal"),
        (F.rank().over(o) + (F.count("*").over(Window.partitionBy("o_custkey", "o_totalprice")) - 1) / 2.0).alias("rank_average"), F.round(m - F.col("o_totalprice"), 2).alias("gap"), F.round(F.col("o_totalprice") / m, 6).alias("ratio"), F.count("*").over(w).alias("size"),
    )


@query("SELECT o_orderkey, count(*) FILTER (near) OVER w AS n_close, CASE WHEN r = 1 THEN max(CASE WHEN r = 2 THEN o_totalprice END) OVER w ELSE max(o_totalprice) OVER w END AS other_best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, o_totalprice >= max(o_totalprice) OVER (PARTITION BY o_custkey) - 50000 AS near FROM orders) WINDOW w AS (PARTITION BY o_custkey)")
def window_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    x = t(spark, d, "orders").withColumns({"r": F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")), "near": F.col("o_totalprice") >= F.max("o_totalprice").over(w) - 50000})
    other = F.when(F.col("r") == 1, F.max(F.when(F.col("r") == 2, F.col("o_totalprice"))).over(w)).otherwise(F.max("o_totalprice").over(w))
    return x.select("o_orderkey", F.count_if("near").over(w).alias("n_close"), other.alias("other_best"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_rows(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


_C, _S = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier"
for _name, _op, _f in (("all", "UNION ALL", lambda a, b: a.unionByName(b)), ("distinct", "UNION", lambda a, b: a.union(b).distinct()), ("intersect", "INTERSECT", lambda a, b: a.intersect(b)), ("except", "EXCEPT", lambda a, b: a.subtract(b))):

    def _set(spark: SparkSession, d: str, f=_f) -> DataFrame:
        return f(t(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))

    QUERIES[f"set_{_name}"], SQL[f"set_{_name}"] = _set, f"{_C} {_op} {_S}"


@query("SELECT s_suppkey AS k, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def set_by_name(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")).unionByName(t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")), allowMissingColumns=True)


@query("SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE (a.p_name, a.p_brand) IN (SELECT (p_name, p_brand) FROM part GROUP BY p_name, p_brand HAVING count(*) BETWEEN 2 AND 20)")
def self_join_block(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_name", "p_brand", "p_partkey")
    p = p.join(p.groupBy("p_name", "p_brand").count().filter(F.col("count").between(2, 20)).drop("count"), ["p_name", "p_brand"], "left_semi")
    return p.withColumnRenamed("p_partkey", "x").join(p.withColumnRenamed("p_partkey", "y"), ["p_name", "p_brand"]).filter("x < y").select("x", "y")


@query("SELECT p_partkey, upper(p_name) AS up, p_name[1:4] AS pre, replace(p_brand, 'Brand#', '') AS brand, starts_with(p_type, 'S') AS s, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '))) AS shared, round(ln(p_size + 1), 6) AS lg, abs(p_size - 25) AS off, TRY_CAST(p_name AS INTEGER) AS num, md5(p_name) AS h FROM part")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    return p.select(
        "p_partkey", F.upper("p_name").alias("up"), F.substring("p_name", 1, 4).alias("pre"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand"), F.col("p_type").startswith("S").alias("s"),
        F.size(F.array_intersect(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " "))).cast("long").alias("shared"), F.round(F.log(F.col("p_size") + 1), 6).alias("lg"), F.abs(F.col("p_size") - 25).alias("off"), F.col("p_name").try_cast("int").alias("num"), F.md5("p_name").alias("h"),
    )
