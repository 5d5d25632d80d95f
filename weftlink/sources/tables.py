"""Sources and sinks: raw tab-separated records, Parquet relations, truth links, id lists and decision rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """All strings, no quoting, empty fields null; ``path`` may be a pattern."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).csv(path)


def convert(spark: SparkSession, pattern: str, out: str, schema: T.StructType = RAW) -> None:
    read_tsv(spark, pattern, schema).write.mode("overwrite").parquet(out)


def read(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def both_sides(source2: DataFrame, source3: DataFrame) -> DataFrame:
    """The two noisy sources in one relation, with the number of the source."""
    return source2.withColumn("source", F.lit(2)).unionByName(source3.withColumn("source", F.lit(3)), allowMissingColumns=True)


def split_ids(ids: Column) -> Column:
    return F.filter(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: x != "")


def truth_links(truth: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
    """(s1, s23) of a truth table with comma lists, both ends known."""
    links = truth.select(F.col("source1_entity_id").alias("s1"), F.explode(split_ids(F.col("matched_entity_ids"))).alias("s23"))
    return links.join(s1.select(F.col("entity_id").alias("s1")), "s1", "left_semi").join(s23.select(F.col("entity_id").alias("s23")), "s23", "left_semi").distinct()


def id_lists(s1: DataFrame, links: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row per id of ``s1``: its linked ids, sorted, distinct, joined by commas; empty without any."""
    grouped = links.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set(F.col("s23").cast("string"))), ",").alias(name))
    return s1.select("s1").distinct().join(grouped, "s1", "left").select("s1", F.coalesce(name, F.lit("")).alias(name))


def links_of(lists: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    return lists.select("s1", F.explode(split_ids(F.col(name))).alias("s23"))


def merge_links(lists: DataFrame, added: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    return id_lists(lists, links_of(lists, name).unionByName(added.select("s1", F.col("s23").cast("string"))).distinct(), name)


def in_order_of(rows: DataFrame, base: DataFrame, key: str = "s1", order: str = "position") -> DataFrame:
    """``rows`` in the order that ``base`` (key, position) has, those it lacks at the end by key: for files that are rewritten
    and keep their rows' order."""
    return rows.join(base.select(key, F.col(order).alias("wl_at")), key, "left").orderBy(F.col("wl_at").asc_nulls_last(), key).drop("wl_at")


def replace_lists(base: DataFrame, new: DataFrame, key: str = "s1", order: str = "position") -> DataFrame:
    """``base`` lists (key, position, list) with those of ``new`` (key, list) in their place, in the base's order."""
    kept = base.join(new.select(key), key, "left_anti").drop(order)
    return in_order_of(kept.unionByName(new.select(*kept.columns)), base, key, order)


def sample_rows(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same for a seed whatever the partitioning: the first by a hash of seed
    and key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *key)), *key).limit(n)


def write_id_lists(lists: DataFrame, path: str) -> None:
    """A folder of tab-separated files, each with a header; as many as the table has partitions."""
    lists.withColumnRenamed("s1", "source1_entity_id").write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").csv(path)


def save_rule(rule: DataFrame, path: str) -> None:
    rule.coalesce(1).write.mode("overwrite").json(path)


def load_rule(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("partition boolean, threshold double, relative double, f05 double, pred string").json(path)
