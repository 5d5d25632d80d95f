"""Queries that apply each operator of this subpackage, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.exact_dedup import exact_dedup
from weftlink.llm.html_text import main_text
from weftlink.llm.license_scan import license_scan
from weftlink.llm.packing import pack
from weftlink.llm.quality import fit_quality, quality_scores
from weftlink.llm.secret_scan import secret_scan
from weftlink.llm.sentencepiece_codec import piece_codec
from weftlink.llm.shingle_join import shingle_join
from weftlink.llm.suffix_dedup import suffix_dedup
from weftlink.llm.vector_dedup import vector_dedup

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed, on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / thousand / hundred / name; the first of a hundred is its licence file."""
    hundred = F.floor(F.col("doc_id") / 100).cast("long")
    name = F.when(F.pmod("doc_id", F.lit(100)) == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"), hundred.cast("string"), F.lit("/"), name)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan(files).withColumn("own_score", F.round("own_score", 6))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return piece_codec(table(spark, sf_dir, "documents"), model, whole=False)


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=2048, end_id=1).drop("ids")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("key"), "html")
    return main_text(pages, id_col="key").select("key.page_id", "key.url", "text", "n_chars", "n_blocks")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_model")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=100, with_bytes=False)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_vector_dedup, op3_sentencepiece, op4_shingle_join, op5_packing, op6_quality, op7_html_text, op8_exact_dedup, op9_secret_scan, op10_suffix_dedup)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS r FROM v UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.r = links.u),
least AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.u = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.u = v.vec_id
""",
    "op4_shingle_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.r = links.u),
least AS (SELECT u, min(r) AS class_id FROM reach GROUP BY u)
SELECT d.doc_id, (SELECT count(*) FROM links WHERE links.u = d.doc_id) AS n_links, class_id FROM documents d JOIN least ON least.u = d.doc_id
""",
    "op8_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_LOW}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
""",
}
