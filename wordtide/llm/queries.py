"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, language_id, near_dedup, packing, pii, sharding, substring_dedup, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dup_of) of every near-duplicate document."""
    return near_dedup.groups(spark, table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other vectors, by cosine, to every vector whose id is divisible by 50."""
    return topk.search(spark, table(spark, sf_dir, "embeddings"), asked="vec_id % 50 = 0")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of fifty words or more that occurred before, and where."""
    return substring_dedup.repeats(spark, table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dup_of) of every exact copy."""
    return exact_dedup.duplicates(spark, table(spark, sf_dir, "documents")).drop("key")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document; copies share one."""
    return sharding.shard(spark, table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training window: its token ids, and which piece of which document lies where in it."""
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and of every web page (the other's id is null)."""
    docs = table(spark, sf_dir, "documents")
    rows = language_id.document_rows(docs).unionByName(language_id.page_rows(table(spark, sf_dir, "pages")), allowMissingColumns=True)
    return language_id.identify(spark, rows.select("doc_id", "page_id", "text", "declared", "suffix", "host"), docs)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text."""
    return bpe.encode(spark, table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, repaired and rendered."""
    return chat.chats(spark, table(spark, sf_dir, "conversations"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sanitised text, and how many entities and terms were replaced in it."""
    done = pii.sanitise(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("_entities").alias("entities"), F.col("_removed").alias("terms"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_topk": op2_topk,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_bpe": op8_bpe,
    "op9_chat": op9_chat,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    # all pairs of word triples; groups by the least id that can be reached
    "op1_near_dedup": """
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
        triples AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS t FROM words WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM triples GROUP BY 1),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM triples a JOIN triples b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        edges AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE s.n >= 0.5 * (x.n + y.n - s.n)),
        links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reach(node, root) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.root)
        SELECT node AS doc_id, min(root) AS dup_of FROM reach GROUP BY node HAVING min(root) < node""",
    "op2_topk": """
        SELECT vec_id, rank, neighbor_id, score FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM (
                SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
                FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0))
        WHERE rank <= 10""",
    "op4_exact_dedup": """
        SELECT doc_id, dup_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_of FROM documents WHERE text IS NOT NULL)
        WHERE doc_id <> dup_of GROUP BY doc_id, dup_of""",
}
