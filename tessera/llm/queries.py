"""The queries of these operators over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, embed_dedup, kmeans, langid, licenses, mixing, packing, repair, simhash, suffix, tokens, url_filters
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("fetched_on", url_filters.fetched_on(F.col("page_id")))
    entries = spark.sql(f"SELECT * FROM VALUES {url_filters.entries_sql()} AS e(key, category, day, listed)")
    return url_filters.filter_captures(pages, entries).withColumn("fetched_on", F.col("fetched_on").cast("string"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(spark.sql(chat.PROBE_SQL))))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies", "text_key")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_url_filters, op3_language_id, op4_simhash, op5_embedding_dedup, op6_chat_format, op7_nearest, op8_packing, op9_mixing, op10_token_counts, op11_centroids, op12_suffix_dedup, op13_conversation_repair, pipeline)
}


def _components_sql(nodes: str, links: str) -> str:
    """Smallest id reachable, by spreading the smaller component to neighbours until nothing changes."""
    return f"reach(id, component) AS (SELECT id, id FROM {nodes} UNION SELECT l.b, r.component FROM reach r JOIN {links} l ON l.a = r.id WHERE r.component < l.b)"


#: All pairs of vectors, where the query's own search may miss a few.
OP5_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= {embed_dedup.THRESHOLD}),
n AS (SELECT vec_id AS id FROM e),
{_components_sql("n", "l")},
c AS (SELECT id, min(component) AS component_id FROM reach GROUP BY id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = id LEFT JOIN k ON vec_id = a"""

SQL = {
    "op1_license_scan": licenses.oracle(),
    "op2_url_filters": url_filters.ORACLE,
    "op5_embedding_dedup": OP5_SQL,
    "op6_chat_format": chat.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_centroids": kmeans.ORACLE,
    "op12_suffix_dedup": suffix.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
}
