"""Queries over the vectors as a store of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, incremental, reports, scoring
from .fixtures import STORE, store, table, values, vector_of

K = 20
QUESTION = "the FHit3 wheel part of M4"
BOOST = ["FHit3"]
SEARCHES = [(0, "wheel part FHit2", ["FHit2"], "definition", "engine"), (1, "how does AActor work", [], "semantic", "all"), (2, "UWheel members in m7", ["UWheel", "EMode"], "hybrid", "project"), (3, "the of is", ["FHit9"], "definition", "all")]
DOT = "list_dot_product(embedding, v)"
QUERY_VECTOR = "q AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings WHERE label = 0)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.lit(vector_of(e)).cast("array<double>")
    return e.withColumn("score", scoring.dense(F.col("embedding"), v))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_k(_scored(spark, sf_dir).select("vec_id", "label", "score"), K, tie="vec_id").withColumn("score", F.round("score", 6))


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).where(F.col("label").isin(1, 2, 3)).select("vec_id", "label", "score")
    return scoring.top_k(scored, K, tie="vec_id").withColumn("score", F.round("score", 6))


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: the first vector of each label, against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    q = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    pairs = scoring.with_questions(e.select("vec_id", "embedding"), q).withColumn("score", scoring.dense(F.col("embedding"), F.col("vector"))).select("query_id", "vec_id", "score")
    return scoring.top_k(pairs, K, ["query_id"], "vec_id").withColumn("score", F.round("score", 6))


def sparse_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir).withColumn("score", scoring.sparse(scoring.keywords(F.lit(QUESTION)), F.col("path"), F.col("entities")))
    return scoring.top_k(s.select("chunk_id", "path", "score"), 100).withColumn("score", F.round("score", 6))


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vector_of(table(spark, sf_dir, "embeddings"))
    q = spark.createDataFrame(SEARCHES, "query_id long, question string, boost_entities array<string>, type string, scope string")
    return q.withColumns({"tokens": scoring.keywords(F.col("question")), "vector": F.lit(v).cast("array<double>")})


def boosted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every chunk in scope for every question: a map over chunks, so nothing is shuffled or ranked."""
    return scoring.scores(store(spark, sf_dir), _searches(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def boosted_score_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(store(spark, sf_dir), _searches(spark, sf_dir), strict_parity=True).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def file_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.search(store(spark, sf_dir), _searches(spark, sf_dir), 10, files_once=True)
    return out.select("query_id", "path", "chunk_id", "rank", F.round("score", 6).alias("score"))


def origin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    parts = [s.where(filters.in_scope(x)).groupBy(F.lit(x).alias("scope"), "origin").agg(F.count("*").alias("n")) for x in ("engine", "project", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


FILTERS = ["type:struct AND macro:UPROPERTY", "type:class AND origin:engine", "entity:UWheel AND file:header", "macro:UCLASS AND origin:project AND boost:macros", "file:implementation", ""]
FILTER_SQL = [
    "list_contains(entity_types, 'struct') AND has_uproperty", "list_contains(entity_types, 'class') AND origin = 'engine'", "list_contains(entities, 'UWheel') AND is_header",
    "has_uclass AND origin = 'project'", "is_implementation", "true",
]


def filter_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    out = None
    for text in FILTERS:
        one = s.where(filters.parse_filter(text).predicate()).agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids")).withColumn("filter", F.lit(text))
        out = one if out is None else out.unionByName(one)
    return out


BROKEN = [(-1, [1.0] * 63), (-2, [float("nan")] * 64), (-3, [0.0] * 64), (-4, None), (-5, [float("inf")] + [0.0] * 63), (-1, [1.0] + [0.0] * 63)]


def store_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    broken = spark.createDataFrame(BROKEN, "chunk_id long, embedding array<float>")
    return incremental.audit(e.unionByName(broken), 64)


def store_audit_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.audit(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), 64)


def entity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.lit(vector_of(table(spark, sf_dir, "embeddings"))).cast("array<double>")
    s = store(spark, sf_dir).withColumn("score", scoring.dense(F.col("embedding"), v))
    out = scoring.entity_rank(s, "FHit3")
    return out.select(F.round("best_score", 6).alias("best_score"), F.round("top_score", 6).alias("top_score"), "n_chunks", "best_rank", F.round("boost_needed", 6).alias("boost_needed"))


def enrichment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.enrichment_stats(store(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir).where(filters.path_like("wheelpart", filters.normal_extensions("H, cpp")))
    return s.groupBy("path").agg(F.count("*").alias("n"))


_SPARSE = """(SELECT coalesce(sum(CASE WHEN contains(lower(string_split(path, '/')[-1]), t) THEN 0.4::DOUBLE WHEN contains(lower(path), t) THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN list_contains(list_transform(entities, lambda e: lower(e)), t) THEN 0.5::DOUBLE WHEN len(list_filter(entities, lambda e: contains(lower(e), t))) > 0 THEN 0.2::DOUBLE ELSE 0 END), 0)
  FROM unnest({tokens}) AS u(t))"""
_TOKENS = "list_filter(list_distinct(regexp_split_to_array(lower({q}), '\\s+')), lambda w: w <> '' AND NOT list_contains(['the','a','an','in','on','at','for','to','of','is','are','how','why','what'], w))"


def _search_sql(strip: str, tail: str) -> str:
    has = "list_has_any(entities, boost_entities)"
    named = f"len(list_filter(boost_entities, lambda e: contains(lower(string_split(path, '/')[-1]), lower({strip})))) > 0"
    return f"""WITH {STORE}, {QUERY_VECTOR},
{values("s", "query_id, question, boost_entities, type, scope", SEARCHES)},
p AS (SELECT s.query_id, s.boost_entities::VARCHAR[] AS boost_entities, s.type, store.*, {DOT} AS dense, {_TOKENS.format(q="question")} AS tokens
      FROM store, q, s WHERE scope = 'all' OR scope = origin),
r AS (SELECT *, dense + {_SPARSE.format(tokens="tokens")} AS raw, len(boost_entities) > 0 AS asked FROM p),
z AS (SELECT *, raw * (CASE WHEN {has} THEN 1.2::DOUBLE ELSE 1 END) * (CASE WHEN has_uproperty OR has_ufunction OR has_uclass OR has_ustruct THEN 1.15::DOUBLE ELSE 1 END)
  * (CASE WHEN asked AND {named} THEN 3.0::DOUBLE ELSE 1 END)
  * (CASE WHEN asked AND type IN ('definition', 'hybrid') AND is_header THEN 2.5::DOUBLE WHEN asked AND type IN ('definition', 'hybrid') AND is_implementation THEN 0.5::DOUBLE ELSE 1 END)
  * (CASE WHEN asked AND NOT {has} THEN 0.1::DOUBLE ELSE 1 END) * (CASE WHEN asked AND len(entities) > 3 THEN 1.3::DOUBLE ELSE 1 END) AS score FROM r)
{tail}"""


_ONE_PREFIX = "CASE WHEN regexp_matches(e, '^[FUAIE]\\p{Lu}') THEN e[2:] ELSE e END"
_ALL_PREFIXES = "regexp_replace(e, '^[FUAE]+', '')"
_ALL = "SELECT query_id, chunk_id, round(score, 6) AS score FROM z"
_AUDIT = """SELECT count(*) AS chunks, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) <> 64) AS wrong_dimension,
  count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS with_nan, count(*) FILTER (len(list_filter(embedding, lambda x: isinf(x))) > 0) AS with_infinity,
  count(*) FILTER (len(embedding) > 0 AND len(list_filter(embedding, lambda x: x = 0)) = len(embedding)) AS zero,
  (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM a GROUP BY chunk_id))::BIGINT AS repeated_ids, {valid} AS valid, count(*) < 100 AS small FROM a"""


def _broken_sql() -> str:
    rows = []
    for i, v in BROKEN:
        rows.append(f"({i}, " + ("NULL" if v is None else "[" + ", ".join("'nan'::FLOAT" if x != x else "'inf'::FLOAT" if x == float("inf") else f"{x}::FLOAT" for x in v) + "]") + ")")
    return ", ".join(rows)


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, vector_topk_batch, sparse_score_topk, boosted_score, boosted_score_strict, file_dedup_topk, origin_filter, filter_dsl, store_audit, store_audit_clean, entity_rank, enrichment_coverage, path_filter)}
_TOP = f"SELECT vec_id, label, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q {{where}}) QUALIFY rank <= {K}"
SQL = {
    "vector_topk": f"WITH {QUERY_VECTOR} " + _TOP.format(where=""),
    "vector_topk_filtered": f"WITH {QUERY_VECTOR} " + _TOP.format(where="WHERE label IN (1, 2, 3)"),
    "vector_topk_batch": f"WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT query_id, vec_id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q) QUALIFY rank <= {K}",
    "sparse_score_topk": f"WITH {STORE}, r AS (SELECT chunk_id, path, {_SPARSE.format(tokens=_TOKENS.format(q=repr(QUESTION)))} AS score FROM store) SELECT chunk_id, path, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM r QUALIFY rank <= 100",
    "boosted_score": _search_sql(_ONE_PREFIX, _ALL),
    "boosted_score_strict": _search_sql(_ALL_PREFIXES, _ALL),
    "file_dedup_topk": _search_sql(_ONE_PREFIX, """, t AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 100),
u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) = 1)
SELECT query_id, path, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, round(score, 6) AS score FROM u QUALIFY rank <= 10"""),
    "origin_filter": f"WITH {STORE} SELECT scope, origin, count(*) AS n FROM store, (VALUES ('engine'), ('project'), ('all')) AS s(scope) WHERE scope = 'all' OR scope = origin GROUP BY scope, origin",
    "filter_dsl": f"WITH {STORE} " + " UNION ALL ".join(f"SELECT count(*) AS n, sum(chunk_id)::BIGINT AS ids, '{t}' AS filter FROM store WHERE {w}" for t, w in zip(FILTERS, FILTER_SQL, strict=True)),
    "store_audit": f"WITH a AS (SELECT vec_id AS chunk_id, embedding FROM embeddings UNION ALL SELECT * FROM (VALUES {_broken_sql()}) AS b(chunk_id, embedding)) " + _AUDIT.format(valid="false"),
    "store_audit_clean": "WITH a AS (SELECT vec_id AS chunk_id, embedding FROM embeddings) " + _AUDIT.format(valid="true"),
    "entity_rank": f"WITH {STORE}, {QUERY_VECTOR}, r AS (SELECT {DOT} AS score, list_contains(entities, 'FHit3') AS has FROM store, q), b AS (SELECT max(score) FILTER (has) AS best_score, max(score) AS top_score, count(*) FILTER (has) AS n_chunks FROM r) SELECT round(best_score, 6) AS best_score, round(top_score, 6) AS top_score, n_chunks, (SELECT count(*) + 1 FROM r WHERE score > best_score) AS best_rank, CASE WHEN best_score > 0 THEN round(top_score / best_score, 6) END AS boost_needed FROM b",
    "enrichment_coverage": f"WITH {STORE} SELECT count(*) AS chunks, sum(len(entities))::BIGINT AS total_entities, count(*) FILTER (len(entities) > 0) AS with_entities, count(*) FILTER (has_uproperty) AS with_uproperty, count(*) FILTER (has_ufunction) AS with_ufunction, count(*) FILTER (has_uclass) AS with_uclass, count(*) FILTER (has_ustruct) AS with_ustruct, 0::BIGINT AS with_uenum, round(count(*) FILTER (len(entities) > 0) / count(*), 6) AS coverage, count(*) FILTER (len(entities) > 0) / count(*) > 0.1 AS enriched FROM store",
    "path_filter": f"WITH {STORE} SELECT path, count(*) AS n FROM store WHERE contains(lower(path), 'wheelpart') AND (path LIKE '%.h' OR path LIKE '%.cpp') GROUP BY path",
}
