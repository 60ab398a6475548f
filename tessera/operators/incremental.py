"""Rebuilding an index for what has changed, and checking a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, sha256, state) of ``files(path, sha256)`` against ``cache(path, sha256)``: added, edited, unchanged or deleted. The
    key is path and content, so a new file with another's content is added, and a moved one is deleted and added."""
    new = files.groupBy("path").agg(F.max("sha256").alias("sha256"))
    old = cache.groupBy("path").agg(F.max("sha256").alias("old_sha256"))
    j = new.join(old, "path", "full")
    state = F.when(F.col("old_sha256").isNull(), "added").when(F.col("sha256").isNull(), "deleted").when(F.col("sha256") == F.col("old_sha256"), "unchanged").otherwise("edited")
    return j.select("path", F.coalesce("sha256", "old_sha256").alias("sha256"), state.alias("state"))


def merge_index(index: DataFrame, fresh_chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """The new index: all chunks of unchanged files, and those made of files added or edited; deleted files are gone."""
    same = changed.where("state = 'unchanged'").select("path")
    return index.join(same, "path", "left_semi").unionByName(fresh_chunks, allowMissingColumns=True)


def safety_brake(index: DataFrame, files: DataFrame, most: int = 100) -> DataFrame:
    """One row: old_engine_chunks, new_engine_files, abort. A run that finds no engine file while the index has over ``most``
    chunks of them has lost its source, and must not prune them."""
    engine = F.coalesce(F.col("origin"), F.lit("engine")) == "engine"
    old = index.agg(F.count_if(engine).alias("old_engine_chunks"))
    new = files.agg(F.count_if(engine).alias("new_engine_files"))
    return old.crossJoin(new).withColumn("abort", (F.col("old_engine_chunks") > most) & (F.col("new_engine_files") == 0))


def rebuild(files: DataFrame, index: DataFrame, make_chunks, force: bool = False) -> DataFrame:
    """The index after a run over ``files(path, origin, text)``. make_chunks: DataFrame of files -> DataFrame of chunks with path,
    origin and sha256; it sees only what was added or edited. RuntimeError if the safety brake says so, unless ``force``."""
    if not force and safety_brake(index, files).first().abort:
        raise RuntimeError("no engine file was found, but the index has engine chunks; use force to drop them")
    hashed = files.withColumn("sha256", F.sha2("text", 256))
    changed = changes(hashed, index.select("path", "sha256"))
    todo = hashed.join(changed.where("state IN ('added', 'edited')").select("path"), "path", "left_semi")
    return merge_index(index, make_chunks(todo), changed)


def is_stale(files: DataFrame, built_at) -> DataFrame:
    """One row: newest change of ``files(modified)``, and whether it is after ``built_at``. No files: not stale."""
    return files.agg(F.max("modified").alias("newest")).withColumn("stale", F.coalesce(F.col("newest") > F.lit(built_at), F.lit(False)))


def audit(store: DataFrame, dim: int, least_chunks: int = 100) -> DataFrame:
    """One row about ``store(chunk_id, embedding)``: chunks, vectors missing, of another length than ``dim``, with NaN, with infinity
    (null components count as NaN), all zero; ids that repeat; valid; small (under ``least_chunks``)."""
    e = F.col("embedding")
    bad = lambda test: F.count_if(F.coalesce(F.exists(e, test), F.lit(False)))
    a = store.agg(
        F.count("*").alias("chunks"), F.count_if(e.isNull()).alias("missing"), F.count_if(F.size(e) != dim).alias("wrong_dimension"),
        bad(lambda x: x.isNull() | F.isnan(x)).alias("with_nan"), bad(lambda x: F.abs(x) == float("inf")).alias("with_infinity"),
        F.count_if((F.size(e) > 0) & F.forall(e, lambda x: F.coalesce(x == 0, F.lit(False)))).alias("zero"))
    repeats = store.groupBy("chunk_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_ids"))
    out = a.crossJoin(repeats)
    faults = ["missing", "wrong_dimension", "with_nan", "with_infinity", "zero", "repeated_ids"]
    return out.withColumn("valid", (F.col("chunks") > 0) & (sum(F.col(c) for c in faults) == 0)).withColumn("small", F.col("chunks") < least_chunks)
