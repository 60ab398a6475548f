"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove_folder, shared_folder

__all__ = ["collect_garbage", "components", "cut", "is_valid_vector", "remove_folder", "shared_folder", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that nothing before it is computed again
    when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as Parquet below ``folder`` and read again: computed once, and read by columns."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver's JVM collects its garbage, which one with much memory seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Edges that one task contracts.
EDGES = 100_000


def forest(batches):
    """Edges of one partition -> an edge from each node to the smallest one that it reaches by them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    links = [(x, r) for x in list(root) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): one row (node, component) for each node that has
    an edge to another; component is the smallest node reachable.

    Tasks of at most about ``per_task`` edges contract them to stars. If that took one task, the stars are the components.
    Else the large-star and small-star steps join the stars of different tasks, and both alternate until nothing
    changes. A star step takes a minimum per node (combined before the shuffle) and joins it back, so a node with very many
    edges is a skewed join, which adaptive execution splits, and never one task's list.
    Empty edges give an empty result. No round raises the smaller end of an edge, so it ends; mostly after as many rounds as the logarithm of
    the nodes.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = (e.count(), None)
    while True:
        parts = max(1, -(-last[0] // per_task))
        e = cut(e.coalesce(parts).mapInArrow(forest, "a long, b long"))
        if parts == 1:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = state(e)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def is_valid_vector(vec: str):
    """A column: the vector has components, all finite and not null, and one that isn't zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)
