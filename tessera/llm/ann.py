"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every vector is indexed, under the leaf that it falls into. A query walks the
tree with a priority queue, always to the branch whose promise (inner product with its centre, plus what its spread can
add) is largest, so leaves come in the order in which they are worth a visit. How many to visit is calibrated: the exact
neighbours of some queries are found by brute force, and visits widen until their recall is the one asked for. Candidates
come from visited leaves alone. A query's first leaves are visited first: its k-th best there is a floor, and of the other leaves
only what reaches it is passed on.
Leaves are gathered into blocks of bounded size; a task compares one block with a bounded share of the queries that
visit it, so neither a large leaf nor a leaf that all queries visit is one task's work.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, is_valid_vector

BLOCK = 2048
QUERIES = 8192
#: The first visits, one in so many, whose results set the floor for the others.
FIRST = 8


#: For products and squares that may overflow: what isn't a number is dealt with where it matters.
quiet = np.errstate(over="ignore", invalid="ignore")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


@dataclass
class Tree:
    """Nodes by number, 0 being the root. children: of inner nodes; leaf: number of a leaf, or -1."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def n_leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    @quiet
    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node the child with the nearest centre."""
        out, todo = np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            near = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    @quiet
    def order(self, q: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` leaves in best-bin-first order; a promise that overflows is the largest."""
        promise = np.nan_to_num(self.centres @ q + self.spread * float(np.sqrt(q @ q)), nan=np.inf, posinf=np.inf, neginf=-np.inf)
        queue, found = [(-promise[0], 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-promise[child], child))
        return np.asarray(found, np.int32)


@quiet
def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The group of each row."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


@quiet
def fit(sample: np.ndarray, leaf_rows: int, branching: int = 16, seed: int = 5) -> Tree:
    """A tree over ``sample`` whose leaves have about ``leaf_rows`` rows of it at most."""
    rng = np.random.default_rng(seed)
    centres, spread, children, leaf, n_leaves = [], [], [], [], 0
    todo = [(None, np.arange(len(sample)))]
    while todo:
        parent, rows = todo.pop(0)
        node = len(centres)
        if parent is not None:
            children[parent].append(node)
        x = sample[rows]
        centres.append(x.mean(0))
        spread.append(float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean() / x.shape[1])) * 2)
        children.append([])
        groups = k_means(x, branching, rng) if len(x) > leaf_rows else np.zeros(len(x), int)
        parts = [rows[groups == j] for j in np.unique(groups)]
        if len(parts) < 2:
            leaf.append(n_leaves)
            n_leaves += 1
        else:
            leaf.append(-1)
            todo += [(node, p) for p in parts]
    return Tree(np.asarray(centres), np.asarray(spread), children, leaf)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


@quiet
def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same way wherever the row stands; one that overflows both ways is minus infinity."""
    s = (x * q).sum(1)
    return np.where(np.isnan(s), -np.inf, s)


@quiet
def slack(qs: np.ndarray, x: np.ndarray) -> np.ndarray:
    """By how much at most a matrix product of ``qs`` and ``x`` may differ from ``exact``; not finite where products may overflow."""
    d = x.shape[1]
    return 4 * d * np.finfo(float).eps * np.sqrt((qs * qs).sum(1))[:, None] * np.sqrt((x * x).sum(1)) + d * np.finfo(float).tiny


@quiet
def top_rows(q: np.ndarray, row: np.ndarray, off: np.ndarray, there: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best of ``row`` (the matrix product's scores, ``off`` by so much at most) that are ``there``."""
    at = np.flatnonzero(there)
    if len(at) > k:
        low, high = row[at] - off[at], row[at] + off[at]
        if np.isfinite(low).all() and np.isfinite(high).all():
            at = at[high >= np.partition(low, len(low) - k)[len(low) - k]]
    s = exact(q, x[at])
    pick = best(ids[at], s, k)
    return at[pick], s[pick]


def bounded_sample(rows: DataFrame, size: int, salt: str) -> list:
    """About ``size`` rows, never more than 1.2 times it, that a hash of the id picks."""
    n = max(1, rows.count())
    h = F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1_000_000_007))
    return rows.where(h <= min(1.0, size / n) * 1_000_000_007).limit(int(1.2 * size)).collect()


def calibrate(rows: DataFrame, queries: list, tree: Tree, k: int, target: float) -> int:
    """The fewest leaves to visit, widening a tenth at a time, for a recall of ``target`` on ``queries``. Their exact
    neighbours come from a pass over all of ``rows(row, id, vec, leaf)``; a task passes on k of them a query."""
    own, qs = [r.row for r in queries], np.asarray([r.vec for r in queries], np.float64)

    def scan(batches):
        keep: dict[int, tuple] = {}
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                c = b.slice(at, BLOCK)
                row, ids, x, leaf = c.column(0).to_numpy(), c.column(1).to_numpy(), matrix(c.column(2)), c.column(3).to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    s, off = qs @ x.T, slack(qs, x)
                for j in range(len(qs)):
                    pick, score = top_rows(qs[j], s[j], off[j], row != own[j], ids, x, k)
                    mine = ids[pick], score, leaf[pick]
                    old = keep.get(j)
                    all_ = mine if old is None else tuple(np.concatenate(z) for z in zip(old, mine, strict=True))
                    top = best(all_[0], all_[1], k)
                    keep[j] = tuple(z[top] for z in all_)
        for j, (a, s, leaf) in keep.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), j, np.int32)), pa.array(a), pa.array(s), pa.array(leaf)], names=["q", "id", "s", "leaf"])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    true = rows.mapInArrow(scan, "q int, id long, s double, leaf int").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("q").agg(F.collect_list("leaf").alias("leaves")).collect()
    total = tree.n_leaves
    place = []
    for r in true:
        order = tree.order(qs[r.q], total)
        at = np.empty(total, int)
        at[order] = np.arange(total)
        place += [at[x] for x in r.leaves]
    place = np.asarray(place)
    visits = 1
    while visits < total and len(place) and (place < visits).mean() < target:
        visits = min(total, visits + max(1, visits // 10))
    return visits if len(place) else total


@dataclass
class Blocks:
    """Where the rows of each leaf are: ``parts`` blocks from ``first`` on. Small leaves share a block, large ones are split."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, sizes: dict[int, int], n_leaves: int) -> Blocks:
        block, filled, first, parts = -1, BLOCK, np.zeros(n_leaves, np.int64), np.ones(n_leaves, np.int64)
        for leaf in range(n_leaves):
            m = sizes.get(leaf, 0)
            if filled + m > BLOCK:
                block, filled = block + 1, 0
            first[leaf], parts[leaf] = block, max(1, -(-m // BLOCK))
            block, filled = block + parts[leaf] - 1, filled + m if parts[leaf] == 1 else BLOCK
        return cls(first, parts)

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows(row, id, vec, leaf)`` with the block of each."""

        def run(batches):
            for b in batches:
                row, leaf = b.column(0).to_numpy(), b.column(3).to_numpy()
                mixed = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(self.first[leaf] + mixed % self.parts[leaf]), *b.columns], names=["block", "row", "id", "vec", "leaf"])

        return rows.mapInArrow(run, "block long, row long, id long, vec array<double>, leaf int")

    def ask(self, queries: DataFrame, tree: Tree, start: int, stop: int) -> DataFrame:
        """(block, q, qvec, floor, leaves) for each block that has any of the leaves from ``start`` to ``stop`` in the order in
        which each of ``queries(row, vec, floor)`` visits them."""

        def run(batches):
            for b in batches:
                out = [[], [], [], [], []]
                for q, vec, floor, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), matrix(b.column(1)), strict=True):
                    visited = np.sort(tree.order(x, stop)[start:])
                    leaves = np.repeat(visited, self.parts[visited])
                    nth = np.arange(len(leaves)) - np.repeat(np.cumsum(self.parts[visited]) - self.parts[visited], self.parts[visited])
                    blocks = self.first[leaves] + nth  # in ascending order, as leaves are
                    cuts = np.flatnonzero(np.diff(blocks, prepend=-1, append=blocks[-1] + 1)).tolist() if len(blocks) else []
                    for a, e in zip(cuts, cuts[1:], strict=False):
                        for col, value in zip(out, (int(blocks[a]), q, vec, floor, leaves[a:e].tolist()), strict=True):
                            col.append(value)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["block", "q", "qvec", "floor", "leaves"])

        return queries.select("row", "vec", "floor").mapInArrow(run, "block long, q long, qvec array<double>, floor double, leaves array<int>")


def compare(asked: DataFrame, there: DataFrame, k: int) -> DataFrame:
    """(q, row, id, score): of each block, the k best of the leaves that a query visits in it, none below its floor. A task has
    one block and at most about QUERIES of the queries that visit it."""
    asked = cut(asked)
    shares = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    asked = asked.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares")).cast("int")).drop("shares")
    there = there.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            row, ids, leaf, x = c["row"].to_numpy(), c["id"].to_numpy(), c["leaf"].to_numpy(), np.stack(c["vec"].to_numpy())
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                qs = np.stack(part["qvec"].to_numpy())
                with np.errstate(over="ignore", invalid="ignore"):
                    s, off = qs @ x.T, slack(qs, x)
                    high = s + off
                for j, (own, leaves, floor) in enumerate(zip(part["q"], part["leaves"], part["floor"], strict=True)):
                    there = np.isin(leaf, leaves) & (row != own) & ~(high[j] < floor)  # what isn't a number may reach it
                    pick, score = top_rows(qs[j], s[j], off[j], there, ids, x, k)
                    found.append((np.full(len(pick), own), row[pick], ids[pick], score))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], [], []]
        return pd.DataFrame({n: np.asarray(x, t) for n, x, t in zip(("q", "row", "id", "score"), cols, (np.int64, np.int64, np.int64, np.float64), strict=True)})

    return asked.groupBy("block", "share").cogroup(there.groupBy("block", "share")).applyInPandas(run, "q long, row long, id long, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = 20, recall: float = 0.97, sample: int = 16_384, calibration: int = 96, visits: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by inner product, its own left out.

    is_query: a column over ``vectors`` that says which rows are queries. sample: rows that the tree is fitted on, about; all rows
    are in its leaves. visits: leaves that a query visits, if they aren't to be found by ``calibration`` queries and ``recall``.
    Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows without id. A vector is compared
    with those of its own length, which have a tree of their own. Each row is a candidate, and a query if it is one: rows that share an id, or
    an id and a vector, stay apart, and a query's own row alone is left out. Ties go to the smaller id. Of rows with equal vectors only the k + 1
    of smallest id can be among a query's k nearest, so copies beyond them aren't compared. A product beyond the doubles is infinite,
    one that overflows both ways minus infinity. Other columns are ignored; an empty table, or no
    query, gives an empty result. With fewer than k candidates all are returned."""
    v = vectors.where(is_valid_vector(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    v = cut(v.withColumn("row", F.monotonically_increasing_id()))
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sorted(v.where("is_query").select(F.size("vec").alias("dim")).distinct().collect()):  # a row for each length
        out = out.unionByName(_nearest(v.where(F.size("vec") == r.dim), r.dim, k, recall, sample, calibration, visits))
    return out


def _nearest(v: DataFrame, dim: int, k: int, recall: float, sample: int, calibration: int, visits: int | None) -> DataFrame:
    copies = Window.partitionBy("vec").orderBy("id", "row")
    few = cut(v.select("row", "id", "vec").withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n"))
    picked = bounded_sample(few, min(sample, 2_000_000 // dim + 1), "fit") or few.limit(1).collect()
    tree = fit(np.asarray([r.vec for r in sorted(picked)], np.float64), leaf_rows=max(8, len(picked) // 256))

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.assign(matrix(b.column(2))))], names=["row", "id", "vec", "leaf"])

    rows = cut(few.mapInArrow(assign, "row long, id long, vec array<double>, leaf int"))
    queries = v.where("is_query")
    if visits is None:
        visits = calibrate(rows, bounded_sample(queries, calibration, "calibrate") or queries.limit(calibration).collect(), tree, k, recall)
    blocks = Blocks.of(dict(rows.groupBy("leaf").count().collect()), tree.n_leaves)  # a row a leaf, and a tree has few
    there = blocks.deal(rows)
    queries = queries.select("id", "row", "vec").repartition(max(4, v.sparkSession.sparkContext.defaultParallelism), "row")
    first = max(1, visits // FIRST)
    near = cut(best_of(compare(blocks.ask(queries.withColumn("floor", F.lit(float("-inf"))), tree, 0, first), there, k), k))
    floors = near.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).select(F.col("q").alias("row"), "floor")
    more = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = near.drop("rank").unionByName(compare(blocks.ask(more, tree, first, visits), there, k)) if first < visits else near.drop("rank")
    ids = v.where("is_query").select(F.col("row").alias("q"), F.col("id").alias("query_id"))
    return best_of(found, k).join(ids, "q").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
