"""Centroid clustering in whole numbers with Drake's adaptive bounds.

Each vector carries an upper bound of the distance to its own centroid, lower bounds for several of the next nearest ones in order, and one
lower bound for all the rest. A round moves the bounds by what the centroids moved. Where the upper bound stays below a lower one, no
centroid from there on can be nearer; only those before it are measured, in whole numbers, and put in order again. Where even the bound of
the rest is not above it, all centroids are. How many bounds are kept follows from how many were needed in the round before.

Bounds are rounded away from certainty and compared strictly, so they never decide a tie; results are those of measuring everything.
Sums per centroid change by the vectors that moved alone. A round reads the vectors with their bounds and writes them for the next one;
what passes through the driver is the centroids and their sums.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove_folder, shared_folder, stored

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Beyond this a component has no place in sums of longs.
LARGEST = float(2**48)
UP, DOWN = np.float64(np.inf), np.float64(-np.inf)
#: ``own``: -1 before the first round. ``other`` and ``low`` hold the kept bounds, ``rest`` that of all further centroids. ``needed``: how many
#: of the bounds didn't suffice. ``was``: the centroid before this round.
STATE = "vec_id long, q array<long>, own int, was int, high double, other array<int>, low array<double>, rest double, needed int"
SUMS = "cluster int, n long, total array<decimal(38,0)>"


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``v`` to ``c`` (one row, or one for each), exact: in doubles, longs or Python's integers, whatever
    holds them."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0))) + 1
    bound = 4 * v.shape[-1] * most * most
    d = v.astype(np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object) - c
    d = (d * d).sum(axis=-1)
    return d.astype(np.int64) if d.dtype == np.float64 else d


def root(d: np.ndarray, toward: np.float64) -> np.ndarray:
    """Square roots as doubles, rounded up or down by more than the error."""
    x = np.sqrt(d.astype(np.float64))
    return np.nextafter(np.nextafter(x, toward), toward)


def measured(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All distances, a column for each centroid."""
    return np.stack([squared(q, c) for c in centroids], axis=1)


def ranked(d: np.ndarray) -> np.ndarray:
    """Columns by ascending distance, ties by number."""
    return np.argsort(d, axis=1, kind="stable")


@dataclass
class Bounds:
    """A block of vectors: the columns of STATE as arrays."""

    q: np.ndarray
    own: np.ndarray
    high: np.ndarray
    other: np.ndarray
    low: np.ndarray
    rest: np.ndarray
    needed: np.ndarray

    def scan(self, rows: np.ndarray, centroids: np.ndarray) -> None:
        """Measures all centroids."""
        if not len(rows):
            return
        kept = self.other.shape[1]
        d = measured(self.q[rows], centroids)
        by = ranked(d)
        d = np.take_along_axis(d, by, axis=1)
        self.own[rows], self.high[rows] = by[:, 0], root(d[:, 0], UP)
        self.other[rows], self.low[rows] = by[:, 1 : kept + 1], root(d[:, 1 : kept + 1], DOWN)
        self.rest[rows] = root(d[:, kept + 1], DOWN) if d.shape[1] > kept + 1 else np.inf

    def move(self, up: np.ndarray, down: np.ndarray) -> None:
        """The centroids moved by at most ``up`` (each) and ``down`` (the largest)."""
        self.high = np.nextafter(self.high + up[self.own], UP)
        self.rest = np.nextafter(self.rest - down, DOWN)
        self.low = np.nextafter(self.low - up[self.other], DOWN)
        # a bound holds for all that come after it too
        after = self.rest
        for j in range(self.low.shape[1] - 1, -1, -1):
            after = self.low[:, j] = np.minimum(self.low[:, j], after)

    def first_above(self, rows: np.ndarray) -> np.ndarray:
        """The first bound that the upper one stays below: so many centroids may be nearer; one more than the bounds if none is."""
        all_low = np.column_stack([self.low[rows], self.rest[rows]])
        above = self.high[rows][:, None] < all_low
        return np.where(above.any(axis=1), above.argmax(axis=1), all_low.shape[1])

    def assign(self, centroids: np.ndarray) -> None:
        """Each vector's nearest centroid; exact."""
        n, kept = len(self.own), self.other.shape[1]
        self.needed = self.first_above(np.arange(n)).astype(np.int32)
        open_ = np.flatnonzero(self.needed > 0)
        if len(open_):
            self.high[open_] = root(squared(self.q[open_], centroids[self.own[open_]]), UP)
            self.needed[open_] = self.first_above(open_)
        for k in range(1, kept + 1):
            rows = np.flatnonzero(self.needed == k)
            if not len(rows):
                continue
            names = np.column_stack([self.own[rows], self.other[rows, :k]])
            d = np.stack([squared(self.q[rows], centroids[names[:, j]]) for j in range(k + 1)], axis=1)
            by = np.argsort(names, axis=1, kind="stable")
            by = np.take_along_axis(by, np.argsort(np.take_along_axis(d, by, axis=1), axis=1, kind="stable"), axis=1)
            names, d = np.take_along_axis(names, by, axis=1), np.take_along_axis(d, by, axis=1)
            self.own[rows], self.high[rows] = names[:, 0], root(d[:, 0], UP)
            self.other[rows, :k] = names[:, 1:]
            # what comes after stays a bound for what comes before it
            self.low[rows, :k] = np.minimum(root(d[:, 1:], DOWN), (self.low[rows, k] if k < kept else self.rest[rows])[:, None])
        self.scan(np.flatnonzero(self.needed > kept), centroids)

    def keep(self, kept: int) -> None:
        """Fewer bounds: the first that goes is the bound of the rest, as it holds for all after it."""
        if kept < self.other.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, kept])
            self.other, self.low = self.other[:, :kept], self.low[:, :kept]


def matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k or 1)[: n + 1] if k else np.zeros(n + 1, int), pa.int32()), pa.array(np.ascontiguousarray(m).ravel(), kind))


def assigned(batches, centroids: list[list[int]], moved: tuple[list[float], float] | None, kept: int):
    """A round over blocks of vectors. ``moved``: how far each centroid went at most since the last one, and the largest; None at first."""
    c = np.array(centroids, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        q, was = matrix(batch.column("q"), np.int64), batch.column("own").to_numpy(zero_copy_only=False).astype(np.int32)
        if moved is None:
            b = Bounds(q, was.copy(), np.zeros(n), np.zeros((n, kept), np.int32), np.zeros((n, kept)), np.zeros(n), np.full(n, kept + 1, np.int32))
            b.scan(np.arange(n), c)
        else:
            b = Bounds(q, was.copy(), batch.column("high").to_numpy(), matrix(batch.column("other"), np.int32), matrix(batch.column("low"), np.float64), batch.column("rest").to_numpy(), np.zeros(n, np.int32))
            b.keep(kept)
            b.move(np.array(moved[0]), np.float64(moved[1]))
            b.assign(c)
        arrays = [batch.column("vec_id"), batch.column("q"), pa.array(b.own, pa.int32()), pa.array(was, pa.int32()), pa.array(b.high), lists(b.other, pa.int32()), lists(b.low, pa.float64()), pa.array(b.rest), pa.array(b.needed, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in STATE.split(", ")])


def sums(batches, clusters: int):
    """Vectors that changed their centroid -> what each centroid's count and sums change by, a row for each centroid of a task."""
    n, total = [0] * clusters, [[0] * DIM for _ in range(clusters)]
    for batch in batches:
        q = matrix(batch.column("q"), np.int64)
        for name, sign in (("was", -1), ("own", 1)):
            of = batch.column(name).to_numpy(zero_copy_only=False)
            for k in np.unique(of[of >= 0]).tolist():
                rows = q[of == k]
                n[k] += sign * len(rows)
                total[k] = [a + sign * b for a, b in zip(total[k], rows.sum(axis=0).tolist(), strict=True)]
    used = [k for k in range(clusters) if n[k] or any(total[k])]
    totals = pa.array([[Decimal(x) for x in total[k]] for k in used], pa.list_(pa.decimal128(38, 0)))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([n[k] for k in used], pa.int64()), totals], names=["cluster", "n", "total"])


def changes(state: DataFrame, clusters: int) -> dict[int, tuple[int, list[int]]]:
    """Per centroid the change of count and sums; a few hundred numbers a task are added up before they reach the driver."""
    part = state.where("own <> was").select("q", "own", "was").mapInArrow(partial(sums, clusters=clusters), SUMS)
    rows = part.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["cluster"], (int(r["n"]), [0] * DIM))[1][r["i"]] = int(r["x"])
    return out


def distances(batches, centroids: list[list[int]]):
    """Vectors with their centroid -> its exact squared distance (Python's integers as decimals)."""
    c = np.array(centroids, np.int64)
    for batch in batches:
        if batch.num_rows:
            own = batch.column("own").to_numpy(zero_copy_only=False)
            d = squared(matrix(batch.column("q"), np.int64), c[own])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("own"), pa.array([Decimal(int(x)) for x in d.tolist()], pa.decimal128(38, 0))], names=["vec_id", "cluster", "d"])


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id and q of the vectors that take part."""
    x = F.transform(vectors["embedding"], lambda v: F.floor(v.cast("double") * SCALE))
    fits = F.forall(vectors["embedding"], lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < LARGEST))
    return vectors.where((F.size("embedding") == DIM) & F.coalesce(fits, F.lit(False))).select(vectors["vec_id"].alias("vec_id"), x.cast("array<long>").alias("q"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, kept: int | None = None, seen: list | None = None) -> DataFrame:
    """One row for each vector of ``vectors(vec_id, embedding)`` that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256.

    Those take part that have DIM components, none null or not finite; one with a component of 2^38 or more doesn't, as its sums would leave
    the whole numbers used. Distances and sums beyond a long are null. The first centroids are those with the smallest hash of seed and
    vec_id; of equal vec_ids the smaller vector; a null vec_id hashes as an empty one. Repeated rows are vectors of their own, so two centroids may
    be equal; the second then has no vectors and stays. Fewer vectors than clusters give fewer clusters; an empty table gives an empty one. Other
    columns are ignored. ``kept`` bounds are kept at first (half of the clusters by default); ``seen`` gets, for each round, how many, and
    how many vectors measured all centroids."""
    spark = vectors.sparkSession
    folder = os.path.join(shared_folder(spark), f"kmeans-{uuid.uuid4().hex}")
    q = whole_numbers(vectors)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["q"]) for r in q.withColumn("name", name).orderBy("name", "q").limit(clusters).collect()]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(centroids)
    kept = min(k - 1, max(1, k // 2) if kept is None else kept)
    state, totals, moved = q.withColumn("own", F.lit(-1)), {i: (0, [0] * DIM) for i in range(k)}, None
    for i in range(rounds + 1):
        state = stored(state.mapInArrow(partial(assigned, centroids=centroids, moved=moved, kept=kept), STATE), folder, f"round-{i}")
        if i >= 2:
            remove_folder(spark, f"{folder}/round-{i - 2}")
        if seen is not None:
            seen.append((kept, state.where(F.col("needed") > kept).count()))
        if i == rounds:
            break
        for c, (n, x) in changes(state, k).items():
            totals[c] = (totals[c][0] + n, [a + b for a, b in zip(totals[c][1], x, strict=True)])
        new = [[x // totals[c][0] for x in totals[c][1]] if totals[c][0] else centroids[c] for c in range(k)]
        if new == centroids:
            break  # every further round would find the same
        steps = [float(root(squared(np.array([a]), np.array([b])), UP)[0]) for a, b in zip(centroids, new, strict=True)]
        if moved is not None and kept > 1:
            # bounds that nearly no vector needs go, once most vectors do with bounds
            used = {r["needed"]: r["count"] for r in state.groupBy("needed").count().collect()}
            rows = sum(n for b, n in used.items() if b <= kept)
            if 2 * rows > sum(used.values()):
                kept = max(1, *(b for b, n in used.items() if b <= kept and 100 * n > rows))
        centroids, moved = new, (steps, max(steps))
    found = state.select("vec_id", "q", "own").mapInArrow(partial(distances, centroids=centroids), "vec_id long, cluster int, d decimal(38,0)")
    found = cut(found)
    remove_folder(spark, folder)
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.try_sum("d").alias("d")).collect()}
    whole = None if None in inertia.values() else int(sum(inertia.values()))
    long = lambda x: None if x is None or x >= 2**63 else int(x)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster"))
    return found.select(
        "vec_id", "cluster", F.when(F.col("d") < Decimal(2**63), F.col("d")).cast("long").alias("distance"), of([long(inertia.get(c)) for c in range(k)], "long").alias("cluster_inertia"),
        F.lit(long(whole)).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"),
    )


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """All distances in every round."""
    ctes = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q FROM embeddings
      WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {clusters}))"""]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(q) AS q, min({{'d': d, 'c': c}}) AS b FROM (SELECT rid, vec_id, v.q, c, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) GROUP BY rid)")
        if i < rounds:
            floor = "(s - ((s % n) + n) % n) // n"
            ctes.append(f"""m{i} AS (SELECT c, list(({floor})::BIGINT ORDER BY p) AS q FROM (SELECT c, p, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT b.c AS c, unnest(q) AS x, unnest(range({DIM})) AS p FROM a{i}) GROUP BY ALL) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))""")
    last = rounds
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{last}.q, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON c{last}.c = b.c"""


ORACLE = oracle()
