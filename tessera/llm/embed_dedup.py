"""Embedding near-dedup by NN-descent.

Vectors that are equal are one class. A first neighbour graph comes from random orders: vectors are sorted by the signs
of random projections, and each is compared with those near it in the order. Then NN-descent: a vector's neighbours
(and those that it is a neighbour of) are compared with each other, and what improves a list enters it; pairs that were
compared before are not compared again. Lists hold what lies within two times the threshold's angle: vectors that both link
to a third do, so no path from link to link is cut, and what is further away costs nothing. It ends when a round finds next to no new
link for a list that isn't full of links and, on audit samples compared with all rows by brute force, the share of a vector's links that was found is high enough, in
small components as in large ones; otherwise more random orders are added, each time twice as many, and if that never does it raises.
A list whose members all link is saturated: it may not hold all links. It is enlarged to its whole component, whose
links are counted exactly: rings around the component's centre say which vectors all link and which can't, and the
others' pairs are counted in blocks, without writing any pair; and to the components with saturated lists around it, as a
link between two dense groups can be cut from the lists at both ends. Components that so link are one. Links are kept at
the threshold.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import matrix
from .common import components, cut, is_valid_vector

THRESHOLD = 0.95
LIST = 10
REVERSE = 10
#: Vectors with links that the audit wants to see of each stratum.
LINKED = 256
#: Vectors that the audit compares with all rows, at most, for one stratum.
AUDITED = 1 << 20
ORDER_BLOCK = 192
BLOCK = 1024
#: Rings around a component's centre within the threshold's angle.
RINGS = 64
GRAPH = "u long, v long, s double"
log = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kind(df: DataFrame) -> str:
    """The type of its vectors: as given, floats or doubles."""
    return df.schema["vec"].dataType.simpleString()


def edges_of(parts: list[tuple]) -> pa.RecordBatch:
    u, v, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "s"])


def reach_of(threshold: float) -> float:
    """The cosine of two times the threshold's angle: vectors further apart have no vector that links to both."""
    return 2 * threshold * threshold - 1 - 1e-9 if threshold > 0 else -2.0


def random_orders(classes: DataFrame, seeds: list[int], k: int, dim: int, least: float) -> DataFrame:
    """Edges (u, v, s): in each random order the k best of those in the same block of ORDER_BLOCK neighbours, s being ``least`` or more."""

    def place(batches):
        for b in batches:
            x = unit(matrix(b.column(1)))
            for seed in seeds:
                p = x @ np.random.default_rng(seed).standard_normal((dim, 13))
                code = ((p[:, :12] > 0) @ (1 << np.arange(12))).astype(np.float64) + 0.5 + 0.499 * np.tanh(p[:, 12])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), seed, np.int32)), pa.array(code), *b.columns], names=["seed", "code", "cid", "vec"])

    def compare(batches):
        left: pa.Table | None = None
        for b in [*batches, None]:
            t = left if b is None else pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            if t is None:
                return
            parts, at = [], 0
            while t.num_rows - at >= (1 if b is None else ORDER_BLOCK):
                c = t.slice(at, ORDER_BLOCK).combine_chunks()
                at += ORDER_BLOCK
                ids, seed = c["cid"].to_numpy(), c["seed"].to_numpy()
                x = unit(matrix(c["vec"].combine_chunks()))
                s = np.where(seed[:, None] == seed, np.minimum(x @ x.T, 1.0), -2.0)
                np.fill_diagonal(s, -2.0)
                n = min(k, len(ids))
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                row = np.repeat(np.arange(len(ids)), n)
                val = s[row, top.ravel()]
                ok = val >= max(least, -1.0)
                parts.append((ids[row][ok], ids[top.ravel()][ok], val[ok]))
            yield edges_of(parts)
            left = t.slice(at) if at < t.num_rows else None

    n = max(2, classes.sparkSession.sparkContext.defaultParallelism)
    dealt = classes.select("cid", "vec").mapInArrow(place, f"seed int, code double, cid long, vec {kind(classes)}")
    return dealt.repartitionByRange(n, "seed", "code", "cid").sortWithinPartitions("seed", "code", "cid").mapInArrow(compare, GRAPH)


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best (v, s, new) of each u; an edge is new only if each row of it is."""
    w = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def descend(classes: DataFrame, graph: DataFrame, k: int, least: float) -> DataFrame:
    """One round: the lists after the neighbours of each vector have been compared with each other. Vectors are sent to lists that hold a new edge."""
    back = Window.partitionBy("u").orderBy(F.desc("new"), F.desc("s"), "v")
    reverse = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "new").withColumn("r", F.row_number().over(back)).where(F.col("r") <= REVERSE).drop("r")
    around = graph.unionByName(reverse).groupBy("u", "v").agg(F.max("new").alias("new"))
    around = around.join(around.where("new = 1").select("u").distinct(), "u", "left_semi")
    worst = graph.groupBy("u").agg(F.min("s").alias("worst"), F.count("*").alias("n")).select(F.col("u").alias("v"), F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(-2.0)).alias("worst"))
    known = classes.select(F.col("cid").alias("v"), "vec").join(worst, "v", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    # Lists of at most LIST + REVERSE neighbours with their vectors; a hub is in many lists but has a short one itself.
    lists = around.join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "new", "worst", "vec")).alias("near")).select("near")

    def local_join(batches):
        for b in batches:
            near = b.column(0)
            ends = np.concatenate([[0], np.cumsum(near.value_lengths().to_numpy())])
            flat = near.flatten()
            ids, new, worst = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = unit(matrix(flat.field(3)))
            parts = []
            for i, j in zip(ends, ends[1:], strict=False):
                s = np.minimum(x[i:j] @ x[i:j].T, 1.0)
                a, c = np.nonzero((s >= least) & (s > np.minimum(worst[i:j, None], worst[i:j])) & np.triu(new[i:j, None] | new[i:j], 1).astype(bool))
                if len(a):
                    parts.append((ids[i + a], ids[i + c], s[a, c]))
            yield edges_of(parts)

    found = lists.mapInArrow(local_join, GRAPH)
    found = found.union(found.select("v", "u", "s")).withColumn("new", F.lit(1))
    return best_lists(graph.withColumn("new", F.lit(0)).unionByName(found), k)


def centres_of(members: DataFrame, most: int = 4096) -> DataFrame:
    """(component, centre): the mean direction of each component of ``members(component, vec)``. Sums leave a task, no vectors."""

    def sums(batches):
        part: dict[int, np.ndarray] = {}
        for b in [*batches, None]:
            if b is None or len(part) > most:
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(list(part), pa.int64()), pa.array([x.tolist() for x in part.values()], pa.list_(pa.float64()))], names=["component", "part"])
                part = {}
            if b is not None and b.num_rows:
                c, x = b.column(0).to_numpy(), unit(matrix(b.column(1)))
                order = np.argsort(c, kind="stable")
                each, first = np.unique(c[order], return_index=True)
                for key, total in zip(each.tolist(), np.add.reduceat(x[order], first, axis=0), strict=True):
                    part[key] = part[key] + total if key in part else total

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["part"].to_numpy()).sum(0)
        return pd.DataFrame({"component": [key[0]], "centre": [x if np.abs(x).max() > 1e-9 else np.eye(1, len(x))[0]]})

    return members.select("component", "vec").mapInArrow(sums, "component long, part array<double>").groupBy("component").applyInPandas(add, "component long, centre array<double>")


def count_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(cid, linked): how many vectors, copies counted, link to each class of ``members(component, cid, n, vec)``. A component of up to a
    BLOCK of classes is one matrix product; of larger ones:

    Vectors are dealt to rings by their angle to the component's centre, RINGS of them to the threshold's angle. By the triangle inequality all
    vectors of two rings link if their outer edges add up to less than that angle, and none do if they lie further apart than it; so a dense
    component is counted by its rings' sizes. Each pair of blocks of the other pairs of rings is one task's matrix product; the sums are all
    that leaves it."""
    sized = cut(members.groupBy("component").agg(F.count("*").alias("classes")))
    few = members.join(sized.where(F.col("classes") <= BLOCK), "component", "left_semi")

    def all_of(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
        linked = np.minimum(x @ x.T, 1.0) >= threshold
        np.fill_diagonal(linked, False)
        return pd.DataFrame({"cid": pdf["cid"], "linked": linked @ pdf["n"].to_numpy()})

    small = few.select("component", "cid", "n", "vec").groupBy("component").applyInPandas(all_of, "cid long, linked long")
    if not sized.where(F.col("classes") > BLOCK).limit(1).count():
        return small
    members = members.join(sized.where(F.col("classes") > BLOCK), "component", "left_semi")
    step = float(np.arccos(threshold)) / RINGS

    def rings(batches):
        for b in batches:
            a = np.arccos(np.clip((unit(matrix(b.column("vec"))) * unit(matrix(b.column("centre")))).sum(1), -1.0, 1.0)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "cid", "n", "vec")), pa.array((a / step).astype(np.int32))], names=["component", "cid", "n", "vec", "ring"])

    m = cut(members.join(centres_of(members), "component").select("component", "cid", "n", "vec", "centre").mapInArrow(rings, f"component long, cid long, n long, vec {kind(members)}, ring int"))
    sizes = cut(m.groupBy("component", "ring").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    other = sizes.select("component", F.col("ring").alias("o"), F.col("total").alias("o_total"), F.col("parts").alias("o_parts"))
    pairs = sizes.join(other, "component")
    all_link = F.col("ring") + F.col("o") + 3 <= RINGS  # a ring to spare
    whole = pairs.where(all_link).groupBy("component", "ring").agg(F.sum("o_total").alias("inside"))
    own = F.when(F.col("ring") * 2 + 3 <= RINGS, F.col("n")).otherwise(F.lit(0))
    by_rings = m.join(whole, ["component", "ring"]).select("cid", (F.col("inside") - own).alias("linked"))
    some = pairs.where(~all_link & (F.abs(F.col("ring") - F.col("o")) <= RINGS + 1)).select("component", "ring", "o", "parts", "o_parts")
    dealt = m.join(some, ["component", "ring"]).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("o_parts") - 1)))
    mine, theirs = F.struct(F.col("ring").alias("r"), F.col("b").alias("b")), F.struct(F.col("o").alias("r"), F.col("p").alias("b"))
    dealt = dealt.select("component", F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"), mine.alias("own"), "cid", "n", "vec").withColumn("first", F.col("own") == F.col("i")).withColumn("same", F.col("i") == F.col("j"))
    dealt = dealt.select("component", *(F.col(f"{x}.{y}").alias(f"{x}{y}") for x in "ij" for y in "rb"), "first", "same", "cid", "n", "vec")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        cid, n, first, x = pdf["cid"].to_numpy(), pdf["n"].to_numpy(), pdf["first"].to_numpy(), unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
        total = np.zeros(len(cid), np.int64)
        if pdf["same"].iat[0]:
            linked = np.minimum(x @ x.T, 1.0) >= threshold
            np.fill_diagonal(linked, False)
            total = linked @ n
        else:
            one, two = np.flatnonzero(first), np.flatnonzero(~first)
            linked = np.minimum(x[one] @ x[two].T, 1.0) >= threshold
            total[one], total[two] = linked @ n[two], linked.T @ n[one]
        return pd.DataFrame({"cid": cid, "linked": total})

    in_blocks = dealt.groupBy("component", "ir", "ib", "jr", "jb").applyInPandas(count, "cid long, linked long")
    return by_rings.unionByName(in_blocks).groupBy("cid").agg(F.sum("linked").alias("linked")).unionByName(small)


def neighbours(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, side, cid, n, vec): for each two components a < b that may link, the vectors of a (side 0) and of b (side 1) that
    may link to the other one. A vector with a link into a component is, by the triangle inequality of angles, no further
    from its centre than its radius and the threshold's angle together; so none is lost."""
    reach = float(np.arccos(threshold)) + 1e-6
    centres = members.groupBy("component").agg(F.min_by("vec", "cid").alias("centre"))

    def angles(batches):
        for b in batches:
            a = np.arccos(np.clip((unit(matrix(b.column("vec"))) * unit(matrix(b.column("centre")))).sum(1), -1.0, 1.0)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a, pa.float64())], names=[*b.schema.names, "angle"])

    radii = members.select("component", "vec").join(centres, "component").mapInArrow(angles, f"component long, vec {kind(members)}, centre {kind(members)}, angle double")
    balls = cut(radii.groupBy("component").agg(F.max("angle").alias("radius")).join(centres, "component"))
    blocks = -(-balls.count() // BLOCK)
    dealt = balls.withColumn("b", F.pmod(F.xxhash64("component"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        c, b, r, x = pdf["component"].to_numpy(), pdf["b"].to_numpy(), pdf["radius"].to_numpy(), unit(np.stack(pdf["centre"].to_numpy()).astype(np.float64))
        one, two = np.flatnonzero(b == i), np.flatnonzero(b == j)
        near = np.arccos(np.clip(x[one] @ x[two].T, -1.0, 1.0)) <= r[one][:, None] + r[two] + reach
        k, m = np.nonzero(near & ((c[one][:, None] < c[two]) if i == j else True))
        p, q = c[one[k]], c[two[m]]
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    pairs = dealt.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "component", "radius", "centre").groupBy("i", "j").applyInPandas(meet, "a long, b long")
    pairs = cut(pairs)
    ways = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("component"), F.col("b").alias("other")).unionByName(pairs.select("a", "b", F.lit(1).alias("side"), F.col("b").alias("component"), F.col("a").alias("other")))
    ways = ways.join(balls.withColumnRenamed("component", "other"), "other").select("a", "b", "side", "component", "radius", "centre")
    sent = members.join(ways, "component").select("a", "b", "side", "cid", "n", "radius", "vec", "centre")
    sent = sent.mapInArrow(angles, f"a long, b long, side int, cid long, n long, radius double, vec {kind(members)}, centre {kind(members)}, angle double")
    return sent.where(F.col("angle") <= F.col("radius") + reach).select("a", "b", "side", "cid", "n", "vec")


def count_between(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cid, linked): how many vectors, copies counted, of the other one of the components a and b link to each class, where
    any does. ``members`` are as for ``count_in_blocks``; a task has at most a block of each component."""
    sent = cut(neighbours(members, threshold))
    sizes = sent.groupBy("a", "b").agg(*(F.ceil(F.sum((F.col("side") == k).cast("int")) / BLOCK).cast("int").alias(f"blocks{k}") for k in (0, 1))).where("blocks0 > 0 and blocks1 > 0")
    mine, other = (F.when(F.col("side") == k, F.col("blocks0")).otherwise(F.col("blocks1")) for k in (0, 1))
    m = sent.join(sizes, ["a", "b"]).withColumn("own", F.pmod(F.xxhash64("cid"), mine).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), other - 1)))
    m = m.select("a", "b", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("o")).alias("i"), F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("own")).alias("j"), "side", "cid", "n", "vec")

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cid, n, side, x = pdf["cid"].to_numpy(), pdf["n"].to_numpy(), pdf["side"].to_numpy(), unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        linked = np.minimum(x[one] @ x[two].T, 1.0) >= threshold
        total = np.zeros(len(cid), np.int64)
        total[one], total[two] = linked @ n[two], linked.T @ n[one]
        some = np.flatnonzero(total)
        return pd.DataFrame({"a": key[0], "b": key[1], "cid": cid[some], "linked": total[some]})

    found = m.groupBy("a", "b", "i", "j").applyInPandas(count, "a long, b long, cid long, linked long")
    return found.groupBy("a", "b", "cid").agg(F.sum("linked").alias("linked"))


def audit(classes: DataFrame, links: DataFrame, comps: DataFrame, size: int, threshold: float, seed: int = 0, need: int = LINKED) -> float:
    """The least recall of the strata, which are vectors in found components of at most 3 classes (or in none), of up to 31, and of
    more: the mean, over sampled vectors that link, of the share of their links that ``links(cid, linked)`` has, against brute
    force over all rows. Each stratum is sampled in batches of about ``size`` to four times that until ``need`` of its vectors link or none is left,
    or AUDITED of them were compared: 1.0 of a stratum without links means that all of it was, or that of so many none had a link. A vector
    counts once, whatever its links."""
    sizes = comps.groupBy("component").count()
    sized = comps.join(sizes, "component").select("cid", "count")
    kind = F.when(F.coalesce("count", F.lit(1)) <= 3, 0).when(F.col("count") <= 31, 1).otherwise(2)
    strata = cut(classes.select("cid", "vec").join(sized, "cid", "left").select("cid", "vec", kind.alias("kind"), F.xxhash64("cid", F.lit(f"audit {seed}")).alias("h")))
    rows = {r.kind: r.n for r in strata.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    worst = 1.0
    for k, n in sorted(rows.items()):
        parts, at, seen, share = -(-n // size), 0, 0, 0.0
        while at < parts and seen < need and at * size < AUDITED:
            upto = min(at + min(at + 1, 4), parts)
            part = F.pmod("h", F.lit(parts))
            picked = strata.where((F.col("kind") == k) & (part >= at) & (part < upto)).select("cid", "vec").toArrow()
            at = upto
            if not picked.num_rows:
                continue
            ids, q = picked["cid"].to_numpy(), unit(matrix(picked["vec"].combine_chunks()))

            def scan(batches, ids=ids, q=q):
                total = np.zeros(len(ids), np.int64)
                for b in batches:
                    step = max(64, (1 << 22) // len(ids))
                    for start in range(0, b.num_rows, step):
                        c = b.slice(start, step)
                        i, j = np.nonzero(q @ unit(matrix(c.column(2))).T >= threshold)
                        cid, copies = c.column(0).to_numpy(), c.column(1).to_numpy()
                        other = ids[i] != cid[j]
                        np.add.at(total, i[other], copies[j[other]])
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], names=["cid", "true"])

            true = classes.select("cid", "n", "vec").mapInArrow(scan, "cid long, true long").groupBy("cid").agg(F.sum("true").alias("true"))
            got = true.join(links, "cid", "left").agg(F.count("*").alias("n"), F.sum(F.least("true", F.coalesce("linked", F.lit(0))) / F.col("true")).alias("share")).first()
            seen, share = seen + got.n, share + (got.share or 0.0)
        worst = min(worst, share / seen if seen else 1.0)
    return worst


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = LIST, recall: float = 0.98, sample: int = 4096, max_rounds: int = 6, max_restarts: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links (other vectors with a cosine of ``threshold`` or more that were
    found), component_id (smallest vec_id reachable), kept (vec_id is component_id). Raises if an audit finds less than ``recall`` of
    the links after ``max_restarts`` restarts; the log tells what it found.

    Equal vectors are compared once and counted as often as they occur. A vector can link with those of its own length, each
    length being searched by itself. Vectors that are null, zero, or hold null or non-finite components link with nothing: 0 links, their own
    component, kept. So do vectors with none near. Repeated rows link like other copies; a null id is null in component_id unless its component
    has another, and is kept only if it hasn't. Other columns are ignored; an empty table gives an empty one."""
    floats = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if floats else "array<double>").alias("vec"))
    ok = is_valid_vector("vec")
    classes = cut(rows.where(ok).groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()))
    out = rows.where(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for r in sorted(classes.groupBy(F.size("vec").alias("dim")).count().collect()):  # a row for each length
        mine = classes.where(F.size("vec") == r.dim)
        links, comps = _search(mine, r.dim, threshold, k, recall, sample, max_rounds, max_restarts) if r["count"] > 1 else (mine.where("false").select("cid", F.lit(0).cast("long").alias("linked")), mine.where("false").select("cid", F.col("cid").alias("component")))
        c = mine.join(links, "cid", "left").join(comps, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        least = c.groupBy("component").agg(F.min("least").alias("component_id"))
        c = c.join(least, "component").select("vec", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
        out = out.unionByName(rows.where(ok & (F.size("vec") == r.dim)).join(c, "vec").select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _search(classes: DataFrame, dim: int, threshold: float, k: int, recall: float, sample: int, max_rounds: int, max_restarts: int) -> tuple[DataFrame, DataFrame]:
    """((cid, linked), (cid, component)) of ``classes(cid, n, vec)`` that link to others."""
    orders, graph, least = 4, None, reach_of(threshold)
    for restart in range(max_restarts):
        for part in range(2**restart - 1, 2 ** (restart + 1) - 1):  # each time twice as many orders, a few at once
            fresh = random_orders(classes, [1 + part * orders + i for i in range(orders)], k, dim, least).withColumn("new", F.lit(1))
            graph = cut(best_lists(fresh if graph is None else graph.unionByName(fresh), k))
        for _ in range(max_rounds):
            graph = cut(descend(classes, graph, k, least))
            # What is new in a saturated list tells nothing: its component is enlarged below.
            of_u = graph.where(F.col("s") >= threshold).groupBy("u").agg(F.sum("new").alias("new"), F.count("*").alias("n"))
            new, all_links = of_u.agg(F.sum(F.when(F.col("n") < k, F.col("new"))), F.sum("n")).first()
            if (new or 0) <= 0.002 * (all_links or 0):
                break
        close = graph.where(F.col("s") >= threshold).select("u", "v")
        comps = cut(components(close.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("cid"), "component"))
        full = close.groupBy("u").count().where(F.col("count") >= k).select(F.col("u").alias("cid"))
        wide = comps.join(full, "cid", "left_semi").select("component").distinct()
        members = comps.join(wide, "component", "left_semi").join(classes, "cid").select("component", "cid", "n", "vec")
        both = close.union(close.select("v", "u")).distinct()
        narrow = comps.join(wide, "component", "left_anti").select(F.col("cid").alias("u"))
        links = both.join(narrow, "u", "left_semi").join(classes.select(F.col("cid").alias("v"), "n"), "v").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("linked"))
        n_wide = wide.limit(2).count()
        if n_wide:
            members = cut(members)
            links = links.unionByName(count_in_blocks(members, threshold))
        if n_wide > 1:
            between = cut(count_between(members, threshold))
            links = links.unionByName(between.select("cid", "linked")).groupBy("cid").agg(F.sum("linked").alias("linked"))
            joined = components(between.select("a", "b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("least"))
            comps = cut(comps.join(joined, "component", "left").select("cid", F.coalesce("least", "component").alias("component")))
        links = cut(links)
        share = audit(classes, links, comps, sample, threshold, restart)
        log.info("near_duplicates: %.4f of the links of an audited vector found after %d orders", share, orders * (2 ** (restart + 1) - 1))
        if share >= recall:
            return links, comps
    raise RuntimeError(f"near_duplicates: {share:.4f} of the links of an audited vector found after {max_restarts} restarts, below {recall}")
