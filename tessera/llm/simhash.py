"""SimHash near-dedup with BK-trees.

Fingerprints that differ in at most ``RADIUS`` = 2 of 64 bits agree on two of four 16-bit blocks, so six masks
of two blocks deal the distinct fingerprints into shards that together hold every link. A shard with more than
``SHARD`` fingerprints is dealt again by parts of the bits that are still free (one of three parts must agree);
as distinct fingerprints that share all but f bits are at most 2^f, four levels bound every shard, whatever the
data. In each shard a BK-tree (children keyed by Hamming distance to the parent) finds the neighbours within
the radius, following only edges whose distance can lead to one. A shard returns a link from each fingerprint to
the smallest it reaches, not all pairs; the links' connected components are the groups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import components, cut

RADIUS = 2
SHARD = 512
FULL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, size: int = 3) -> int:
    """Of the word shingles' XXH64 (seed 42): a bit is one if it is in over half of them."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()  # bytes: A-Z only; white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter((h(s, 42) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row, from its whole text."""

    def run(batches):
        for b in batches:
            fps = [signed(fingerprint(t or b"")) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bits(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def first_masks(radius: int = RADIUS) -> list[int]:
    """Masks of two of radius + 2 blocks: of so many blocks at most ``radius`` hold a difference."""
    blocks = np.array_split(np.arange(64), radius + 2)
    return [sum(1 << int(b) for part in pair for b in part) for pair in combinations(blocks, 2)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """``mask`` with each of radius + 1 parts of the bits that it leaves free; one of them must agree."""
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(bits(FULL & ~mask), radius + 1)]


class BKTree:
    """Each node's children by their integer distance to it."""

    def __init__(self):
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def add(self, x: int) -> int:
        """Its place; x must not be in the tree."""
        at = 0 if self.nodes else None
        while at is not None:
            y, children = self.nodes[at]
            at = children.get(d := (x ^ y).bit_count())
        if self.nodes:
            children[d] = len(self.nodes)
        self.nodes.append((x, {}))
        return len(self.nodes) - 1

    def near(self, x: int, radius: int) -> list[int]:
        """Places of those within ``radius`` of x. By the triangle inequality only edges of d - radius to d + radius lead there."""
        found, todo = [], [0] if self.nodes else []
        while todo:
            y, children = self.nodes[at := todo.pop()]
            d = (x ^ y).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
        return found


def shard_links(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(fingerprint, the smallest one that it reaches by links inside the shard), for those that reach a smaller one."""
    fps = sorted(fps)
    tree, root = BKTree(), list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for k, x in enumerate(fps):
        unsigned = x & FULL
        for j in tree.near(unsigned, radius):
            a, b = sorted((find(k), find(j)))
            root[b] = a
        tree.add(unsigned)
    return [(x, fps[r]) for k, x in enumerate(fps) if (r := find(k)) != k]


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct ``fps(fp)`` within ``radius`` bits."""

    def solve(batches):
        for b in batches:
            out = [e for x in b.column(0).to_pylist() for e in shard_links(x, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    masks = first_masks(radius)
    rows = fps.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    found = None
    while True:
        rows = rows.withColumn("part", F.expr("fp & mask"))
        sizes = cut(rows.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"))
        # A shard's list has at most ``shard`` longs, by the count beside it.
        small = rows.join(sizes.where(F.col("n") <= shard).drop("n"), ["mask", "part"]).groupBy("mask", "part").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(solve, "a long, b long")
        found = small if found is None else found.union(small)
        large = sizes.where(F.col("n") > shard).drop("n")
        if large.isEmpty():
            return found
        finer = {m: finer_masks(m, radius) for m in masks}
        masks = sorted({x for xs in finer.values() for x in xs})
        into = F.create_map(*(x for m, xs in finer.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(y)) for y in xs)))))
        rows = cut(rows.join(large, ["mask", "part"]).select("fp", F.explode(into[F.col("mask")]).alias("mask")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for each row of ``docs``; component_id is the smallest id of the
    fingerprints reachable by links of at most ``radius`` bits.

    Copies meet as one fingerprint before anything is joined. Null and empty texts, and texts of white space,
    have fingerprint zero and link like others. Repeated rows give repeated rows; a null id takes the smallest
    other id of its group, null if there is none. Other columns are ignored; an empty table gives an empty one."""
    rows = cut(fingerprints(docs, id_col, text_col))
    each = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = components(links(each.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    named = each.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, name: str = "fp", text_col: str = "text") -> DataFrame:
    """``docs`` with its fingerprints as a last column of hex digits."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            fps = [f"{fingerprint(t or b''):016x}" for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.string())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, StringType())]))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each group of near copies stays: that with the
    smallest doc_id; of rows with that id one. Rows without id stay only in groups that have no id, one a fingerprint."""
    groups = cut(near_duplicates(docs.select("doc_id", "text"), radius))
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = cut(groups.groupBy("doc_id").agg(F.count("*").alias("m"), F.bool_or(own).alias("own")).where("own"))
    kept = docs.join(ids.where("m = 1 AND doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    odd = ids.where("m > 1 OR doc_id IS NULL").select("doc_id")
    if odd.isEmpty():
        return kept
    some = docs.join(odd, docs["doc_id"].eqNullSafe(odd["doc_id"]), "left_semi")
    some = with_fingerprint(some, "__fp")
    right = groups.where(own).select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__print")).distinct()
    some = some.join(right, some["doc_id"].eqNullSafe(right["__id"]) & (some["__fp"] == right["__print"]), "left_semi")
    some = some.withColumn("__each", F.when(F.col("doc_id").isNull(), F.col("__fp"))).dropDuplicates(["doc_id", "__each"])
    return kept.unionByName(some.select(docs.columns))
