"""Suffix-array dedup: bytes covered by strings of a given length that occur more than once are removed.

A string of ``length`` bytes is *anchored* at the least hashed of its ``seed``-byte substrings (the leftmost of equals), so equal strings
have equal anchors. Strings in a row that share an anchor are one segment. Only segments whose anchor occurs again can hold repeated strings;
of those, equal segments are counted as one, and different segments with one anchor meet in a task. There the suffixes that begin at the
anchors, and the reversed prefixes that end there, are sorted: a mergesort whose comparisons find common extensions by binary search over
prefix polynomial hashes. Each result is verified byte by byte and sorted again by another base if a hash collided. Two strings at the same
distance from their anchors are equal if they are neighbours deep enough in both orders.

Texts are shuffled once, compressed, into a table with buckets by text; whatever needs them again is sent to their buckets.

Anchors that very many different segments share are split: the strings on each side of the anchor take a longer one, half of the missing
bytes to the left or to the right, until few are together or the anchor is the whole string. So no group is ever held whole.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from functools import cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, cut, remove_folder, shared_folder, stored

LENGTH = 200
SEED = 32
#: Different segments of one anchor that are sorted in one task.
MOST = 2048
#: Segments that are sorted together, at least, and rows of a batch.
BLOCK = 1024
#: Bytes of text that are hashed at once.
PIECE = 1 << 16
#: Odd multipliers modulo 2^64: the first makes anchors, the others compare suffixes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
U = np.uint64


@cache
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Prefix:
    """Prefix hashes of a byte string: the hash of any part in constant time."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = powers(base, 1 << max(10, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def part(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def anchors(data: np.ndarray, ends: np.ndarray, length: int, seed: int):
    """Texts laid end to end (``ends`` as offsets, from 0) -> for each segment its first start, count of starts, anchor's place and key."""
    n, span = len(data), length - seed + 1
    starts = n - length + 1
    mark = np.zeros(n + 1, np.int32)  # starts of strings that lie within one text
    np.add.at(mark, ends[:-1], 1)
    np.add.at(mark, np.maximum(ends[:-1], ends[1:] - length + 1), -1)
    good = np.flatnonzero(np.cumsum(mark)[: max(starts, 0)] > 0)
    if not len(good):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    h = Prefix(data, BASES[0])
    k = (h.sums[seed:] - h.sums[:-seed]) * h.down[: n - seed + 1]
    k ^= k >> U(32)
    k *= U(0xFF51AFD7ED558CCD)
    k ^= k >> U(29)
    # sliding leftmost minimum: suffixes and prefixes of blocks of ``span``
    blocks = -(-len(k) // span)
    v = np.full(blocks * span, U(2**64 - 1))
    v[: len(k)] = k
    v = v.reshape(blocks, span)
    at = np.arange(blocks * span).reshape(blocks, span)
    low = np.minimum.accumulate(v, axis=1)
    new = np.ones_like(v, bool)
    new[:, 1:] = v[:, 1:] < low[:, :-1]
    low_at = np.maximum.accumulate(np.where(new, at, 0), axis=1).ravel()
    back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1]
    back_at = np.minimum.accumulate(np.where(back == v, at, blocks * span)[:, ::-1], axis=1)[:, ::-1].ravel()
    low, back = low.ravel()[good + span - 1], back.ravel()[good]
    place = np.where(back <= low, back_at[good], low_at[good + span - 1])
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (good[1:] != good[:-1] + 1)])
    return good[first], np.diff(np.r_[first, len(good)]), place[first], k[place[first]].view(np.int64)


def pieces(batch: pa.RecordBatch, length: int):
    """Texts of a batch in pieces of about PIECE bytes: (bytes, offsets, row of the first text, offset of the piece in that text). A piece has
    the ``length`` - 1 bytes after its own, so each string starts in one piece; a string cut off at a text's end starts in none."""
    text = batch.column("text").cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    for a in range(int(ends[0]), int(ends[-1]), PIECE):
        b = min(a + PIECE + length - 1, int(ends[-1]))
        i, j = int(np.searchsorted(ends, a, "right")) - 1, int(np.searchsorted(ends, b, "left"))
        yield data[a:b], np.clip(ends[i : j + 1] - a, 0, b - a), i, a - int(ends[i])


def keys(batches, length: int, seed: int):
    """Texts -> each one's anchors: key, id, how often."""
    for batch in few_rows(batches, 2048):
        ids = batch.column("id")
        for data, ends, row, _ in pieces(batch, length):
            start, _, _, key = anchors(data, ends, length, seed)
            text = row + np.searchsorted(ends, start, "right") - 1
            order = np.lexsort((key, text))
            key, text = key[order], text[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(key)])
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), ids.take(pa.array(text[first])), pa.array(np.diff(np.r_[first, len(key)]))], names=["key", "id", "c"])


#: ``parent`` and ``pos``: the text, or the segment one level up, and where in it the first string starts. ``starts`` strings; ``at``: the
#: anchor's place from the first start; ``fresh``: this task hasn't said the segment before; ``bytes``: null where the parent is a text.
ROWS = "key long, seg binary, parent binary, pos long, starts int, at int, copies long, fresh boolean, bytes binary"


def to_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])


def name_of(at: int, part: bytes) -> bytes:
    """What identifies a segment: 128 bits of its bytes and its anchor's place."""
    return hashlib.blake2b(part, digest_size=16, salt=at.to_bytes(8, "little")).digest()


def few_rows(batches, rows: int = 256):
    """Slices of batches. Arrow gives back what it doesn't use after each batch, as workers go on to other stages."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        pa.default_memory_pool().release_unused()


def compressed(batches):
    """id and text -> id and the text compressed."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in few_rows(batches):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([z.compress(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())], names=["id", "z"])


def texts_of(batches):
    """Batches of few rows, with their texts' bytes in place of the compressed ones."""
    z = zstandard.ZstdDecompressor()
    for batch in few_rows(batches):
        at = batch.schema.get_field_index("z")
        yield batch.set_column(at, "text", pa.array([z.decompress(x) for x in batch.column(at).to_pylist()], pa.binary()))


def segments(batches, length: int, seed: int):
    """Texts with the keys that occur again -> the segments of those keys."""
    said: set[bytes] = set()
    for batch in texts_of(batches):
        ids, copies = batch.column("id").to_pylist(), batch.column("copies").to_pylist()
        wanted = np.unique(batch.column("keys").flatten().to_numpy(zero_copy_only=False))
        for data, ends, row, shift in pieces(batch, length):
            start, count, place, key = anchors(data, ends, length, seed)
            keep = np.isin(key, wanted)
            start, count, place, key = start[keep], count[keep], place[keep], key[keep]
            text = np.searchsorted(ends, start, "right") - 1
            pos = start - ends[text] + np.where(text == 0, shift, 0)
            whole, rows = data.tobytes(), []
            for s, n, p, k, t, at in zip(start.tolist(), count.tolist(), place.tolist(), key.tolist(), text.tolist(), pos.tolist(), strict=True):
                seg = name_of(p - s, whole[s : s + n - 1 + length])
                rows.append((k, seg, ids[row + t], at, n, p - s, copies[row + t], seg not in said, None))
                said.add(seg)
                if len(rows) == BLOCK:
                    yield to_rows(rows)
                    rows = []
            yield to_rows(rows)


def split(batches, length: int, seed: int):
    """Segments of an anchor that too many share -> their strings with a longer anchor, to the left or to the right."""
    more = -(-(length - seed) // 2)
    for batch in batches:
        rows = []
        for seg, n, at, copies, part in zip(*(batch.column(c).to_pylist() for c in ("seg", "starts", "at", "n", "bytes")), strict=True):
            left = min(n, max(0, at - more + 1))  # so many strings have ``more`` bytes before the anchor
            for i, j, a in ((0, left, at - more), (left, n, at)):
                if i < j:
                    sub = part[i : j - 1 + length]
                    key = int.from_bytes(hashlib.blake2b(part[a : a + seed + more], digest_size=8).digest(), "little", signed=True)
                    rows.append((key, name_of(a - i, sub), seg, i, j - i, a - i, copies, True, sub))
        yield to_rows(rows)


MET = "key long, seg binary, starts int, at int, n long, m long, bytes binary"


def fetched(batches, length: int):
    """Texts with the segments wanted of each -> the segments with their bytes."""
    names = [x.split()[0] for x in MET.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    for batch in texts_of(batches):
        rows = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            rows += [(*(w[c] for c in names[:-1]), text[w["pos"] : w["pos"] + w["starts"] - 1 + length]) for w in wanted]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def extension(h: Prefix, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the suffixes at a and b, up to ``most``: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (go := np.flatnonzero(low < high)).size:
        mid = (low[go] + high[go] + 1) >> 1
        same = h.part(a[go], mid) == h.part(b[go], mid)
        low[go[same]] = mid[same]
        high[go[~same]] = mid[~same] - 1
    return low


def hash_sorted(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``data[start:start + size]`` in order within groups (``group`` ascends), and each one's common length with the one before.
    Mergesort from below: every suffix of a run finds its place in the sibling run by binary search."""
    h, n = Prefix(data, base), len(start)
    order, first = np.arange(n), np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    own = np.searchsorted(first, np.arange(n), "right") - 1
    begin, end = first[own], np.r_[first[1:], n][own]  # of each place's group
    ended = np.r_[data, np.zeros(1, np.uint8)]

    def less(x: np.ndarray, y: np.ndarray, on_tie: np.ndarray) -> np.ndarray:
        both = extension(h, start[x], start[y], np.minimum(size[x], size[y]))
        over_x, over_y = both == size[x], both == size[y]
        byte = ended[start[x] + both] < ended[start[y] + both]
        return np.where(over_x & over_y, on_tie, np.where(over_x, True, np.where(over_y, False, byte)))

    width, largest = 1, int((end - begin).max(initial=0))
    while width < largest:
        place = np.flatnonzero(end - begin > width)  # groups that aren't one run yet
        run = (place - begin[place]) // width
        other = begin[place] + (run ^ 1) * width
        low = np.minimum(other, end[place])
        other, high = low.copy(), np.minimum(low + width, end[place])
        right = run & 1 == 1
        while (go := np.flatnonzero(low < high)).size:
            mid = (low[go] + high[go]) >> 1
            # those of a right run come after equals of the left one
            before = less(order[mid], order[place[go]], right[go])
            low[go[before]] = mid[before] + 1
            high[go[~before]] = mid[~before]
        pair = begin[place] + (run >> 1) * 2 * width
        to = pair + (place - begin[place] - run * width) + (low - other)
        moved = order.copy()
        moved[to] = order[place]
        order, width = moved, width * 2
    common = np.zeros(n, np.int64)
    later = np.flatnonzero(np.arange(n) > begin)
    a, b = order[later - 1], order[later]
    common[later] = extension(h, start[a], start[b], np.minimum(size[a], size[b]))
    return order, common


def verified(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, order: np.ndarray, common: np.ndarray) -> bool:
    """Whether the bytes agree: common beginnings are equal, and what follows ascends."""
    later = np.flatnonzero(np.r_[False, group[1:] == group[:-1]][: len(start)])
    a, b, c = order[later - 1], order[later], common[later]
    ended = np.r_[data, np.zeros(1, np.uint8)]
    over_a, over_b = c == size[a], c == size[b]
    if not (over_a | (~over_b & (ended[start[a] + c] < ended[start[b] + c]))).all():
        return False
    for i in range(0, len(c), BLOCK):
        x, y, n = start[a[i : i + BLOCK]], start[b[i : i + BLOCK]], c[i : i + BLOCK]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(x, n) + inside] != data[np.repeat(y, n) + inside]).any():
            return False
    return True


def suffix_sort(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, bases=BASES[1:]) -> tuple[np.ndarray, np.ndarray]:
    """``hash_sorted``, verified; after a collision with another base."""
    for base in bases:
        order, common = hash_sorted(data, start, size, group, base)
        if verified(data, start, size, group, order, common):
            return order, common
    raise RuntimeError("hashes collided for every base")


def repeated(parts: list[bytes], group: np.ndarray, starts: np.ndarray, at: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """Different segments, by group -> which of their strings occur again: a row for each segment, a column for each start."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    right, right_common = suffix_sort(data, begin + at, size - at, group)
    left, left_common = suffix_sort(data[::-1], len(data) - begin - at, at, group)
    out, n = np.zeros((len(parts), int(starts.max())), bool), len(parts)
    for before in range(int((at - starts).min()) + 1, int(at.max()) + 1):  # bytes of the string before the anchor
        on = np.flatnonzero((before <= at) & (before > at - starts))
        if not len(on):
            continue
        classes = np.empty((2, n), np.int64)
        classes[0, right] = np.cumsum(right_common < length - before)
        classes[1, left] = np.cumsum(left_common < before)
        _, which, count = np.unique(classes[0, on] * (n + 1) + classes[1, on], return_inverse=True, return_counts=True)
        out[on, at[on] - before] = count[which] > 1
    return out | ((copies > 1)[:, None] & (np.arange(out.shape[1]) < starts[:, None]))


RANGES = "seg binary, start int, stop int"


def sorted_ranges(batches, length: int):
    """Segments ordered by key and name -> ranges of starts whose strings occur again. Whole keys are gathered to blocks."""
    held: list[tuple] = []

    def done(rows: list[tuple]) -> pa.RecordBatch:
        rows = [r for r, before in zip(rows, [None, *rows], strict=False) if before is None or r[1] != before[1]]
        key, name, starts, at, copies, parts = zip(*rows, strict=True)
        key = np.array(key)
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        found = repeated(list(parts), group, np.array(starts, np.int64), np.array(at, np.int64), np.array(copies), length)
        edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, start = np.nonzero(edges > 0)
        _, stop = np.nonzero(edges < 0)
        return pa.RecordBatch.from_arrays([pa.array([name[i] for i in row.tolist()], pa.binary()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["seg", "start", "stop"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "starts", "at", "n", "bytes")), strict=True):
            if len(held) >= BLOCK and held[-1][0] != row[0]:
                yield done(held)
                held = []
            held.append(row)
    if held:
        yield done(held)


def ranges(rows: DataFrame, fetch: Callable[[DataFrame], DataFrame], folder: str, length: int, seed: int, most: int, level: int = 0) -> DataFrame:
    """(parent, start, stop): ranges of starts within a text, or within a segment one level up, whose strings occur again. ``fetch`` adds the
    bytes to segments."""
    counted = stored(rows.groupBy("key", "seg").agg(F.sum("copies").alias("n"), F.first("starts").alias("starts")), folder, f"counted-{level}")
    shared = counted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = rows.where("fresh").drop("copies", "fresh").join(counted.select("key", "seg", "n").join(shared, "key"), ["key", "seg"]).dropDuplicates(["key", "seg"])
    met = stored(met, folder, f"met-{level}")
    collect_garbage(rows.sparkSession)
    last = seed >= length
    few = fetch(met if last else met.where(F.col("m") <= most)).repartition("key").sortWithinPartitions("key", "seg").mapInArrow(partial(sorted_ranges, length=length), RANGES)
    found = counted.where("n > 1").select("seg", F.lit(0).alias("start"), F.col("starts").alias("stop")).union(few)
    if not last and (met.agg(F.max("m")).first()[0] or 0) > most:
        below = stored(fetch(met.where(F.col("m") > most)).mapInArrow(partial(split, length=length, seed=seed), ROWS), folder, f"rows-{level + 1}")
        lower = ranges(below, lambda x: x, folder, length, seed + -(-(length - seed) // 2), most, level + 1)
        found = found.union(lower.select(F.col("parent").alias("seg"), "start", "stop"))
    found = stored(found, folder, f"found-{level}")
    collect_garbage(rows.sparkSession)
    return rows.select("seg", "parent", "pos").join(found, "seg").select("parent", (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("stop")).alias("stop"))


CUT = "id binary, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"


def removed(batches, length: int):
    """Texts with the starts of repeated strings -> the maximal runs of covered bytes, and the bytes that are left."""
    types = [pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
    for batch in texts_of(batches):
        rows = []
        for name, data, found in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "found")), strict=True):
            spans = []
            for r in sorted((r["start"], r["stop"] - 1 + length) for r in found):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append([*r])
            at = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
            rows.append((name, len(data) - len(kept), [{"start": a, "stop": b} for a, b in spans], kept))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["id", "n_removed", "spans", "kept"])


def text_id(text) -> F.Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


class Found:
    """The texts of ``docs(text)`` that lose bytes, each once: ``texts(id, n_removed, spans, kept)``; id as by ``text_id``, spans as runs of
    removed bytes, [start, stop), kept the bytes that are left, which may cut a character. To be used in a with block, at whose end the tables that it reads go.

    A null text is empty. Copies of a text are one text that counts as often; a text that occurs twice loses every byte if it has ``length``
    of them. Shorter texts lose nothing. An empty table gives an empty one. Texts are hashed in pieces and segments are short, so very long
    texts need no more memory than their own row; a run of one character has a segment for each byte."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, seed: int = SEED, most: int = MOST):
        self.spark = docs.sparkSession
        name = f"suffixes_{uuid.uuid4().hex}"
        self.folder, self.table = os.path.join(shared_folder(self.spark), name), name
        texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text")).where(F.octet_length("text") >= length).withColumn("id", text_id(F.col("text")))
        size = dict(length=length, seed=seed)
        k = stored(texts.mapInArrow(partial(keys, **size), "key long, id binary, c long"), self.folder, "keys")
        again = k.groupBy("key").agg(F.sum("c").alias("c")).where("c > 1").select("key")
        wanted = stored(k.select("key", "id").join(again, "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys")), self.folder, "wanted")
        remove_folder(self.spark, f"{self.folder}/keys")
        collect_garbage(self.spark)
        once = texts.mapInArrow(compressed, "id binary, z binary").groupBy("id").agg(F.first("z").alias("z"), F.count("*").alias("copies"))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        once.join(wanted, "id").write.bucketBy(buckets, "id").option("path", f"{self.folder}/texts").saveAsTable(name)
        collect_garbage(self.spark)
        held = self.spark.table(name)
        rows = stored(held.mapInArrow(partial(segments, **size), ROWS), self.folder, "rows-0")

        def fetch(met: DataFrame) -> DataFrame:
            asked = met.groupBy(F.col("parent").alias("id")).agg(F.collect_list(F.struct("key", "seg", "starts", "at", "n", "m", "pos")).alias("wanted"))
            return held.select("id", "z").join(asked, "id").mapInArrow(partial(fetched, length=length), MET)

        found = ranges(rows, fetch, self.folder, length, seed, most).groupBy(F.col("parent").alias("id")).agg(F.collect_list(F.struct("start", "stop")).alias("found"))
        self.texts = held.select("id", "z").join(found, "id").mapInArrow(partial(removed, length=length), CUT)

    def __enter__(self) -> DataFrame:
        return self.texts

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE {self.table}")
        remove_folder(self.spark, self.folder)


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """``docs(doc_id, text, ...)`` with text_left (binary) and spans added: what is left of each text, and the runs that were removed
    (empty: none). Rows and other columns stay as they are, whatever they hold; columns named like these two are replaced. See ``Found``."""
    with Found(docs, **how) as texts:
        lost = cut(texts.select(F.col("id").alias("_id"), F.col("spans").alias("_spans"), F.col("kept").alias("_kept")))
    text = F.coalesce(docs["text"], F.lit(""))
    both = docs.withColumn("_id", text_id(text)).join(lost, "_id", "left")
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return both.withColumns({"text_left": F.coalesce("_kept", text.cast("binary")), "spans": F.coalesce("_spans", none)}).drop("_id", "_spans", "_kept")


def digests(docs: DataFrame, **how) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256. See ``Found``. Texts themselves
    aren't joined, so repeated doc_ids, null ones and other columns play no part."""
    with Found(docs, **how) as texts:
        lost = cut(texts.select("id", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")).withColumn("id", F.unhex(F.substring("sha", 1, 32)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(lost, "id", "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


#: Every string of LENGTH bytes by its place: its first byte's character lies before it, so the hex of the text is cut by two digits a byte.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT rid, unnest(generate_series(1, octet_length(b) - {LENGTH} + 1)) AS i FROM d WHERE octet_length(b) >= {LENGTH}),
h AS (SELECT s.rid, s.i, md5(b[s.i:s.i + {LENGTH} - 1]) AS h FROM s JOIN d USING (rid)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > {LENGTH}, true) AS first FROM r),
n AS (SELECT rid, i, sum(first::INT) OVER (PARTITION BY rid ORDER BY i) AS span FROM g),
x AS (SELECT rid, span, min(i) AS a, max(i) + {LENGTH} AS z FROM n GROUP BY ALL),
k AS (SELECT rid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops FROM x GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(array_to_string(list_transform(generate_series(1, len(starts) + 1),
              lambda j: hex(b[CASE WHEN j = 1 THEN 1 ELSE stops[j - 1] END:CASE WHEN j > len(starts) THEN octet_length(b) ELSE starts[j] - 1 END])), '')) END) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""
