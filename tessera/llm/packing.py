"""Best-fit packing with certified bounds.

Documents become token ids, documents over the capacity are cut, and pieces are dealt to partitions of bounded
size, each packed by best-fit decreasing. Dual-feasible functions give a lower bound on any packing of the
partition. Where the bins exceed it, the partition gives its bins with room to a pool; the pool's pieces are
dealt anew, meet those of other partitions, and are packed again. That ends when the bounds are met, a round saves
nothing, or ``ROUNDS`` packings are done; whatever gap is left is in ``certificate``.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
#: Pieces that one task packs, about.
PIECES = 1 << 16
ROUNDS = 4
END = (0).to_bytes(4, "little")

#: A space with no white space beside it: the tokenizer's pre-tokens begin there, whatever stands around it.
LONE_SPACE = re.compile(r"(?<!\s) (?!\s)")
WIDE_SPACE = re.compile(r"\s | \s")
WIDE_ASCII = [x for c in "\t\n\v\f\r \x1c\x1d\x1e\x1f" for x in {c + " ", " " + c}]
#: Texts of these characters, and their pre-tokens.
PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ſ]*")
PRE_TOKENS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Settings of a tokenizer for which these cuts hold.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_characters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if it is printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def cuts_hold(tokenizer) -> bool:
    """Whether this tokenizer's ids are those of the parts of a text between lone spaces, and PRE_TOKENS its pre-tokens: by its
    settings, and on a text that has every three kinds of characters in a row."""
    t = json.loads(tokenizer.to_str())
    given = {k: (t["pre_tokenizer"] or {}).get(k) for k in BYTE_LEVEL}
    if given != BYTE_LEVEL or t["normalizer"] or t["post_processor"] or t["truncation"] or t["padding"] or t["model"]["type"] != "BPE" or t["model"]["dropout"]:
        return False
    plain_kinds = ["a", "Bc", "é", "ſ", "1", ".", "'s", "'", "\n", "\x1c", "\0", " "]
    ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    text = "".join(map("".join, product([*plain_kinds, "字", "²", "\u3000", "😀"], repeat=3)))
    first, *rest = LONE_SPACE.split(text)
    plain = "".join(map("".join, product(plain_kinds, repeat=3)))
    return ids(text) == [i for part in (first, *(" " + x for x in rest)) for i in ids(part)] and PRE_TOKENS.findall(plain) == [plain[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(plain)]


class Ids(dict):
    """Pre-token, or what stands from one lone space to the next -> its ids as little-endian 32-bit numbers.

    The library's model encodes a pre-token when it is new. Those of up to ``longest`` characters are kept, ``most`` of them; then
    they are the old ones, from which those in use come back, and what was old before goes. So two times ``most`` short strings and their
    ids are all that is held. A tokenizer for which the cuts aren't proven encodes texts whole."""

    def __init__(self, path: str, most: int = 250_000, longest: int = 48):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.longest, self.old = Tokenizer.from_file(path), most, longest, {}
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.numbers = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = cuts_hold(self.tokenizer)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        plain = part.isascii() or PLAIN.fullmatch(part)
        if plain and not (part[1:] if part[:1] == " " else part).isalpha():
            cut = PRE_TOKENS.findall(part)
            if len(cut) != 1:
                return b"".join(map(self.__getitem__, cut))
        ids = self.old.get(part)
        if ids is None:
            words = [part.encode().decode("latin-1").translate(self.characters)] if plain else [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            ids = b"".join([self.numbers[t.id] for w in words for t in self.model.tokenize(w)])
        if len(part) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.cut or any(s in text for s in self.special):
            return self.whole(text)
        wide = any(x in text for x in WIDE_ASCII) if text.isascii() else WIDE_SPACE.search(text)
        if wide or "\0" in text:
            first, *rest = LONE_SPACE.split(text)
            return b"".join(map(self.__getitem__, [first, *(" " + x for x in rest)]))
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Ids:
    """One for each Python worker, which keeps its table from task to task."""
    return Ids(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the id 0 that ends it. A document
    of more than ``capacity`` ids is cut into pieces of that many; the first may be shorter."""
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        ids = encoder(tokenizer_path)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = ids.encode(t.as_py() or "") + END
                n = len(data) // 4
                start = 0
                for k in range(-(-n // capacity)):
                    stop = (n - 1) % capacity + 1 + k * capacity
                    out.append((i, k, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                    start = stop
            cols = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(n: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of n[x] pieces of each length x has fewer bins, by the largest of two families of dual-feasible
    functions, in whole numbers.
    With x = length / capacity: (1 if x > 1 - e, x if e <= x <= 1 - e, else 0) for every e; and (x if (k+1) x is
    whole, else floor((k+1) x) / k) for k up to 20."""
    size = np.arange(capacity + 1)
    count, words = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    e = np.arange(capacity // 2 + 1)
    large, middle = count[-1] - count[capacity - e + 1], words[capacity - e + 1] - words[e]
    best = int((-(-(large * capacity + middle) // capacity)).max())
    for k in range(1, 21):
        times = (k + 1) * size
        value = np.where(times % capacity == 0, k * size, times // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each piece; fill of each bin). Bins wait by the room that they have left; a bit set of the
    rooms gives the smallest one in which a piece fits."""
    at, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = open_ >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        at[i], offset[i] = b, fill[b]
        fill[b] += x
        if room > x:
            rooms[room - x].append(b)
            open_ |= 1 << (room - x)
    return at, offset, np.asarray(fill, np.int64)


PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "gap", "row"]


def pack_partitions(rows: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """``rows`` dealt to ``parts`` partitions by a hash of their own number, whatever ids they share, and packed in each; fill: of a
    piece's bin; gap: the bins of its partition over the partition's lower bound. Only numbers are dealt, no texts."""
    given = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]

    def run(batches):
        from pyspark import TaskContext

        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        lengths = t["length"].to_numpy()
        at, offset, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        seq = (turn << 56) + (TaskContext.get().partitionId() << 32) + at
        cols = [*(t[c] for c in given[:5]), pa.array(seq), pa.array(offset), pa.array(fill[at]), pa.array(np.full(len(at), gap)), t["row"]]
        yield from pa.table(cols, names=PACKED).combine_chunks().to_batches(max_chunksize=10_000)

    dealt = rows.select(given).repartition(parts, F.xxhash64("row", F.lit(turn)))
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long, gap long, row long")


def pack(rows: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset: no sequence over ``capacity``, no gaps in one."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n_bins = lambda df: df.agg(F.count_if(F.col("offset") == 0)).first()[0]
    parts = lambda n: max(1, -(-n // per_task))
    packed = cut(pack_partitions(rows, parts(rows.count()), 0, capacity))
    for turn in range(1, rounds):
        loose = (F.col("gap") > 0) & (F.col("fill") < capacity)
        pool = packed.where(loose)
        n, old = pool.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if old < 2:
            break
        again = cut(pack_partitions(pool, parts(n), turn, capacity))
        if n_bins(again) >= old:
            break
        packed = packed.where(~loose).unionByName(again)
    return packed


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, per_task: int = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs``.

    Null and empty texts are the one id that ends a document. Repeated rows are packed as documents of their
    own; a null id stays null. Other columns are ignored; an empty table gives an empty one."""
    return pack(pieces(docs, tokenizer_path, capacity, id_col, text_col), capacity, per_task).select(PACKED[:7])


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound of any packing of all pieces): the bound needs the count of each length, at most ``capacity`` rows."""
    n = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        n[r.length] = r.n
    return packed.where("offset = 0").count(), lower_bound(n, capacity)
