"""Text vectors. The encoder is a plug; the one here needs no model: words and their parts hashed to signed components."""

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64


class Encoder(Protocol):
    """Unit vectors of texts, in order. Encoders are sent to the executors; one with a large model loads it there on first use.
    ``most_tokens`` is what its model reads of a text, None if all; an encoder that doesn't say has a model of 512."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


#: Words that a worker knows the components of, and the characters of the longest of them: some 40 MB.
WORDS, LONGEST = 1 << 17, 48
WORD, PART, GAP = re.compile(r"\w+"), re.compile(r"[A-Z]?[a-z0-9]+"), re.compile(r"\W")


@lru_cache(maxsize=WORDS)
def places(word: str, dim: int) -> tuple[tuple[int, int], ...]:
    """(component, sign) of a word and of each of its parts."""
    if PART.fullmatch(word):  # its only part is the whole
        h = zlib.crc32(word.lower().encode())
        return ((h % dim, 2 if h >> 31 else -2),)
    hashes = [zlib.crc32(part.lower().encode()) for part in (word.lower(), *PART.findall(word))]
    return tuple((h % dim, 1 if h >> 31 else -1) for h in hashes)


#: Texts under so many characters are taken word by word, more of them at once; and the characters that are taken at once.
FEW, MOST = 1 << 12, 1 << 18
#: What a character is: part of a word, A-Z, a-z or 0-9, of another length in UTF-8 (or another letter at a word's end) in lower case.
IN_WORD, UPPER, LOWER, ODD = 1, 2, 4, 8


@cache
def kinds() -> np.ndarray:
    """What each character is, by its number."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for m in WORD.finditer(np.arange(len(out), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        out[m.start() : m.end()] = IN_WORD
    for bit, chars in ((UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (LOWER, b"abcdefghijklmnopqrstuvwxyz0123456789")):
        out[list(chars)] |= bit
    for c in map(chr, np.flatnonzero(out & IN_WORD).tolist()):
        if c.lower() != c and len(c.lower().encode()) != len(c.encode()) or c == "Σ":
            out[ord(c)] |= ODD
    return out


@cache
def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of strings up to LONGEST bytes is an exclusive or of one number for each byte, by how many follow it, and one for the length."""
    zeros = np.array([zlib.crc32(bytes(n)) for n in range(LONGEST + 1)], np.uint32)
    return np.array([[zlib.crc32(bytes([b]) + bytes(n)) for b in range(256)] for n in range(LONGEST)], np.uint32) ^ zeros[1:, None], zeros


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start:end]``, none of them empty."""
    table, zeros = crc_tables()
    n = np.minimum(ends - starts, LONGEST)
    behind = np.cumsum(n)
    left = np.repeat(behind, n) - np.arange(1, n.sum() + 1)
    out = np.bitwise_xor.reduceat(table.ravel()[left * 256 + data[np.repeat(ends, n) - 1 - left]], behind - n) ^ zeros[n] if len(n) else n.astype(np.uint32)
    for i in np.flatnonzero(ends - starts > LONGEST):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def runs(there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of what is there start and end."""
    edges = np.flatnonzero(np.diff(there, prepend=False, append=False))
    return edges[::2], edges[1::2]


def by_word(texts: list[str], dim: int) -> np.ndarray:
    """The sum of the ``places`` of each text's words."""
    out = np.zeros((len(texts), dim))
    for k, text in enumerate(texts):
        row = [0] * dim
        for w, n in Counter(WORD.findall(text)).items():
            for i, sign in places(w, dim) if len(w) <= LONGEST else places.__wrapped__(w, dim):
                row[i] += n * sign
        out[k] = row
    return out


def at_once(texts: list[str], dim: int) -> np.ndarray:
    """The same, of all words of all texts at once, as arrays over their bytes: words are runs of their characters, parts those of a-z and 0-9 with
    an upper-case letter before; a word that is its only part counts twice."""
    text = "".join("\n" + t for t in texts)
    kind = kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if (kind & ODD).any():
        odd = np.bitwise_or.reduceat(kind, firsts[:-1]) & ODD > 0
        out = at_once(["" if o else t for t, o in zip(texts, odd, strict=True)], dim)
        out[odd] = by_word([t for t, o in zip(texts, odd, strict=True) if o], dim)
        return out
    low = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(low) > len(kind):
        new = low & 0xC0 != 0x80
        kind, firsts = kind[np.cumsum(new) - 1], np.append(np.flatnonzero(new), len(low))[firsts]
    words, parts = runs(kind & IN_WORD > 0), runs(kind & LOWER > 0)
    parts = (parts[0] - (kind[parts[0] - 1] & UPPER > 0), parts[1])
    ends, single = np.zeros(len(low), np.int64), np.zeros(len(low), bool)
    ends[words[0]] = words[1]
    whole = ends[parts[0]] == parts[1]
    single[parts[0][whole]] = True
    out = np.zeros(len(texts) * dim)
    for (a, b), times in ((words, 1 + single[words[0]]), ((parts[0][~whole], parts[1][~whole]), 1)):
        row, h = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(a, firsts))), crcs(low, a, b)
        out += np.bincount(row * dim + h % dim, np.where(h >> 31, times, -times), len(out))
    return out.reshape(-1, dim)


def gathered(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """``texts`` in groups of about MOST characters, with their numbers; a longer text in pieces, cut where no word is."""
    rows, pieces, held = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = GAP.search(text, at + MOST - held) if len(text) - at > MOST - held else None
            end = cut.start() if cut else len(text)
            rows.append(row)
            pieces.append(text[at:end])
            held, at = held + end - at, end
            if held >= MOST:
                yield rows, pieces
                rows, pieces, held = [], [], 0
    if rows:
        yield rows, pieces


class HashEncoder:
    """Deterministic, offline, and without any knowledge of meaning. It reads texts of any length."""

    most_tokens = None

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for rows, pieces in gathered([t or "" for t in texts]):
            np.add.at(out, rows, (by_word if sum(map(len, pieces)) < FEW else at_once)(pieces, self.dim))
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def cut_for_model(text: Column, most_tokens: int = 512) -> Column:
    """What fits a model, at four characters a token, with ten tokens to spare."""
    return F.substring(text, 1, (most_tokens - 10) * 4)


def encoded(enc: Encoder, texts: list[str], batch: int = 512) -> np.ndarray:
    """Vectors of ``texts``. A batch that fails is tried again in halves, so a bad text among n costs about 2 log n calls; batches after it are half as large as
    the one that failed, as what fails by size fails again. A text that fails alone has a zero vector, which the store's audit reports."""
    out, size = np.zeros((len(texts), enc.dim), np.float32), max(1, batch)
    at = 0
    while at < len(texts):
        todo, failed = [(at, min(at + size, len(texts)))], False
        at = todo[0][1]
        while todo:
            a, b = todo.pop()
            try:
                out[a:b] = enc.encode(texts[a:b])
            except (RuntimeError, ValueError):
                failed = True
                if b - a > 1:
                    todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        size = max(1, size // 2) if failed else size
    return out


def embed(rows: DataFrame, encoder: Encoder | None = None, text: str = "chunk_text", out: str = "embedding", batch: int = 512) -> DataFrame:
    """``rows`` with the unit vectors of a text column, a batch at a time (``encoded``). Null texts are empty."""
    enc = encoder or HashEncoder()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            vectors = encoded(enc, [t or "" for t in texts.to_pylist()], batch)
            offsets = np.arange(0, vectors.size + 1, enc.dim, dtype=np.int32) if vectors.size else np.zeros(len(texts) + 1, np.int32)
            yield pa.ListArray.from_arrays(offsets, vectors.ravel())

    vector = F.arrow_udf(run, "array<float>")
    most = getattr(enc, "most_tokens", 512)
    return rows.withColumn(out, vector(F.col(text) if most is None else cut_for_model(F.col(text), most)))


def embed_missing(rows: DataFrame, store: DataFrame, encoder: Encoder | None = None, key: str = "chunk_sha", text: str = "chunk_text") -> DataFrame:
    """Vectors for ``rows``, those of texts that ``store(key, embedding)`` has taken from there; each other text is encoded once."""
    known = store.select(key, "embedding").dropDuplicates([key])
    fresh = embed(rows.select(key, text).dropDuplicates([key]).join(known, key, "left_anti"), encoder, text).select(key, "embedding")
    return rows.join(known.unionByName(fresh), key)
