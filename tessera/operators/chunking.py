"""Cutting texts into chunks: fixed windows as plain columns, and structure-aware chunks, whose cuts need the places of
matches and the size of what has been gathered so far, as a function over Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.batches import bounded
from ..functions.matching import matches_in

SIZE, OVERLAP, LEAST, TAIL = 2000, 200, 500, 300
MAX_CHARS = 120_000
#: Which of some strings a chunk holds, a bit each.
HOLDS = "__holds"

# Where a structure starts, each at the start of a line.
BOUNDARIES = [
    re.compile(r"^\s*(?:(?:inline|static|virtual|explicit|constexpr|template\s*<[^>]*>)\s+)*(?:[\w:]+\s*(?:<[^>]*>)?)\s+[\w:]+\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?(?:final\s*)?\s*\{", re.M),
    re.compile(r"^\s*(?:class|struct)\s+[\w_]+\s*(?::\s*public\s+[\w_]+)?\s*\{", re.M),
    re.compile(r"^\s*(?:enum\s+class|enum)\s+[\w_]+\s*(?::\s*[\w_]+)?\s*\{", re.M),
    re.compile(r"^\s*U(?:CLASS|STRUCT|ENUM|FUNCTION|PROPERTY|INTERFACE)\s*\(", re.M),
    re.compile(r"^\s*namespace\s+[\w_]+\s*\{", re.M),
    re.compile(r"^\s*(?:/\*\*|//\s*[-=]{5,})", re.M),
]
#: Of each structure: strings one of which is in every match, and what every match ends with, if that is fixed.
MARKS = [(("{",), "{"), (("class", "struct"), "{"), (("enum",), "{"), (("UCLASS", "USTRUCT", "UENUM", "UFUNCTION", "UPROPERTY", "UINTERFACE"), "("), (("namespace",), "{"), (("/**", "//"), "")]


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP, tail: int = TAIL) -> Column:
    """An array of windows of ``size`` characters, each ``size - overlap`` behind the last; a window under ``tail``
    characters that isn't the first ends the array and is left out. An empty text has none."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    kept = F.filter(starts, lambda s: (s == 0) | (F.length(text) - s >= tail))
    return F.transform(kept, lambda s: F.substring(text, s + 1, F.lit(size)))


def explode_chunks(files: DataFrame, chunks: Column) -> DataFrame:
    """One row for each chunk: the file's columns but its text and those of the names that follow; chunk_index, total_chunks,
    chars, chunk_text."""
    made = files.withColumn("__chunks", chunks).drop("text", "chunk_index", "total_chunks", "chars", "chunk_text").withColumn("total_chunks", F.size("__chunks"))
    rest = [c for c in made.columns if c != "__chunks"]
    out = made.select(*rest, F.posexplode("__chunks").alias("chunk_index", "chunk_text"))
    return out.withColumn("chars", F.length("chunk_text"))


def window_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, tail: int = TAIL) -> DataFrame:
    """Fixed windows of ``files(..., text)``; a text of up to ``size`` characters is one chunk."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return explode_chunks(files, F.when(F.length(text) <= size, F.array(text)).otherwise(windows(text, size, overlap, tail)))


def starts_of_structures(text: str) -> list[int]:
    return sorted({m.start() for p, (words, end) in zip(BOUNDARIES, MARKS, strict=True) for m in matches_in(p, text, words, end)})


def sections(text: str, size: int) -> list[str]:
    """Cut at the first structure at which at least ``size`` characters have gathered; blank sections go."""
    cuts = [0]
    for at in starts_of_structures(text):
        if at - cuts[-1] >= size:
            cuts.append(at)
    parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
    return [p for p in parts if p.strip()] or [text]


def paragraphs(text: str, size: int) -> list[str]:
    """Paragraphs, each with a blank line behind it, gathered while they fit."""
    out, held = [], ""
    for p in re.split(r"\n\s*\n", text):
        if len(held) + len(p) + 2 > size:
            out.append(held)
            held = ""
        held += p + "\n\n"
    return [x for x in [*out, held] if x.strip()] or [text]


def plain_windows(text: str, size: int, overlap: int, tail: int = TAIL) -> list[str]:
    """Windows as above, but a short last one is added to the one before it, which then holds the overlap twice."""
    out: list[str] = []
    for at in range(0, len(text), size - overlap):
        part = text[at : at + size]
        if out and len(part) < tail and at + size >= len(text):
            out[-1] += part
            break
        out.append(part)
    return out


def structured(text: str, size: int = SIZE, least: int = LEAST, overlap: int = 0) -> list[str]:
    """A text's structure-aware chunks, without overlap between neighbours. ``overlap`` is that of the windows into which
    a paragraph over ``size`` is cut. Sections under ``least`` join the next if both fit together."""
    if len(text) <= size:
        return [text]
    starts = starts_of_structures(text)
    todo = sections(text, size) if starts else plain_windows(text, size, overlap)
    out: list[str] = []
    held = ""
    for k, part in enumerate(todo):
        part = held + part
        held = ""
        if len(part) > size:
            out += [w for p in paragraphs(part, size) for w in (plain_windows(p, size, overlap) if len(p) > size else [p])]
        elif len(part) < least and k + 1 < len(todo) and len(part) + len(todo[k + 1]) <= size:
            held = part
        else:
            out.append(part)
    return out


def overlapped(chunks: list[str], size: int, overlap: int) -> list[str]:
    """Each chunk but the last with the first ``overlap`` characters of the next, if it doesn't pass ``size`` with them."""
    more = [x[: max(overlap, 0)] for x in chunks[1:]]
    return [x + y if len(x) + len(y) <= size else x for x, y in zip(chunks, [*more, ""], strict=True)]


def structured_chunks(files: DataFrame, size: int = SIZE, least: int = LEAST, overlap: int = OVERLAP, words: tuple[str, ...] = ()) -> DataFrame:
    """Structure-aware chunks of ``files(..., text)``, one row each, with the columns of ``explode_chunks``; each but a file's last takes the first ``overlap``
    characters of the next one if it doesn't pass ``size`` with them. words: a column HOLDS says which of these strings a chunk holds, a bit each. Texts go to
    Python once and only chunks come back."""
    files = files.drop("chunk_index", "total_chunks", "chars", "chunk_text")
    at = files.columns.index("text")
    rest = [i for i in range(len(files.columns)) if i != at]
    made = [StructField("total_chunks", IntegerType()), StructField("chunk_index", IntegerType()), StructField("chunk_text", StringType()), StructField(HOLDS, IntegerType())]
    schema = StructType([*(files.schema[i] for i in rest), *(made if words else made[:-1])])

    def run(batches):
        for b in bounded(batches, at):
            chunks = [overlapped(structured(t or "", size, least, overlap), size, overlap) for t in b.column(at).to_pylist()]
            n = np.array([len(x) for x in chunks], np.int32)
            rows, total = np.repeat(np.arange(len(n)), n), np.repeat(n, n)
            flat = [x for xs in chunks for x in xs]
            out = [*(b.column(i).take(pa.array(rows)) for i in rest), pa.array(total), pa.array((np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)), pa.array(flat, pa.string())]
            if words:
                out.append(pa.array([sum(1 << k for k, w in enumerate(words) if w in x) for x in flat], pa.int32()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    out = files.mapInArrow(run, schema)
    return out.select(*(c for c in out.columns if c != HOLDS), F.length("chunk_text").alias("chars"), *([HOLDS] if words else []))


def overlap_by_window(chunks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The same over rows ``chunks(path, chunk_index, chunk_text)`` that are already apart."""
    more = F.substring(F.lead("chunk_text").over(Window.partitionBy("path").orderBy("chunk_index")), 1, overlap)
    return chunks.withColumn("chunk_text", F.when(F.length("chunk_text") + F.length(more) <= size, F.concat("chunk_text", more)).otherwise(F.col("chunk_text")))


def over_cap(files: DataFrame, most_chars: int = MAX_CHARS) -> DataFrame:
    """(origin, files, over, chars_over): how many files the size cap leaves out, and how many characters."""
    over, chars = F.length("text") > most_chars, F.length("text").cast("long")
    return files.groupBy("origin").agg(F.count("*").alias("files"), F.count_if(over).alias("over"), F.coalesce(F.sum(F.when(over, chars)), F.lit(0)).cast("long").alias("chars_over"))


def chunk_files(files: DataFrame, structure: bool = True, size: int | None = None, overlap: int = OVERLAP, most_chars: int | None = MAX_CHARS, words: tuple[str, ...] = ()) -> DataFrame:
    """The chunks of ``files(path, ..., text)`` under the size cap (None: of all): structure-aware ones, which say which of ``words`` they hold, or fixed windows of 1500."""
    capped = files if most_chars is None else files.where(F.length("text") <= most_chars)
    return structured_chunks(capped, size or SIZE, overlap=overlap, words=words) if structure else window_chunks(capped, size or 1500, overlap)


def snippet(text: Column, chunk_index: Column, size: int = 1500, overlap: int = 200) -> Column:
    """What a fixed-window chunk of that number covers."""
    return F.substring(text, chunk_index * (size - overlap) + 1, F.lit(size))


def chunk_text_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits(path, chunk_index, ...)`` with the stored text of their chunks; null where there is none."""
    return hits.join(chunks.select("path", "chunk_index", "chunk_text"), ["path", "chunk_index"], "left")
