"""Entities and flags of chunks of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import is_header, is_implementation, module_by_place
from .chunking import HOLDS

# What names an entity, and what marks a macro.
STRUCT = r"\bstruct\s+(?:\w+_API\s+)?([A-Z_]\w+)"
CLASS = r"\bclass\s+(?:\w+_API\s+)?([UAI][A-Z]\w+)"
ENUM = r"\benum\s+(?:class\s+)?([A-Z_]\w+)"
MACROS = ("uproperty", "ufunction", "uclass", "ustruct", "uenum")
#: Flags that rank a chunk higher; enums don't.
BOOSTED_MACROS = MACROS[:4]
#: Without any of these a text has no entities and flags.
WORDS = ("struct", "class", "enum", *(m.upper() for m in MACROS))


def entity_columns(text: Column, path: Column, holds: Column | None = None) -> dict[str, Column]:
    """entities and entity_types (distinct, sorted), has_* for each macro, is_header, is_implementation. The name of an
    enum class that starts like a class counts as a class too. Each pattern is tried only where its word is; holds: which of WORDS the text holds, a bit each,
    where that is known."""

    def there(word: str) -> Column:
        return F.contains(text, F.lit(word)) if holds is None else holds.bitwiseAND(F.lit(1 << WORDS.index(word))) != 0

    def every(word: str, pattern: str) -> Column:
        return F.when(~there(word), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(1)))

    structs, classes, enums = every("struct", STRUCT), every("class", CLASS), every("enum", ENUM)
    types = F.array_compact(F.array(F.when(F.size(classes) > 0, F.lit("class")), F.when(F.size(enums) > 0, F.lit("enum")), F.when(F.size(structs) > 0, F.lit("struct"))))
    return {
        "entities": F.array_sort(F.array_distinct(F.concat(structs, classes, enums))),
        "entity_types": types,
        **{f"has_{m}": there(m.upper()) & text.rlike(rf"(?U)\b{m.upper()}\s*\(") for m in MACROS},
        "is_header": is_header(path),
        "is_implementation": is_implementation(path),
    }


def enrich(chunks: DataFrame, text: str = "chunk_text", path: str = "path") -> DataFrame:
    """``chunks`` with their ``entity_columns``; those that say which of WORDS they hold aren't searched for them."""
    holds = F.col(HOLDS) if HOLDS in chunks.columns else None
    return chunks.withColumns(entity_columns(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(path), F.lit("")), holds)).drop(HOLDS)


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Columns that a store may lack or leave null get their defaults: origin engine, no entities, no flags."""
    empty = F.array().cast("array<string>")
    defaults = {"origin": F.lit("engine"), "entities": empty, "entity_types": empty, **{f"has_{m}": F.lit(False) for m in MACROS}, "is_header": F.lit(False), "is_implementation": F.lit(False)}
    return chunks.withColumns({c: F.coalesce(F.col(c), d) if c in chunks.columns else d for c, d in defaults.items()})


def re_enrich(chunks: DataFrame, files: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """Entities and flags of stored ``chunks(path, chunk_index)`` anew, from the window of their file in ``files(path, text)``
    at which a chunk of that number starts. Chunks whose file is gone keep what they have."""
    base = with_defaults(chunks)
    given = list(entity_columns(F.lit(""), F.lit("")))
    joined = base.join(files.select("path", F.col("text").alias("__text")), "path", "left")
    window = F.substring("__text", F.col("chunk_index") * (size - overlap) + 1, F.lit(size))
    fresh = entity_columns(window, F.col("path"))
    return joined.withColumns({c: F.when(F.col("__text").isNotNull(), fresh[c]).otherwise(F.col(c)) for c in given}).drop("__text")


def modules(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``files(path, ...)`` with module: the name of the build file in the nearest folder above it and below the last Source folder
    (``listing(path)`` has the build files), else the second folder below Source, else Unknown. An equi-join on folders."""
    name = F.regexp_extract("path", r"([^/]*)\.Build\.cs$", 1)
    builds = listing.where(F.col("path").endswith(".Build.cs")).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.min(name).alias("name"))
    parts = F.split("path", "/")
    source = F.size(parts) - F.array_position(F.reverse(parts), "Source").cast("int") + 1
    above = F.when(F.array_contains(parts, "Source") & (source + 2 <= F.size(parts)), F.transform(F.sequence(source + 1, F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"))))
    near = files.select("path").distinct().select("path", F.inline(above)).join(builds, "folder").groupBy("path").agg(F.max_by("name", "depth").alias("__module"))
    return files.join(near, "path", "left").withColumn("module", F.coalesce("__module", module_by_place(F.col("path")))).drop("__module")
