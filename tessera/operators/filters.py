"""Predicates over files and chunks, and the small filter language that compiles to one of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import file_name, suffix

# What is indexed, and which folders aren't.
EXTENSIONS = (".cpp", ".h", ".hpp", ".inl", ".cs")
DOC_EXTENSIONS = (".md", ".markdown", ".rst", ".txt", ".text", ".csv", ".tsv", ".xml", ".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".html", ".htm", ".css", ".js", ".pdf", ".docx", ".docm")
EXCLUDED = ("Intermediate", "Binaries", "DerivedDataCache", "Saved", ".vs", ".vscode", ".idea", ".git", ".hg", ".svn", "Build/BatchFiles", "Build/Android", "Build/IOS", "Build/Linux", "Build/Mac", "ThirdParty", "Documentation", "Content", "Extras")


def normal_extensions(text: str) -> list[str]:
    """"h, CPP" -> [".h", ".cpp"]"""
    parts = [p.strip().lower() for p in text.split(",")]
    return [p if p.startswith(".") else "." + p for p in parts if p]


def glob_pattern(glob: str) -> str:
    """A Java regular expression for a shell glob over a whole name; * and ? match any character, case counts."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = glob[i + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner.replace("^", r"\^", 1) if inner[0] == "^" else inner) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def has_extension(path: Column, extensions=EXTENSIONS) -> Column:
    return suffix(path).isin(*extensions)


def in_folder(path: Column, folders) -> Column:
    """A part of the path, its name included, equals one of ``folders``. One with a slash in it never does."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders))) if folders else F.lit(False)


def name_allowed(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """The name matches no excluded glob, and an included one if there are any."""
    any_of = lambda globs: file_name(path).rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))
    return (~any_of(exclude) if exclude else F.lit(True)) & (any_of(include) if include else F.lit(True))


def passes(path: Column, extensions=EXTENSIONS, folders=EXCLUDED, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    return has_extension(path, extensions) & ~in_folder(path, folders) & name_allowed(path, include, exclude)


def in_scope(scope: str, origin: Column | None = None) -> Column:
    """engine: origin is engine or null; project: it isn't; all: any."""
    is_engine = F.coalesce(F.col("origin") if origin is None else origin, F.lit("engine")) == "engine"
    if scope not in ("engine", "project", "all"):
        raise ValueError(f"unknown scope: {scope!r}")
    return {"engine": is_engine, "project": ~is_engine, "all": F.lit(True)}[scope]


def path_like(pattern: str = "", extensions: list[str] | None = None, path: str = "path") -> Column:
    """The path holds ``pattern``, case aside, and has one of the extensions."""
    held = F.contains(F.lower(F.col(path)), F.lit(pattern.lower())) if pattern else F.lit(True)
    return held & (suffix(F.col(path)).isin(*extensions) if extensions else F.lit(True))


@dataclass
class Filter:
    """What a search is narrowed to; None or empty: not by that."""

    entity: str | None = None
    entity_type: str | None = None
    origin: str | None = None
    has_uproperty: bool | None = None
    has_uclass: bool | None = None
    has_ufunction: bool | None = None
    has_ustruct: bool | None = None
    file_type: str | None = None
    boost_entities: list[str] = field(default_factory=list)
    boost_macros: bool = False

    def predicate(self) -> Column:
        """One predicate over chunks. Flags and origin come first, so that Parquet can skip by them."""
        p = in_scope(self.origin) if self.origin else F.lit(True)
        for flag in ("has_uproperty", "has_uclass", "has_ufunction", "has_ustruct"):
            if (on := getattr(self, flag)) is not None:
                p &= F.coalesce(F.col(flag), F.lit(False)) == F.lit(on)
        if self.file_type:
            p &= F.coalesce(F.col({"header": "is_header", "implementation": "is_implementation"}[self.file_type]), F.lit(False))
        if self.entity:
            p &= F.coalesce(F.array_contains("entities", self.entity), F.lit(False))
        if self.entity_type:
            p &= F.coalesce(F.array_contains("entity_types", self.entity_type), F.lit(False))
        return p


# What the filter language knows.
TYPES = ("struct", "class", "enum", "function", "delegate")
MACRO_NAMES = ("UPROPERTY", "UCLASS", "UFUNCTION", "USTRUCT")
KEYS = ("type", "macro", "origin", "entity", "file", "boost")
HELP = """Supported syntax:
  type:struct|class|enum|function
  macro:UPROPERTY|UCLASS|UFUNCTION|USTRUCT
  origin:engine|project
  entity:EntityName
  file:header|implementation
  boost:macros

Use AND to combine filters (OR not yet supported)"""


def parse_filter(text: str | None) -> Filter:
    """"type:struct AND macro:UPROPERTY" -> Filter. A later part for a key replaces an earlier one; what follows a part's
    key:value is ignored; an entity is boosted too. ValueError, with help, for anything else."""
    out = Filter()

    def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
        if value not in allowed:
            raise ValueError(f"Invalid {what}: '{value}'. Must be one of {', '.join(allowed)}\n\n{HELP}")
        return value

    for part in filter(None, (p.strip() for p in (text or "").split(" AND "))):
        m = re.match(r"(\w+):(\w+)", part)
        if not m:
            raise ValueError(f"Invalid filter syntax: '{part}'. Expected format: key:value\n\n{HELP}")
        key, value = one_of(m[1].lower(), KEYS, "filter key"), m[2]
        if key == "type":
            out.entity_type = one_of(value.lower(), TYPES, "entity type")
        elif key == "macro":
            setattr(out, "has_" + one_of(value.upper(), MACRO_NAMES, "macro").lower(), True)
        elif key == "origin":
            out.origin = one_of(value.lower(), ("engine", "project"), "origin")
        elif key == "file":
            out.file_type = one_of(value.lower(), ("header", "implementation"), "file type")
        elif key == "entity":
            out.entity = value
            out.boost_entities.append(value)
        elif one_of(value.lower(), ("macros", "entity", "entities"), "boost type") == "macros":
            out.boost_macros = True
    return out


def parsed(text: Column) -> Column:
    """``parse_filter`` as a column: a struct of what a filter narrows to and boosts, and error, its message, else null. So a batch has as
    many different filters as it likes."""
    bare = lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")
    texts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), " AND ", -1), bare), lambda p: p != "")
    group = lambda p, k: F.regexp_extract(p, r"(?U)^(\w+):(\w+)", k)
    parts = F.transform(texts, lambda p: F.struct(p.alias("text"), F.lower(group(p, 1)).alias("key"), group(p, 2).alias("value")))

    def wrong(value: Column, allowed: tuple[str, ...], what: str) -> Column:
        return F.when(~value.isin(*allowed), F.concat(F.lit(f"Invalid {what}: '"), value, F.lit(f"'. Must be one of {', '.join(allowed)}\n\n{HELP}")))

    def message(p: Column) -> Column:
        key, low = p["key"], F.lower(p["value"])
        return (
            F.when(key == "", F.concat(F.lit("Invalid filter syntax: '"), p["text"], F.lit(f"'. Expected format: key:value\n\n{HELP}"))).when(~key.isin(*KEYS), wrong(key, KEYS, "filter key"))
            .when(key == "type", wrong(low, TYPES, "entity type")).when(key == "macro", wrong(F.upper(p["value"]), MACRO_NAMES, "macro")).when(key == "origin", wrong(low, ("engine", "project"), "origin"))
            .when(key == "file", wrong(low, ("header", "implementation"), "file type")).when(key == "boost", wrong(low, ("macros", "entity", "entities"), "boost type"))
        )

    of = lambda key: F.transform(F.filter(parts, lambda p: p["key"] == key), lambda p: p["value"])
    last = lambda key: F.try_element_at(of(key), F.lit(-1))
    macros = F.transform(of("macro"), lambda v: F.upper(v))
    flags = [F.array_contains(macros, m).alias(f"has_{m.lower()}") for m in MACRO_NAMES]
    return F.struct(
        last("entity").alias("entity"), F.lower(last("type")).alias("entity_type"), F.lower(last("origin")).alias("origin"), *flags, F.lower(last("file")).alias("file_type"), of("entity").alias("boost_entities"),
        F.exists(of("boost"), lambda v: F.lower(v) == "macros").alias("boost_macros"), F.try_element_at(F.filter(F.transform(parts, message), lambda m: m.isNotNull()), F.lit(1)).alias("error"))


def matches(f: Column) -> Column:
    """The predicate of a filter that ``parsed`` made, over chunks beside it."""
    unless = lambda wanted, held: wanted.isNull() | F.coalesce(held, F.lit(False))
    is_engine = F.coalesce(F.col("origin"), F.lit("engine")) == "engine"
    p = unless(f["origin"], (f["origin"] == "engine") == is_engine)
    for flag in ("has_uproperty", "has_uclass", "has_ufunction", "has_ustruct"):
        p &= ~f[flag] | F.coalesce(F.col(flag), F.lit(False))
    p &= unless(f["file_type"], F.when(f["file_type"] == "header", F.col("is_header")).otherwise(F.col("is_implementation")))
    return p & unless(f["entity"], F.array_contains("entities", f["entity"])) & unless(f["entity_type"], F.array_contains("entity_types", f["entity_type"]))


def form_filter(macro: str = "", entity_type: str = "", file_type: str = "", boost_macros: bool = False) -> Filter:
    """A Filter from the choices of a form; "" and "any" choose nothing."""
    chosen = lambda x: x if x and x.lower() != "any" else None
    out = Filter(entity_type=chosen(entity_type), file_type=chosen(file_type), boost_macros=boost_macros)
    if chosen(macro):
        setattr(out, f"has_{macro.lower()}", True)
    return out


def subsume(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths that lie under no other one, part by part. Each path is looked up under its own parents, so this is
    an equi-join on them and no comparison of all pairs."""
    p = paths.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
    parts = F.split("path", "/")
    parents = p.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("parent")).where("contains(path, '/')")
    under = parents.join(p.select(F.col("path").alias("parent")), "parent", "left_semi").select("path").distinct()
    return p.join(under, "path", "left_anti").withColumn("depth", F.size(parts))


def check_dimension(store: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """``store``; reading a vector of another length than the query's fails the job with a message."""
    n = F.size(column)
    message = F.format_string(f"Dimension mismatch: the query vector has {len(query)} dimensions, a stored one has %d", n)
    return store.withColumn(column, F.when(n == len(query), F.col(column)).otherwise(F.raise_error(message).cast(store.schema[column].dataType)))
