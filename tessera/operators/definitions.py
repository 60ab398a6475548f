"""Definitions in source files, found once for all names, and looked up by name afterwards."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.matching import matches_in
from ..functions.naming import include_of, module_by_place
from ..functions.similarity import match_quality
from .similar import MOST_ASKED, forms, similar

# How definitions start: behind blanks of their own line, so that line numbers are those of the line that they or their macro stand in.
# The group "name" is the entity's.
STARTS = {
    "struct": re.compile(r"^[ \t]*(?:USTRUCT\s*\([^)]*\)\s*)?struct\s+(?:\w+_API\s+)?(?P<name>[A-Z_]\w*)\s*(?::\s*public\s+\w+)?\s*\{", re.M),
    "class": re.compile(r"^[ \t]*(?:UCLASS\s*\([^)]*\)\s*)?class\s+(?:\w+_API\s+)?(?P<name>[UAI][A-Z]\w*)\s*(?::\s*public\s+[\w\s,]+)?\s*\{", re.M),
    "enum": re.compile(r"^[ \t]*(?:UENUM\s*\([^)]*\)\s*)?enum\s+(?:class\s+)?(?P<name>[A-Z_]\w*)\s*(?::\s*\w+)?\s*\{", re.M),
    "function": re.compile(r"^[ \t]*(?:UFUNCTION\s*\([^)]*\)\s*)?(?:virtual\s+)?(?:static\s+)?(?:inline\s+)?[\w:<>,\*&][\w:<>,\*& \t]*[ \t]+\*?&?(?P<name>\w+)\s*\(", re.M),
    "delegate": re.compile(r"^[ \t]*DECLARE_\w+_DELEGATE[^(\n]*\(\s*(?P<name>\w+)\s*,", re.M),
}
#: Of each kind: a string in every match, and what every match ends with.
MARKS = {"struct": ("struct", "{"), "class": ("class", "{"), "enum": ("enum", "{"), "function": ("(", "("), "delegate": ("DECLARE_", ",")}
# Words that look like the name of a function, or like what it returns.
NOT_FUNCTIONS = {"if", "for", "while", "switch", "return", "else", "new", "delete", "case", "do"}
MARKED_MEMBER = re.compile(r"UPROPERTY\s*\([^)]*\)\s*([\w:<>,\*&\s]+?)\s+(\w+)\s*;", re.S)
PLAIN_MEMBER = re.compile(r"^\s*(?!UPROPERTY|UFUNCTION|//)([\w:<>,\*&\s]+?)\s+(\w+)\s*;", re.M)
ENUM_VALUE = re.compile(r"^\s*(\w+)\s*(?:=\s*[^,}]+)?[,}]", re.M)
MOST_CHARS, MOST_MEMBERS = 32_000, 10

#: What a scan for braces must not look into, or stop at.
TOKENS = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?(?:\*/|\Z)|[{};]', re.S)

SCHEMA = "file_path string, entity_type string, entity_name string, line_start int, line_end int, header string, definition string, members array<string>"


def block_end(text: str, at: int) -> int:
    """Behind the brace that closes the one at ``at``; strings and comments don't count. The text's end if none does."""
    depth = 0
    for m in TOKENS.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return m.end()
    return len(text)


def body_start(text: str, at: int) -> int | None:
    """Of a function's body from its name on; None for a declaration, which a semicolon ends."""
    for m in TOKENS.finditer(text, at):
        if m[0] in "{;}":
            return m.start() if m[0] == "{" else None
    return None


def members_of(body: str, kind: str) -> list[str]:
    """Members of a struct or class (marked ones first), values of an enum, parameters of a function or delegate."""
    if kind in ("struct", "class"):
        found = [" ".join(m.groups()) for m in MARKED_MEMBER.finditer(body)]
        plain = [(m[1].strip(), m[2]) for m in PLAIN_MEMBER.finditer(body)]
        return list(dict.fromkeys([*found, *(f"{t} {n}" for t, n in plain if not t.isupper())]))
    if kind == "enum":
        return [m[1] for m in ENUM_VALUE.finditer(body) if not m[1].startswith("GENERATED")]
    inside = body.partition("(")[2].partition(")")[0]
    return [p for p in map(str.strip, inside.split(",")) if p and p != "void"]


def find_definitions(text: str) -> list[tuple]:
    """(kind, name, first line, last line, header, definition, members) of each definition in a file."""
    text = text.replace("\r\n", "\n")
    out = []
    for kind, pattern in STARTS.items():
        word, last = MARKS[kind]
        for m in matches_in(pattern, text, (word,), last):
            name, head = m["name"], m.start()
            if kind in ("struct", "class", "enum"):
                opened = m.end() - 1
                end = block_end(text, opened)
                header, body = text[head:opened].strip(), text[opened:end].strip()
                inside = body
            else:
                words = text[head : m.start("name")].split()
                if name in NOT_FUNCTIONS or kind == "function" and (not words or words[-1].strip("*&") in NOT_FUNCTIONS):
                    continue
                opened = body_start(text, m.end("name")) if kind == "function" else None
                stop = text.find(";", m.end())
                end = block_end(text, opened) if opened is not None else len(text) if stop < 0 else stop + 1
                header, body = text[head : opened if opened is not None else end].strip(), text[head:end].strip()
                inside = header if kind == "function" else "(" + header.partition("(")[2].partition(",")[2]
            first = text.count("\n", 0, head) + 1
            out.append((kind, name, first, first + text[head:end].rstrip().count("\n"), header, body, members_of(inside, kind)))
    return out


def definitions(files: DataFrame) -> DataFrame:
    """All definitions of ``files(path, text, origin)``: one pass over the files, however many names are looked up later."""

    def run(batches):
        for b in bounded(batches, 1):
            rows = [(path, *d, origin) for path, text, origin in zip(*(c.to_pylist() for c in b.columns), strict=True) for d in find_definitions(text or "")]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            path, kind, name, first, last, header, body, members, origin = cols
            strings = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays([strings(path), strings(kind), strings(name), pa.array(first, pa.int32()), pa.array(last, pa.int32()), strings(header), strings(body), pa.array(members, pa.list_(pa.string())), strings(origin)], names=["file_path", "entity_type", "entity_name", "line_start", "line_end", "header", "definition", "members", "origin"])

    origin = F.coalesce(F.col("origin"), F.lit("engine")) if "origin" in files.columns else F.lit("engine")
    found = files.select("path", "text", origin.alias("origin")).mapInArrow(run, SCHEMA + ", origin string")
    path = F.col("file_path")
    return found.withColumns({"module": module_by_place(path), "include": include_of(path)})


def kind_asked() -> Column:
    """The kind that a definition is looked up by."""
    return F.when(F.col("entity_type") == "delegate", "function").otherwise(F.col("entity_type"))


def names_of(defs: DataFrame) -> DataFrame:
    """The distinct names of ``defs`` by kind, as look-ups compare them."""
    return forms(defs.select("entity_name", kind_asked().alias("kind")).where("entity_name IS NOT NULL").distinct(), "entity_name")


def look_up(defs: DataFrame, wanted: DataFrame, fuzzy: bool = True, names: DataFrame | None = None, most_asked: int | None = MOST_ASKED) -> DataFrame:
    """Definitions for ``wanted(query_id, name, kind, scope)`` with match_quality: of the kind that is asked for (a function
    may be a delegate), in scope, one for each file and line, the best match first, ties by path and line.

    Distinct names meet by an index (``similar``), each kind with its own, and only those that match are joined with their definitions. ``names`` is
    ``names_of(defs)`` where it was made before."""
    kinds = kind_asked()
    if fuzzy:
        close = similar(wanted, names_of(defs) if names is None else names, ["kind"], most_asked)
    else:
        close = defs.select(F.col("entity_name"), kinds.alias("kind")).distinct().join(wanted.select("name", "kind").distinct(), "kind").withColumn("match_quality", match_quality(F.col("name"), F.col("entity_name"), False)).where("match_quality > 0")
    hits = wanted.join(close, ["name", "kind"]).join(defs.withColumn("kind", kinds), ["entity_name", "kind"])
    hits = hits.where((F.col("scope") == "all") | ((F.col("scope") == "engine") == (F.col("origin") == "engine")))
    once = Window.partitionBy("query_id", "file_path", "line_start").orderBy(F.desc("match_quality"), "name", "entity_type", "entity_name")
    hits = hits.withColumn("__r", F.row_number().over(once)).where("__r = 1").drop("__r", "kind", "name")
    order = Window.partitionBy("query_id").orderBy(F.desc("match_quality"), "file_path", "line_start")
    return hits.withColumn("rank", F.row_number().over(order))


def shown(hits: DataFrame) -> DataFrame:
    """A definition as results show it: cut to MOST_CHARS, the first MOST_MEMBERS members, and how many there are."""
    return hits.withColumns({"total_members": F.size("members"), "definition": F.substring("definition", 1, MOST_CHARS), "members": F.slice("members", 1, MOST_MEMBERS)})


def first_kind(defs: DataFrame, name: Column) -> DataFrame:
    """The definitions named ``name``, of the first kind that has any: struct, then class, then enum."""
    order = F.when(F.col("entity_type") == "struct", 1).when(F.col("entity_type") == "class", 2).when(F.col("entity_type") == "enum", 3)
    found = defs.where(F.col("entity_name") == name).withColumn("__kind", order).where("__kind IS NOT NULL")
    return found.withColumn("__first", F.min("__kind").over(Window.partitionBy("entity_name"))).where("__kind = __first").drop("__kind", "__first")
