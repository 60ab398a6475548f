"""Renderings of results. A result is a row (question, intent, definition_results, semantic_results, combined_results, timing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import file_name
from ..functions.numbers import fixed

DEFINITION = "struct<entity_type: string, entity_name: string, file_path: string, line_start: int, line_end: int, match_quality: double, definition: string, members: array<string>, total_members: int, origin: string>"
SEMANTIC = "struct<path: string, chunk_index: int, total_chunks: int, score: double, origin: string, entities: array<string>>"
NO_FILES, NO_CODE = "No files found", "// No code snippets available"


def _definition(d: Column, code: bool) -> list[Column]:
    out = [F.lit("definition").alias("type"), *(d[c].alias(c) for c in ("entity_type", "entity_name", "file_path", "line_start", "line_end", "match_quality")), d["total_members"].alias("members_count"), d["origin"].alias("origin")]
    return out + ([d["definition"].alias("definition"), d["members"].alias("members")] if code else [])


def _semantic(s: Column) -> Column:
    names = F.when(F.size(s["entities"]) > 0, s["entities"])
    return F.struct(F.lit("semantic").alias("type"), *(s[c].alias(c) for c in ("path", "chunk_index", "total_chunks", "score", "origin")), names.alias("entities"))


def as_json(code: bool = True) -> Column:
    n = lambda c: F.size(c)
    return F.to_json(F.struct(
        F.struct("question", "intent").alias("query"),
        F.struct(F.transform("definition_results", lambda d: F.struct(*_definition(d, code))).alias("definitions"), F.transform("semantic_results", _semantic).alias("semantic"), F.col("combined_results").alias("combined")).alias("results"),
        "timing", F.struct(n("combined_results").alias("total_results"), n("definition_results").alias("definition_count"), n("semantic_results").alias("semantic_count")).alias("metadata")))


def as_jsonl(code: bool = True) -> Column:
    head = F.to_json(F.struct(F.lit("query_metadata").alias("type"), "question", "intent", F.col("timing").alias("timestamp")))
    defs = F.transform("definition_results", lambda d: F.to_json(F.struct(*_definition(d, code))))
    sems = F.transform("semantic_results", lambda s: F.to_json(_semantic(s)))
    timing = F.to_json(F.map_concat(F.create_map(F.lit("type"), F.lit("timing")), F.transform_values("timing", lambda _, v: v.cast("string"))))
    return F.concat_ws("\n", head, defs, sems, timing)


def _escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _tag(name: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))


def _leaf(name: str, text: Column) -> Column:
    return _tag(name, _escape(F.coalesce(text.cast("string"), F.lit(""))))


def as_xml(code: bool = True) -> Column:
    joined = lambda xs: F.array_join(xs, "")

    def one(d: Column) -> Column:
        parts = [_leaf(c, d[c]) for c in ("entity_type", "entity_name", "file_path", "line_start", "line_end")]
        parts += [_leaf("match_quality", fixed(d["match_quality"], 2)), _leaf("origin", d["origin"])]
        if code:
            inner = joined(F.transform(F.slice(d["members"], 1, 10), lambda m: _leaf("member", m)))
            parts += [F.when(d["definition"] != "", _leaf("definition", d["definition"])).otherwise(""), F.when(F.size(d["members"]) > 0, _tag("members", inner)).otherwise("")]
        return _tag("definition", *parts)

    def hit(s: Column) -> Column:
        names = F.when(F.size(s["entities"]) > 0, _tag("entities", joined(F.transform(s["entities"], lambda e: _leaf("entity", e))))).otherwise("")
        return _tag("result", _leaf("path", s["path"]), _leaf("score", fixed(s["score"], 3)), _leaf("origin", s["origin"]), names)

    times = joined(F.transform(F.map_entries("timing"), lambda t: F.concat(F.lit("<"), t["key"], F.lit(">"), fixed(t["value"], 3), F.lit("</"), t["key"], F.lit(">"))))
    intent = F.concat(*(_leaf(c, F.col(f"intent.{c}")) for c in ("type", "entity_type", "entity_name", "confidence", "enhanced_query")))
    return _tag("query_result", _tag("query", _leaf("question", F.col("question")), _tag("intent", intent)),
        _tag("results", _tag("definitions", joined(F.transform("definition_results", one))), _tag("semantic", joined(F.transform("semantic_results", hit)))), _tag("timing", times))


def _first_lines(code: Column, most: int, more: str) -> Column:
    lines = F.split(code, "\n")
    rest = F.size(lines) - most
    return F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.when(rest > 0, F.format_string("\n" + more, rest)).otherwise(""))


def as_markdown(code: bool = True, most_lines: int = 50) -> Column:
    def one(d: Column, i: Column) -> Column:
        n = F.size(d["members"])
        named = F.format_string("\n**Members (%d):** %s", n, F.array_join(F.slice(d["members"], 1, 5), ", "))
        members = F.when(n > 0, F.concat(named, F.when(n > 5, F.format_string("\n... and %d more", n - 5)).otherwise(""))).otherwise("")
        block = F.when(d["definition"] != "", F.concat(F.lit("\n\n```cpp\n"), _first_lines(d["definition"], most_lines, "... (%d more lines)"), F.lit("\n```"))).otherwise("") if code else F.lit("")
        return F.concat(F.format_string("### %d. %s `%s`\n**File:** `%s:%d-%d`\n**Match Quality:** %s", i + 1, d["entity_type"], d["entity_name"], d["file_path"], d["line_start"], d["line_end"], fixed(d["match_quality"], 2)), members, block, F.lit("\n"))

    def hit(s: Column, i: Column) -> Column:
        names = F.when(F.size(s["entities"]) > 0, F.concat(F.lit("\n   - Entities: "), F.array_join(F.slice(s["entities"], 1, 5), ", "))).otherwise("")
        return F.concat(F.format_string("%d. **%s** (score: %s, origin: %s)", i + 1, file_name(s["path"]), fixed(s["score"], 3), s["origin"]), names)

    head = F.format_string("# Query: %s\n\n**Intent:** %s (confidence: %s)\n", "question", F.coalesce("intent.type", F.lit("unknown")), fixed(F.col("intent.confidence"), 2))
    defs = F.when(F.size("definition_results") > 0, F.concat(F.format_string("## Definitions (%d)\n\n", F.size("definition_results")), F.array_join(F.transform("definition_results", one), "\n")))
    sems = F.when(F.size("semantic_results") > 0, F.concat(F.format_string("## Semantic Matches (%d)\n\n", F.size("semantic_results")), F.array_join(F.transform("semantic_results", hit), "\n"), F.lit("\n")))
    times = F.when(F.size("timing") > 0, F.concat(F.lit("## Performance\n"), F.array_join(F.transform(F.map_entries("timing"), lambda t: F.format_string("- %s: %ss", t["key"], fixed(t["value"], 3))), "\n"), F.lit("\n")))
    return F.concat_ws("\n", head, defs, sems, times)


def as_code(most_lines: int = 50) -> Column:
    shown = F.filter("definition_results", lambda d: d["definition"] != "")
    parts = F.transform(shown, lambda d: F.concat(F.format_string("// %s %s\n// File: %s:%d\n", d["entity_type"], d["entity_name"], d["file_path"], d["line_start"]), _first_lines(d["definition"], most_lines, "// ... (%d more lines)"), F.lit("\n")))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(NO_CODE)


def as_paths() -> Column:
    """Distinct paths of the definitions in order; those of semantic results if there are none."""
    of = lambda c, f: F.array_distinct(F.filter(F.transform(c, lambda x: x[f]), lambda p: p != ""))
    defs, sems = of("definition_results", "file_path"), of("semantic_results", "path")
    return F.when(F.size(defs) > 0, F.array_join(defs, "\n")).when(F.size(sems) > 0, F.array_join(sems, "\n")).otherwise(NO_FILES)


def as_text() -> Column:
    def one(d: Column, i: Column) -> Column:
        few = F.concat(F.array_join(F.slice(d["members"], 1, 5), ", "), F.when(F.size(d["members"]) > 5, "...").otherwise(""))
        return F.format_string("\n[%d] %s %s\n    File: %s\n    Lines: %d-%d\n    Members: %s\n    Origin: %s", i + 1, F.upper(d["entity_type"]), d["entity_name"], d["file_path"], d["line_start"], d["line_end"], few, d["origin"])

    hit = lambda s, i: F.format_string("[%d] score=%s | %s | chunk %d/%d\n    Origin: %s", i + 1, fixed(s["score"], 3), file_name(s["path"]), s["chunk_index"] + 1, s["total_chunks"], s["origin"])
    defs = F.when(F.size("definition_results") > 0, F.concat(F.format_string("\n=== Definition Results (%d) ===\n", F.size("definition_results")), F.array_join(F.transform("definition_results", one), "\n")))
    sems = F.when(F.size("semantic_results") > 0, F.concat(F.format_string("\n=== Semantic Results (%d) ===\n", F.size("semantic_results")), F.array_join(F.transform("semantic_results", hit), "\n")))
    times = F.concat(F.lit("\n\n=== Timing ===\n"), F.array_join(F.transform(F.map_entries("timing"), lambda t: F.format_string("%s: %ss", t["key"], fixed(t["value"], 3))), "\n"), F.lit("\n"))
    return F.concat_ws("\n", defs, sems, times)


FORMATS = {"json": as_json, "jsonl": as_jsonl, "xml": as_xml, "markdown": as_markdown, "code": as_code, "path": as_paths, "text": as_text}


def render(results: DataFrame, kind: str = "text", **options) -> DataFrame:
    """``results`` with the column rendered; an unknown kind is text."""
    return results.withColumn("rendered", FORMATS.get(kind, as_text)(**options))
