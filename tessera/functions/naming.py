"""Column functions over names, paths and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_of(xs) -> Column:
    """An array of texts, as one expression: a long list costs one call to the JVM, not one for each of its members."""
    return F.expr(f"array({', '.join(map(_quoted, xs))})")


def lists_by(table: dict[str, list[str]]) -> Column:
    """A map from texts to arrays of texts, as one expression."""
    return F.expr("map(" + ", ".join(f"{_quoted(k)}, array({', '.join(map(_quoted, xs))})" for k, xs in table.items()) + ")")

# File kinds.
HEADER = (".h", ".hpp")
IMPLEMENTATION = (".cpp", ".c", ".cc", ".m", ".mm")
DOC = (".md", ".txt", ".pdf", ".docx", ".html")
DATA = (".csv", ".xml", ".json", ".yaml", ".toml")
# Modules that every project depends on.
CORE_MODULES = ("Core", "CoreUObject", "Engine", "InputCore", "Slate", "SlateCore")


def file_name(path: Column) -> Column:
    """The last part of a path with "/" between its parts."""
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The extension with its dot, lower case; "" for none. A leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def norm_path(path: Column) -> Column:
    """Forward slashes, no doubled or closing ones, no "." parts; case is kept."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"(?<=/)(\./)+", ""), r"^(\./)+", "")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/\.?$", ""))


def category(path: Column) -> Column:
    """doc, data or, for everything else, code."""
    s = suffix(path)
    return F.when(s.isin(*DOC), "doc").when(s.isin(*DATA), "data").otherwise("code")


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    return F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def is_header(path: Column) -> Column:
    return _ends(path, HEADER)


def is_implementation(path: Column) -> Column:
    return _ends(path, IMPLEMENTATION)


def strip_prefix(name: Column) -> Column:
    """Without a first letter that marks its kind, if an upper-case letter follows."""
    return F.regexp_replace(name, r"^[FUAIE](?=\p{Lu})", "")


def strip_all_prefixes(name: Column) -> Column:
    """Without any of the letters F, U, A, E in front, however many: what strict parity with old rankings needs."""
    return F.regexp_replace(name, "^[FUAE]+", "")


def kind_of(name: Column) -> Column:
    """struct, class, enum or function by a name's first letters; unknown if it starts with no upper-case letter."""
    return (
        F.when(name.rlike("^F[A-Z]"), "struct").when(name.rlike("^[UAI][A-Z]"), "class").when(name.rlike("^E[A-Z]"), "enum")
        .when(name.rlike(r"^\p{Lu}"), "function").otherwise("unknown")
    )


def _after_last(parts: Column, folder: str) -> Column:
    """The parts behind the last one that is ``folder``, joined; null if none is."""
    back = F.array_position(F.reverse(parts), folder)
    return F.when(back > 0, F.array_join(F.slice(parts, F.size(parts) - back.cast("int") + 2, F.greatest(back.cast("int") - 1, F.lit(0))), "/"))


def include_of(path: Column) -> Column:
    """The line that includes a header: its path behind Public, else Classes, else Private, else its name."""
    parts = F.split(path, "/")
    inner = F.coalesce(*(_after_last(parts, x) for x in ("Public", "Classes", "Private")), file_name(path))
    return F.concat(F.lit('#include "'), inner, F.lit('"'))


def module_by_place(path: Column) -> Column:
    """The second folder below the last Source folder; Unknown if there is none. The file itself counts as a part."""
    parts = F.split(path, "/")
    back = F.array_position(F.reverse(parts), "Source").cast("int")
    return F.when(back > 2, F.element_at(parts, F.size(parts) - back + 3)).otherwise("Unknown")


def dependency_tip(module: Column) -> Column:
    """What to add to a build file to use a module; null for modules that are always there."""
    return F.when(~module.isin(*CORE_MODULES, "Unknown"), F.format_string('Add "%s" to PublicDependencyModuleNames in your Build.cs', module))


def version_parts(version: Column) -> Column:
    """Three whole numbers; missing or malformed parts are 0."""
    parts = F.split(F.coalesce(version, F.lit("")), r"\.")
    ints = F.transform(F.slice(F.concat(parts, F.array(F.lit("0"), F.lit("0"))), 1, 3), lambda x: F.coalesce(F.when(x.rlike("^[0-9]+$"), x.try_cast("int")), F.lit(0)))
    return ints


def versions_match(a: Column, b: Column) -> Column:
    """Equal in the first two numbers."""
    return F.slice(version_parts(a), 1, 2) == F.slice(version_parts(b), 1, 2)


def version_of_path(path: Column) -> Column:
    """The engine version in a path such as /opt/UE_5.3/Engine; null if there is none."""
    v = F.regexp_extract(path, r"UE[_-]?(\d+\.\d+)", 1)
    return F.when(v != "", v)
