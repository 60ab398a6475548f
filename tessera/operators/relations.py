"""Relationships of code entities as edges: inherits, contains, includes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

# Where parents, members and includes stand in code.
PARENTS = r"(?:class|struct)\s+(?:\w+_API\s+)?(\w+)\s*:\s*(.+?)\s*\{"
MARKED_MEMBER = r"UPROPERTY\([^)]*\)\s+([A-Z]\w+(?:<[^>]+>)?(?:\*)*)\s+(\w+)\s*;"
PLAIN_MEMBER = r"(?m)^\s+([A-Z]\w+(?:<[^>]+>)?(?:\*)*)\s+(\w+)\s*;\s*(?://.*)?$"
INCLUDE = r'#include\s+[<"]([^>"]+)[>"]'
ACCESS = ("public", "protected", "private", "virtual")

MEMBER = "struct<name: string, type: string, macro: string, is_component: boolean, is_pointer: boolean>"


def parents(code: Column) -> Column:
    """The parents in the first class or struct header of ``code``, in order, without access words."""
    listed = F.regexp_extract(code, "(?U)" + PARENTS, 2)
    return F.filter(F.regexp_extract_all(listed, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: ~w.isin(*ACCESS))


def includes(code: Column) -> Column:
    """What a file includes, in order, repeats kept."""
    return F.regexp_extract_all(code, F.lit(INCLUDE), F.lit(1))


def _members(code: Column, pattern: str, macro: str | None) -> Column:
    """All matches; the two groups of one are taken from the text of the match."""
    hits = F.regexp_extract_all(code, F.lit("(?U)" + pattern), F.lit(0))
    group = lambda m, k: F.regexp_extract(m, "(?U)" + pattern, k)
    return F.transform(hits, lambda m: F.struct(
        group(m, 2).alias("name"), group(m, 1).alias("type"), F.lit(macro).cast("string").alias("macro"),
        F.contains(group(m, 1), F.lit("Component")).alias("is_component"), F.contains(group(m, 1), F.lit("*")).alias("is_pointer"))).cast(f"array<{MEMBER}>")


def members(code: Column) -> Column:
    """Members with upper-case types, those marked by a macro first; of equal names the first."""
    both = F.concat(_members(code, MARKED_MEMBER, "UPROPERTY"), _members(code, PLAIN_MEMBER, None))

    def add(acc: Column, m: Column) -> Column:
        return F.when(F.exists(acc, lambda x: x["name"] == m["name"]), acc).otherwise(F.concat(acc, F.array(m)))

    return F.aggregate(both, F.array().cast(f"array<{MEMBER}>"), add)


def graph(defs: DataFrame) -> DataFrame:
    """One row for each definition: entity, inherits, contains, defined_in and counts. Parents stand in the header,
    so header and definition are looked at together."""
    code = F.concat_ws(" ", "header", "definition")
    g = defs.where(F.col("entity_type").isin("struct", "class")).select(F.col("entity_name").alias("entity"), parents(code).alias("inherits"), members(F.col("definition")).alias("contains"), F.coalesce("file_path", F.lit("unknown")).alias("defined_in"))
    return g.withColumns({
        "has_macros": F.exists("contains", lambda m: m["macro"].isNotNull()), "has_components": F.exists("contains", lambda m: m["is_component"]),
        "member_count": F.size("contains"), "parent_count": F.size("inherits")})


def edges(graphs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(src, rel, dst, member_name, macro, is_component, is_pointer, defined_in); a contained type without its template
    arguments and stars, so that it can be the src of other edges."""
    null = F.lit(None)
    i = graphs.select(F.col("entity").alias("src"), F.lit("inherits").alias("rel"), F.explode("inherits").alias("dst"), null.cast("string").alias("member_name"), null.cast("string").alias("macro"), null.cast("boolean").alias("is_component"), null.cast("boolean").alias("is_pointer"), "defined_in")
    m = graphs.select("entity", "defined_in", F.explode("contains").alias("m"))
    c = m.select(F.col("entity").alias("src"), F.lit("contains").alias("rel"), F.regexp_extract("m.type", r"^\w+", 0).alias("dst"), F.col("m.name").alias("member_name"), F.col("m.macro").alias("macro"), F.col("m.is_component").alias("is_component"), F.col("m.is_pointer").alias("is_pointer"), "defined_in")
    out = i.unionByName(c)
    if files is not None:
        f = files.select(F.col("path").alias("src"), F.explode(includes(F.col("text"))).alias("dst"), F.col("path").alias("defined_in"))
        out = out.unionByName(f.withColumn("rel", F.lit("includes")), allowMissingColumns=True)
    return out


def reachable(all_edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, hops): what each of ``roots(root)`` leads to, by the shortest way, itself included; with ``depth`` in at most so many hops. One equi-join
    a hop up to a ``depth``, from the nodes that the last hop found first. Without one, ways are doubled: after n rounds those of up to 2^n hops are known, so a chain
    of a thousand takes ten rounds, and it ends with the first that finds nothing, cycles or not. Its tables are kept in the shared folder."""
    e = all_edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    start = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct()
    if depth is None:
        return _doubled(e, start)
    seen = front = start
    for hop in range(1, depth + 1):
        step = front.join(e, front["node"] == e["src"]).select("root", F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def _doubled(e: DataFrame, start: DataFrame) -> DataFrame:
    """``far`` has what is up to 2^n hops from a root, ``ways`` what is up to 2^n hops from any node; both are joined with ``ways``."""
    shortest = lambda df, key: df.groupBy(key, "node").agg(F.min("hops").alias("hops"))
    size = lambda df: tuple(df.agg(F.count("*"), F.sum("hops")).first())
    far, ways = settled(start), settled(e.where("src <> dst").select("src", F.col("dst").alias("node"), F.lit(1).alias("hops")))
    last = size(far)
    while True:
        step = ways.select(F.col("src").alias("__via"), F.col("node").alias("__to"), F.col("hops").alias("__more"))
        longer = lambda df, key: df.join(step, F.col("node") == F.col("__via")).select(key, F.col("__to").alias("node"), (F.col("hops") + F.col("__more")).alias("hops"))  # noqa: E731, B023
        far = settled(shortest(far.union(longer(far, "root")), "root"))
        now = size(far)
        if now == last:
            return far
        ways, last = settled(shortest(ways.union(longer(ways, "src").where("src <> node")), "src")), now


def tree(g: DataFrame) -> DataFrame:
    """``g`` with its relationships drawn as text."""
    line = lambda m: F.concat(F.lit("|   +-- "), m["type"], F.lit(" "), m["name"], F.when(m["macro"].isNotNull(), F.concat(F.lit(" ("), m["macro"], F.lit(")"))).otherwise(""), F.when(m["is_component"], " [Component]").otherwise(""))
    inherits = F.concat(F.lit("+-- Inherits: "), F.when(F.size("inherits") > 0, F.array_join("inherits", ", ")).otherwise("(none)"))
    contains = F.when(F.size("contains") > 0, F.concat(F.format_string("+-- Contains (%d members):\n", F.size("contains")), F.array_join(F.transform("contains", line), "\n"))).otherwise("+-- Contains: (no members)")
    return g.withColumn("tree", F.concat_ws("\n", "entity", inherits, contains, F.concat(F.lit("+-- Defined in: "), "defined_in")))


def as_json(g: DataFrame) -> DataFrame:
    relationships = F.struct("inherits", "contains")
    metadata = F.struct("defined_in", F.col("has_macros").alias("has_ue5_macros"), "has_components", "member_count", "parent_count")
    return g.withColumn("json", F.to_json(F.struct("entity", relationships.alias("relationships"), metadata.alias("metadata")), {"ignoreNullFields": "false"}))


def one_each(g: DataFrame) -> DataFrame:
    """The first definition of each entity by file."""
    return g.withColumn("__r", F.row_number().over(Window.partitionBy("entity").orderBy("defined_in"))).where("__r = 1").drop("__r")
