"""Queries over source files (snippets, and documents with code of their own) and over questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import definitions, enrich, filters, formats, intent, relations, reports
from . import hybrid
from .fixtures import CODE_SQL, QUESTIONS_SQL, code, fed, fed_sql, questions, table, values
from .text_queries import _compound


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich(code(spark, sf_dir), "text")


def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _enriched(spark, sf_dir)
    return e.select("path", F.array_join("entities", ",").alias("entities"), F.array_join("entity_types", ",").alias("entity_types"))


def macro_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("path", *(f"has_{m}" for m in enrich.MACROS), "is_header", "is_implementation")


def entity_frequency_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.entity_frequency(_enriched(spark, sf_dir))


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).where(F.array_contains("entities", "FHitInfo")).select("path")


def include_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("path", F.posexplode(relations.includes(F.col("text"))).alias("pos", "include"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.graph(definitions.definitions(code(spark, sf_dir)))


def inheritance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.edges(_graph(spark, sf_dir)).where("rel = 'inherits'").select("src", "dst")


def composition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = relations.edges(_graph(spark, sf_dir)).where("rel = 'contains'")
    return e.select("src", "dst", "member_name", F.coalesce("macro", F.lit("")).alias("macro"), "is_component", "is_pointer")


def include_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.edges(_graph(spark, sf_dir), code(spark, sf_dir)).groupBy("rel").agg(F.count("*").alias("n"))


def reachable_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entity leads to, however far."""
    e = relations.edges(_graph(spark, sf_dir))
    roots = e.select(F.col("src").alias("root")).distinct()
    return relations.reachable(e, roots)


def definition_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = definitions.definitions(code(spark, sf_dir))
    return d.select("file_path", "entity_type", "entity_name", "line_start", "line_end", F.array_join("members", "; ").alias("members"), "origin", "module", "include")


def definition_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where structs, classes and enums start."""
    d = definitions.definitions(code(spark, sf_dir))
    return d.where("entity_type IN ('struct', 'class', 'enum')").select("file_path", "entity_type", "entity_name", "line_start")


def definition_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where definitions of all kinds start, functions and delegates too."""
    return definitions.definitions(code(spark, sf_dir)).select("file_path", "entity_type", "entity_name", "line_start")


WANTED = [(0, "FHitInfo", "struct", "all"), (1, "HitInfo", "struct", "engine"), (2, "AThing", "class", "engine"), (3, "UWheelComp", "class", "project"), (4, "Use", "function", "all"), (5, "FOnHit", "function", "all"), (6, "EChannel", "enum", "engine"), (7, "FPlain", "struct", "engine")]


def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.createDataFrame(WANTED, "query_id long, name string, kind string, scope string")
    return definitions.look_up(definitions.definitions(code(spark, sf_dir)), w).select("query_id", "rank", "file_path", "line_start", "entity_name", F.round("match_quality", 6).alias("match_quality"))


def relationship_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.as_json(relations.tree(relations.one_each(_graph(spark, sf_dir)))).select("entity", "tree", "json")


PATHS = [
    ("/eng/Source/Runtime/Engine/Public/Sub/X.h",), ("/eng/Source/Editor/Tool/Classes/Y.h",), ("/eng/Source/Runtime/Core/Private/A/B/Z.cpp",), ("/eng/Source/Main.cpp",), ("/other/place/file.h",),
    ("/p/Source/A/Source/Runtime/Mod/Public/Q.h",), ("/UE_5.3/Engine/Source/Runtime/Slate/Public/S.h",), ("Source/One/Two.h",),
]
NESTED = [("/a",), ("/a/b",), ("/a/bc",), ("/ab",), ("/c/d",), ("/c/d/e/f",), ("/c/de",), ("rel/x",), ("rel",), ("/a",), ("solo",)]


#: Paths of all documents as sources, as folders in folders, and versions, from their numbers.
SOURCE_PATHS = ["concat('/eng/Source/Runtime/M', doc_id % 7, CASE doc_id % 4 WHEN 0 THEN '/Public/' WHEN 1 THEN '/Private/' WHEN 2 THEN '/Classes/' ELSE '/' END, lang, '/', doc_id, '.h')"]
FOLDERS = ["CASE WHEN doc_id % 5 = 0 THEN concat(source, '/', lang, '/', doc_id % 11) ELSE concat(source, '/', lang, '/', doc_id % 13, '/', doc_id) END"]
TWO_VERSIONS = ["concat(doc_id % 6, '.', doc_id % 11)", "concat(n_chars % 6, '.', doc_id % 11, '.', n_chars % 3)"]


def module_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    m = naming.module_by_place(p)
    return fed(spark, sf_dir, "documents", "path string", PATHS, SOURCE_PATHS).select("path", m.alias("module"), naming.include_of(p).alias("include"), naming.dependency_tip(m).alias("tip"), naming.version_of_path(p).alias("version"))


def path_subsumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.subsume(fed(spark, sf_dir, "documents", "path string", NESTED, FOLDERS)).select("path")


VERSIONS = [("5.3", "5.3.2"), ("5.3", "5.4"), ("4.27", "5.3"), ("4.27", "5.27"), ("invalid", "0.0"), ("", "0"), ("5", "5.0.9"), ("5.x", "5.0"), ("10.2.3.4", "10.2")]


def version_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fed(spark, sf_dir, "documents", "v1 string, v2 string", VERSIONS, TWO_VERSIONS)
    return v.select("v1", "v2", F.array_join(naming.version_parts(F.col("v1")).cast("array<string>"), ".").alias("parts"), naming.versions_match(F.col("v1"), F.col("v2")).alias("matched"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated questions, what users say in all conversations, and the texts of the benchmark."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000).alias("query_id"), F.col("text").alias("question"))
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 500_000).alias("query_id"), F.col("text").alias("question"))
    return questions(spark).unionByName(c).unionByName(b)


def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).withColumn("i", intent.intent(F.col("question"))).select("query_id", "i.*")


def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", F.array_join(intent.expand(F.col("question")), "|").alias("terms"))


def relationship_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", intent.relationship_entity(F.col("question")).alias("entity"))


def related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words with synonyms, and all words of the benchmark."""
    words = [(w,) for w in [*intent.SYNONYMS, "Trace", "nothing"]]
    there = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("term"))
    return spark.createDataFrame(words, "term string").union(there).distinct().select("term", F.explode(intent.related(F.col("term"))).alias("entity"))


def hybrid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stated questions against all files, in one plan, rendered."""
    q = questions(spark).withColumns({"top_k": F.lit(5), "scope": F.lit("all"), "filter": F.lit(None).cast("string")})
    out = hybrid.answer(q, hybrid.Index.build(code(spark, sf_dir), most_chars=None).kept(chunks=False)).withColumn("timing", F.create_map().cast("map<string, double>"))
    return out.select("query_id", "intent.type", F.size("definition_results").alias("n_definitions"), F.size("semantic_results").alias("n_semantic"), F.size("combined_results").alias("n_combined"), formats.as_paths().alias("paths"), formats.as_json(False).alias("json"))


def format_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([(0, "struct FHitInfo"), (1, "how do wheels work")], "query_id long, question string").withColumns({"top_k": F.lit(3), "scope": F.lit("all")})
    out = hybrid.answer(q, hybrid.Index.build(code(spark, sf_dir), most_chars=None).kept(chunks=False)).withColumn("timing", F.create_map().cast("map<string, double>"))
    kinds = F.create_map(*(x for name, f in formats.FORMATS.items() for x in (F.lit(name), f())))
    return out.select("query_id", F.explode(kinds).alias("format", "rendered"))


QUERIES = {f.__name__: f for f in (entity_extract, macro_flags, entity_frequency_top10, entity_mentions, include_dependencies, inheritance_edges, composition_edges, include_edges, reachable_entities, definition_extract, definition_starts, definition_kinds, definition_lookup, relationship_tree, module_include, path_subsumption, version_match, intent_route, query_expand, relationship_entity, related_entities, hybrid_answers, format_outputs)}

_ASKED = f"""{QUESTIONS_SQL}, asked AS (SELECT query_id::BIGINT AS query_id, question FROM questions UNION ALL SELECT conv_id * 1000 + turn + 1000000, text FROM conversations WHERE role = 'user'
UNION ALL SELECT item_id + 500000, text FROM benchmark)"""
_ENTITIES = r"""e AS (SELECT path, text, regexp_extract_all(text, '\bstruct\s+(?:\w+_API\s+)?([A-Z_]\w+)', 1) AS s, regexp_extract_all(text, '\bclass\s+(?:\w+_API\s+)?([UAI][A-Z]\w+)', 1) AS c,
  regexp_extract_all(text, '\benum\s+(?:class\s+)?([A-Z_]\w+)', 1) AS n FROM code), d AS (SELECT *, list_sort(list_distinct(s || c || n)) AS entities FROM e)"""
#: Headers and bodies of the snippets' structs and classes, by an expression of their own.
_HEADS = r"""h AS (SELECT path, unnest(regexp_extract_all(text, '(?:struct|class)\s+(?:\w+_API\s+)?[A-Z_]\w*\s*(?::[\w\s,]+)?\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}')) AS block FROM code),
g AS (SELECT path, block, regexp_extract(block, '(?:struct|class)\s+(?:\w+_API\s+)?([A-Z_]\w*)', 1) AS src FROM h WHERE starts_with(block, 'struct') OR regexp_matches(regexp_extract(block, '(?:struct|class)\s+(?:\w+_API\s+)?([A-Z_]\w*)', 1), '^[UAI][A-Z]'))"""
_MARK = r"UPROPERTY\([^)]*\)\s+([A-Z]\w+(?:<[^>]+>)?(?:\*)*)\s+(\w+)\s*;"
_PLAIN = r"(?m)^\s+([A-Z]\w+(?:<[^>]+>)?(?:\*)*)\s+(\w+)\s*;\s*(?://.*)?$"
_CONTAINS = f"""m AS (SELECT src, unnest(regexp_extract_all(block, '{_MARK}')) AS x, 'UPROPERTY' AS macro, '{_MARK}' AS p FROM g
  UNION ALL SELECT src, unnest(regexp_extract_all(block, '{_PLAIN}')), '', '{_PLAIN}' FROM g),
k AS (SELECT src, macro, regexp_extract(x, '{_MARK}', 1) AS t1, regexp_extract(x, '{_MARK}', 2) AS n1, regexp_extract(x, '{_PLAIN}', 1) AS t2, regexp_extract(x, '{_PLAIN}', 2) AS n2 FROM m),
c AS (SELECT src, macro, CASE WHEN macro = '' THEN t2 ELSE t1 END AS type, CASE WHEN macro = '' THEN n2 ELSE n1 END AS member_name FROM k),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY src, member_name ORDER BY macro DESC) = 1)"""
_INHERITS = r"i AS (SELECT src, unnest(list_filter(regexp_extract_all(regexp_extract(block, '(?:class|struct)\s+(?:\w+_API\s+)?(\w+)\s*:\s*(.+?)\s*\{', 2), '\w+'), lambda w: w NOT IN ('public', 'protected', 'private', 'virtual'))) AS dst FROM g)"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


def _kind(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^F[A-Z]') THEN 'struct' WHEN regexp_matches({x}, '^[UAI][A-Z]') THEN 'class' WHEN regexp_matches({x}, '^E[A-Z]') THEN 'enum' WHEN regexp_matches({x}, '^\\p{{Lu}}') THEN 'function' ELSE 'unknown' END"


def _any(text: str, xs: list[str]) -> str:
    return f"len(list_filter({_list(xs)}, lambda k: contains({text}, k))) > 0"


_HINTED = " || ".join(f"CASE WHEN kind = '{k}' AND {_any('low', hints)} THEN ['{w}'] ELSE [] END" for k, hints, w in intent.HINTS)
_OWN = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_list(ws)}" for k, ws in intent.KIND_WORDS.items()) + " ELSE [] END"
_INTENT = rf"""WITH {_ASKED},
a AS (SELECT query_id, question AS q, lower(question) AS low,
  regexp_extract(question, '(?i){intent.KIND_NAME}', 1) AS k1, regexp_extract(question, '(?i){intent.KIND_NAME}', 2) AS n1,
  regexp_extract(question, '(?i){intent.NAME_KIND}', 1) AS g1, regexp_extract(question, '(?i){intent.NAME_KIND}', 2) AS g2,
  regexp_extract(question, '(?i){intent.DEFINE_NAME}', 1) AS k3, regexp_extract(question, '(?i){intent.DEFINE_NAME}', 2) AS n3,
  regexp_extract(question, '(?i){intent.ASK_NAME}', 1) AS k4, regexp_extract(question, '(?i){intent.ASK_NAME}', 2) AS n4,
  regexp_extract(question, '(?i){intent.NAME_FUNCTION}', 1) AS f1, regexp_extract(question, '(?i){intent.FUNCTION_NAME}', 1) AS f2 FROM asked),
b AS (SELECT *, lower(g1) IN ('struct', 'class', 'enum', 'define', 'definition', 'what', 'show', 'find') OR contains(lower(g1), 'definition') AS turned FROM a),
c AS (SELECT *, CASE WHEN n1 <> '' THEN n1 WHEN g1 <> '' THEN CASE WHEN turned THEN g2 ELSE g1 END WHEN n3 <> '' THEN n3 WHEN n4 <> '' THEN n4 END AS name,
  lower(CASE WHEN n1 <> '' THEN k1 WHEN g1 <> '' THEN CASE WHEN turned THEN g1 ELSE g2 END WHEN n3 <> '' THEN k3 WHEN n4 <> '' THEN k4 END) AS kw,
  CASE WHEN f1 <> '' THEN f1 WHEN f2 <> '' THEN f2 END AS fn,
  {_any('low', intent.CONCEPTUAL)} AS conceptual, {_any('low', intent.FILE)} AS by_file, {_any('low', intent.DEFINITION)} AS by_definition,
  list_filter(regexp_extract_all(q, '\b[A-Z][\p{{L}}\p{{M}}\p{{Nd}}_]+'), lambda w: NOT list_contains({_list(intent.NOT_ENTITIES)}, w))[1] AS entity,
  list_filter(regexp_split_to_array(q, '\s+'), lambda w: length(w) > 2 AND NOT list_contains({_list(intent.INSIGNIFICANT)}, lower(w))) AS significant FROM b),
d AS (SELECT *, {_kind('entity')} AS kind FROM c),
e AS (SELECT *, list_filter({_OWN} || {_HINTED}, lambda w: NOT contains(low, lower(w))) AS lacking,
  list_filter(regexp_extract_all(q, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)(?:[^\p{{L}}\p{{M}}\p{{Nd}}_]|$)', 1), lambda w: w <> entity) AS named FROM d),
f AS (SELECT *, q || CASE WHEN len(lacking) > 0 THEN ' ' || array_to_string(lacking, ' ') ELSE '' END || CASE WHEN len(named) > 0 THEN ' ' || array_to_string(named, ' ') ELSE '' END AS more,
  CASE WHEN q IS NULL OR trim(regexp_replace(q, '\s+', ' ', 'g')) = '' THEN 0 WHEN name IS NOT NULL THEN 1 WHEN fn IS NOT NULL THEN 2
    WHEN entity IS NOT NULL AND NOT conceptual AND len(significant) <= 2 AND len(list_filter(significant, lambda w: list_contains({_list(intent.DEFINITION)}, lower(w)))) = 0 THEN 3
    WHEN entity IS NOT NULL AND NOT conceptual AND (by_definition OR by_file) THEN 4 WHEN conceptual THEN 5 WHEN by_file THEN 6 ELSE 7 END AS step FROM e)
SELECT query_id, CASE step WHEN 0 THEN 'unknown' WHEN 1 THEN 'definition' WHEN 2 THEN 'definition' WHEN 3 THEN 'definition' WHEN 4 THEN 'hybrid' ELSE 'semantic' END AS type,
  CASE step WHEN 1 THEN CASE WHEN contains(kw, 'struct') THEN 'struct' WHEN contains(kw, 'define') OR contains(kw, 'definition') THEN {_kind('name')} WHEN contains(kw, 'class') THEN 'class' WHEN contains(kw, 'enum') THEN 'enum' ELSE {_kind('name')} END
    WHEN 2 THEN 'function' WHEN 3 THEN kind WHEN 4 THEN kind END AS entity_type,
  CASE step WHEN 1 THEN name WHEN 2 THEN fn WHEN 3 THEN entity WHEN 4 THEN entity END AS entity_name,
  [0.0, 0.95, 0.9, 0.85, 0.75, 0.9, 0.8, 0.5][step + 1]::DOUBLE AS confidence, CASE WHEN step = 4 OR step = 7 AND entity IS NOT NULL THEN more ELSE q END AS enhanced_query, step = 6 AS is_file_search,
  CASE step WHEN 1 THEN printf('{intent.REASONS["explicit"]}', CASE WHEN contains(kw, 'struct') THEN 'struct' WHEN contains(kw, 'define') OR contains(kw, 'definition') THEN {_kind('name')} WHEN contains(kw, 'class') THEN 'class' WHEN contains(kw, 'enum') THEN 'enum' ELSE {_kind('name')} END, name)
    WHEN 2 THEN printf('{intent.REASONS["function"]}', fn) WHEN 3 THEN printf('{intent.REASONS["bare"]}', kind, entity) WHEN 4 THEN printf('{intent.REASONS["hybrid"].replace("'", "''")}', entity, CASE WHEN by_file THEN 'file' ELSE 'definition' END)
    WHEN 5 THEN '{intent.REASONS["conceptual"]}' WHEN 6 THEN '{intent.REASONS["file"]}' WHEN 7 THEN '{intent.REASONS["default"]}' END AS reasoning FROM f"""
_SYNONYMS = "syn(k, vs) AS (VALUES " + ", ".join(f"('{k}', {_list(vs)})" for k, vs in intent.SYNONYMS.items()) + ")"

#: Starts of all five kinds: each line of a file with what follows it, and the pattern of each kind there.
_STARTS = r"""k(kind, macro, body) AS (VALUES ('struct', 'USTRUCT', 'struct\s+(?:\w+_API\s+)?([A-Z_]\w*)\s*(?::\s*public\s+\w+)?\s*\{'), ('class', 'UCLASS', 'class\s+(?:\w+_API\s+)?([UAI][A-Z]\w*)\s*(?::\s*public\s+[\w\s,]+)?\s*\{'),
  ('enum', 'UENUM', 'enum\s+(?:class\s+)?([A-Z_]\w*)\s*(?::\s*\w+)?\s*\{'), ('function', 'UFUNCTION', '(?:virtual\s+)?(?:static\s+)?(?:inline\s+)?[\w:<>,\*&][\w:<>,\*& \t]*[ \t]+\*?&?(\w+)\s*\('), ('delegate', '', 'DECLARE_\w+_DELEGATE[^(\n]*\(\s*(\w+)\s*,')),
l AS (SELECT path, origin, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM code),
o AS (SELECT path, origin, text, no, coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM l QUALIFY contains(line, '(') OR contains(line, '{') OR regexp_matches(line, 'struct|class|enum|USTRUCT|UCLASS|UENUM|UFUNCTION')),
m AS (SELECT path, origin, kind, macro, no, text[1:spot] AS before, text[spot + 1:spot + 4000] AS after, '^[ \t]*' || CASE WHEN macro = '' THEN '' ELSE '(?:' || macro || '\s*\([^)]*\)\s*)?' END || body AS pattern FROM o, k),
starts AS (SELECT path AS file_path, origin, kind AS entity_type, no::INT AS line_start, regexp_extract(after, pattern, 1) AS entity_name, regexp_extract(after, pattern) AS head FROM m WHERE regexp_matches(after, pattern) AND (macro = '' OR NOT regexp_matches(before, macro || '\s*\([^)]*\)\s*$'))),
w AS (SELECT *, string_split_regex(trim(regexp_replace(head, '\w+\s*\($', '')), '\s+') AS words FROM starts),
defs AS (SELECT file_path, origin, entity_type, line_start, entity_name FROM w WHERE entity_type <> 'function' OR entity_name NOT IN ('if', 'for', 'while', 'switch', 'return', 'else', 'new', 'delete', 'case', 'do')
  AND trim(words[-1], '*&') NOT IN ('if', 'for', 'while', 'switch', 'return', 'else', 'new', 'delete', 'case', 'do'))"""


def _lookup_sql() -> str:
    """All names of a kind against all names asked."""
    bare = lambda x: f"CASE WHEN regexp_matches({x}, '^[FUAIE]\\p{{Lu}}') THEN {x}[2:] ELSE {x} END"
    return f"""WITH {CODE_SQL}, {_STARTS}, {values("wanted", "query_id, name, kind, scope", WANTED)},
n AS (SELECT DISTINCT entity_name, CASE WHEN entity_type = 'delegate' THEN 'function' ELSE entity_type END AS kind FROM defs),
x AS (SELECT DISTINCT name, n.kind, entity_name, {bare("name")} AS qs, {bare("entity_name")} AS cs FROM n JOIN wanted USING (kind)),
y AS (SELECT name, kind, entity_name, CASE WHEN lower(name) = lower(entity_name) THEN 1 WHEN lower(qs) = lower(cs) THEN 0.9::DOUBLE ELSE greatest({_compound("name", "entity_name")}, {_compound("qs", "cs")}) END AS q FROM x),
z AS (SELECT query_id, file_path, line_start, entity_type, y.entity_name, y.name, q FROM wanted JOIN y USING (name, kind) JOIN defs d ON d.entity_name = y.entity_name AND CASE WHEN d.entity_type = 'delegate' THEN 'function' ELSE d.entity_type END = y.kind
      WHERE q > 0.4 AND (scope = 'all' OR (scope = 'engine') = (origin = 'engine'))),
u AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY query_id, file_path, line_start ORDER BY q DESC, name, entity_type, entity_name) = 1)
SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY q DESC, file_path, line_start)::INT AS rank, file_path, line_start, entity_name, round(q, 6)::DOUBLE AS match_quality FROM u"""


def _tree_sql() -> str:
    """Trees and JSON, written out by hand."""
    member = lambda p, macro: f"list_transform(regexp_extract_all(block, '{p}'), lambda x: {{'name': regexp_extract(x, '{p}', 2), 'type': regexp_extract(x, '{p}', 1), 'macro': {macro}}})"
    parents = _INHERITS[_INHERITS.index("list_filter") : _INHERITS.rindex(") AS dst")]
    return f"""WITH {CODE_SQL}, {_HEADS}, a AS (SELECT path, src, {parents} AS inherits, {member(_MARK, "'UPROPERTY'::VARCHAR")} || {member(_PLAIN, "NULL::VARCHAR")} AS xs FROM g QUALIFY row_number() OVER (PARTITION BY src ORDER BY path) = 1),
b AS (SELECT path, src, inherits, list_filter(xs, lambda x, i: list_position(list_transform(xs, lambda y: y.name), x.name) = i) AS ms FROM a)
SELECT src AS entity, src || chr(10) || '+-- Inherits: ' || CASE WHEN len(inherits) > 0 THEN array_to_string(inherits, ', ') ELSE '(none)' END || chr(10) || CASE WHEN len(ms) > 0 THEN '+-- Contains (' || len(ms) || ' members):' || chr(10)
  || array_to_string(list_transform(ms, lambda m: '|   +-- ' || m.type || ' ' || m.name || coalesce(' (' || m.macro || ')', '') || CASE WHEN contains(m.type, 'Component') THEN ' [Component]' ELSE '' END), chr(10)) ELSE '+-- Contains: (no members)' END || chr(10) || '+-- Defined in: ' || path AS tree,
  '{{"entity":"' || src || '","relationships":{{"inherits":[' || array_to_string(list_transform(inherits, lambda p: '"' || p || '"'), ',') || '],"contains":[' || array_to_string(list_transform(ms, lambda m: '{{"name":"' || m.name || '","type":"' || m.type || '","macro":'
  || coalesce('"' || m.macro || '"', 'null') || ',"is_component":' || contains(m.type, 'Component') || ',"is_pointer":' || contains(m.type, '*') || '}}'), ',') || ']}},"metadata":{{"defined_in":"' || path || '","has_ue5_macros":' || (len(list_filter(ms, lambda m: m.macro IS NOT NULL)) > 0)
  || ',"has_components":' || (len(list_filter(ms, lambda m: contains(m.type, 'Component'))) > 0) || ',"member_count":' || len(ms) || ',"parent_count":' || len(inherits) || '}}}}' AS json FROM b"""


SQL = {
    "relationship_tree": _tree_sql(),
    "definition_lookup": _lookup_sql(),
    "definition_kinds": f"WITH {CODE_SQL}, {_STARTS} SELECT file_path, entity_type, entity_name, line_start FROM defs",
    "entity_extract": f"WITH {CODE_SQL}, {_ENTITIES} SELECT path, array_to_string(entities, ',') AS entities, array_to_string((CASE WHEN len(c) > 0 THEN ['class'] ELSE [] END) || (CASE WHEN len(n) > 0 THEN ['enum'] ELSE [] END) || (CASE WHEN len(s) > 0 THEN ['struct'] ELSE [] END), ',') AS entity_types FROM d",
    "macro_flags": f"WITH {CODE_SQL} SELECT path, " + ", ".join(rf"regexp_matches(text, '\b{m.upper()}\s*\(') AS has_{m}" for m in enrich.MACROS) + r", regexp_matches(lower(path), '\.h(pp)?$') AS is_header, regexp_matches(lower(path), '\.(cpp|c|cc|m|mm)$') AS is_implementation FROM code",
    "entity_frequency_top10": f"WITH {CODE_SQL}, {_ENTITIES}, u AS (SELECT unnest(entities) AS entity FROM d) SELECT entity, count(*) AS n FROM u GROUP BY entity ORDER BY n DESC, entity LIMIT 10",
    "entity_mentions": f"WITH {CODE_SQL}, {_ENTITIES} SELECT path FROM d WHERE list_contains(entities, 'FHitInfo')",
    "include_dependencies": f"""WITH {CODE_SQL}, i AS (SELECT path, regexp_extract_all(text, '#include\\s+[<"]([^>"]+)[>"]', 1) AS xs FROM code) SELECT path, (unnest(range(len(xs))))::INT AS pos, unnest(xs) AS include FROM i""",
    "inheritance_edges": f"WITH {CODE_SQL}, {_HEADS}, {_INHERITS} SELECT src, dst FROM i",
    "composition_edges": f"WITH {CODE_SQL}, {_HEADS}, {_CONTAINS} SELECT src, regexp_extract(type, '^\\w+') AS dst, member_name, macro, contains(type, 'Component') AS is_component, contains(type, '*') AS is_pointer FROM o",
    "include_edges": f"""WITH {CODE_SQL}, {_HEADS}, {_INHERITS}, {_CONTAINS}, r AS (SELECT 'inherits' AS rel FROM i UNION ALL SELECT 'contains' FROM o UNION ALL SELECT 'includes' FROM (SELECT unnest(regexp_extract_all(text, '#include\\s+[<"]([^>"]+)[>"]', 1)) FROM code)) SELECT rel, count(*) AS n FROM r GROUP BY rel""",
    "reachable_entities": f"WITH RECURSIVE {CODE_SQL}, {_HEADS}, {_INHERITS}, {_CONTAINS}, ed AS (SELECT src, dst FROM i UNION SELECT src, regexp_extract(type, '^\\w+') FROM o), t(root, node, hops) AS (SELECT DISTINCT src, src, 0 FROM ed UNION SELECT t.root, ed.dst, t.hops + 1 FROM t JOIN ed ON t.node = ed.src WHERE t.hops < 12) SELECT root, node, min(hops)::INT AS hops FROM t GROUP BY root, node",
    "definition_starts": rf"""WITH {CODE_SQL}, k(kind, macro, body) AS (VALUES ('struct', 'USTRUCT', 'struct\s+(?:\w+_API\s+)?([A-Z_]\w*)\s*(?::\s*public\s+\w+)?\s*\{{'),
  ('class', 'UCLASS', 'class\s+(?:\w+_API\s+)?([UAI][A-Z]\w*)\s*(?::\s*public\s+[\w\s,]+)?\s*\{{'), ('enum', 'UENUM', 'enum\s+(?:class\s+)?([A-Z_]\w*)\s*(?::\s*\w+)?\s*\{{')),
l AS (SELECT path, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM code),
o AS (SELECT path, text, no, coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM l),
m AS (SELECT path, kind, no, macro, body, text[1:spot] AS before, text[spot + 1:] AS after FROM o, k)
SELECT path AS file_path, kind AS entity_type, regexp_extract(after, '^[ \t]*(?:' || macro || '\s*\([^)]*\)\s*)?' || body, 1) AS entity_name, no::INT AS line_start FROM m
WHERE regexp_matches(after, '^[ \t]*(?:' || macro || '\s*\([^)]*\)\s*)?' || body) AND NOT regexp_matches(before, macro || '\s*\([^)]*\)\s*$')""",
    "module_include": rf"""WITH {fed_sql("p", "documents", "path", PATHS, SOURCE_PATHS)}, s AS (SELECT path, string_split(path, '/') AS parts FROM p), i AS (SELECT *, len(parts) - list_position(list_reverse(parts), 'Source') + 1 AS spot FROM s),
m AS (SELECT *, CASE WHEN spot + 2 <= len(parts) THEN parts[spot + 2] ELSE 'Unknown' END AS module,
  CASE WHEN regexp_matches(path, '/Public/') THEN regexp_extract(path, '.*/Public/(.*)$', 1) WHEN regexp_matches(path, '/Classes/') THEN regexp_extract(path, '.*/Classes/(.*)$', 1) WHEN regexp_matches(path, '/Private/') THEN regexp_extract(path, '.*/Private/(.*)$', 1) ELSE parts[-1] END AS inner_path FROM i)
SELECT path, module, '#include "' || inner_path || '"' AS include, CASE WHEN module NOT IN ('Core', 'CoreUObject', 'Engine', 'InputCore', 'Slate', 'SlateCore', 'Unknown') THEN 'Add "' || module || '" to PublicDependencyModuleNames in your Build.cs' END AS tip, nullif(regexp_extract(path, 'UE[_-]?(\d+\.\d+)', 1), '') AS version FROM m""",
    "path_subsumption": f"WITH {fed_sql('p', 'documents', 'path', NESTED, FOLDERS)} SELECT DISTINCT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS o WHERE starts_with(p.path, o.path || '/'))",
    "version_match": f"WITH {fed_sql('v', 'documents', 'v1, v2', VERSIONS, TWO_VERSIONS)}, s AS (SELECT *, list_transform((string_split(v1, '.') || ['0', '0'])[1:3], lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::INT ELSE 0 END) AS a, list_transform((string_split(v2, '.') || ['0', '0'])[1:3], lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::INT ELSE 0 END) AS b FROM v) SELECT v1, v2, array_to_string(a, '.') AS parts, a[1:2] = b[1:2] AS matched FROM s",
    "intent_route": _INTENT,
    "query_expand": rf"""WITH {_ASKED}, {_SYNONYMS}, w AS (SELECT query_id, question, lower(question) AS low, unnest(regexp_split_to_array(lower(question), '\s+')) AS word FROM asked),
x AS (SELECT query_id, question AS term FROM asked UNION SELECT query_id, unnest(vs) FROM asked JOIN syn ON lower(question) = k UNION SELECT query_id, unnest(vs) FROM w JOIN syn ON word = k UNION SELECT query_id, replace(low, k, s) FROM (SELECT query_id, low, k, unnest(vs) AS s FROM w JOIN syn ON word = k))
SELECT query_id, string_agg(term, '|' ORDER BY term) AS terms FROM x GROUP BY query_id""",
    "relationship_entity": rf"""WITH {_ASKED}, n AS (SELECT query_id, list_filter(regexp_extract_all(question, '[\p{{L}}\p{{M}}\p{{Nd}}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z0-9_]+')) AS names FROM asked) SELECT query_id, coalesce(list_filter(names, lambda x: regexp_matches(x, '^[FAUET]'))[1], names[1]) AS entity FROM n""",
    "related_entities": f"WITH {_SYNONYMS}, t AS (SELECT k AS term FROM syn UNION VALUES ('Trace'), ('nothing') UNION SELECT unnest(string_split(lower(text), ' ')) FROM benchmark) SELECT term, unnest(vs) AS entity FROM t JOIN syn ON lower(term) = k",
}
