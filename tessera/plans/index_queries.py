"""Queries for building and checking an index, batches, logs and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, definitions, embed, enrich, incremental, reports
from ..operators.filters import DOC_EXTENSIONS, EXTENSIONS
from ..sources import files as sources
from ..sources import tree
from ..sources.shared import scratch, settled
from ..sources.snapshots import Store
from ..streaming import batch_stream
from . import hybrid
from .code_queries import _INTENT
from .fixtures import CODE_SQL, FILES, code, fed, fed_sql, files, table, values

#: The new state of documents: every tenth is edited, every seventh is gone, and there are two more.
MORE = [(-1, "new/one.h"), (-2, "new/two.md")]


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = files(spark, sf_dir)
    new = old.where(F.col("doc_id") % 7 != 3).withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    more = spark.createDataFrame(MORE, "doc_id long, path string").withColumns({"origin": F.lit("engine"), "text": F.lit("new text")})
    return old, new.unionByName(more)


def incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    sha = lambda d: d.select("path", F.sha2("text", 256).alias("sha256"))
    return incremental.changes(sha(new), sha(old))


def incremental_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a run: one chunk a file, marked by which run made it."""
    old, new = _old_and_new(spark, sf_dir)
    make = lambda run: lambda d: d.select("path", "origin", F.sha2("text", 256).alias("sha256"), F.length("text").alias("chars"), F.lit(run).alias("run"))
    return incremental.rebuild(new, make("old")(old), make("new"))


def safety_brake(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    ok = incremental.safety_brake(old, new).withColumn("run", F.lit("whole"))
    return ok.unionByName(incremental.safety_brake(old, new.where("origin = 'project'")).withColumn("run", F.lit("lost")))


def embed_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents, each text encoded once; the digest of the components stands for the vector."""
    f = files(spark, sf_dir).select("doc_id", F.col("text").alias("chunk_text"), F.sha2("text", 256).alias("chunk_sha"))
    none = spark.createDataFrame([], "chunk_sha string, embedding array<float>")
    e = embed.embed_missing(f, none)
    return e.select("doc_id", F.size("embedding").alias("dim"), F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("int").cast("string")), ",")).alias("digest"))


CASES = [(0, ["FHitResult", "HitResult.h"]), (1, ["AActor"]), (2, ["LineTraceSingle", "World.h", "nothing"]), (3, []), (4, ["x"])]
FOUND = [(0, "/eng/Hitresult.H"), (0, "fhitresult"), (1, "/a/b.h"), (2, "LineTraceSingleByChannel"), (2, "MyWorld.hpp"), (2, "World.h"), (3, "y")]
FOUND_B = [(0, "fhitresult"), (1, "AActorBase"), (2, "nothing else"), (4, "X.h")]


#: Five documents in a row are a case: those with even numbers are expected, and a length picks those found.
CASE_OF, FOUND_IF = "CAST((doc_id - doc_id % 5) / 5 + 100 AS BIGINT)", {"base": "n_chars % 3 <> 0", "other": "n_chars % 3 <> 1"}


def _evaluate(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    f = files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    cases = f.where("doc_id % 2 = 0").groupBy(F.expr(CASE_OF).alias("case_id")).agg(F.collect_list("path").alias("expected"))
    found = f.where(FOUND_IF[variant]).select(F.expr(CASE_OF).alias("case_id"), F.upper("path").alias("item"))
    stated = FOUND if variant == "base" else FOUND_B
    return reports.evaluate(cases.unionByName(spark.createDataFrame(CASES, "case_id long, expected array<string>")), found.unionByName(spark.createDataFrame(stated, "case_id long, item string")))


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluate(spark, sf_dir, "base")


def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.compare({v: _evaluate(spark, sf_dir, v) for v in FOUND_IF}, 0.4)
    return c.withColumns({x: F.round(x, 6) for x in ("avg_precision", "avg_recall")})


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's documents as a case: how many of those of good quality a length threshold retrieves."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("hit", F.coalesce(F.length("text"), F.lit(0)) > 1000)
    return j.groupBy("lang").agg(F.count_if(F.col("hit") & (F.col("quality") == 1)).alias("hits"), F.count_if(F.col("hit")).alias("retrieved"), F.count_if(F.col("quality") == 1).alias("relevant"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source as its definitions, in order, up to 6000 characters."""
    f = files(spark, sf_dir).select(F.split("path", "/")[0].alias("query_id"), F.col("doc_id").alias("rank"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("entity_name"), F.col("path").alias("file_path"), F.col("text").alias("definition"))
    c = reports.context(f, 6000)
    return c.select("query_id", F.length("context").alias("chars"), F.md5("context").alias("md5"))


LINES = ['{"question": "FHitInfo members", "top_k": 3}', "", '{"question": "how do wheels work", "scope": "all", "filter": "file:header"}', "not json", '{"question": "AThing", "filter": "type:wrong"}', "[1, 2]", '{"top_k": 2}', '{"question": "x"']


#: A line for each turn of all conversations: questions, some with a filter, and what is no question.
TURN_LINES = [
    "1000000 + conv_id * 1000 + turn",
    """CASE conv_id % 5 WHEN 0 THEN concat('{"question": "struct F', conv_id, '", "top_k": ', turn + 1, '}') WHEN 1 THEN concat('{"question": "w', turn, '", "filter": "type:', CASE turn % 2 WHEN 0 THEN 'struct' ELSE 'wrong' END, '"}')
WHEN 2 THEN concat('not json ', conv_id) WHEN 3 THEN concat('[', turn, ']') ELSE '  ' END""",
]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fed(spark, sf_dir, "conversations", "query_id long, value string", list(enumerate(LINES)), TURN_LINES)


def batch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return sources.parse_batch(lines).select("query_id", "question", "top_k", "scope", "filter", "status")


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    out = hybrid.run_batch(sources.parse_batch(lines), hybrid.Index.build(code(spark, sf_dir), most_chars=None).kept())
    return out.groupBy("status").agg(F.count("*").alias("n"))


def event_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "map<string, string>"))
    return e.groupBy("event_type", F.date_trunc("day", F.col("ts")).cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum(F.floor("value")).alias("whole_value"), F.sum(F.size("p")).alias("props"))


CHECKS = [("a", 1, True, 1.0, None, None), ("a", 2, True, 0.5, None, "Missing some directories: Plugins"), ("a", 3, False, 0.0, "no version", None), ("a", 4, True, 1.0, None, None),
          ("b", 1, False, 0.0, "Invalid engine path", None), ("b", 2, True, 1.0, None, None), ("c", 1, True, 1.0, None, None), ("c", 2, True, 1.0, None, None), ("c", 3, True, 1.0, None, None), ("c", 4, True, 1.0, None, None)]


#: Six documents in a row are an installation, each a check.
DOC_CHECKS = ["concat('i', CAST((doc_id - doc_id % 6) / 6 AS BIGINT))", "doc_id % 6 + 1", "doc_id % 4 <> 0", "(doc_id % 5) / 4.0", "CASE WHEN doc_id % 4 = 0 THEN concat('issue ', doc_id) END", "CASE WHEN n_chars % 7 = 0 THEN concat('warning ', doc_id) END"]


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = reports.health(fed(spark, sf_dir, "documents", "install string, check_no int, passed boolean, score double, issue string, warning string", CHECKS, DOC_CHECKS))
    return h.select("install", "valid", F.round("health_score", 6).alias("health_score"), F.array_join("issues", ";").alias("issues"), F.array_join("warnings", ";").alias("warnings"), F.col("checks_passed").cast("int"), F.col("checks_total").cast("int"))


INSTALLS = [("/ue/5.3", "registry", 2), ("/ue/5.3", "env", 3), ("/ue/5.3", "scan", 1), ("/ue/5.4", "scan", 1), ("/ue/4", "b", 1), ("/ue/4", "a", 1)]


DOC_INSTALLS = ["concat('/doc/', CAST((doc_id - doc_id % 3) / 3 AS BIGINT))", "lang", "n_chars % 4"]


def install_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_installs(fed(spark, sf_dir, "documents", "engine_root string, source string, priority int", INSTALLS, DOC_INSTALLS))


LISTING = [("/x", p) for p in ("Source", "Config", "Content", "Binaries")] + [("/y", "Engine"), ("/y", "Engine/Source"), ("/y", "GenerateProjectFiles.bat"), ("/z", "GenerateProjectFiles.bat"), ("/z", "Engine/Source"), ("/no", "Source")]


#: Each document is a root; the digits of its number say what lies in it.
MARKS = [x for _, xs, _ in reports.LAYOUTS for x in xs]
DOC_LISTING = ", ".join(f"CASE WHEN (doc_id + 300) % {2 ** (j + 1)} >= {2**j} THEN '{m}' END" for j, m in enumerate(dict.fromkeys(MARKS)))


def layout_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stated roots and of all documents."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("/d"), F.col("doc_id").cast("string")).alias("root"), F.explode(F.array_compact(F.expr(f"array({DOC_LISTING})"))).alias("path"))
    return reports.layouts(spark.createDataFrame(LISTING, "root string, path string").unionByName(d))


RUNS = [("mini", 1.3, 384), ("coder", 2.6, 768), ("base", 1.3, 768)]


EVENT_RUNS = ["concat('m', user_id % 1000, event_type)", "value + 0.5", "user_id"]


def fastest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fastest(fed(spark, sf_dir, "events", "model string, encode_s double, dim int", RUNS, EVENT_RUNS))


PROGRESS = ["Discovering source files", "Found 12 files", "Processing files (3/12)...", "Chunking", "Embedding batch 5/10", "batch at 37.5%", "Embedding", "Saving", "Done", "other"]


DOC_LINES = [
    """CASE doc_id % 6 WHEN 0 THEN concat('Processing files (', doc_id % 97, '/', 97 + n_chars % 5, ')...') WHEN 1 THEN concat('Embedding batch ', n_chars % 50, '/', n_chars % 51) WHEN 2 THEN concat('batch at ', n_chars % 100, '.5%')
WHEN 3 THEN concat('Found ', doc_id, ' files') WHEN 4 THEN concat('Chunking ', doc_id) ELSE concat('other ', doc_id) END"""
]


def index_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fed(spark, sf_dir, "documents", "line string", [(x,) for x in PROGRESS], DOC_LINES).withColumn("p", reports.progress(F.col("line"))).select("line", "p.percent", "p.message")


LISTED = [("/e/Source/Runtime/Phys/Phys.Build.cs",), ("/e/Source/Runtime/Phys/Inner/Inner.Build.cs",), ("/e/Source/Top.Build.cs",), ("/e/Source/Runtime/Phys/Inner/Public/A.h",), ("/e/Source/Runtime/Phys/Private/B.cpp",), ("/e/Source/Runtime/Other/C.h",), ("/x/D.h",), ("/e/Source/E.h",)]


DOC_SOURCES = ["CASE WHEN doc_id % 9 = 0 THEN concat('/e/Source/Runtime/M', doc_id % 20, '/N', doc_id % 20, '.Build.cs') ELSE concat('/e/Source/Runtime/M', doc_id % 23, '/Private/', doc_id, '.cpp') END"]


def module_build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = fed(spark, sf_dir, "documents", "path string", LISTED, DOC_SOURCES)
    return enrich.modules(listing.where("path NOT LIKE '%.Build.cs'"), listing)


def stored_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last chunk of every document, by its number, from the stored chunks."""
    chunks = chunking.window_chunks(files(spark, sf_dir))
    hits = chunks.groupBy("path").agg(F.max("chunk_index").alias("chunk_index"))
    return chunking.chunk_text_of(hits, chunks).select("path", "chunk_index", F.md5("chunk_text").alias("md5"))


def index_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    e = table(spark, sf_dir, "events").select(F.col("ts").alias("modified"))
    a = incremental.is_stale(e, datetime(2020, 1, 1)).withColumn("built", F.lit("before"))
    b = incremental.is_stale(e, datetime(2100, 1, 1)).withColumn("built", F.lit("after"))
    return a.unionByName(b).select("built", "stale", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"))


def re_enriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored chunks of all files, two of a file that is gone."""
    stored = chunking.chunk_files(code(spark, sf_dir), structure=False, most_chars=None).select("path", "chunk_index").union(spark.createDataFrame([("/gone.h", 0), ("/gone.h", 1)], "path string, chunk_index int"))
    r = enrich.re_enrich(stored, code(spark, sf_dir))
    return r.select("path", "chunk_index", F.array_join("entities", ",").alias("entities"), "has_uclass", "is_header")


def first_kind_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = definitions.definitions(code(spark, sf_dir))
    return definitions.first_kind(d, F.lit("FHitInfo")).select("file_path", "entity_type", "line_start")


#: Where ignore files stand in the tree of documents, by the path of their folder, and what they say.
IGNORES = [("", "# tops\nIntermediate/\n*7.json\n"), ("%1", "de\n[0-3]*.cpp\n"), ("%2/en", "1*\n*5.h\n\n")]


def ignored_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files of a tree with nested ignore files, and what a walk of it finds."""
    f = files(spark, sf_dir).select("path", "text")
    folders = f.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("folder")).distinct()
    rules = [folders.where(F.col("folder").like(at) & (F.size(F.split("folder", "/")) == len(at.split("/")))).select(F.ltrim(F.concat("folder", F.lit("/" + tree.IGNORE_FILE)), F.lit("/")).alias("path"), F.lit(text).alias("text")) for at, text in IGNORES]
    with scratch(spark, "tree") as top:
        for part in (f, *rules):
            tree.write_tree(part, top)
        found = tree.walk(spark, {"docs": [top]}, (*EXTENSIONS, *DOC_EXTENSIONS))
        inner = F.substring_index(F.substring("path", F.length(F.regexp_replace(F.lit(top), "^file:/*", "/")) + 2, F.lit(10**6)), "/", -3)
        return settled(found.select(inner.alias("path"), "origin", "ext", "category", "bytes", F.col("n_chars").cast("long"), "sha256"))


def _window_chunks(files: DataFrame) -> DataFrame:
    return chunking.window_chunks(files, 1500).select("path", "origin", "chunk_index", "chunk_text")


def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents committed to a store, a tenth of them edited and a seventh gone in a second commit; both snapshots, read back by scope."""
    old, new = _old_and_new(spark, sf_dir)
    with scratch(spark, "store") as top:
        store = Store(spark, top)
        for f in (old, new):
            store.commit(f.drop("doc_id"), _window_chunks)
        rows = [store.read(scope, snapshot).select(F.lit(scope).alias("scope"), F.lit(snapshot).alias("snapshot"), "path", "chunk_index", "version", F.md5("chunk_text").alias("md5")) for scope in ("engine", "project") for snapshot in (1, 2)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        out = settled(out)
        store.forget()
        return out


#: A file of questions is one row of a stream until its lines are numbered, and one task's; so many lines are a few MB.
FILE_LINES = 5_000


def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say in all conversations, written as JSON lines, every ninth broken and some with a filter, and answered as a stream from the snippets."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = F.to_json(F.struct("conv_id", "turn", F.col("text").alias("question"), F.lit(2).alias("top_k"), F.lit("all").alias("scope"), F.when(F.col("turn") == 2, F.when(F.col("conv_id") % 2 == 0, "file:header").otherwise("type:wrong")).alias("filter"), (F.col("conv_id") % 3 == 0).alias("show_reasoning")))
    line = F.when((F.col("conv_id") + F.col("turn")) % 9 == 4, F.concat(asked, F.lit("]"))).otherwise(asked)
    with scratch(spark, "questions") as top:
        c.select(line.alias("value")).write.option("maxRecordsPerFile", FILE_LINES).text(f"{top}/in")
        index = hybrid.Index.build(code(spark), most_chars=None)
        batch_stream.answer_stream(batch_stream.stream_lines(spark, f"{top}/in"), index, f"{top}/out", f"{top}/checkpoint", once=True).awaitTermination()
        out = batch_stream.answered(spark, f"{top}/out")
        get = lambda k: F.regexp_extract("value", rf'"{k}":(-?\d+)', 1).cast("long").alias(k)
        return settled(out.select(get("conv_id"), get("turn"), "status", F.col("results.intent.type").alias("type"), F.col("results.intent.reasoning").alias("reasoning")))


QUERIES = {f.__name__: f for f in (ignored_tree, store_snapshots, conversation_stream, module_build_files, stored_chunk_text, index_staleness, re_enriched_chunks, first_kind_definition, incremental_anti_join, incremental_rebuild, safety_brake, embed_reuse, precision_recall, ab_compare, label_quality, context_budget, batch_parse, batch_status, event_log_counts, health_score, install_dedup, layout_profiles, fastest_model, index_progress)}

_NEW = FILES + ", new AS (SELECT doc_id, path, origin, CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END AS text FROM files WHERE doc_id % 7 <> 3 UNION ALL " + " UNION ALL ".join(f"SELECT {i}, '{p}', 'engine', 'new text'" for i, p in MORE) + ")"


def _eval_sql(variant: str, name: str) -> str:
    cases, stated = values(f"c{name}", "case_id, expected", [(i, x) for i, x in CASES if x]), FOUND if variant == "base" else FOUND_B
    return f"""{cases}, {values(f"g{name}", "case_id, item", stated)}, d{name} AS (SELECT {CASE_OF} AS case_id, f.doc_id, path, n_chars FROM files f JOIN documents USING (doc_id)),
f{name} AS (SELECT case_id, lower(item) AS item FROM g{name} UNION SELECT case_id, lower(path) FROM d{name} WHERE {FOUND_IF[variant]}),
w{name} AS (SELECT case_id, unnest(list_distinct(expected)) AS x FROM c{name} UNION SELECT case_id, path FROM d{name} WHERE doc_id % 2 = 0), h{name} AS (SELECT case_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM f{name} f WHERE f.case_id = w.case_id AND contains(item, lower(x)))) AS found FROM w{name} w GROUP BY case_id),
e{name} AS (SELECT case_id::BIGINT AS case_id, found / 5 AS precision, found / n AS recall FROM h{name} UNION ALL SELECT {next(i for i, x in CASES if not x)}::BIGINT, 0.0, 0.0)"""


_BATCH_SQL = f"""{fed_sql("v", "conversations", "query_id, value", list(enumerate(LINES)), TURN_LINES)},
j AS (SELECT query_id, value, json_valid(value) AND coalesce(json_type(CASE WHEN json_valid(value) THEN value ELSE 'null' END), '') = 'OBJECT' AS good FROM v WHERE trim(value) <> ''),
b AS (SELECT query_id::BIGINT AS query_id, good, CASE WHEN good THEN coalesce(value->>'question', '') END AS question, CASE WHEN good THEN coalesce((value->>'top_k')::INT, 5) END AS top_k,
             CASE WHEN good THEN coalesce(value->>'scope', 'engine') END AS scope, CASE WHEN good THEN value->>'filter' END AS filter FROM j)"""

#: CRC-32 of a word's bytes, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(hex), 2), lambda i: ('0x' || hex[i + 1:i + 2])::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

SQL = {
    "embed_reuse": rf"""WITH {FILES}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS word FROM files), n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
p AS (SELECT word, lower(unnest([word] || regexp_extract_all(word, '[A-Z]?[a-z0-9]+'))) AS part FROM (SELECT DISTINCT word FROM n)), h AS (SELECT part, hex(encode(part)) AS hex FROM (SELECT DISTINCT part FROM p)), c AS (SELECT part, {_CRC} AS crc FROM h),
s AS (SELECT doc_id, crc % 64 AS i, sum(n * CASE WHEN crc >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM n JOIN p USING (word) JOIN c USING (part) GROUP BY ALL), z AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY doc_id),
a AS (SELECT f.doc_id, r.i, CASE WHEN norm > 0 THEN (coalesce(x, 0) / norm)::FLOAT ELSE 0::FLOAT END AS v FROM files f CROSS JOIN range(64) AS r(i) LEFT JOIN z ON z.doc_id = f.doc_id LEFT JOIN s ON s.doc_id = f.doc_id AND s.i = r.i)
SELECT doc_id, 64 AS dim, md5(string_agg(round(v * 1000::FLOAT)::INT::VARCHAR, ',' ORDER BY i)) AS digest FROM a GROUP BY doc_id""",
    "conversation_stream": f"""WITH i AS ({_INTENT}), c AS (SELECT *, conv_id * 1000 + turn + 1000000 AS query_id, (conv_id + turn) % 9 = 4 AS broken, turn = 2 AND conv_id % 2 = 1 AS wrong FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN broken OR wrong THEN 'error' ELSE 'success' END AS status, CASE WHEN NOT (broken OR wrong) THEN i.type END AS type, CASE WHEN NOT (broken OR wrong) AND conv_id % 3 = 0 THEN i.reasoning END AS reasoning FROM c JOIN i USING (query_id)""",
    "store_snapshots": f"""WITH {_NEW}, s AS (SELECT 1 AS snapshot, path, origin, text, 1 AS version FROM files
UNION ALL SELECT 2, n.path, n.origin, n.text, CASE WHEN f.text IS NOT DISTINCT FROM n.text THEN 1 ELSE 2 END FROM new n LEFT JOIN files f ON n.path = f.path),
w AS (SELECT *, unnest(CASE WHEN length(text) <= 1500 THEN [0] ELSE list_filter(range(0, length(text), 1300), lambda s: s = 0 OR length(text) - s >= 300) END) AS spot FROM s)
SELECT origin AS scope, snapshot, path, (spot // 1300)::INT AS chunk_index, version, md5(substr(text, spot + 1, 1500)) AS md5 FROM w""",
    "ignored_tree": rf"""WITH {FILES}, p AS (SELECT path, replace(text, chr(13) || chr(10), chr(10)) AS text, strlen(text) AS bytes, string_split(path, '/') AS s FROM files),
k AS (SELECT * FROM p WHERE NOT (s[3] GLOB '*7.json') AND NOT (s[1] LIKE '%1' AND (s[2] = 'de' OR s[3] GLOB '[0-3]*.cpp')) AND NOT (s[1] LIKE '%2' AND s[2] = 'en' AND (s[3] GLOB '1*' OR s[3] GLOB '*5.h')))
SELECT path, 'docs' AS origin, '.' || string_split(path, '.')[-1] AS ext, CASE string_split(path, '.')[-1] WHEN 'md' THEN 'doc' WHEN 'json' THEN 'data' ELSE 'code' END AS category, bytes::BIGINT AS bytes, length(text)::BIGINT AS n_chars, sha256(text) AS sha256 FROM k""",
    "module_build_files": f"""WITH {fed_sql("l", "documents", "path", LISTED, DOC_SOURCES)}, b AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)\\.Build\\.cs$', 1) AS name FROM l WHERE path LIKE '%.Build.cs'),
f AS (SELECT path, string_split(path, '/') AS parts FROM l WHERE path NOT LIKE '%.Build.cs'), m AS (SELECT f.path, arg_max(name, length(folder)) AS name FROM f JOIN b ON starts_with(f.path, folder || '/') AND regexp_matches(folder, '/Source/') AND len(parts) - list_position(list_reverse(parts), 'Source') + 3 <= len(parts) GROUP BY f.path)
SELECT path, coalesce(name, CASE WHEN list_contains(parts, 'Source') AND len(parts) - list_position(list_reverse(parts), 'Source') + 3 <= len(parts) THEN parts[len(parts) - list_position(list_reverse(parts), 'Source') + 3] ELSE 'Unknown' END) AS module FROM f LEFT JOIN m USING (path)""",
    "stored_chunk_text": f"WITH {FILES}, w AS (SELECT path, text, CASE WHEN length(text) <= 2000 THEN [0] ELSE list_filter(range(0, length(text), 1800), lambda s: s = 0 OR length(text) - s >= 300) END AS starts FROM files) SELECT path, (len(starts) - 1)::INT AS chunk_index, md5(substr(text, starts[-1] + 1, 2000)) AS md5 FROM w",
    "index_progress": rf"""WITH {fed_sql("l", "documents", "line", [(x,) for x in PROGRESS], DOC_LINES)}, n AS (SELECT *, nullif(regexp_extract(line, '(\d+)/(\d+)', 1), '')::INT AS done, nullif(regexp_extract(line, '(\d+)/(\d+)', 2), '')::INT AS total,
  nullif(regexp_extract(line, '(\d+(?:\.\d+)?)%', 1), '')::DOUBLE AS share, regexp_matches(line, 'Chunking|Processing') AS files, regexp_matches(line, 'Embedding|(?i:batch)') AS batch FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(line, 'Discovering|Finding') THEN 1 WHEN contains(line, 'Found') AND contains(line, 'files') THEN 2 WHEN files AND done IS NOT NULL THEN 3 WHEN files THEN 4 WHEN batch AND done IS NOT NULL THEN 5
  WHEN batch AND share IS NOT NULL THEN 6 WHEN batch THEN 7 WHEN regexp_matches(line, 'Saving|Writing') THEN 8 WHEN regexp_matches(line, 'Complete|SUCCESS|Done') THEN 9 END AS step FROM n)
SELECT line, CASE step WHEN 3 THEN trunc(CASE WHEN total > 0 THEN 10 + done / total * 20 ELSE 15 END) WHEN 5 THEN trunc(CASE WHEN total > 0 THEN 30 + done / total * 60 ELSE 60 END) WHEN 6 THEN trunc(30 + share * 0.6) ELSE [5, 10, 0, 20, 0, 0, 60, 95, 100][step] END::INT AS percent,
  CASE step WHEN 1 THEN 'Discovering source files...' WHEN 2 THEN 'Discovered: ' || trim(line) WHEN 3 THEN printf('Processing files (%d/%d)...', done, total) WHEN 4 THEN 'Processing files...' WHEN 5 THEN printf('Generating embeddings (%d/%d)...', done, total)
  WHEN 6 THEN printf('Generating embeddings (%.1f%%)...', share) WHEN 7 THEN 'Generating embeddings...' WHEN 8 THEN 'Saving vector store...' WHEN 9 THEN 'Complete!' END AS message FROM k""",
    "index_staleness": "SELECT built, (SELECT max(ts) FROM events) > made AS stale, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS newest FROM (VALUES ('before', TIMESTAMP '2020-01-01'), ('after', TIMESTAMP '2100-01-01')) AS t(built, made)",
    "re_enriched_chunks": f"""WITH {CODE_SQL}, w AS (SELECT path, text, unnest(CASE WHEN length(text) <= 1500 THEN [0] ELSE list_filter(range(0, length(text), 1300), lambda s: s = 0 OR length(text) - s >= 300) END) AS spot FROM code),
e AS (SELECT path, (spot // 1300)::INT AS chunk_index, substr(text, spot + 1, 1500) AS t FROM w) SELECT path, chunk_index, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\bstruct\\s+(?:\\w+_API\\s+)?([A-Z_]\\w+)', 1) || regexp_extract_all(t, '\\bclass\\s+(?:\\w+_API\\s+)?([UAI][A-Z]\\w+)', 1) || regexp_extract_all(t, '\\benum\\s+(?:class\\s+)?([A-Z_]\\w+)', 1))), ',') AS entities,
regexp_matches(t, '\\bUCLASS\\s*\\(') AS has_uclass, regexp_matches(path, '\\.h$') AS is_header FROM e UNION ALL SELECT '/gone.h', i, '', false, false FROM (VALUES (0), (1)) AS g(i)""",
    "first_kind_definition": rf"""WITH {CODE_SQL}, k(no, kind, p) AS (VALUES (1, 'struct', '(USTRUCT\s*\([^)]*\)\s*)?struct\s+(\w+_API\s+)?FHitInfo\s*(:[^{{;]*)?\{{'), (2, 'class', '(UCLASS\s*\([^)]*\)\s*)?class\s+(\w+_API\s+)?FHitInfo\s*(:[^{{;]*)?\{{'), (3, 'enum', '(UENUM\s*\([^)]*\)\s*)?enum\s+(class\s+)?FHitInfo\s*(:[^{{;]*)?\{{')),
f AS (SELECT path, no, kind, position(regexp_extract(text, p) IN text) AS spot, text FROM code, k WHERE regexp_matches(text, p))
SELECT path AS file_path, kind AS entity_type, (length(text[1:spot - 1]) - length(replace(text[1:spot - 1], chr(10), '')) + 1)::INT AS line_start FROM f WHERE no = (SELECT min(no) FROM f)""",
    "incremental_anti_join": f"WITH {_NEW} SELECT coalesce(n.path, f.path) AS path, sha256(coalesce(n.text, f.text)) AS sha256, CASE WHEN f.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.text = f.text THEN 'unchanged' ELSE 'edited' END AS state FROM new n FULL JOIN files f ON n.path = f.path",
    "incremental_rebuild": f"WITH {_NEW} SELECT n.path, n.origin, sha256(n.text) AS sha256, length(n.text)::INT AS chars, CASE WHEN f.text IS NOT DISTINCT FROM n.text THEN 'old' ELSE 'new' END AS run FROM new n LEFT JOIN files f ON n.path = f.path",
    "safety_brake": f"WITH {_NEW}, o AS (SELECT count(*) AS n FROM files WHERE origin = 'engine') SELECT o.n AS old_engine_chunks, (SELECT count(*) FROM new WHERE origin = 'engine') AS new_engine_files, false AS abort, 'whole' AS run FROM o UNION ALL SELECT o.n, 0, o.n > 100, 'lost' FROM o",
    "precision_recall": f"WITH {FILES}, {_eval_sql("base", "0")} SELECT case_id, precision, recall FROM e0",
    "ab_compare": f"WITH {FILES}, {_eval_sql("base", "1")}, {_eval_sql("other", "2")}, u AS (SELECT 'base' AS variant, * FROM e1 UNION ALL SELECT 'other', * FROM e2) SELECT variant, round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, avg(recall) >= 0.4 AS passed FROM u GROUP BY variant",
    "label_quality": "SELECT lang, count(*) FILTER (length(coalesce(text, '')) > 1000 AND quality = 1) AS hits, count(*) FILTER (length(coalesce(text, '')) > 1000) AS retrieved, count(*) FILTER (quality = 1) AS relevant FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "context_budget": f"""WITH {FILES}, d AS (SELECT string_split(path, '/')[1] AS query_id, doc_id, '    <definition name="D' || doc_id || '" file="' || path || '">' || chr(10) || text || chr(10) || '    </definition>' AS entry FROM files WHERE text <> ''),
s AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY doc_id) AS upto FROM d), c AS (SELECT query_id, '<context>' || chr(10) || string_agg(entry, chr(10) ORDER BY doc_id) || chr(10) || '</context>' AS context FROM s WHERE upto <= 6000 GROUP BY query_id)
SELECT query_id, length(context)::INT AS chars, md5(context) AS md5 FROM c""",
    "batch_parse": f"WITH {_BATCH_SQL} SELECT query_id, question, top_k, scope, filter, CASE WHEN good THEN 'success' ELSE 'error' END AS status FROM b",
    "batch_status": f"""WITH {_BATCH_SQL}, p AS (SELECT query_id, good, unnest(list_filter(string_split(coalesce(filter, ''), ' AND '), lambda x: trim(x) <> '')) AS part FROM b),
w AS (SELECT DISTINCT query_id FROM p WHERE NOT regexp_matches(trim(part), '^(type:(struct|class|enum|function|delegate)|macro:(UPROPERTY|UCLASS|UFUNCTION|USTRUCT)|origin:(engine|project)|file:(header|implementation)|entity:\\w+|boost:(macros|entity|entities))$'))
SELECT CASE WHEN good AND w.query_id IS NULL THEN 'success' ELSE 'error' END AS status, count(*) AS n FROM b LEFT JOIN w USING (query_id) GROUP BY 1""",
    "event_log_counts": "SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS users, sum(floor(value))::BIGINT AS whole_value, sum(len(json_keys(props)))::BIGINT AS props FROM events GROUP BY 1, 2",
    "health_score": f"""WITH {fed_sql("c", "documents", "install, check_no, passed, score, issue, warning", CHECKS, DOC_CHECKS)}, k AS (SELECT *, bool_or(check_no = 1 AND NOT passed) OVER (PARTITION BY install) AS gone FROM c), s AS (SELECT * FROM k WHERE NOT gone OR check_no = 1)
SELECT install, bool_and(passed) AS valid, round(CASE WHEN bool_or(gone) THEN 0 ELSE avg(score) END::DOUBLE, 6) AS health_score, coalesce(string_agg(issue, ';' ORDER BY check_no), '') AS issues, coalesce(string_agg(warning, ';' ORDER BY check_no), '') AS warnings, (count(*) FILTER (passed))::INT AS checks_passed, CASE WHEN bool_or(gone) THEN 4 ELSE count(*) END::INT AS checks_total FROM s GROUP BY install""",
    "install_dedup": f"WITH {fed_sql('i', 'documents', 'engine_root, source, priority', INSTALLS, DOC_INSTALLS)} SELECT engine_root, source, priority::INT AS priority FROM i QUALIFY row_number() OVER (PARTITION BY engine_root ORDER BY priority DESC, source) = 1",
    "layout_profiles": f"""WITH {values("t0", "root, path", LISTING)}, t AS (SELECT * FROM t0 UNION ALL SELECT root, path FROM (SELECT '/d' || doc_id AS root, unnest([{DOC_LISTING}]) AS path FROM documents) WHERE path IS NOT NULL), {values("m", "no, layout, path, n, sub", [(i, name, x, len(xs), sub) for i, (name, xs, sub) in enumerate(reports.LAYOUTS) for x in xs])},
f AS (SELECT root, no, layout, sub FROM (SELECT DISTINCT root, path FROM t) JOIN m USING (path) GROUP BY root, no, layout, sub, n HAVING count(*) = n)
SELECT root, layout, CASE WHEN sub = '' THEN root ELSE root || '/' || sub END AS engine_root FROM f QUALIFY row_number() OVER (PARTITION BY root ORDER BY no) = 1""",
    "fastest_model": f"WITH {fed_sql('r', 'events', 'model, encode_s, dim', RUNS, EVENT_RUNS)} SELECT model, encode_s::DOUBLE AS encode_s FROM r ORDER BY encode_s, model LIMIT 1",
}
