"""Statistics of an index, of a log, of installations; evaluation of retrieval; context for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from .enrich import MACROS


def share(condition: Column) -> Column:
    return F.when(F.count("*") > 0, F.count_if(condition) / F.count("*")).otherwise(F.lit(0.0))


def build_stats(chunks: DataFrame, reused: Column | None = None) -> DataFrame:
    """A row for each origin and one for all (origin "all"): files, chunks, new_chunks, chars."""
    new = F.count_if(~reused) if reused is not None else F.count("*")
    r = chunks.rollup(F.coalesce("origin", F.lit("engine")).alias("origin")).agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"), new.alias("new_chunks"), F.sum("chars").alias("chars"))
    return r.withColumn("origin", F.coalesce("origin", F.lit("all")))


def enrichment_stats(chunks: DataFrame, least: float = 0.1) -> DataFrame:
    """One row: entities in all, chunks with some, and with each macro; coverage (chunks with an entity or a macro), and
    whether it exceeds ``least``."""
    flags = [F.coalesce(F.col(f"has_{m}"), F.lit(False)) for m in MACROS]
    some = F.size("entities") > 0
    covered = some
    for f in flags:
        covered = covered | f
    out = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).cast("long").alias("total_entities"), F.count_if(some).alias("with_entities"), *(F.count_if(f).alias(f"with_{m}") for f, m in zip(flags, MACROS, strict=True)), share(covered).alias("coverage"))
    return out.withColumn("enriched", F.col("coverage") > least)


def entity_frequency(chunks: DataFrame, k: int = 10) -> DataFrame:
    """The k entities in most chunks; ties by name."""
    return chunks.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(k)


def extension_stats(files: DataFrame, suffix: Column) -> DataFrame:
    """Files and bytes for each extension, and a total row with a null extension."""
    return files.rollup(suffix.alias("ext")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def evaluate(cases: DataFrame, retrieved: DataFrame, k: int = 5) -> DataFrame:
    """Precision at k and recall of each case: ``cases(case_id, expected array)``, ``retrieved(case_id, item)``. An expected item
    is found if a retrieved one holds it, case aside. Items meet only those of their own case."""
    want = cases.select("case_id", F.explode(F.array_distinct("expected")).alias("expected"))
    got = retrieved.select("case_id", F.lower("item").alias("item")).distinct()
    found = want.join(got, "case_id").where(F.contains("item", F.lower("expected"))).select("case_id", "expected").distinct().groupBy("case_id").agg(F.count("*").alias("found"))
    out = cases.select("case_id", F.size(F.array_distinct("expected")).alias("n")).join(found, "case_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.select("case_id", (F.col("found") / k).alias("precision"), F.when(F.col("n") > 0, F.col("found") / F.col("n")).otherwise(F.lit(0.0)).alias("recall"))


def compare(variants: dict[str, DataFrame], target: float = 0.7) -> DataFrame:
    """Mean precision and recall of each variant's evaluation, and whether its recall meets the target."""
    rows = None
    for name, e in variants.items():
        one = e.select(F.lit(name).alias("variant"), "precision", "recall")
        rows = one if rows is None else rows.unionByName(one)
    means = rows.groupBy("variant").agg(F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"))
    return means.withColumn("passed", F.col("avg_recall") >= target)


def fastest(runs: DataFrame) -> DataFrame:
    """``runs(model, encode_s, ...)``: the model with the least encoding time; ties by name."""
    return runs.agg(F.min_by("model", F.struct("encode_s", "model")).alias("model"), F.min("encode_s").alias("encode_s"))


def health(checks: DataFrame) -> DataFrame:
    """``checks(install, check_no, passed, score, issue, warning)`` -> install, valid, health_score, issues, warnings, checks_passed,
    checks_total; an install whose first check (its path) fails has only that one."""
    first = checks.withColumn("gone", F.max(F.when(F.col("check_no") == 1, ~F.col("passed"))).over(Window.partitionBy("install")))
    kept = first.where((F.col("check_no") == 1) | ~F.coalesce("gone", F.lit(False)))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("check_no", F.col(c).alias("t"))))), lambda x: x["t"])
    out = kept.groupBy("install").agg(F.bool_and("passed").alias("valid"), F.max("gone").alias("gone"), F.avg("score").alias("health_score"), texts("issue").alias("issues"), texts("warning").alias("warnings"), F.count_if(F.col("passed")).alias("checks_passed"), F.count("*").alias("checks_total"))
    return out.withColumn("health_score", F.when(F.col("gone"), 0.0).otherwise(F.col("health_score"))).withColumn("checks_total", F.when(F.col("gone"), 4).otherwise(F.col("checks_total"))).drop("gone")


def best_installs(installs: DataFrame) -> DataFrame:
    """One of each engine_root: that of the source with the highest priority, then the first by name."""
    w = Window.partitionBy("engine_root").orderBy(F.desc("priority"), "source")
    return installs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def is_fresh(scanned: Column, now: Column, hours: int = 24) -> Column:
    return scanned > now - F.expr(f"INTERVAL {hours} HOURS")


# Layouts of an installation (name, what lies in it, folder below it that counts).
LAYOUTS = [("Launcher_Standard_Internal", ["Source", "Config", "Content", "Binaries"], ""), ("Launcher_Standard_Base", ["Engine", "Engine/Source"], "Engine"), ("Source_Build_GitHub", ["GenerateProjectFiles.bat", "Engine/Source"], "Engine")]


def layouts(listing: DataFrame) -> DataFrame:
    """The first layout whose marks all lie in each root, and the root that counts: ``listing(root, path below it)``."""
    marks = [(i, name, m, len(ms), sub) for i, (name, ms, sub) in enumerate(LAYOUTS) for m in ms]
    table = listing.sparkSession.createDataFrame(marks, "no int, layout string, path string, n int, sub string")
    full = listing.select("root", "path").distinct().join(F.broadcast(table), "path").groupBy("root", "no", "layout", "n", "sub").count().where("count = n")
    first = full.groupBy("root").agg(F.min(F.struct("no", "layout", "sub")).alias("x"))
    return first.select("root", "x.layout", F.when(F.col("x.sub") == "", F.col("root")).otherwise(F.concat_ws("/", "root", "x.sub")).alias("engine_root"))


# How definitions become context for a model.
ENTRY = '    <definition name="%s" file="%s">\n%s\n    </definition>'
CONTEXT = "<context>\n%s\n</context>"
SYSTEM = "%s\n\nYou have access to the following relevant UE5 source code context:\n\n%s\n\nUse this context to answer the user's question accurately. \nCite specific member variables or functions from the provided code when applicable.\nIf the context doesn't contain the answer, rely on your general knowledge but mention that the specific code wasn't found."
PROMPT_HEAD = "You are a domain assistant. Use ONLY the provided context to answer.\nIf uncertain, say you are not sure.\n\n"


def context(definitions: DataFrame, most_chars: int) -> DataFrame:
    """(query_id, context) of ``definitions(query_id, rank, entity_name, file_path, definition)``: entries in order up to the first
    that passes ``most_chars`` in all. No row for a question without an entry. Empty definitions are passed over."""
    d = definitions.where(F.coalesce(F.length("definition"), F.lit(0)) > 0)
    d = d.withColumn("entry", F.format_string(ENTRY, F.coalesce("entity_name", F.lit("Unknown")), F.coalesce("file_path", F.lit("Unknown")), "definition"))
    # No entry is shorter than its frame, so only the first of these can fit, and a task passes on no more of a question.
    first = Window.partitionBy("query_id").orderBy("rank")
    d = d.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= max(1, most_chars // len(ENTRY.replace("%s", "")) + 1))
    upto = first.rowsBetween(Window.unboundedPreceding, 0)
    # Lengths only grow, so all entries up to the first that doesn't fit are those whose running sum fits.
    kept = d.withColumn("__sum", F.sum(F.length("entry")).over(upto)).where(F.col("__sum") <= most_chars)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"])
    return kept.groupBy("query_id").agg(F.format_string(CONTEXT, F.array_join(entries, "\n")).alias("context"))


def system_prompt(base: Column, ctx: Column) -> Column:
    return F.when(F.coalesce(ctx, F.lit("")) == "", base).otherwise(F.format_string(SYSTEM, base, ctx))


def prompt(hits: DataFrame) -> DataFrame:
    """(query_id, prompt) of ``hits(query_id, question, rank, score, path, chunk_index, total_chunks, chunk_text)``."""
    part = F.format_string("[Doc %d score=%s path=%s chunk=%d/%d]\n%s", "rank", fixed(F.col("score"), 3), "path", F.col("chunk_index") + 1, "total_chunks", F.coalesce("chunk_text", F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"])
    return hits.groupBy("query_id", "question").agg(F.concat(F.lit(PROMPT_HEAD), F.array_join(parts, "\n\n"), F.lit("\n\nQuestion:\n"), F.col("question"), F.lit("\n\nAnswer:")).alias("prompt")).select("query_id", "prompt")


def progress(line: Column) -> Column:
    """(percent, message) of a line that an index build prints; null for other lines."""
    done, total = (F.regexp_extract(line, r"(\d+)/(\d+)", k).try_cast("int") for k in (1, 2))
    percent = F.regexp_extract(line, r"(\d+(?:\.\d+)?)%", 1).try_cast("double")
    has = lambda *xs: line.rlike("|".join(xs))
    made = lambda p, m: F.struct(p.cast("int").alias("percent"), m.alias("message"))
    part = lambda base, width, otherwise: F.when(total > 0, base + done / total * width).otherwise(F.lit(otherwise))
    counted = done.isNotNull()
    t = F.trim(line)
    return (
        F.when(has("Discovering", "Finding"), made(F.lit(5), F.lit("Discovering source files...")))
        .when(has("Found") & has("files"), made(F.lit(10), F.concat(F.lit("Discovered: "), t)))
        .when(has("Chunking", "Processing") & counted, made(part(10, 20, 15), F.format_string("Processing files (%d/%d)...", done, total)))
        .when(has("Chunking", "Processing"), made(F.lit(20), F.lit("Processing files...")))
        .when(has("Embedding", "(?i:batch)") & counted, made(part(30, 60, 60), F.format_string("Generating embeddings (%d/%d)...", done, total)))
        .when(has("Embedding", "(?i:batch)") & percent.isNotNull(), made(30 + percent * 0.6, F.format_string("Generating embeddings (%s%%)...", fixed(percent, 1))))
        .when(has("Embedding", "(?i:batch)"), made(F.lit(60), F.lit("Generating embeddings...")))
        .when(has("Saving", "Writing"), made(F.lit(95), F.lit("Saving vector store...")))
        .when(has("Complete", "SUCCESS", "Done"), made(F.lit(100), F.lit("Complete!")))
    )
