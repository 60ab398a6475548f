"""Queries over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming, similarity
from ..operators import chunking, filters, reports, scoring
from ..sources.files import legacy_index
from .fixtures import FILES, files, table, values


def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"))
    return f.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def char_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.window_chunks(files(spark, sf_dir))
    return c.select("doc_id", "chunk_index", "total_chunks", "chars", F.md5("chunk_text").alias("md5"))


def chunk_overlap_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1000 without overlap, each then with the start of the next."""
    c = chunking.overlap_by_window(chunking.window_chunks(files(spark, sf_dir), 1000, 0, 0), 1200, 200)
    return c.select("path", "chunk_index", F.length("chunk_text").alias("chars"), F.md5("chunk_text").alias("md5"))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.build_stats(chunking.window_chunks(files(spark, sf_dir)))


#: The cap of the query, which leaves out some files of every table; that of an index is ``chunking.MAX_CHARS``.
CAP = 6_000


def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.over_cap(files(spark, sf_dir), CAP)


def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunk_files(files(spark, sf_dir), most_chars=None)
    return c.select("doc_id", "chunk_index", "total_chunks", "chars", F.md5("chunk_text").alias("md5"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", F.md5(chunking.snippet(F.col("text"), F.lit(1))).alias("md5"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select(naming.category(F.col("path")).alias("category"), naming.is_header(F.col("path")).alias("is_header"), naming.is_implementation(F.col("path")).alias("is_implementation"))
    return f.groupBy("category", "is_header", "is_implementation").agg(F.count("*").alias("n"))


def extension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("bytes", F.octet_length("text").cast("long"))
    return reports.extension_stats(f, naming.suffix(F.col("path")))


def index_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumns({"bytes": F.octet_length("text").cast("long"), "ext": naming.suffix(F.col("path"))})
    return legacy_index(f, 3).select("path", "bytes", "extension", F.md5("preview").alias("preview_md5"))


def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(filters.has_extension(F.col("path"))).select("doc_id", "path")


def path_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by whole name: src1 isn't src10; names by glob."""
    p = F.col("path")
    kept = ~filters.in_folder(p, ["src1", "src2", "fr", "src3/en"]) & filters.name_allowed(p, ["*.cpp", "1?[0-4]*.h", "*.md"], ["*7.md"])
    return files(spark, sf_dir).where(kept).select("doc_id", "path")


def url_suffix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract(path, r"^/([^/]*)", 1).alias("folder"), naming.suffix(path).alias("ext")).agg(F.count("*").alias("n"))


def reranked_pages(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every benchmark item's text as a question to every page: the k pages that share most of its words. A page's words are taken
    once, pairs carry words and numbers, and texts come back to the k best."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_id"), F.col("url").alias("path"), F.regexp_replace("html", "<[^>]*>", " ").alias("chunk_text"), (1.0 / (F.col("page_id") + 1)).alias("vector_score"))
    asked = b.select("query_id", scoring.keywords(F.col("question")).alias("asked"))
    pairs = scoring.with_questions(pages.select("chunk_id", scoring.text_words(F.col("chunk_text")).alias("there")), asked)
    best = scoring.top_k(pairs.select("query_id", "chunk_id", scoring.shared(F.col("asked"), F.col("there")).alias("score")), k, ["query_id"])
    return best.withColumn("rerank_score", F.col("score")).join(pages, "chunk_id").join(b, "query_id")


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked_pages(spark, sf_dir, 5).select("query_id", "chunk_id", "rank", F.round("rerank_score", 6).alias("rerank_score"), F.round("vector_score", 6).alias("vector_score"))


def answer_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each benchmark item from its three pages."""
    h = reranked_pages(spark, sf_dir, 3).withColumns({"chunk_index": F.lit(0), "total_chunks": F.lit(1)})
    return reports.prompt(h).select("query_id", F.md5("prompt").alias("md5"))


NAMES = ["FHitResult", "HitResult", "fhitresult", "FHitResalt", "Hit", "ab", "", "UHitResultComponent", "AActor", "Actor", "almond antique", "part", "customer#000000001", "xyz"]
NAME_ROWS = [(n,) for n in NAMES]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of names against each other, all parts and all suppliers."""
    there = table(spark, sf_dir, "part").select(F.col("p_name").alias("candidate")).union(table(spark, sf_dir, "supplier").select("s_name"))
    there = there.union(spark.createDataFrame(NAME_ROWS, "candidate string")).distinct()
    return there.crossJoin(F.broadcast(spark.createDataFrame(NAME_ROWS, "query string")))


def levenshtein_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = F.lower("query"), F.lower("candidate")
    return _pairs(spark, sf_dir).select("query", "candidate", F.levenshtein(q, c).alias("distance"), F.round(similarity.levenshtein_similarity(q, c), 6).alias("similarity"))


def jaro_winkler_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("query", "candidate", F.round(similarity.jaro_winkler(F.lower("query"), F.lower("candidate")), 6).alias("similarity"))


def bigram_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("query", "candidate", F.round(similarity.dice(F.lower("query"), F.lower("candidate")), 6).alias("similarity"))


def compound_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("query", "candidate", F.round(similarity.compound(F.col("query"), F.col("candidate")), 6).alias("score"))


def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("query", "candidate", F.round(similarity.match_quality(F.col("query"), F.col("candidate")), 6).alias("quality"))


def prefix_strip_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = similarity.match_quality(F.col("query"), F.col("candidate"), fuzzy=False)
    return _pairs(spark, sf_dir).withColumn("quality", q).where("quality > 0")


_P = f"""{values("n", "query", NAME_ROWS)},
c AS (SELECT p_name AS candidate FROM part UNION SELECT s_name FROM supplier UNION SELECT query FROM n),
p AS (SELECT query, candidate, lower(query) AS q, lower(candidate) AS c, CASE WHEN regexp_matches(query, '^[FUAIE]\\p{{Lu}}') THEN query[2:] ELSE query END AS qs,
             CASE WHEN regexp_matches(candidate, '^[FUAIE]\\p{{Lu}}') THEN candidate[2:] ELSE candidate END AS cs FROM n, c)"""


def _lev(q: str, c: str) -> str:
    return f"CASE WHEN greatest(length({q}), length({c})) > 0 THEN 1 - levenshtein({q}, {c})::DOUBLE / greatest(length({q}), length({c})) ELSE 0 END"


def _jw(q: str, c: str) -> str:
    same = f"CASE WHEN {q}[1:1] <> {c}[1:1] OR {q} = '' OR {c} = '' THEN 0 WHEN {q}[2:2] <> {c}[2:2] OR length({q}) < 2 OR length({c}) < 2 THEN 1 WHEN {q}[3:3] <> {c}[3:3] OR length({q}) < 3 OR length({c}) < 3 THEN 2 WHEN {q}[4:4] <> {c}[4:4] OR length({q}) < 4 OR length({c}) < 4 THEN 3 ELSE 4 END"
    return f"CASE WHEN {q} = {c} THEN 1 WHEN {q} = '' OR {c} = '' THEN 0 ELSE jaro_similarity({q}, {c}) + ({same}) * 0.1::DOUBLE * (1 - jaro_similarity({q}, {c})) * (jaro_similarity({q}, {c}) > 0)::INT END"


def _dice(q: str, c: str) -> str:
    g = lambda x: f"list_distinct(list_transform(range(1, length({x})), lambda i: {x}[i:i+1]))"
    return f"CASE WHEN length({q}) >= 2 AND length({c}) >= 2 THEN 2.0::DOUBLE * len(list_intersect({g(q)}, {g(c)})) / (len({g(q)}) + len({g(c)})) ELSE 0 END"


def _compound(a: str, b: str) -> str:
    q, c = f"lower({a})", f"lower({b})"
    s = f"(({_jw(q, c)}) * 0.45::DOUBLE + ({_lev(q, c)}) * 0.3::DOUBLE + ({_dice(q, c)}) * 0.25::DOUBLE)"
    return f"CASE WHEN {a} = {b} THEN 1 WHEN {q} = {c} THEN 0.95::DOUBLE WHEN contains({c}, {q}) AND length({c}) > 0 THEN least(1, {s} + 0.1::DOUBLE * (length({q})::DOUBLE / length({c}))) ELSE {s} END"


_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(question), '\\s+')), lambda w: w <> '' AND NOT list_contains(['the','a','an','in','on','at','for','to','of','is','are','how','why','what'], w))"

_RERANKED = f"""b AS (SELECT item_id AS query_id, text AS question FROM benchmark), k AS (SELECT *, {_WORDS} AS words FROM b),
g AS (SELECT page_id, url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS page FROM pages), v AS (SELECT *, list_distinct(regexp_split_to_array(lower(page), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) AS there FROM g),
s AS (SELECT query_id, question, page_id AS chunk_id, url, page, 1.0::DOUBLE / (page_id + 1) AS vector_score, CASE WHEN len(words) > 0 THEN len(list_intersect(words, there)) / len(words) ELSE 0 END AS r FROM k, v),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, chunk_id)::INT AS rank FROM s)"""

QUERIES = {f.__name__: f for f in (content_hash_dedup, char_window_chunks, chunk_overlap_lead, chunk_stats, size_cap, structured_chunks, snippets, category_counts, extension_stats, index_previews, ext_filter, path_exclude, url_suffix_counts, lexical_rerank, answer_prompt, levenshtein_match, jaro_winkler_match, bigram_dice, compound_fuzzy, fuzzy_match, prefix_strip_match)}
_WINDOWS = """w AS (SELECT *, CASE WHEN length(text) <= 2000 THEN [0] ELSE list_filter(range(0, length(text), 1800), lambda s: s = 0 OR length(text) - s >= 300) END AS starts FROM files {where}),
x AS (SELECT *, unnest(starts) AS s, unnest(range(len(starts))) AS i FROM w)"""
SQL = {
    "content_hash_dedup": f"WITH {FILES} SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM files GROUP BY 1",
    "char_window_chunks": f"WITH {FILES}, {_WINDOWS.format(where='')} SELECT doc_id, i::INT AS chunk_index, len(starts)::INT AS total_chunks, length(substr(text, s + 1, 2000))::INT AS chars, md5(substr(text, s + 1, 2000)) AS md5 FROM x",
    "chunk_overlap_lead": f"""WITH {FILES}, x AS (SELECT path, text, unnest(range(0, greatest(length(text), 1), 1000)) AS s FROM files),
y AS (SELECT path, s, substr(text, s + 1, 1000) AS c FROM x), z AS (SELECT *, lead(c) OVER (PARTITION BY path ORDER BY s)[1:200] AS more FROM y),
t AS (SELECT path, s, CASE WHEN length(c) + length(more) <= 1200 THEN c || more ELSE c END AS c FROM z) SELECT path, (s // 1000)::INT AS chunk_index, length(c)::INT AS chars, md5(c) AS md5 FROM t""",
    "chunk_stats": f"WITH {FILES}, {_WINDOWS.format(where='')} SELECT coalesce(origin, 'all') AS origin, count(DISTINCT path) AS files, count(*) AS chunks, count(*) AS new_chunks, sum(length(substr(text, s + 1, 2000)))::BIGINT AS chars FROM x GROUP BY ROLLUP (origin)",
    "size_cap": f"WITH {FILES} SELECT origin, count(*) AS files, count(*) FILTER (length(text) > {CAP}) AS over, coalesce(sum(length(text)) FILTER (length(text) > {CAP}), 0)::BIGINT AS chars_over FROM files GROUP BY origin",
    "snippets": f"WITH {FILES} SELECT doc_id, md5(substr(text, 1301, 1500)) AS md5 FROM files",
    "category_counts": f"WITH {FILES} SELECT CASE WHEN path LIKE '%.md' THEN 'doc' WHEN path LIKE '%.json' THEN 'data' ELSE 'code' END AS category, path LIKE '%.h' AS is_header, path LIKE '%.cpp' AS is_implementation, count(*) AS n FROM files GROUP BY 1, 2, 3",
    "extension_stats": f"WITH {FILES}, e AS (SELECT regexp_extract(path, '\\.[^.]+$') AS ext, octet_length(encode(text))::BIGINT AS bytes FROM files) SELECT ext, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM e GROUP BY ROLLUP (ext)",
    "index_previews": f"WITH {FILES} SELECT path, octet_length(encode(text))::BIGINT AS bytes, regexp_extract(path, '\\.[^.]+$') AS extension, md5(array_to_string(string_split(text, chr(10))[1:3], chr(10))) AS preview_md5 FROM files WHERE octet_length(encode(text)) <= 480000",
    "ext_filter": f"WITH {FILES} SELECT doc_id, path FROM files WHERE regexp_matches(path, '\\.(cpp|h|hpp|inl|cs)$')",
    "path_exclude": f"WITH {FILES}, p AS (SELECT *, string_split(path, '/') AS parts FROM files) SELECT doc_id, path FROM p WHERE NOT list_has_any(parts, ['src1', 'src2', 'fr']) AND (parts[-1] GLOB '*.cpp' OR parts[-1] GLOB '1?[0-4]*.h' OR parts[-1] GLOB '*.md') AND NOT parts[-1] GLOB '*7.md'",
    "url_suffix_counts": r"WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT regexp_extract(path, '^/([^/]*)', 1) AS folder, lower(regexp_extract(string_split(path, '/')[-1], '[^.](\.[^.]+)$', 1)) AS ext, count(*) AS n FROM p GROUP BY 1, 2",
    "lexical_rerank": f"WITH {_RERANKED} SELECT query_id, chunk_id, rank, round(r, 6) AS rerank_score, round(vector_score, 6) AS vector_score FROM t WHERE rank <= 5",
    "answer_prompt": f"""WITH {_RERANKED}, p AS (SELECT *, printf('[Doc %d score=%.3f path=%s chunk=1/1]', rank, r, url) || chr(10) || page AS part FROM t WHERE rank <= 3)
SELECT query_id, md5('You are a domain assistant. Use ONLY the provided context to answer.' || chr(10) || 'If uncertain, say you are not sure.' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question:' || chr(10) || any_value(question) || chr(10) || chr(10) || 'Answer:') AS md5 FROM p GROUP BY query_id""",
    "levenshtein_match": f"WITH {_P} SELECT query, candidate, levenshtein(q, c)::INT AS distance, round({_lev('q', 'c')}, 6) AS similarity FROM p",
    "jaro_winkler_match": f"WITH {_P} SELECT query, candidate, round({_jw('q', 'c')}, 6) AS similarity FROM p",
    "bigram_dice": f"WITH {_P} SELECT query, candidate, round({_dice('q', 'c')}, 6) AS similarity FROM p",
    "compound_fuzzy": f"WITH {_P} SELECT query, candidate, round({_compound('query', 'candidate')}, 6) AS score FROM p",
    "fuzzy_match": f"WITH {_P}, f AS (SELECT *, greatest({_compound('query', 'candidate')}, {_compound('qs', 'cs')}) AS best FROM p) SELECT query, candidate, round(CASE WHEN q = c THEN 1 WHEN lower(qs) = lower(cs) THEN 0.9::DOUBLE WHEN best > 0.4 THEN best ELSE 0 END, 6) AS quality FROM f",
    "prefix_strip_match": f"WITH {_P} SELECT query, candidate, CASE WHEN q = c THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS quality FROM p WHERE q = c OR lower(qs) = lower(cs)",
}
