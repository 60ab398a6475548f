"""Scores of chunks for questions: dense, by keyword, boosts; and top-k."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import file_name, list_of, strip_all_prefixes, strip_prefix
from .enrich import BOOSTED_MACROS
from .intent import words

# Words that no keyword score counts, and the weights of the score and the boosts.
STOP_WORDS = ["the", "a", "an", "in", "on", "at", "for", "to", "of", "is", "are", "how", "why", "what"]
IN_NAME, IN_PATH, IS_ENTITY, IN_ENTITY = 0.4, 0.1, 0.5, 0.2
ENTITY, MACRO, NAME, HEADER, IMPLEMENTATION, MISSING, MANY = 1.2, 1.15, 3.0, 2.5, 0.5, 0.1, 1.3


def dense(vector: Column, query: Column) -> Column:
    """Inner product in double precision, summed from the first component on. A column of the JVM."""
    products = F.zip_with(vector, query, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def keywords(question: Column) -> Column:
    """Distinct lower-case words of a question, without stop words."""
    return F.array_except(F.array_distinct(words(F.lower(question))), list_of(STOP_WORDS))


def looked_in(path: Column, entities: Column) -> dict[str, Column]:
    """What ``sparse`` looks into, in lower case: made once a chunk, not for each question or token."""
    return {"__path": F.lower(path), "__name": file_name(F.lower(path)), "__entities": F.transform(entities, lambda e: F.lower(e))}


def sparse(tokens: Column, path: Column, entities: Column) -> Column:
    """For each token: 0.4 if the file's name holds it, else 0.1 if the path does; and 0.5 if it is an entity, else 0.2 if
    an entity holds it, case aside."""
    return _sparse(tokens, *looked_in(path, entities).values())


def _sparse(tokens: Column, low: Column, name: Column, names: Column) -> Column:

    def one(acc: Column, t: Column) -> Column:
        place = F.when(F.contains(name, t), IN_NAME).when(F.contains(low, t), IN_PATH).otherwise(0.0)
        entity = F.when(F.array_contains(names, t), IS_ENTITY).when(F.exists(names, lambda e: F.contains(e, t)), IN_ENTITY).otherwise(0.0)
        return acc + place + entity

    return F.aggregate(tokens, F.lit(0.0), one)


def boosted(score: Column, boost_entities: Column, question_type: Column, path: Column, entities: Column, boost_macros: bool = True, logical: bool = True, strict_parity: bool = False) -> Column:
    """A score times its boosts: an entity that is asked for; a macro; and if entities are asked for, a file named like one,
    headers before implementations for questions that want definitions, chunks without the entity last, chunks with many
    entities first. Negative scores are multiplied as well. strict_parity strips all prefix letters of a name, not one."""
    asked = F.size(boost_entities) > 0
    has = F.coalesce(F.arrays_overlap(entities, boost_entities), F.lit(False))
    strip = strip_all_prefixes if strict_parity else strip_prefix
    named = F.exists(boost_entities, lambda e: F.contains(F.lower(file_name(path)), F.lower(strip(e))))
    one = F.lit(1.0)
    s = score * F.when(has, ENTITY).otherwise(one)
    if boost_macros:
        flags = [F.coalesce(F.col(f"has_{m}"), F.lit(False)) for m in BOOSTED_MACROS]
        s = s * F.when(flags[0] | flags[1] | flags[2] | flags[3], MACRO).otherwise(one)
    if logical:
        s = s * F.when(asked & named, NAME).otherwise(one)
        wants = asked & question_type.isin("definition", "hybrid")
        s = s * F.when(wants & F.coalesce(F.col("is_header"), F.lit(False)), HEADER).when(wants & F.coalesce(F.col("is_implementation"), F.lit(False)), IMPLEMENTATION).otherwise(one)
        s = s * F.when(asked & ~has, MISSING).otherwise(one)
        s = s * F.when(asked & (F.size(entities) > 3), MANY).otherwise(one)
    return s


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, tie: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best rows, or the k best of each group ``by``, with their rank from 1; ties by ``tie``. A task keeps k rows (a
    group) before anything is shuffled."""
    if not by:
        best = scored.orderBy(F.desc(score), tie).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


#: A question with its vector and terms, or a chunk with its text, takes a few KB; so many of them are sent to every executor.
MOST_QUESTIONS = 2_000


def with_questions(chunks: DataFrame, questions: DataFrame, most: int = MOST_QUESTIONS, n: int | None = None) -> DataFrame:
    """Every chunk with every question, in one plan however many there are. Up to ``most`` questions are broadcast, so that the chunks are scanned once;
    if there are more, up to ``most`` chunks are. Where both are many, the questions are dealt to partitions of about that many, and a task has a partition of
    chunks and one of questions. n: how many questions there are, if that is known."""
    n = questions.count() if n is None else n
    if n <= most:
        return chunks.crossJoin(F.broadcast(questions))
    columns = [*chunks.columns, *questions.columns]
    if chunks.select(F.lit(1)).limit(most + 1).count() <= most:
        return questions.crossJoin(F.broadcast(chunks)).select(columns)
    return chunks.crossJoin(questions.repartition(-(-n // most)).hint("shuffle_replicate_nl"))


@cache
def _score(boost_macros: bool, logical: bool, strict_parity: bool) -> Column:
    """The score's expressions, made once."""
    raw = dense(F.col("embedding"), F.col("vector")) + _sparse(F.col("tokens"), F.col("__path"), F.col("__name"), F.col("__entities"))
    return boosted(raw, F.col("boost_entities"), F.col("type"), F.col("path"), F.col("entities"), boost_macros, logical, strict_parity)


def scores(chunks: DataFrame, questions: DataFrame, boost_macros: bool = True, logical: bool = True, strict_parity: bool = False, where: Column | None = None, n: int | None = None) -> DataFrame:
    """Every one of ``chunks`` in scope with its score for each row of ``questions(query_id, tokens, vector, boost_entities, type, scope)``.
    where: a further condition over the columns of both."""
    scope = (F.col("scope") == "all") | ((F.col("scope") == "engine") == (F.coalesce(F.col("origin"), F.lit("engine")) == "engine"))
    chunks = chunks.withColumns(looked_in(F.col("path"), F.col("entities")))
    pairs = with_questions(chunks, questions, n=n).where(scope if where is None else scope & where)
    scored = pairs.withColumn("score", _score(boost_macros, logical, strict_parity))
    return scored.drop("vector", "embedding", "tokens", "__path", "__name", "__entities")


def search(chunks: DataFrame, questions: DataFrame, k: int = 5, files_once: bool = False, over_fetch: int = 10, **options) -> DataFrame:
    """The k best ``chunks`` for each of ``questions``, by ``scores`` with its options. With ``files_once`` the best chunk of each file
    counts, of the k * ``over_fetch`` best chunks."""
    scored = scores(chunks, questions, **options)
    if not files_once:
        return top_k(scored, k, ["query_id"])
    many = top_k(scored, k * over_fetch, ["query_id"]).drop("rank")
    return top_k(best_of_file(many), k, ["query_id"])


def best_of_file(hits: DataFrame) -> DataFrame:
    """The best hit of each path for each question."""
    w = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def rerank(hits: DataFrame, k: int, scorer=None) -> DataFrame:
    """``hits(query_id, question, chunk_id, score, ...)`` in a new order. scorer: a column from the question and the text;
    the default is the share of the question's words that the text holds. The text is the chunk's, else the definition,
    else path and entities. The old score is kept as vector_score, the new one as rerank_score."""
    options = [F.when(F.col(c) != "", F.col(c)) for c in ("chunk_text", "definition") if c in hits.columns]
    names = F.concat_ws(" ", F.col("path"), F.array_join("entities", " ")) if "entities" in hits.columns else F.col("path")
    text = F.coalesce(*options, names)
    new = (scorer or lexical)(F.col("question"), text)
    out = hits.withColumn("vector_score", F.col("score")).withColumn("rerank_score", new)
    return top_k(out.withColumn("score", F.col("rerank_score")), k, ["query_id"])


def text_words(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != ""))


def shared(asked: Column, there: Column) -> Column:
    """The share of the words ``asked`` that are ``there``."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, there)) / F.size(asked)).otherwise(F.lit(0.0))


def lexical(question: Column, text: Column) -> Column:
    return shared(keywords(question), text_words(text))


def entity_rank(scored: DataFrame, entity: str) -> DataFrame:
    """One row for a ranking ``scored(chunk_id, score, entities)``: best_rank and best_score of the chunks with ``entity``,
    top_score, and the factor that would put the best of them on top. Two aggregates, no sort of the whole."""
    has = F.array_contains("entities", entity)
    best = scored.agg(F.max(F.when(has, F.col("score"))).alias("best_score"), F.max("score").alias("top_score"), F.count_if(has).alias("n_chunks"))
    above = scored.crossJoin(F.broadcast(best.select("best_score"))).where(F.col("score") > F.col("best_score")).agg(F.count("*").alias("above"))
    out = best.crossJoin(above)
    return out.select("best_score", "top_score", "n_chunks", F.when(F.col("best_score").isNotNull(), F.col("above") + 1).alias("best_rank"), F.when(F.col("best_score") > 0, F.col("top_score") / F.col("best_score")).alias("boost_needed"))
