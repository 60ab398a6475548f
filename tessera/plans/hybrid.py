"""The whole search as one plan for any number of questions: analysis, definitions, semantic search, merge."""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.naming import norm_path
from ..operators import chunking, definitions, enrich, formats, intent, late, relations, scoring
from ..operators.embed import Encoder, HashEncoder, embed
from ..operators.filters import matches, parsed
from ..sources import shared

FEW_DEFINITIONS = 3
#: How many more chunks a re-ranker looks at than are asked for.
RERANKED = 10
#: Encoded questions that an index keeps on the driver.
ENCODED = 64
#: Analysed questions, of a few KB each, that go through the driver as a table of its own; more are persisted.
SETTLED = 10_000


@dataclass
class Index:
    """What questions are answered from: chunks with their text, entities and vectors, and all definitions. Questions are encoded
    by ``encoder``, or by the one of ``encoders`` that they name as their model. reranker: a column of scores from question and text; late interaction by default."""

    chunks: DataFrame
    definitions: DataFrame
    encoder: Encoder
    encoders: dict[str, Encoder] = field(default_factory=dict)
    encoded: OrderedDict = field(default_factory=OrderedDict, repr=False)
    names: DataFrame | None = field(default=None, repr=False)
    reranker: Callable[[Column, Column], Column] | None = field(default=None, repr=False)

    @classmethod
    def build(cls, files: DataFrame, encoder: Encoder | None = None, encoders: dict[str, Encoder] | None = None, **options) -> Index:
        """From ``files(path, origin, text)``; chunk_id follows path and number in the file."""
        enc = encoder or HashEncoder()
        chunks = enrich.enrich(chunking.chunk_files(files, words=enrich.WORDS, **options))
        chunks = chunks.withColumn("chunk_id", F.xxhash64("path", "chunk_index"))
        return cls(embed(chunks, enc), definitions.definitions(files), enc, encoders or {})

    def kept(self, chunks: bool = True) -> Index:
        """The same, computed once for all plans of the session (an index that is to last is a written store). Without ``chunks`` only definitions and their
        names are kept, which an answer reads more than once: chunks it reads once, so that for a single answer their texts needn't be held."""
        defs = self.definitions.persist()
        return Index(self.chunks.persist() if chunks else self.chunks, defs, self.encoder, self.encoders, names=definitions.names_of(defs).persist(), reranker=self.reranker)

    def release(self) -> None:
        """Frees what ``kept`` holds."""
        for df in (self.chunks, self.definitions, self.names):
            if df is not None:
                df.unpersist()

    def model_error(self, model: Column) -> Column:
        """What is wrong with the model that a question names: it isn't known, or its vectors are of another length than the chunks'. Else null."""
        bad = {m: f"Dimension mismatch: Query vector has {e.dim} dimensions (model: {m}), but vector store has {self.encoder.dim} dimensions." for m, e in self.encoders.items() if e.dim != self.encoder.dim}
        wrong = F.when(~model.isin(*self.encoders), F.concat(F.lit("Unknown model: "), model)) if self.encoders else F.concat(F.lit("Unknown model: "), model)
        return F.when(model.isNotNull(), F.coalesce(*(F.when(model == m, F.lit(text)) for m, text in bad.items()), wrong))

    def encode(self, text: str, model: str | None = None) -> list[float]:
        """The vector of one question, on the driver; the last ENCODED ones are kept."""
        key = (text, model)
        if key not in self.encoded:
            self.encoded[key] = np.asarray((self.encoders[model] if model else self.encoder).encode([text])[0], float).tolist()
            if len(self.encoded) > ENCODED:
                self.encoded.popitem(last=False)
        self.encoded.move_to_end(key)
        return self.encoded[key]


def settled(rows: DataFrame, cut: bool = False) -> DataFrame:
    """``rows`` computed once, so that no plan on top of them repeats or optimises the expressions below. cut: many rows are written to the shared folder
    too, so that plans on top don't hold those below, which the driver has again for each place where the rows are read."""
    held = rows.persist()
    some = held.limit(SETTLED + 1).toArrow()
    if some.num_rows > SETTLED and not cut:
        return held
    out = shared.settled(held).persist() if some.num_rows > SETTLED else rows.sparkSession.createDataFrame(some, rows.schema)
    held.unpersist()
    return out


@cache
def _parsed_filter() -> Column:
    return parsed(F.col("filter"))


def understood(questions: DataFrame, index: Index) -> DataFrame:
    """``questions(query_id, question, top_k, scope, ...)`` analysed. Optional columns are filter, use_reranker and model; a filter or model
    that is wrong fails the job."""
    given = {"filter": "string", "use_reranker": "boolean", "model": "string"}
    questions = questions.withColumns({c: F.lit(None).cast(kind) for c, kind in given.items() if c not in questions.columns})
    error = F.coalesce(F.col("parsed_filter.error"), index.model_error(F.col("model")))
    q = settled(intent.with_intent(questions).withColumn("parsed_filter", _parsed_filter()))
    q = q.withColumn("question", F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.col("question")))
    return settled(intent.with_terms(q))


def analyse(questions: DataFrame, index: Index) -> DataFrame:
    """``understood`` questions with the vector of their semantic text."""
    q = understood(questions, index)
    out = embed(q.where("model IS NULL") if index.encoders else q, index.encoder, "semantic_text", "vector")
    for name, encoder in index.encoders.items():
        out = out.unionByName(embed(q.where(F.col("model") == name), encoder, "semantic_text", "vector"))
    return settled(out, cut=True)


#: What ``find_definitions`` gives.
FOUND = f"query_id long, rank int, d {formats.DEFINITION}"


def find_definitions(q: DataFrame, index: Index, few: bool = False) -> DataFrame:
    """(query_id, rank, d) of the definitions of all names that analysed questions ask for. few: they are known to be, and aren't counted."""
    wanted = q.select("query_id", "scope", F.explode("entities").alias("e")).select("query_id", "scope", "e.name", "e.kind")
    defs = definitions.shown(definitions.look_up(index.definitions, wanted, names=index.names, most_asked=None if few else definitions.MOST_ASKED))
    return defs.select("query_id", "rank", F.struct("entity_type", "entity_name", "file_path", "line_start", "line_end", "match_quality", "definition", "members", "total_members", "origin").cast(formats.DEFINITION).alias("d"))


def find_chunks(q: DataFrame, index: Index, files_once: bool = False, use_reranker: bool = False, known: tuple[int, int, bool] | None = None) -> DataFrame:
    """(query_id, rank, s) of the best chunks for analysed questions that aren't blank, each narrowed by its own filter and re-ranked
    if it says so (or, if it says nothing, by ``use_reranker``). known: how many questions there are, the most chunks that one needs, and whether any is
    re-ranked, where that is known."""
    own = F.when(F.col("intent.entity_name").isNotNull(), F.array("intent.entity_name")).otherwise(F.array().cast("array<string>"))
    again = F.coalesce("use_reranker", F.lit(use_reranker))
    asked = q.where("intent.type <> 'unknown'").select("query_id", "question", "scope", "top_k", F.col("parsed_filter").alias("f"), scoring.keywords(F.col("semantic_text")).alias("tokens"), "vector", F.array_distinct(F.concat(own, "parsed_filter.boost_entities")).alias("boost_entities"), F.col("intent.type").alias("type"), again.alias("again"))
    n, most, some = known or (None, *asked.agg(F.max(F.col("top_k") * F.when(F.col("again"), RERANKED).otherwise(1)), F.bool_or("again")).first())
    hits = scoring.search(index.chunks, asked, most or 1, files_once=files_once, where=matches(F.col("f")), n=n)
    plain = hits.where(~F.col("again") & (F.col("rank") <= F.col("top_k")))
    if some:
        # of each question only its over-fetched hits reach the scorer
        best = scoring.rerank(hits.where(F.col("again") & (F.col("rank") <= F.col("top_k") * RERANKED)).drop("rank"), most, index.reranker or late.scorer())
        plain = plain.unionByName(best.where(F.col("rank") <= F.col("top_k")), allowMissingColumns=True)
    return plain.select("query_id", "rank", F.struct("path", "chunk_index", "total_chunks", "score", F.coalesce("origin", F.lit("engine")), "entities").cast(formats.SEMANTIC).alias("s"))


class Watch:
    """Counters of one answer, taken by Spark while its own job runs, without another: questions, definitions and chunks found, and seconds of its phases.
    Those before the job are there at once and in the rows' timing; counts and the job's seconds when the answer's first action is over."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.began = time.perf_counter()
        self.seen = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("questions", "definitions", "chunks")}

    def phase(self, name: str) -> None:
        """What went on since the last phase, or the start, was ``name``."""
        self.seconds[name] = time.perf_counter() - self.began - sum(self.seconds.values())

    def watched(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.observe(self.seen[name], F.count("*").alias("rows"))

    def counts(self) -> dict[str, int]:
        """Waits for the first action on the answer."""
        return {name: seen.get["rows"] for name, seen in self.seen.items()}

    def timing(self) -> Column:
        return F.create_map(*(F.lit(x) for kv in self.seconds.items() for x in kv)) if self.seconds else F.create_map().cast("map<string, double>")


def assemble(q: DataFrame, defs: DataFrame, sems: DataFrame, watch: Watch | None = None) -> DataFrame:
    """A row for each analysed question, with its results in order and combined: definitions, then the semantic hits whose path no
    definition has, cut to top_k; a question without definitions keeps all of its semantic hits. One that asks for a definition
    has semantic hits if it found fewer than FEW_DEFINITIONS."""
    watch = watch or Watch()
    q, defs, sems = watch.watched("questions", q), watch.watched("definitions", defs), watch.watched("chunks", sems)
    found = defs.withColumn("s", F.lit(None).cast(formats.SEMANTIC)).unionByName(sems.withColumn("d", F.lit(None).cast(formats.DEFINITION)))
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct("rank", x)))), lambda r: r[x])
    found = found.groupBy("query_id").agg(in_order("d").alias("ds"), in_order("s").alias("ss"))
    out = q.join(found, "query_id", "left").withColumns({"ds": F.coalesce("ds", F.array().cast(f"array<{formats.DEFINITION}>")), "ss": F.coalesce("ss", F.array().cast(f"array<{formats.SEMANTIC}>"))})
    wants = (F.col("intent.type") != "definition") | (F.size("ds") < FEW_DEFINITIONS)
    out = out.withColumn("ss", F.when(wants, F.col("ss")).otherwise(F.slice("ss", 1, 0)))
    paths = F.transform("ds", lambda d: norm_path(d["file_path"]))
    fresh = F.filter("ss", lambda s: ~F.array_contains(paths, norm_path(s["path"])))
    hit = lambda kind, path, name: F.struct(F.lit(kind).alias("kind"), path.alias("path"), name.cast("string").alias("entity_name"))
    semantic = lambda xs: F.transform(xs, lambda s: hit("semantic", s["path"], F.lit(None)))
    both = F.slice(F.concat(F.transform("ds", lambda d: hit("definition", d["file_path"], d["entity_name"])), semantic(fresh)), F.lit(1), F.col("top_k"))
    combined = F.when(F.size("ds") > 0, both).otherwise(semantic("ss"))
    return out.select("query_id", "question", "intent", "expanded_terms", F.col("ds").alias("definition_results"), F.col("ss").alias("semantic_results"), combined.alias("combined_results"), watch.timing().alias("timing"))


def answer(questions: DataFrame, index: Index, files_once: bool = False, use_reranker: bool = False, watch: Watch | None = None) -> DataFrame:
    """A row for each question: question, intent, definition_results, semantic_results, combined_results, timing (the phase before the plan,
    intent_analysis_s; ``watch`` has the counts of the others, ``timed`` their seconds). Blank questions have the type unknown and no results.
    Definitions and chunks are two branches of one plan, and one aggregate brings them together. More than SETTLED questions stay persisted."""
    watch = watch or Watch()
    q = analyse(questions, index)
    watch.phase("intent_analysis_s")
    return assemble(q, find_definitions(q, index), find_chunks(q, index, files_once, use_reranker), watch)


def timed(questions: DataFrame, index: Index, files_once: bool = False, use_reranker: bool = False) -> DataFrame:
    """``answer``, phase by phase, with the seconds of each in timing. The result is kept until it is unpersisted."""
    took, held = {}, []

    def run(name: str, made: DataFrame) -> DataFrame:
        began = time.perf_counter()
        made = made.persist()
        made.count()
        took[name] = time.perf_counter() - began
        held.append(made)
        return made

    began = time.perf_counter()
    q = run("intent_analysis_s", analyse(questions, index))
    defs, sems = run("definition_s", find_definitions(q, index)), run("semantic_s", find_chunks(q, index, files_once, use_reranker))
    out = run("merge_s", assemble(q, defs, sems))
    took["total_s"] = time.perf_counter() - began
    for part in held[:-1]:
        part.unpersist()
    return out.withColumn("timing", F.create_map(*(F.lit(x) for kv in took.items() for x in kv)))


#: The local property by which a driver's questions reach the one task that analyses them.
ROWS_PROPERTY = "tessera.questions"
ROW = "query_id long, question string, top_k int, scope string, model string, filter string, use_reranker boolean"
_PREPARED: dict[str, DataFrame] = {}


def _rows_of_job(batches):
    """The questions that the driver gave its job, whatever comes in."""
    from pyspark import TaskContext

    for _ in batches:
        pass
    rows = json.loads(TaskContext.get().getLocalProperty(ROWS_PROPERTY))
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])


def _as_it_is(batches):
    yield from batches


def analysed_rows(spark: SparkSession, rows: list[tuple]) -> tuple[pa.Table, StructType]:
    """``understood`` for a few questions (question, top_k, scope, model) of the driver. The plan is made once a session; each time it runs it reads the
    questions of its own job, so that a question costs a short task and no planning."""
    key = spark.sparkContext.applicationId
    if key not in _PREPARED:
        _PREPARED.clear()
        q = intent.with_intent(spark.range(0, 1, 1, 1).mapInArrow(_rows_of_job, ROW)).withColumn("parsed_filter", _parsed_filter())
        _PREPARED[key] = intent.with_terms(q.mapInArrow(_as_it_is, q.schema))
    sc = spark.sparkContext
    sc.setLocalProperty(ROWS_PROPERTY, json.dumps([(i, *r, None, None) for i, r in enumerate(rows)]))
    try:
        return _PREPARED[key].toArrow(), _PREPARED[key].schema
    finally:
        sc.setLocalProperty(ROWS_PROPERTY, None)


def answer_rows(spark: SparkSession, index: Index, rows: list[tuple], files_once: bool = False, use_reranker: bool = False, watch: Watch | None = None) -> DataFrame:
    """``answer`` for a few questions (question, top_k, scope, model) of the driver, query_id being their place. They are analysed by one short job and encoded on the
    driver, where the last ones are kept; nothing is counted, so the answer is one job more. ValueError for a model that can't answer."""
    watch = watch or Watch()
    for _, _, _, model in rows:
        if model is not None and (model not in index.encoders or index.encoders[model].dim != index.encoder.dim):
            raise ValueError(f"model {model} isn't known, or of another dimension than the index")
    held, schema = analysed_rows(spark, rows)
    watch.phase("intent_analysis_s")
    vectors = [index.encode(text or "", rows[i][3]) for text, i in zip(held["semantic_text"].to_pylist(), held["query_id"].to_pylist(), strict=True)]
    q = spark.createDataFrame(held.append_column("vector", pa.array(vectors, pa.list_(pa.float64()))), StructType([*schema, StructField("vector", ArrayType(DoubleType()))]))
    watch.phase("encode_s")
    most = max((r[1] for r in rows), default=1) * (RERANKED if use_reranker else 1)
    named = any(held["entities"].to_pylist())
    defs = find_definitions(q, index, few=True) if named else spark.createDataFrame([], FOUND)
    return assemble(q, defs, find_chunks(q, index, files_once, use_reranker, (len(rows), most, use_reranker)), watch)


def answer_one(spark: SparkSession, index: Index, question: str, top_k: int = 5, scope: str = "engine", model: str | None = None, **options) -> DataFrame:
    """``answer_rows`` for one question."""
    return answer_rows(spark, index, [(question, top_k, scope, model)], **options)


def run_batch(batch: DataFrame, index: Index, **options) -> DataFrame:
    """(query_id, question, status, results or error) of a parsed batch; a bad line, filter or model is an error of its own question. The intent's reasoning is
    there for questions that ask for it (show_reasoning)."""
    model = F.col("model") if "model" in batch.columns else F.lit(None).cast("string")
    wrong = F.coalesce(parsed(F.col("filter"))["error"], index.model_error(model))
    batch = settled(batch.withColumn("error", F.coalesce("error", wrong)).withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status"))))
    good = answer(batch.where("status = 'success'"), index, **options)
    told = batch.select("query_id", F.coalesce("show_reasoning", F.lit(False)).alias("show_reasoning")) if "show_reasoning" in batch.columns else None
    shown = F.col("intent").withField("reasoning", F.when(F.col("show_reasoning"), F.col("intent.reasoning")))
    good = good if told is None else good.join(told, "query_id").withColumn("intent", shown)
    done = good.select("query_id", "question", F.lit("success").alias("status"), F.struct("intent", "definition_results", "semantic_results", "combined_results").alias("results"))
    failed = batch.where("status = 'error'").select("query_id", "question", "status", "error")
    return done.unionByName(failed, allowMissingColumns=True)


def relationships(questions: DataFrame, index: Index, depth: int | None = 1) -> DataFrame:
    """``questions(query_id, question)`` with the relationships of the entity that each names: entity, tree, json; null where no struct,
    class or enum has the name. With ``depth`` over 1, also what its members and parents lead to (None: however far)."""
    asked = questions.select("query_id", intent.relationship_entity(F.col("question")).alias("entity"))
    g = relations.as_json(relations.tree(relations.one_each(relations.graph(index.definitions))))
    out = asked.join(g, "entity", "left").select("query_id", "entity", "tree", "json")
    if depth is None or depth > 1:
        reach = relations.reachable(relations.edges(relations.graph(index.definitions)), asked.where("entity IS NOT NULL").select(F.col("entity").alias("root")).distinct(), depth)
        near = reach.where("hops > 0").groupBy(F.col("root").alias("entity")).agg(F.array_sort(F.collect_list(F.struct("hops", "node"))).alias("leads_to"))
        out = out.join(near, "entity", "left")
    return out
