"""Sources, chunking, definitions, hybrid search, batches, index upkeep, streams, service."""

import io
import json
import re
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import server
from tessera.functions import matching
from tessera.operators import chunking, definitions, embed, enrich, formats, incremental, reports, scoring
from tessera.plans import fixtures, hybrid
from tessera.sources import files as sources
from tessera.streaming import index_stream


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:document>')
    for path, data in {"src/A.h": b"struct FA { int32 X; };\r\n\xff", "src/Intermediate/B.h": b"x", "src/sub/C.cpp": b"void F() {}", "src/notes.docx": docx.getvalue(), "src/skip.bin": b"0"}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(data)
    return top


def test_scan(spark, tree):
    df = sources.scan(spark, {"engine": [str(tree / "src")], "project": [str(tree / "src/sub")]}, (".h", ".cpp", ".docx"))
    got = {r.path.rpartition("/")[2]: r for r in df.collect()}
    assert set(got) == {"A.h", "C.cpp", "notes.docx"}
    assert got["A.h"].text == "struct FA { int32 X; };\n"
    assert got["notes.docx"].text == "One\nTwo" and got["notes.docx"].category == "doc"
    assert got["C.cpp"].origin == "engine"


def test_index_file(spark, tree):
    listing = sources.scan(spark, {"engine": [str(tree / "src")]}, text=False)
    (tree / "index.json").write_text(json.dumps({"files": [{"fullPath": str(tree / "src/A.h")}, {"path": "/gone.h"}, {"path": str(tree / "src/sub/C.cpp"), "fullPath": ""}]}))
    assert sources.from_index(spark, str(tree / "index.json"), listing).count() == 2


def test_settings_files(tmp_path):
    (tmp_path / "dirs").write_text("# c\n\n{ENGINE_ROOT}/x\n/none\n")
    (tmp_path / "x").mkdir()
    assert sources.read_dirs(str(tmp_path / "dirs"), str(tmp_path)) == [str(tmp_path / "x")]
    (tmp_path / "ignore").write_text("Build/\n*.tmp\n#x\n")
    assert sources.read_ignores([str(tmp_path / "ignore"), str(tmp_path / "missing")]) == (["Build"], ["*.tmp"])
    sources.write_settings(str(tmp_path / "env"), {"A": "1", "B": "x=y"})
    assert sources.read_settings(str(tmp_path / "env")) == {"A": "1", "B": "x=y"}


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    assert sources.read_if_exists(spark, path, "chunk_id long, origin string").count() == 0
    df = spark.createDataFrame([(1, "engine"), (2, "project")], "chunk_id long, origin string")
    sources.write_store(df, path)
    assert sorted(map(tuple, sources.read_store(spark, path).select("chunk_id", "origin").collect())) == [(1, "engine"), (2, "project")]


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    sources.log_events(spark.createDataFrame([("2024-01-01T00:00:00", "a", {"k": "v"})], sources.LOG), path)
    sources.log_events(spark.createDataFrame([("bad", "b", None)], sources.LOG), path)
    assert {r.event: r.ts is None for r in sources.read_log(spark, path).collect()} == {"a": False, "b": True}


def test_batch_file(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "a"}\n\n{"question": "b", "top_k": 2}\nbad\n')
    got = {r.query_id: (r.question, r.top_k, r.status) for r in sources.read_batch(spark, str(tmp_path / "q.jsonl")).collect()}
    assert got == {0: ("a", 5, "success"), 2: ("b", 2, "success"), 3: (None, None, "error")}
    assert sources.batch_of(spark, [{"question": "x"}]).first().question == "x"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["class A {\n", "void F() {\n", "word word\n", "\n\n", "x" * 30 + "\n", "}\n", "/**\n"]), max_size=60).map("".join))
def test_chunks_cover_the_text(text):
    parts = chunking.structured(text, 100, 20, 10)
    joined = "".join("".join(p.split()) for p in parts)
    rest = iter(joined)
    assert all(ch in rest for ch in "".join(text.split()))  # everything is there, in order; windows may repeat some


def test_chunk_edges(spark):
    df = spark.createDataFrame([("a", "x" * 2000), ("b", "x" * 2001), ("c", ""), ("d", "x" * 2101)], "path string, text string")
    n = {r["path"]: r["n"] for r in chunking.window_chunks(df).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 1, "b": 1, "c": 1, "d": 2}
    assert chunking.plain_windows("x" * 2001, 2000, 200) == ["x" * 2000 + "x" * 201]


def test_definitions_in_snippets():
    found = {(k, n): (first, last, members) for k, n, first, last, _, _, members in definitions.find_definitions(fixtures.CODE[1][2] + fixtures.CODE[3][2])}
    assert found["class", "AThing"][2] == ["TArray<FHitInfo> Hits", "UWheelComponent* Wheel"]
    assert found["enum", "EChannel"][2] == ["Visible", "Camera", "Hidden"]
    strings = definitions.find_definitions('struct FA {\n const char* S = "}";\n // }\n /* } */ int X;\n};\nint Y;')
    assert strings[0][5].endswith("int X;\n}") and strings[0][2:4] == (1, 5)
    assert definitions.find_definitions("\n\n\nstruct FB {};")[0][2] == 4
    assert [d[1] for d in definitions.find_definitions("void F(int A)\n{\n if (A) { G(); }\n return H(A);\n}\n")] == ["F"]


@pytest.fixture(scope="module")
def index(spark):
    return hybrid.Index.build(fixtures.code(spark)).kept()


def ask(spark, index, *texts, **options):
    q = spark.createDataFrame([(i, t, 3, "all") for i, t in enumerate(texts)], "query_id long, question string, top_k int, scope string")
    return {r.query_id: r for r in hybrid.answer(q, index, **options).collect()}


def test_answers(spark, index):
    got = ask(spark, index, "struct FHitInfo", "how do wheels work", "", None)
    assert got[0].definition_results[0].entity_name == "FHitInfo" and got[0].combined_results[0].kind == "definition" and len(got[0].combined_results) == 3
    assert got[1].intent.type == "semantic" and len(got[1].semantic_results) == 3 and got[1].definition_results == []
    assert got[2].intent.type == got[3].intent.type == "unknown" and got[2].combined_results == []
    paths = [c.path for c in got[0].combined_results if c.kind == "semantic"]
    assert got[0].definition_results[0].file_path not in paths


def test_reranked_once_per_file(spark, index):
    got = ask(spark, index, "how do wheels work", files_once=True, use_reranker=True)
    paths = [s.path for s in got[0].semantic_results]
    assert len(paths) == len(set(paths)) and paths[0].endswith("notes.txt")


def test_batch_errors_stay_with_their_question(spark, index):
    batch = sources.batch_of(spark, [{"question": "FHitInfo", "scope": "all"}, {"question": "x", "filter": "type:no"}])
    got = {r.query_id: r for r in hybrid.run_batch(batch, index).collect()}
    assert got[0].status == "success" and got[1].status == "error" and "entity type" in got[1].error


BROKEN_FILTERS = ["type:no", "type", "what:x", "macro:UENUM", "origin:mars", "file:h", "boost:all", "type:struct OR macro:UCLASS", "  ", "type:struct AND AND macro:UCLASS", "TYPE:Enum AND entity:A AND entity:B AND boost:Macros", "macro:uproperty AND macro:UCLASS", "entity:x y z", "type:struct AND type:wrong AND what:x"]


def test_filters_as_columns(spark):
    """The column against the parser, for right and wrong filters, and both predicates over chunks."""
    from tessera.operators import filters
    from tessera.plans.vector_queries import FILTERS

    texts = [*FILTERS, *BROKEN_FILTERS, None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", filters.parsed(F.col("t")).alias("f")).collect()
    good = []
    for i, f in got:
        try:
            want = filters.parse_filter(texts[i])
        except ValueError as e:
            assert f.error == str(e), texts[i]
            continue
        good.append(texts[i])
        assert f.error is None and (f.entity, f.entity_type, f.origin, f.file_type, f.boost_entities, f.boost_macros) == (want.entity, want.entity_type, want.origin, want.file_type, want.boost_entities, want.boost_macros)
        assert all(getattr(f, n) == bool(getattr(want, n)) for n in ("has_uproperty", "has_uclass", "has_ufunction", "has_ustruct"))
    rows = [(i, ["A", "B"][: i % 3], [["struct"], ["enum"], None][i % 3], ["engine", "project", None][i % 3], i % 2 == 0, [True, None][i % 2], i % 4 == 0, False, i % 5 == 0, i % 5 == 1) for i in range(60)]
    chunks = spark.createDataFrame(rows, "id int, entities array<string>, entity_types array<string>, origin string, has_uproperty boolean, has_uclass boolean, has_ufunction boolean, has_ustruct boolean, is_header boolean, is_implementation boolean")
    both = chunks.crossJoin(spark.createDataFrame([(t,) for t in good], "t string")).where(filters.matches(filters.parsed(F.col("t"))))
    found = {t: {r.id for r in both.collect() if r.t == t} for t in good}
    assert found == {t: {r.id for r in chunks.where(filters.parse_filter(t).predicate()).collect()} for t in good}


def test_very_many_filters(spark, index):
    batch = sources.batch_of(spark, [{"question": "how do wheels work", "scope": "all", "filter": f"entity:E{i}"} for i in range(150)] + [{"question": "how do wheels work", "scope": "all", "filter": "file:header"}])
    got = {r.query_id: r.results.semantic_results for r in hybrid.run_batch(batch, index).collect()}
    assert all(got[i] == [] for i in range(150)) and got[150] and all(s.path.endswith(".h") for s in got[150])


def test_reranker_of_each_question(spark, index):
    q = {"question": "how do wheels work", "scope": "all", "top_k": 3}
    batch = sources.batch_of(spark, [q, q | {"use_reranker": True}, q | {"use_reranker": False}])
    got = {r.query_id: [(s.path, s.score) for s in r.results.semantic_results] for r in hybrid.run_batch(batch, index).collect()}
    assert got[0] == got[2] != got[1] and got[1][0][0].endswith("notes.txt") and len(got[1]) == 3
    over = {r.query_id: [(s.path, s.score) for s in r.results.semantic_results] for r in hybrid.run_batch(batch, index, use_reranker=True).collect()}
    assert over[0] == over[1] == got[1] and over[2] == got[2]


def test_model_of_each_question(spark, index):
    class Turned(embed.HashEncoder):
        def encode(self, texts):
            return -super().encode(texts)

    more = hybrid.Index(index.chunks, index.definitions, index.encoder, {"turned": Turned(), "short": embed.HashEncoder(8)})
    q = {"question": "how do wheels work", "scope": "all"}
    got = {r.query_id: r for r in hybrid.run_batch(sources.batch_of(spark, [q, q | {"model": "turned"}, q | {"model": "short"}, q | {"model": "none"}]), more).collect()}
    first, second = ({s.path: s.score for s in got[i].results.semantic_results} for i in (0, 1))
    assert first != second and got[2].status == got[3].status == "error"
    assert "8 dimensions (model: short)" in got[2].error and got[3].error == "Unknown model: none"
    assert server.respond(spark, more, "/search?q=x&model=short")[0] == 400 and server.respond(spark, more, "/search?q=wheels&model=turned")[0] == 200


def test_encoded_questions_are_kept(spark, index):
    seen = []

    class Counted(embed.HashEncoder):
        def encode(self, texts):
            seen.extend(texts)
            return super().encode(texts)

    mine = hybrid.Index(index.chunks, index.definitions, Counted())
    a, b = (server.search(spark, mine, "struct FHitInfo", 2, "all") for _ in range(2))
    assert len(seen) == 1 and a["results"] == b["results"] and b["timing"]["total_s"] > 0
    for i in range(hybrid.ENCODED):
        mine.encode(f"q{i}")
    assert len(mine.encoded) == hybrid.ENCODED and mine.encode("q0") and len(seen) == 1 + hybrid.ENCODED


def test_timed_answers_are_the_answers(spark, index):
    q = spark.createDataFrame([(0, "struct FHitInfo", 3, "all"), (1, "how do wheels work", 3, "all"), (2, "", 3, "all")], "query_id long, question string, top_k int, scope string")
    timed = hybrid.timed(q, index)
    plain = hybrid.answer(q, index)
    key = lambda r: r.query_id
    assert sorted(timed.drop("timing").collect(), key=key) == sorted(plain.drop("timing").collect(), key=key)
    t = timed.first().timing
    assert set(t) == {"intent_analysis_s", "definition_s", "semantic_s", "merge_s", "total_s"} and t["total_s"] > 0
    timed.unpersist()


def test_bound_of_the_match(spark):
    import random

    from tessera.functions import similarity

    random.seed(4)
    word = lambda: "".join(random.choice("FUAabcdeHit_") for _ in range(random.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(1500)] + [(w, w + word()) for w in (word() for _ in range(300))] + [("FHit", "hit"), ("", ""), ("a", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.match_quality(F.col("a"), F.col("b")).alias("q"), similarity.may_match(F.col("a"), F.col("b")).alias("m"), similarity.compound(F.col("a"), F.col("b")).alias("c"), similarity.most_compound(F.col("a"), F.col("b")).alias("most")).collect()
    assert all(r.m or r.q == 0 for r in got) and all(r.most >= r.c - 1e-9 or r.a.lower() == r.b.lower() for r in got)
    assert sum(not r.m for r in got) > 300


def test_chunk_columns_that_clash(spark):
    df = spark.createDataFrame([("a", "x" * 2101, 7, "old", 9, 3)], "path string, text string, chunk_index int, chunk_text string, total_chunks int, chars int")
    assert sorted((r.chunk_index, r.total_chunks, r.chars) for r in chunking.window_chunks(df).collect()) == [(0, 2, 2000), (1, 2, 301)]


def test_relationships(spark, index):
    q = spark.createDataFrame([(0, "what does AThing contain"), (1, "relationships of FNothing")], "query_id long, question string")
    got = {r.query_id: r for r in hybrid.relationships(q, index, 2).collect()}
    assert "+-- Inherits: AActor, IUsable" in got[0].tree and "TArray<FHitInfo> Hits (UPROPERTY)" in got[0].tree and got[1].tree is None


def test_formats(spark, index):
    q = spark.createDataFrame([(0, "struct FHitInfo", 3, "all")], "query_id long, question string, top_k int, scope string")
    res = hybrid.answer(q, index).persist()
    out = {k: formats.render(res, k).first().rendered for k in formats.FORMATS}
    assert json.loads(out["json"])["results"]["definitions"][0]["entity_name"] == "FHitInfo"
    assert [json.loads(x)["type"] for x in out["jsonl"].splitlines()][:2] == ["query_metadata", "definition"]
    import xml.etree.ElementTree as ET

    assert ET.fromstring(out["xml"]).find("results/definitions/definition/entity_name").text == "FHitInfo"
    assert "### 1. struct `FHitInfo`" in out["markdown"] and "```cpp" in out["markdown"]
    assert out["code"].startswith("// struct FHitInfo\n// File: ") and out["path"].splitlines()[0].endswith("Hit.h") and "[1] STRUCT FHitInfo" in out["text"]
    assert "definition" not in json.loads(formats.render(res, "json", code=False).first().rendered)["results"]["definitions"][0]


def test_context(spark):
    df = spark.createDataFrame([(0, 1, "A", "a.h", "x" * 10), (0, 2, "B", "b.h", "y" * 500), (0, 3, "C", "c.h", "z"), (1, 1, "D", "d.h", "A" * 100)], "query_id long, rank int, entity_name string, file_path string, definition string")
    got = {r.query_id: r.context for r in reports.context(df, 120).collect()}
    assert list(got) == [0] and "xxxxxxxxxx" in got[0] and "zz" not in got[0] and got[0].startswith("<context>")


def test_rebuild_brake(spark):
    index = spark.range(200).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("engine").alias("origin"), F.lit("s").alias("sha256"))
    none = spark.createDataFrame([], "path string, origin string, text string")
    with pytest.raises(RuntimeError):
        incremental.rebuild(none, index, lambda d: d)
    assert incremental.rebuild(none, index, lambda d: d.select("path", "origin", "sha256"), force=True).count() == 0


def test_moved_and_copied_files_are_indexed(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "path string, sha256 string")
    old = spark.createDataFrame([("a", "1"), ("d", "2")], "path string, sha256 string")
    assert {(r.path, r.state) for r in incremental.changes(new, old).collect()} == {("a", "unchanged"), ("b", "added"), ("c", "added"), ("d", "deleted")}


def test_encoder_that_fails(spark):
    class Bad(embed.HashEncoder):
        def encode(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no memory")
            return super().encode(texts)

    df = spark.createDataFrame([(0, "good one"), (1, "bad one"), (2, None)], "i int, chunk_text string").coalesce(1)
    got = {r.i: any(r.embedding) for r in embed.embed(df, Bad()).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_stream(spark, tree, tmp_path):
    rows = index_stream.stream_files(spark, str(tree / "src"), "engine")
    q = index_stream.keep_index(rows, chunking.chunk_files, str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(60)
    assert {r.path.rpartition("/")[2] for r in index_stream.latest(spark, str(tmp_path / "out")).collect()} >= {"A.h", "C.cpp"}


def test_service(spark, index):
    assert server.respond(spark, None, "/search?q=x")[0] == 503
    assert server.respond(spark, index, "/nothing")[0] == 404 and server.respond(spark, index, "/search?q=x&top_k=0")[0] == 400
    status, body = server.respond(spark, index, "/search?q=struct+FHitInfo&top_k=2&scope=all")
    assert status == 200 and body["metadata"]["definition_count"] >= 1
    assert server.respond(spark, index, "/config")[1]["dimension"] == embed.DIM


def test_whole_texts_are_embedded(spark):
    texts = ["word " * 1000 + "tail", "." * 3000 + " tail", "word " * 1000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, chunk_text string").withColumn("chunk_sha", F.sha2("chunk_text", 256))
    none = spark.createDataFrame([], "chunk_sha string, embedding array<float>")
    got = {r.i: r.embedding for r in embed.embed_missing(rows, none).collect()}
    assert [got[i] for i in range(3)] == [list(map(float, v)) for v in embed.HashEncoder().encode(texts)]
    assert got[0] != got[2] and any(got[1])

    class Short(embed.HashEncoder):
        most_tokens = 512

    assert not any(embed.embed(rows.where("i = 1"), Short()).first().embedding)


@pytest.fixture(scope="module")
def with_long_text(spark, sf_dir, tmp_path_factory):
    """A folder of test tables in which one document, a .cpp file, has 130,000 characters; its last word is its own."""
    top = tmp_path_factory.mktemp("long")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = docs.where("source LIKE '%1'").limit(1).withColumns({"doc_id": F.lit(10**6), "text": F.concat(F.repeat(F.lit("a b c d e\n"), 13_000), F.lit("\nstruct FLast { int32 X; };"))})
    docs.limit(30).unionByName(long).write.parquet(str(top / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(20).write.parquet(str(top / "conversations.parquet"))
    return str(top)


@pytest.mark.parametrize(("module", "name"), [("code_queries", "hybrid_answers"), ("code_queries", "format_outputs"), ("index_queries", "batch_status")])
def test_registered_queries_keep_long_texts(spark, with_long_text, monkeypatch, module, name):
    seen = []
    build = hybrid.Index.build.__func__
    monkeypatch.setattr(hybrid.Index, "build", classmethod(lambda cls, *a, **k: seen.append(build(cls, *a, **k)) or seen[0]))
    from tessera.plans import registry

    registry.QUERIES[name](spark, with_long_text)
    ends = seen[0].chunks.where("path LIKE '%1000000.%'").agg(F.max("chunk_index"), F.max(F.array_contains("entities", "FLast"))).first()
    assert ends[0] > 60 and ends[1]
    spark.catalog.clearCache()


def test_all_chunks_are_enriched_again(spark, with_long_text):
    from tessera.plans import registry

    rows = registry.QUERIES["re_enriched_chunks"](spark, with_long_text).where("path LIKE '%1000000.%'").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and len(rows) > 95 and "FLast" in rows[-1].entities


def test_a_bad_text_costs_a_logarithm_of_calls():
    class Counting(embed.HashEncoder):
        def __init__(self, most=10**9):
            super().__init__()
            self.calls, self.most = [], most

        def encode(self, texts):
            self.calls.append(len(texts))
            if "bad" in texts or len(texts) > self.most:
                raise RuntimeError("out of memory")
            return super().encode(texts)

    texts = [f"t{i}" for i in range(1024)]
    want = embed.HashEncoder().encode(texts)
    enc = Counting()
    assert (embed.encoded(enc, texts, 512) == want).all() and enc.calls == [512, 512]
    texts[300] = "bad"
    got = embed.encoded(enc := Counting(), texts, 512)
    assert not got[300].any() and (got[:300] == want[:300]).all() and (got[301:] == want[301:]).all()
    assert len(enc.calls) <= 1 + 2 * 9 + 2 and enc.calls[-2:] == [256, 256]  # later batches stay small
    got = embed.encoded(enc := Counting(most=100), [f"t{i}" for i in range(1024)], 512)
    assert (got == want).all() and enc.calls[-1] <= 100 and sum(c > 100 for c in enc.calls) <= 11
    assert embed.encoded(Counting(), [], 512).shape == (0, embed.DIM)


def test_reachable_at_any_depth(spark):
    from tessera.operators import relations

    chain = [(f"c{i}", f"c{i + 1}") for i in range(1000)]
    rows = [*chain, ("x", "y"), ("y", "z"), ("z", "x"), ("z", "z"), ("z", "q"), ("x", None), (None, "x"), ("x", "y")]
    e = spark.createDataFrame(rows, "src string, dst string")
    roots = spark.createDataFrame([("c0",), ("c990",), ("x",), ("alone",), ("x",)], "root string")
    got = {(r.root, r.node): r.hops for r in relations.reachable(e, roots).collect()}
    want = {("c0", f"c{i}"): i for i in range(1001)} | {("c990", f"c{i}"): i - 990 for i in range(990, 1001)}
    want |= {("x", "x"): 0, ("x", "y"): 1, ("x", "z"): 2, ("x", "q"): 3, ("alone", "alone"): 0}
    assert got == want
    near = {(r.root, r.node): r.hops for r in relations.reachable(e, roots, 2).collect()}
    assert near == {k: v for k, v in want.items() if v <= 2}


def test_reasons_for_an_intent(spark, index):
    got = ask(spark, index, "struct FHitInfo", "function Tick", "FVector", "FHitInfo members of it today", "how do wheels work", "where is the header of the wheel", "nothing much here", "")
    assert [got[i].intent.reasoning for i in range(8)] == [
        "Explicit definition query detected: struct FHitInfo", "Function definition query detected: Tick", "Bare entity name detected: struct FVector",
        "Detected entity 'FHitInfo' with definition keywords, using hybrid search", "Conceptual question detected, using semantic search", "File/Location query detected", "No strong indicators, defaulting to semantic search", None,
    ]


def test_late_interaction(spark, index):
    """Against plain loops, and in an answer, where both scores stay and only over-fetched hits are looked at."""
    from tessera.operators import late, scoring

    enc = late.TokenEncoder()
    assert enc.tokens("FHitResult's wheelRPM2 x_y é") == ["f", "hit", "result", "s", "wheel", "rpm", "2", "x", "_", "y", "é"]
    texts = ["The hitting result of wheels", "", None, "nothing near", "FHitResult", "wheel " * 5000 + "hit", "é"]
    rows = [(q, i, t) for q in ("hit results", "FHitResult wheels", "", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(str(q), 1.0 / (i + 1), i, q, t or "", "p") for q, i, t in rows], "query_id string, score double, chunk_id int, question string, chunk_text string, path string")

    def plain(q, t):
        a, b = (list(dict.fromkeys(enc.tokens(x))) for x in (q, t))
        return sum(max(float(enc.vector(x) @ enc.vector(y)) for y in b) for x in a) / len(a) if a and b else 0.0

    got = scoring.rerank(df, 10, late.scorer()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.rerank_score - plain(r.question, r.chunk_text)) < 1e-9 and r.vector_score == 1.0 / (r.chunk_id + 1) and r.score == r.rerank_score
    order = [r.chunk_text for r in sorted((r for r in got if r.query_id == "hit results"), key=lambda r: r["rank"])]
    assert order[0] == "FHitResult" and order.index("The hitting result of wheels") < order.index("nothing near")
    out = ask(spark, index, "how do wheels work", use_reranker=True)[0].semantic_results
    assert len(out) == 3 and [s.score for s in out] == sorted((s.score for s in out), reverse=True)


def test_requests_that_come_together(spark, index):
    """Concurrent requests share plans; each has its own answer, a bad one fails alone, and they are faster than one after the other."""
    import threading
    import time

    asked = ["struct FHitInfo", "how do wheels work", "class AThing", "EChannel", "FPlain members", "where is the wheel header"] * 4
    alone = {q: server.search(spark, index, q, 2, "all") for q in set(asked)}
    g = server.Gatherer(spark, index, wait_s=0.2, workers=2)
    got: dict[int, dict] = {}
    began = time.perf_counter()
    threads = [threading.Thread(target=lambda i=i, q=q: got.update({i: g.search(q, 2, "all")})) for i, q in enumerate(asked)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    together = time.perf_counter() - began
    for i, q in enumerate(asked):
        assert {k: v for k, v in got[i].items() if k != "timing"} == {k: v for k, v in alone[q].items() if k != "timing"}
    assert sum(g.sizes) == len(asked) and len(g.sizes) <= 6 and max(r["timing"]["answered_together"] for r in got.values()) > 4
    assert together < sum(alone[q]["timing"]["total_s"] for q in asked)
    # a model that isn't known fails its own request alone
    results: dict[str, object] = {}

    def try_(q, model):
        try:
            results[q] = g.search(q, 2, "all", model)
        except Exception as e:
            results[q] = e

    threads = [threading.Thread(target=try_, args=x) for x in (("struct FHitInfo", None), ("class AThing", "unknown"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert isinstance(results["class AThing"], Exception) and results["struct FHitInfo"]["results"]
    g.close()
    assert not any(w.is_alive() for w in g.workers)


def test_counts_and_seconds_of_an_answer(spark, index):
    """By the answer's own job: counters are those of its results, and the phase before it is in its rows."""
    q = spark.createDataFrame([(i, t, 3, "all") for i, t in enumerate(["struct FHitInfo", "how do wheels work", ""])], "query_id long, question string, top_k int, scope string")
    watch = hybrid.Watch()
    rows = hybrid.answer(q, index, watch=watch).collect()
    counts = watch.counts()
    assert counts["questions"] == 3 and counts["definitions"] >= sum(len(r.definition_results) for r in rows) > 0
    assert counts["chunks"] >= sum(len(r.semantic_results) for r in rows) > 0
    assert all(r.timing.keys() == {"intent_analysis_s"} and r.timing["intent_analysis_s"] == watch.seconds["intent_analysis_s"] > 0 for r in rows)
    one = hybrid.answer_one(spark, index, "struct FHitInfo", scope="all").first()
    assert one.timing.keys() == {"intent_analysis_s", "encode_s"}


def test_pairs_of_many_questions_are_one_plan(spark):
    """However many questions there are, no part of the plan is there once for each block of them, and every chunk meets every question."""
    chunks = spark.range(7).select(F.col("id").alias("chunk_id"), F.lit("t").alias("text"))
    for n, most in ((3, 5), (60, 10), (60, 5)):  # questions are few; chunks are; neither is
        asked = spark.range(n).select(F.col("id").alias("query_id"))
        pairs = scoring.with_questions(chunks, asked, most=most)
        assert pairs.columns == ["chunk_id", "text", "query_id"]
        assert sorted((r.chunk_id, r.query_id) for r in pairs.collect()) == [(c, q) for c in range(7) for q in range(n)]
        assert "Union" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_settled_rows_are_computed_once(spark, monkeypatch):
    """More rows than go through the driver stay persisted from their first computation on."""
    monkeypatch.setattr(hybrid, "SETTLED", 10)
    for n, cached in ((8, False), (40, True)):
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        rows = hybrid.settled(spark.range(0, n, 1, 1).mapInArrow(count, "id long"))
        assert rows.count() == n and rows.count() == n and seen.value == n and rows.is_cached == cached
        rows.unpersist()


@given(st.lists(st.one_of(st.text(max_size=60), st.from_regex(r"([A-Z]{0,2}[a-zé0-9_ ]{1,9}){1,12}", fullmatch=True)), max_size=4), st.sampled_from([64, 7]))
@settings(max_examples=80, deadline=None)
def test_hash_encoder_by_its_words(texts, dim):
    """Counted words and known places give the vectors that single words and their parts add up to."""
    want = np.zeros((len(texts), dim))
    for row, text in zip(want, texts, strict=True):
        for w in re.findall(r"\w+", text):
            for part in (w.lower(), *re.findall(r"[A-Z]?[a-z0-9]+", w)):
                h = zlib.crc32(part.lower().encode())
                row[h % dim] += 1.0 if h >> 31 else -1.0
    norm = np.sqrt((want * want).sum(1, keepdims=True))
    want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 0).astype(np.float32)
    assert (embed.HashEncoder(dim).encode(texts) == want).all()


def test_a_word_is_hashed_once():
    """A repeated word costs a look-up, not another hash; very long ones aren't kept."""
    embed.places.cache_clear()
    embed.HashEncoder().encode(["FHitInfo fooBar fooBar", "fooBar FHitInfo " + "x" * 1000])
    assert embed.places.cache_info()[:2] == (2, 2) and embed.places.cache_info().currsize == 2


LETTERS = st.sampled_from(list("aZb9_ \n.éÈΣσſİKßȺ中𐐀") + ["FHitInfo ", "fooBar", "ABC ", "x" * 70, "Été9a ", "ΑΣ "])


@given(st.lists(st.one_of(st.lists(LETTERS, max_size=40).map("".join), st.text(max_size=60)), min_size=1, max_size=6), st.sampled_from([64, 7]))
@settings(max_examples=150, deadline=None)
def test_all_words_at_once(texts, dim):
    assert (embed.at_once(texts, dim) == embed.by_word(texts, dim)).all()


def test_many_words_are_hashed_at_once(monkeypatch):
    """Longer texts cost no look-up a word; those over MOST characters are cut between words, and add up to the same."""
    texts = ["", None, "FHitInfo fooBar é " * 400, "ab", "w1 élan_X " * 900 + "x" * 3000, "y" * 3000]
    want = np.concatenate([embed.by_word([t or ""], 64) for t in texts])
    norm = np.sqrt((want * want).sum(1, keepdims=True))
    want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 0).astype(np.float32)
    monkeypatch.setattr(embed, "places", None)
    for most in (embed.MOST, 5000):
        monkeypatch.setattr(embed, "MOST", most)
        monkeypatch.setattr(embed, "FEW", 0)
        assert (embed.HashEncoder().encode(texts) == want).all()


@given(st.lists(st.sampled_from(["class A {\n", "  struct ENGINE_API FB : public C\n{", "void F() {\n", "word word\n", "int X(int y) const\n{\n", "(", ")", "\n\n", "UPROPERTY (\n", "}\n", "/**\n", "enum class E : int {", "namespace n {\n", "// ------\n", "DECLARE_X_DELEGATE(a, b)\n", ";"]), max_size=30).map("".join))
@settings(max_examples=150, deadline=None)
def test_patterns_are_tried_where_they_can_match(text):
    spans = lambda found: [m.span() for m in found]
    for p, (words, end) in zip(chunking.BOUNDARIES, chunking.MARKS, strict=True):
        assert spans(matching.matches_in(p, text, words, end)) == spans(p.finditer(text))
    for kind, p in definitions.STARTS.items():
        word, end = definitions.MARKS[kind]
        assert spans(matching.matches_in(p, text, (word,), end)) == spans(p.finditer(text))


def test_patterns_leave_prose_alone():
    class Never:
        def finditer(self, text, start=0, stop=None):
            assert text[:stop].endswith("{")
            return iter(())

    for text in ("struct of words, " * 9, "no mark {}", "struct A {} " + "word " * 9):
        assert list(matching.matches_in(Never(), text, ("struct",), "{")) == []


def test_chunks_say_what_they_hold(spark):
    """Structure-aware chunks come from Python without their file's text, in one step with the overlap, and with the words by which they are searched."""
    texts = ["UPROPERTY(x) struct FA {\n" + "word é " * 700 + "\n\nenum class EB {" + " z" * 1500, "", None, "class UC { UCLASS (", "s" * 5000]
    files = spark.createDataFrame([(f"/{i}.h", i, t) for i, t in enumerate(texts)], "path string, i int, text string")
    told = chunking.chunk_files(files, words=enrich.WORDS, most_chars=None)
    plain = chunking.chunk_files(files, most_chars=None)
    assert [c for c in told.columns if c != chunking.HOLDS] == plain.columns == ["path", "i", "total_chunks", "chunk_index", "chunk_text", "chars"]
    rows = sorted(plain.collect(), key=lambda r: (r.i, r.chunk_index))
    for i, t in enumerate(texts):
        parts = chunking.structured(t or "", overlap=chunking.OVERLAP)
        want = [x + y[:200] if len(x) + len(y[:200]) <= chunking.SIZE else x for x, y in zip(parts, [*parts[1:], ""], strict=True)]
        assert [(r.chunk_index, r.total_chunks, r.chunk_text, r.chars) for r in rows if r.i == i] == [(k, len(want), x, len(x)) for k, x in enumerate(want)]
    assert sorted(enrich.enrich(told).collect()) == sorted(enrich.enrich(plain).collect())
    assert "text" not in [a.name() for a in _attributes(told, "MapInArrow")]


def _attributes(df, node):
    """What the plan's first node of that kind gives."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() != node:
        plan = plan.children().head()
    out = plan.output()
    return [out.apply(i) for i in range(out.size())]


@pytest.mark.parametrize("name", ["hybrid_answers", "format_outputs"])
def test_single_answers_hold_no_chunks(spark, with_long_text, monkeypatch, name):
    seen = []
    build = hybrid.Index.build.__func__
    monkeypatch.setattr(hybrid.Index, "build", classmethod(lambda cls, *a, **k: seen.append(build(cls, *a, **k)) or seen[0]))
    from tessera.plans import registry

    registry.QUERIES[name](spark, with_long_text)
    assert not seen[0].chunks.is_cached and seen[0].definitions.is_cached
    spark.catalog.clearCache()


def test_scores_make_what_they_look_into_once_a_chunk(spark):
    """Lower-case names and paths are below the pairs of the plan, not in each pair's score."""
    c = spark.createDataFrame([(1, "/a/Wheel.h", "engine", ["UWheel"], [0.5, 0.5])], "chunk_id long, path string, origin string, entities array<string>, embedding array<float>")
    c = c.withColumns({x: F.lit(False) for x in ("has_uproperty", "has_ufunction", "has_uclass", "has_ustruct", "is_header", "is_implementation")})
    q = spark.createDataFrame([(0, ["wheel", "a"], [1.0, 1.0], "semantic", "all")], "query_id long, tokens array<string>, vector array<double>, type string, scope string").withColumn("boost_entities", F.array().cast("array<string>"))
    out = scoring.scores(c, q)
    assert out.first().score == pytest.approx(1.0 + scoring.IN_NAME + scoring.IN_ENTITY + scoring.IN_PATH)
    above = out._jdf.queryExecution().optimizedPlan().toString().partition("Join")[0]
    assert "split(lower(" not in above and "__name" not in out.columns


def test_plans_on_many_questions_hold_no_analysis(spark, index, monkeypatch):
    """What analyses many questions stands in no plan on top of them; they are the same as those that go through the driver."""
    asked = spark.createDataFrame([(i, f"struct FHitInfo{i} members", 5, "all") for i in range(8)], "query_id long, question string, top_k int, scope string")
    few = hybrid.analyse(asked, index)
    monkeypatch.setattr(hybrid, "SETTLED", 3)
    many = hybrid.analyse(asked, index)
    assert many.is_cached and "EvalPython" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    many.unpersist()
