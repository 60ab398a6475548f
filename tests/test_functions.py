"""Names, versions, similarity, intents."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import naming, numbers, similarity
from tessera.operators import filters, intent, reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "want"), [("5.3", "5.3.2", True), ("5.3", "5.4", False), ("4.27", "5.3", False), ("4.27", "5.27", False)])
def test_versions(spark, a, b, want):
    assert one(spark, naming.versions_match(F.lit(a), F.lit(b))) is want


@pytest.mark.parametrize("text", ["invalid", ""])
def test_bad_version(spark, text):
    assert one(spark, naming.version_parts(F.lit(text))) == [0, 0, 0]


@pytest.mark.parametrize(("path", "want"), [("/a//b/./c/", "/a/b/c"), ("a\\b", "a/b"), ("/", "/"), ("./x", "x")])
def test_norm_path(spark, path, want):
    assert one(spark, naming.norm_path(F.lit(path))) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.H", ".h"), ("a/.gitignore", ""), ("a.b/c", ""), ("x.tar.gz", ".gz")])
def test_suffix(spark, path, want):
    assert one(spark, naming.suffix(F.lit(path))) == want


def test_jaro_winkler_known():
    assert similarity.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler_of("", "a") == 0.0
    assert similarity.jaro_winkler_of("", "") == 1.0


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
def test_jaro_winkler_bounds(a, b):
    assert 0 <= similarity.jaro_winkler_of(a, b) <= 1
    assert (similarity.jaro_winkler_of(a, b) == 1) == (a == b)


INTENTS = [
    *((q, "definition", "struct", "FHitResult", 0.95) for q in ("struct FHitResult", "FHitResult struct", "definition of FHitResult", "define FHitResult", "what is FHitResult")),
    *((q, "definition", "class", "AActor", 0.95) for q in ("class AActor", "AActor class", "show me AActor", "define AActor")),
    ("find ECollisionChannel", "definition", "enum", "ECollisionChannel", 0.95), ("show me FVector", "definition", "struct", "FVector", 0.95),
    ("FVector", "definition", "struct", "FVector", 0.85), ("AActor", "definition", "class", "AActor", 0.85),
    ("LineTraceSingleByChannel function", "definition", "function", "LineTraceSingleByChannel", 0.9),
    ("FHitResult members", "hybrid", "struct", "FHitResult", 0.75), ("AActor methods", "hybrid", "class", "AActor", 0.75), ("LineTraceSingleByChannel parameters", "hybrid", "function", "LineTraceSingleByChannel", 0.75),
    *((q, "semantic", None, None, 0.9) for q in ("how does garbage collection work", "explain replication", "best practices for networking")),
    *((q, "semantic", None, None, 0.5) for q in ("FVector math calculation", "list ECollisionChannel values please", "The FVector usage is amazing")),
    ("", "unknown", None, None, 0.0), ("   ", "unknown", None, None, 0.0), (None, "unknown", None, None, 0.0),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(INTENTS)], "i int, q string").withColumn("x", intent.intent(F.col("q")))
    got = {r.i: r.x for r in df.collect()}
    for i, (q, *want) in enumerate(INTENTS):
        assert [got[i].type, got[i].entity_type, got[i].entity_name, got[i].confidence] == want, q


@pytest.mark.parametrize(("q", "word"), [("AActor methods", "UFUNCTION"), ("LineTraceSingleByChannel parameters", "UFUNCTION"), ("FVector math calculation", "struct"), ("list ECollisionChannel values please", "UENUM")])
def test_enhanced(spark, q, word):
    assert word in one(spark, intent.intent(F.lit(q))).enhanced_query.split()


@pytest.mark.parametrize("text", ["type:struct", "type:struct AND macro:UPROPERTY", "type:class AND origin:engine", "entity:FHitResult AND file:header", "type:struct AND boost:macros", "type:class AND macro:UCLASS AND origin:engine", "", None])
def test_filters_parse(text):
    filters.parse_filter(text)


@pytest.mark.parametrize("text", ["invalid syntax", "type:invalid", "macro:UNKNOWN", "color:red", "origin:moon", "file:x", "boost:y"])
def test_filters_refuse(text):
    with pytest.raises(ValueError, match="Supported syntax"):
        filters.parse_filter(text)


def test_filter_details():
    f = filters.parse_filter("entity:A AND entity:B AND macro:ufunction junk AND type:ENUM")
    assert (f.entity, f.boost_entities, f.has_ufunction, f.entity_type) == ("B", ["A", "B"], True, "enum")


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.h", "a.h", "a.hpp"), ("a?c", "abc", "ac"), ("[!x]y", "ay", "xy"), ("[a-c]1", "b1", "d1"), ("a+b(", "a+b(", "aab(")])
def test_globs(spark, glob, yes, no):
    assert one(spark, F.lit(yes).rlike(filters.glob_pattern(glob))) and not one(spark, F.lit(no).rlike(filters.glob_pattern(glob)))


def test_dimension_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    assert filters.check_dimension(df, [0.0, 0.0]).count() == 1
    with pytest.raises(Exception, match="Dimension mismatch"):
        filters.check_dimension(df, [0.0]).collect()


def test_fixed_prints_as_python(spark):
    # 0.0625 and 0.1875 are ties in binary; 0.0125, 0.0005 and 1.0005 only look like ones
    xs = [0.0, -0.0, 0.0625, 0.1875, -0.0625, 0.0125, 0.0375, 0.0005, 0.0015, 1.0005, 2.0005, 0.9995, 0.99949999, -1e-9, 1 / 3, 123456.7895, 999.9995, 5e-324, 2.5, *(k / n for n in (16, 80, 400, 2000) for k in range(n))]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: (r.a, r.b) for r in df.select("i", numbers.fixed(F.col("x"), 3).alias("a"), numbers.fixed(F.col("x"), 1).alias("b")).collect()}
    assert got == {i: (f"{x:.3f}", f"{x:.1f}") for i, x in enumerate(xs)}
    assert df.where("i = 2").select(reports.progress(F.lit("batch at 12.25%"))["message"]).first()[0] == "Generating embeddings (12.2%)..."


def test_prompt_scores_print_as_python(spark):
    hits = spark.createDataFrame([(0, "q", 1, 0.0625, "p", 0, 1, "t")], "query_id int, question string, rank int, score double, path string, chunk_index int, total_chunks int, chunk_text string")
    assert "[Doc 1 score=0.062 path=p chunk=1/1]" in reports.prompt(hits).first().prompt
