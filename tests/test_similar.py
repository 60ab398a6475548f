"""The similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.similarity import match_quality
from tessera.operators import definitions, similar
from tessera.plans import fixtures
from tessera.plans.code_queries import WANTED


def names(seed, n, letters, most):
    rnd = random.Random(seed)
    out = {"", "A", "a", "FHitInfo", "UHitInfo", "hitinfo", "HitInfo", "xHitInfoy", "éÉ", "Ünïcode", "aaaaaa", "abababab", "FF", "\U0001f600b"}
    while len(out) < n:
        out.add(rnd.choice(["", "", "F", "U", "A"]) + "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most))))
    return sorted(out)


@pytest.mark.parametrize(("letters", "most"), [("abcd", 7), ("abcdefghXY_1", 12), ("abcdefghijklmnopqrstuvwxyz", 30)])
@pytest.mark.parametrize("most_asked", [10_000, 5])
def test_no_match_is_lost(spark, letters, most, most_asked):
    there = spark.createDataFrame([(n, k) for i, n in enumerate(names(1, 300, letters, most)) for k in ("struct", "class")[: 1 + i % 2]] + [(None, "struct"), ("abc", None)], "entity_name string, kind string")
    asked = spark.createDataFrame([(n, "struct") for n in names(2, 60, letters, most)] + [("abc", None), (None, "struct")], "name string, kind string")
    pairs = asked.join(there, asked["kind"].eqNullSafe(there["kind"])).drop(there["kind"]).where("name IS NOT NULL AND entity_name IS NOT NULL")
    want = {tuple(r): q for *r, q in pairs.select("name", "entity_name", "kind", match_quality(F.col("name"), F.col("entity_name")).alias("q")).where("q > 0").collect()}
    got = similar.similar(asked, there, ["kind"], most_asked).collect()
    assert {(r.name, r.entity_name, r.kind): r.match_quality for r in got} == want and len(got) == len(want) > 100
    met = similar.candidates(asked.where("name IS NOT NULL"), there.where("entity_name IS NOT NULL"), ["kind"], most_asked).count()
    assert len(want) <= met < pairs.count()
    if most > 20:
        assert met < pairs.count() / 2


def test_all_documents_names(spark, sf_dir):
    """Of all names of a kind with all that are asked, few meet; those that match are all there."""
    defs = definitions.definitions(fixtures.code(spark, sf_dir)).persist()
    kinds = F.when(F.col("entity_type") == "delegate", "function").otherwise(F.col("entity_type")).alias("kind")
    there, asked = defs.select("entity_name", kinds).distinct(), spark.createDataFrame(WANTED, "query_id long, name string, kind string, scope string")
    pairs = asked.select("name", "kind").distinct().join(there, "kind")
    want = {tuple(r) for r in pairs.select("name", "entity_name", "kind").where(match_quality(F.col("name"), F.col("entity_name")) > 0).collect()}
    met = {tuple(r) for r in similar.candidates(asked, there, ["kind"]).collect()}
    assert want and want <= met and len(met) < pairs.count() / 3
    defs.unpersist()


def test_asked_names_are_broadcast_behind_a_count(spark):
    a, b = spark.createDataFrame([("abc", "k")], "name string, kind string"), spark.createDataFrame([("abd", "k")], "entity_name string, kind string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(similar.candidates(a, b, ["kind"])) and "strategy=broadcast" not in plan(similar.candidates(a, b, ["kind"], 0))


def test_whole_questions_as_names_are_not_sent(spark):
    """A few asked names that are as long as questions take much as rows: the names are sent to them, or both are dealt, and no match is lost."""
    rnd = random.Random(3)
    long = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ,.") for _ in range(300)) for _ in range(25)]
    short = ["", "a", "F", "FHitInfo", "hitinfo", *(q[5:40] for q in long[:4])]
    changed = [q[:150] + "xyz" + q[170:] for q in long[:3]]
    asked = spark.createDataFrame([(n, "struct") for n in [*long, *short, long[0].upper(), "A", "UHitInfo"]] + [(None, "struct"), ("abc", None)], "name string, kind string").where("name IS NOT NULL")
    there = spark.createDataFrame([(n, "struct") for n in [*short, *changed, "f", "b"]] + [("abc", None)], "entity_name string, kind string")
    pairs = asked.join(there, asked["kind"].eqNullSafe(there["kind"])).drop(there["kind"])
    want = {tuple(r): q for *r, q in pairs.select("name", "entity_name", "kind", match_quality(F.col("name"), F.col("entity_name")).alias("q")).where("q > 0").collect()}
    assert any(len(n) == 300 for n, _, _ in want)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for most_asked, sent, told in ((10_000, True, "strategy=broadcast"), (5, False, "strategy=merge")):
        met = plan(similar.candidates(asked, there, ["kind"], most_asked))
        assert "rightHint=(strategy=broadcast)" not in met and ("leftHint=(strategy=broadcast)" in met) == sent and told in met
        got = similar.similar(asked, there, ["kind"], most_asked).collect()
        assert {(r.name, r.entity_name, r.kind): r.match_quality for r in got} == want and len(got) == len(want)
