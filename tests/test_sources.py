"""Trees walked by executors, stores with snapshots, batches as streams."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import batches
from tessera.sources import files as sources
from tessera.sources import tree
from tessera.sources.snapshots import Store


def make(top, files):
    for path, text in files.items():
        to = top / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(text if isinstance(text, bytes) else text.encode())


FILES = {
    "a/A.h": b"struct FA {};\r\n\xff", "a/Intermediate/B.h": "x", "a/sub/C.cpp": "c", "a/sub/deep/er/D.H": "d", "a/sub/deep/skip/E.h": "e", "a/sub/deep/skip/er/F.h": "f", "a/other/skip/G.h": "g", "a/sub/x.gen.h": "h", "a/sub/deep/y.gen.h": "i",
    "a/x.gen.h": "j", "a/sub/no.txt": "k", "a/.indexignore": "# nothing\n\nGone/\n", "a/Gone/Z.h": "z", "a/sub/.indexignore": "*.gen.h\n", "a/sub/deep/.indexignore": "skip\n", "b/H.h": "l",
}
LEFT = ["a/A.h", "a/sub/C.cpp", "a/sub/deep/er/D.H", "a/other/skip/G.h", "a/x.gen.h"]


@pytest.mark.parametrize("partitions", [1, 3, 100])
def test_walk_by_rules(spark, tmp_path, partitions):
    """However the tree is dealt out, rules hold for their own folder and below it."""
    make(tmp_path, FILES)
    df = tree.walk(spark, {"engine": [str(tmp_path / "a")]}, partitions=partitions)
    got = {r.path: r for r in df.collect()}
    assert sorted(got) == sorted(str(tmp_path / p) for p in LEFT)
    assert got[str(tmp_path / "a/A.h")].text == "struct FA {};\n" and got[str(tmp_path / "a/A.h")].bytes == 16
    # without ignore files it is what the scan finds
    for p in tmp_path.rglob(".indexignore"):
        p.unlink()
    a, b = (sorted(map(tuple, x.select("path", "origin", "ext", "category", "bytes", "text", "sha256").collect())) for x in (tree.walk(spark, {"engine": [str(tmp_path / "a")]}, exclude=["x*"]), sources.scan(spark, {"engine": [str(tmp_path / "a")]}, exclude=["x*"])))
    assert a == b and len(a) > len(LEFT)


def test_roots_in_roots(spark, tmp_path):
    make(tmp_path, FILES)
    df = tree.walk(spark, {"project": [str(tmp_path / "a/sub/deep"), str(tmp_path / "b")], "engine": [str(tmp_path / "a"), str(tmp_path / "none")]}, text=False)
    got = {os.path.relpath(r.path, tmp_path): r.origin for r in df.collect()}
    assert df.columns == ["path", "origin", "ext", "category", "bytes", "modified"]
    assert got == {**dict.fromkeys(LEFT, "engine"), "a/sub/deep/y.gen.h": "engine", "b/H.h": "project"}  # a root of its own has only rules of its own
    assert tree.walk(spark, {"x": [str(tmp_path / "none")]}).count() == 0
    with pytest.raises(ValueError):
        tree.walk(spark, {})


def test_ignored_folders_are_never_listed(tmp_path):
    make(tmp_path, FILES)
    os.symlink(tmp_path / "a", tmp_path / "a/sub/loop")
    walker = tree.Walker("/", {str(tmp_path / "a"): "engine"}, (".h",))
    parts = walker.partitions(tree.Rules(frozenset({"Intermediate"})), 3)
    assert len(parts) <= 4 and len(walker.listed) <= 3
    found = [x.path for p in parts for x in walker.files(p)]
    assert len(found) == len(set(found)) == 4
    listed = {os.path.relpath(x, tmp_path) for x in walker.listed}
    assert listed == {"a", "a/sub", "a/sub/deep", "a/sub/deep/er", "a/other", "a/other/skip"}


def test_written_tree_is_read_again(spark, tmp_path):
    rows = [("x/1.h", "one"), ("x/y/2.h", ""), ("3.h", None)]
    assert tree.write_tree(spark.createDataFrame(rows, "path string, text string"), str(tmp_path)) == 3
    assert tree.write_tree(spark.createDataFrame(rows, "path string, text string").where("path = '3.h'"), str(tmp_path)) == 1
    got = {os.path.relpath(r.path, tmp_path): r.text for r in tree.walk(spark, {"e": [f"file://{tmp_path}"]}).collect()}
    assert got == {p: t or "" for p, t in rows} and not list(tmp_path.rglob("*.part"))
    assert tree.walk(spark, {"e": [str(tmp_path)]}).groupBy(F.spark_partition_id()).count().count() == 3


def store_files(spark, rows):
    return spark.createDataFrame(rows, "path string, origin string, text string")


def by_words(files):
    return files.select("path", "origin", F.posexplode(F.split("text", " ")).alias("chunk_index", "chunk_text"))


def texts(df):
    return sorted((r.path, r.version, r.chunk_text) for r in df.collect())


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=5)
    assert store.current() == 0 and store.manifest() is None and store.listing().count() == 0
    with pytest.raises(ValueError):
        store.read()
    one = [("a", "engine", "x y"), ("b", "engine", "z"), ("c", "project", "w"), ("d", None, ""), (None, "engine", "no path"), ("a", "engine", "x y")]
    assert store.commit(store_files(spark, one), by_words).states == {"added": 4}
    assert texts(store.read()) == [("a", 1, "x"), ("a", 1, "y"), ("b", 1, "z"), ("c", 1, "w"), ("d", 1, "")]
    two = [("a", "engine", "x y"), ("b", "engine", "zz"), ("c", "engine", "w"), ("e", "project", "new")]
    assert store.commit(store_files(spark, two), by_words).states == {"unchanged": 1, "edited": 2, "deleted": 1, "added": 1}
    assert texts(store.read()) == [("a", 1, "x"), ("a", 1, "y"), ("b", 2, "zz"), ("c", 2, "w"), ("e", 2, "new")]
    assert texts(store.read("project")) == [("e", 2, "new")] and texts(store.read("project", 1)) == [("c", 1, "w")]
    # a reader in another session's place sees the same
    assert texts(Store(spark, str(tmp_path / "store")).read(version=1)) == [("a", 1, "x"), ("a", 1, "y"), ("b", 1, "z"), ("c", 1, "w"), ("d", 1, "")]
    assert store.commit(store_files(spark, two), by_words).states == {"unchanged": 4}
    assert store.expire(1) == [] and texts(store.read()) == [("a", 1, "x"), ("a", 1, "y"), ("b", 2, "zz"), ("c", 2, "w"), ("e", 2, "new")]
    with pytest.raises(ValueError):
        store.read(version=1)
    store.commit(store_files(spark, [("q", "engine", "all new")]), by_words)
    assert store.expire(1) == [1, 2, 3] and texts(store.read()) == [("q", 4, "all"), ("q", 4, "new")]
    store.forget()


def test_a_failed_run_leaves_the_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=3)
    rows = [(f"p{i}", "engine", str(i)) for i in range(150)]
    store.commit(store_files(spark, rows), by_words)
    before = texts(store.read())

    def breaks(files):
        return by_words(files).withColumn("chunk_text", F.when(F.col("path") == "p7", F.raise_error(F.lit("lost"))).otherwise(F.col("chunk_text")))

    changed = store_files(spark, [(p, o, t + "!") for p, o, t in rows])
    with pytest.raises(Exception, match="lost"):
        store.commit(changed, breaks)
    with pytest.raises(RuntimeError, match="engine"):
        store.commit(store_files(spark, [("x", "project", "y")]), by_words)
    with pytest.raises(ValueError, match="columns"):
        store.commit(changed, lambda f: by_words(f).withColumn("more", F.lit(1)))
    assert store.current() == 1 and texts(store.read()) == before
    assert store.commit(changed, by_words).states == {"edited": 150}  # what the failed runs left is gone
    assert texts(store.read()) == sorted((p, 2, t + "!") for p, _, t in rows)
    store.forget()


@pytest.mark.parametrize("buckets", [3, 4, 16])
def test_the_store_is_not_shuffled(spark, tmp_path, buckets):
    """Neither to read a snapshot nor to compare a new run with it, whatever the number of shuffle partitions; a scope reads its folders alone."""
    store = Store(spark, str(tmp_path), buckets)
    rows = store_files(spark, [(f"p{i}", "engine" if i % 2 else "project", str(i)) for i in range(40)])
    store.commit(rows, by_words)
    store.commit(rows.where("path <> 'p3'"), by_words)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = plan(store.read("engine"))
        assert "Exchange" not in read and read.count(f"SelectedBucketsCount: {buckets} out of {buckets}") >= 2 and "/origin=project" not in read
        probe = plan(store.changes(rows.select("path", "origin", F.sha2("text", 256).alias("sha256"))))
        new, _, stored = probe.partition("FileScan parquet")
        assert new.count("Exchange") == 1 and "Exchange" not in stored and f"SelectedBucketsCount: {buckets} out of {buckets}" in stored
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        store.forget()


def test_stream_of_batches_resumes(spark, tmp_path):
    """A driver lost between a micro-batch's results and its offsets, or in the middle of them: every line is answered once."""
    import json

    from tessera.plans import fixtures, hybrid
    from tessera.streaming import batch_stream

    (tmp_path / "in").mkdir()
    for i in range(3):
        lines = [json.dumps({"question": f"struct FHitInfo {i}{j}", "top_k": 1, "scope": "all", "show_reasoning": j == 0}) for j in range(3)]
        (tmp_path / f"in/{i}.jsonl").write_text("\n".join([lines[0], "", *lines[1:], "broken"]) + "\n")
    (tmp_path / "in/blank.jsonl").write_text("\n \n")
    index, calls = hybrid.Index.build(fixtures.code(spark)).kept(), []
    real, out = batch_stream.answer_lines, str(tmp_path / "out")

    def run(answer):
        batch_stream.answer_lines = answer
        try:
            stream = batch_stream.stream_lines(spark, str(tmp_path / "in"), files_at_once=1)
            batch_stream.answer_stream(stream, index, out, str(tmp_path / "checkpoint"), once=True).awaitTermination()
        finally:
            batch_stream.answer_lines = real

    def lost_after(lines, index, **options):
        real(lines, index, **options).write.mode("overwrite").parquet(f"{out}/batch={len(calls)}")
        calls.append(lines.count())
        if len(calls) == 2:
            raise RuntimeError("the driver is lost")
        return real(lines, index, **options)

    def lost_amid(lines, index, **options):
        return real(lines, index, **options).withColumn("question", F.raise_error(F.lit("an executor is lost")))

    def counted(lines, index, **options):
        calls.append(lines.count())
        return real(lines, index, **options)

    with pytest.raises(Exception, match="lost"):
        run(lost_after)
    assert batch_stream.committed(spark, out) == [0, 1]
    with pytest.raises(Exception, match="lost"):
        run(lost_amid)
    before = len(calls)
    run(counted)
    assert len(calls) - before <= 2  # neither whole micro-batch was answered again
    got = batch_stream.answered(spark, out).collect()
    assert len(got) == 12 and len({(r.file, r.line) for r in got}) == 12
    assert {r.line for r in got} == {0, 2, 3, 4} and all(r.status == ("error" if r.line == 4 else "success") for r in got)
    assert all((r.results.intent.reasoning is not None) == (r.line == 0) for r in got if r.status == "success")
    assert all(r.results.definition_results for r in got if r.status == "success")
    (tmp_path / "in/late.jsonl").write_text('{"question": "class AThing"}')
    run(counted)
    assert batch_stream.answered(spark, out).count() == 13
    with pytest.raises(ValueError):
        batch_stream.answered(spark, str(tmp_path / "none"))
    spark.catalog.clearCache()


def test_workers_hold_parts_of_batches(spark):
    """Rows of a batch come in parts by their bytes, all of them and in order; a long one is alone, and nothing is copied."""
    texts = ["a" * 10, None, "", "b" * 50, "é" * 20, "c", "d" * 9]
    whole = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    parts = list(batches.bounded(iter([whole, whole.slice(0, 0), whole.slice(2, 3)]), 1, 40))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4], [5, 6], [2], [3], [4]]
    assert pa.Table.from_batches(parts).column(1).to_pylist() == texts + texts[2:5]
    kept = list(batches.bounded(iter([whole.slice(1, 2)]), 1, 0))
    assert [p.column(0).to_pylist() for p in kept] == [[1, 2]]


def test_decoding_holds_a_part_at_a_time(spark, monkeypatch):
    """A batch of many long files is decoded in several."""
    n, size = 40, 200_000
    f = spark.range(0, n, 1, 1).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".h")).alias("path"), F.encode(F.repeat(F.lit("x"), size), "utf-8").alias("content"))
    seen = []
    monkeypatch.setattr(type(f), "mapInArrow", lambda df, run, schema, go=type(f).mapInArrow: seen.append(run) or go(df, run, schema))
    out = sources.decode(f)
    made = list(seen[0](iter(f.toArrow().combine_chunks().to_batches())))
    assert sum(b.num_rows for b in made) == n and max(b.num_rows for b in made) <= batches.MOST_BYTES // size
    assert out.agg(F.sum("n_chars"), F.countDistinct("path")).first()[:] == (n * size, n)
