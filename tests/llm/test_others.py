"""Operators over vectors, conversations and URLs, the pipeline, and connected components."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, chat, embed_dedup, url_filters
from tessera.llm.common import components

VECTORS = "vec_id long, embedding array<float>, label int, id long, vec string, n int, u int, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x", 2, 3, 4) for i, v in rows], VECTORS)


def clusters(seed, n=300, dim=16):
    """Unit vectors, pairs and dense groups of near copies, exact copies, and what takes no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = [x[i % 40] + rng.normal(size=dim) * 0.02 for i in range(60)] + [x[50] + rng.normal(size=dim) * 0.05 for _ in range(40)]
    rows = [(i, v) for i, v in enumerate([*x, *near, *[x[60]] * 5, x[61] * 3])]
    n = len(rows)
    return rows + [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] + [1.0] * (dim - 1)), (n + 3, [None] + [1.0] * (dim - 1)), (n + 4, [float("inf")] * dim), (n + 5, [1.0] * 3), (n + 6, []), (None, x[62]), (3, x[3])]


def valid(rows, dim=16):
    return [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v) and any(v)]


@pytest.mark.parametrize("seed", [1, 2])
def test_embedding_dedup(spark, seed):
    rows = clusters(seed)
    ok = valid(rows)
    x = embed_dedup.unit(np.stack([v for _, v in ok]))
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    want_links = Counter()
    comp = list(range(len(ok)))
    for _ in range(len(ok)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(ok))]
        if new == comp:
            break
        comp = new
    least = {}
    for (i, _), c in zip(ok, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, 1 << 60), i)
    want = [((-1 if i is None else i), int(linked[k].sum()), least.get(comp[k], -1)) for k, (i, _) in enumerate(ok)]
    kept = {id(v) for _, v in ok}
    got = embed_dedup.near_duplicates(vectors(spark, rows), k=6).collect()
    assert len(got) == len(rows) and kept
    bad = [(i, v) for i, v in rows if not valid([(i, v)])]
    want += [(i, 0, i) for i, _ in bad]
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and not want_links


def test_embedding_dedup_small_tables(spark):
    assert embed_dedup.near_duplicates(vectors(spark, [])).count() == 0
    got = embed_dedup.near_duplicates(vectors(spark, [(1, [1, 0]), (2, [1, 0]), (3, None)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_embedding_dedup_of_every_length(spark):
    rows = [(1, [1, 0]), (2, [1, 0.01]), (5, [1, 0, 0]), (4, [1, 0.01, 0]), (7, [0, 1, 0]), (8, [3.0]), (9, [5.0]), (6, [-1.0])] + [(20 + i, np.eye(5)[i]) for i in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 5: (1, 4, False), 4: (1, 4, True), 7: (0, 7, True), 8: (1, 8, True), 9: (1, 8, False), 6: (0, 6, True)} | {20 + i: (0, 20 + i, True) for i in range(5)}


def bridged(groups, size, dim=16):
    """Dense groups 20 degrees apart, the first two joined only by a vector of each that are 17 degrees apart."""
    rng = np.random.default_rng(5)
    at = lambda degrees, turn: np.concatenate([[np.cos(np.radians(degrees)), np.sin(np.radians(degrees))] if not turn else [0, 0], np.eye(dim - 2)[turn] if turn else np.zeros(dim - 2)])
    centres = [at(0, 0), at(20, 0), *(at(0, t) for t in range(1, groups - 1))]
    x = [c + rng.normal(size=dim) * 0.0005 for c in centres for _ in range(size)] + [at(1.5, 0), at(18.5, 0)]
    return [(i, v) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [7, 1024])
def test_link_between_dense_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = bridged(4, 25)
    x = embed_dedup.unit(np.stack([v for _, v in valid(rows)]))
    linked = x @ x.T >= 0.95
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: int(linked[i].sum()) - 1 for i, _ in rows}
    assert linked[100, 101] and not linked[:25, 25:50].any()
    assert {i: r.component_id for i, r in got.items()} == {i: 0 if i < 50 or i > 99 else i // 25 * 25 for i, _ in rows}


def rare_pairs(groups=1, size=150, pairs=20, alone=700, dim=32):
    """A dense group, pairs and vectors with nothing near; the ids of pairs follow those of the group."""
    rng = np.random.default_rng(7)
    x = [v for _ in range(groups) for v in rng.normal(size=dim) + rng.normal(size=(size, dim)) * 0.01]
    for v in rng.normal(size=(pairs, dim)):
        x += [v, v + rng.normal(size=dim) * 0.2]
    return list(enumerate([*x, *rng.normal(size=(alone, dim))]))


def test_audit_sees_pairs_beside_a_dense_group(spark):
    rows = rare_pairs()
    x = embed_dedup.unit(np.stack([v for _, v in rows]))
    linked = (x @ x.T >= 0.95).sum(1) - 1
    classes = spark.createDataFrame([(i, 1, [float(c) for c in v]) for i, v in rows], "cid long, n long, vec array<float>")
    comps = spark.createDataFrame([(i, 0) for i in range(150)], "cid long, component long")
    all_links = spark.createDataFrame([(i, int(n)) for i, n in enumerate(linked) if n], "cid long, linked long")
    assert linked[150:190].min() == 1
    assert embed_dedup.audit(classes, all_links, comps, 64, 0.95) == 1.0
    assert embed_dedup.audit(classes, all_links.where("cid < 150"), comps, 64, 0.95) == 0.0


def test_audit_failure_is_raised(spark):
    with pytest.raises(RuntimeError):
        embed_dedup.near_duplicates(vectors(spark, rare_pairs(size=20, pairs=5, alone=20, dim=16)), recall=1.1, max_restarts=1)


@pytest.mark.parametrize("spread", [0.01, 0.1, 0.2, 0.5, 3.0])
def test_blocks_of_a_component(spark, monkeypatch, spread):
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=8) + rng.normal(size=(40, 8)) * spread
    n = rng.integers(1, 4, 40)
    df = spark.createDataFrame([(0, i, int(n[i]), [float(c) for c in x[i]]) for i in range(40)], "component long, cid long, n long, vec array<float>")
    u = embed_dedup.unit(x.astype(np.float32).astype(float))
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    assert {r.cid: r.linked for r in embed_dedup.count_in_blocks(df, 0.95).collect()} == {i: int(linked[i] @ n) for i in range(40)}


def brute_nearest(rows, k=20):
    """(row of the query, its nearest (rank, id, score)) for each row whose id is divisible by 20."""
    ok = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for n, (q, qv) in enumerate(ok):
        if q % 20 == 0:
            near = sorted((-float((v * qv).sum()), i) for m, (i, v) in enumerate(ok) if m != n and len(v) == len(qv))[:k]
            yield q, [(rank, i, -s) for rank, (s, i) in enumerate(near, 1)]


def recall_of(got, rows):
    """Share of the nearest that were found, each at its exact score; ``rows`` have each query's id once."""
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, want in brute_nearest(rows):
        mine = sorted(found.pop(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        scores = Counter((i, round(s, 9)) for _, i, s in want)
        hit += sum(min(n, scores[x]) for x, n in Counter((i, round(s, 9)) for _, i, s in mine).items())
        total += len(want)
    assert not found
    return hit / total


@pytest.mark.parametrize("scale", [False, True])
def test_nearest(spark, scale):
    rng = np.random.default_rng(9)
    usable = lambda i, v: v is not None and i is not None and i > 10 and len(v) == 16 and not any(c is None for c in v)
    rows = [(i, np.asarray(v) * (1 + 3 * rng.random())) if scale and usable(i, v) else (i, v) for i, v in clusters(4, 800)]
    assert recall_of(ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect(), rows) >= 0.9


def test_nearest_comes_from_the_leaves(spark):
    """A table five times as large as the sample: the recall asked for is met, and it falls with fewer visits."""
    x = np.random.default_rng(11).normal(size=(1600, 24))
    rows = list(enumerate(x))
    found = lambda **more: recall_of(ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, sample=320, **more).collect(), rows)
    one, ten, enough = found(visits=1), found(visits=10), found()
    assert one < 0.4 and one < ten < enough and enough >= 0.9


def test_nearest_visits_split_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 20)
    monkeypatch.setattr(ann, "QUERIES", 3)
    x = np.random.default_rng(12).normal(size=(400, 4))
    rows = list(enumerate(x))
    assert recall_of(ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, sample=64, visits=10**6).collect(), rows) == 1.0


def test_nearest_of_every_length_and_row(spark):
    """Lengths don't mix; repeated ids and repeated rows are candidates of their own, and a query's own row alone is left out."""
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 1.0, 1.0]), (2, [5.0, 5.0]), (20, [1.0, 0.5]), (3, [3.0, 3.0]), (3, [3.0, 3.0]), (0, [9.0, 9.0, 9.0]), (40, [7.0])]
    got = defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got[20]) == [(1, 2, 7.5), (2, 3, 4.5), (3, 3, 4.5)] and 40 not in got
    assert sorted(got[0]) == [(1, 0, 54.0), (1, 0, 54.0), (2, 1, 6.0), (2, 1, 27.0)]


def test_nearest_ties_and_few(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [2.0, 0.0]), (101, None)]
    got = [(r.rank, r.vec_id) for r in ann.nearest(vectors(spark, rows), F.col("vec_id") == 40).orderBy("rank").collect()]
    assert got == [(1, 100)] + [(k + 2, k) for k in range(19)]
    few = ann.nearest(vectors(spark, [(0, [1.0, 2.0]), (1, [3.0, 1.0])]), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 1, 5.0)]
    assert ann.nearest(vectors(spark, []), F.lit(True)).count() == 0
    assert ann.nearest(vectors(spark, [(1, [1.0])]), F.lit(False)).count() == 0


def test_tree_order_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(500, 8))
    t = ann.fit(x, 10)
    assert sorted(t.order(x[0], t.n_leaves)) == list(range(t.n_leaves)) and set(t.assign(x)) <= set(range(t.n_leaves))


# Chat

TURNS = "conv_id long, turn long, role string, text string, turns string, segments string, state string"
NASTY = ["<|im_end|>", "\\<|x|>\\\\", "<\\|im_start|>", "a\nb", "", None, "<\\n>", "\\", "<|im_end|>\n<|im_start|>assistant\nhi", "日本 <|"]


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)


def test_chat_round_trip(spark):
    rows = [(k, t, role, text) for k, text in enumerate(NASTY) for t, role in enumerate(["user", "assistant", NASTY[(k + 1) % len(NASTY)]])]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns(spark, rows))).collect()}
    for k, text in enumerate(NASTY):
        assert [(t.role, t.text) for t in got[k].turns] == [(r or "", text or "") for r in ("user", "assistant", NASTY[(k + 1) % len(NASTY)])]
        assert got[k].loss_text == (text or "") and got[k].formatted.count("<|im_start|>") == 3
        assert "".join(s.text for s in got[k].segments) == got[k].formatted


@pytest.mark.parametrize(("roles", "valid", "bad"), [("su a".replace(" ", ""), True, None), ("ua", True, None), ("uaua", True, None), ("u", False, None), ("au", False, 0), ("uua", False, 1), ("sua s".replace(" ", ""), False, 3), ("ssua", False, 1)])
def test_turn_order(spark, roles, valid, bad):
    names = {"s": "system", "u": "user", "a": "assistant"}
    r = chat.format_conversations(turns(spark, [(1, i, names[x], "t") for i, x in enumerate(roles)])).first()
    assert (r.valid, r.bad_turn) == (valid, bad)


def test_chat_edges(spark):
    rows = [(1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, None, "user", "first"), (None, 1, None, None), (1, 2, "assistant", "a")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns(spark, rows))).collect()}
    assert [t.text for t in got[1].turns] == ["first", "a", "a", "b"] and got[1].loss_text == "aab"
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert chat.digests(chat.format_conversations(turns(spark, []))).count() == 0


def test_chat_plan_has_no_python(spark):
    plan = chat.digests(chat.format_conversations(turns(spark, [(1, 0, "user", "x")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# URLs


def filtered(spark, pages, entries):
    p = spark.createDataFrame(pages, "page_id long, url string, fetched_on date, host string, keys string")
    e = spark.createDataFrame(entries, "key string, category string, day date, listed boolean")
    return {r.page_id: r for r in url_filters.filter_captures(p, e).collect()}


def test_url_intervals(spark):
    from datetime import date as d

    entries = [("bad.org", "spam", d(2024, 1, 10), True), ("bad.org", "spam", d(2024, 2, 1), False), ("bad.org", "malware", d(2024, 3, 1), True), ("x.bad.org/a", "phish", d(2024, 1, 1), True), ("bad.org", "spam", d(2024, 1, 10), True), (None, "x", d(2024, 1, 1), True), ("org2", None, d(2024, 1, 1), None)]
    days = [d(2024, 1, 9), d(2024, 1, 10), d(2024, 1, 31), d(2024, 2, 1), d(2024, 3, 1)]
    pages = [(i, "http://u:p@X.bad.ORG.:8080/a/b?q", day, "h", "k") for i, day in enumerate(days)]
    pages += [(10, "https://notbad.org/", days[1], "h", "k"), (11, None, days[1], "h", "k"), (12, "nonsense", days[1], "h", "k"), (13, "http://bad.org", None, "h", "k"), (14, "http://y.org2/", days[1], "h", "k"), (15, "http://x.bad.org/ab", days[0], "h", "k")]
    got = filtered(spark, pages, entries)
    assert [(got[i].n_active, got[i].matched_key, got[i].category) for i in range(5)] == [(1, "x.bad.org/a", "phish"), (2, "x.bad.org/a", "phish"), (2, "x.bad.org/a", "phish"), (1, "x.bad.org/a", "phish"), (2, "x.bad.org/a", "phish")]
    assert [got[i].blocked for i in (10, 11, 12, 13, 14, 15)] == [False, False, False, False, True, False]
    assert got[0].host == "x.bad.org"
    assert filtered(spark, pages, [])[1].blocked is False and filtered(spark, [], entries) == {}


def test_url_keys_of_any_form_and_depth(spark):
    from datetime import date as d

    keys = ["BAD.org", "https://Deep.Example.com:80/a/B/c/d/e/", "trail.org.", "x.y.z.long.host.net", "slash.org//p"]
    pages = ["http://sub.bad.org/", "http://deep.example.com/a/B/c/d/e/f?q", "http://deep.example.com/a/b/c/d/e", "http://trail.org", "http://w.x.y.z.long.host.net/", "http://z.long.host.net/", "http://slash.org/p/q", "http://" + "a." * 3000 + "bad.org/" + "s/" * 3000]
    got = filtered(spark, [(i, u, d(2024, 1, 2), "h", "k") for i, u in enumerate(pages)], [(k, "spam", d(2024, 1, 1), True) for k in keys])
    assert [got[i].matched_key for i in range(8)] == ["bad.org", "deep.example.com/a/B/c/d/e", None, "trail.org", "x.y.z.long.host.net", None, "slash.org/p", "bad.org"]


def test_url_long_history_against_intervals(spark):
    """The as-of join against each interval, for a key with very many entries and captures."""
    from datetime import date, timedelta

    rng = np.random.default_rng(2)
    day = lambda n: date(2020, 1, 1) + timedelta(int(n))
    entries = [(str(rng.choice(["hot.org", "hot.org/a", "b.net"])), str(rng.choice(["spam", "adult", None])), day(rng.integers(900)), bool(rng.random() < 0.6)) for _ in range(600)]
    pages = [(i, str(rng.choice(["http://hot.org/a/b", "http://x.hot.org/", "http://b.net/a", "http://c.net"])), day(rng.integers(-5, 905)), "h", "k") for i in range(2000)]
    e = spark.createDataFrame(entries, "key string, category string, day date, listed boolean")
    held = [tuple(r) for r in url_filters.intervals(e).collect()]
    got = filtered(spark, pages, entries)
    for i, url, on, _, _ in pages:
        keys = {"http://hot.org/a/b": ["hot.org", "hot.org/a"], "http://x.hot.org/": ["hot.org"], "http://b.net/a": ["b.net"], "http://c.net": []}[url]
        want = sorted((-len(k), k, c) for k, c, a, b in held if k in keys and a <= on and (b is None or on < b))
        assert (got[i].n_active, got[i].matched_key, got[i].category) == (len(want), *(want[0][1:] if want else (None, None)))


# Components and pipeline


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, 4), (4, 5), (9, 8), (8, 7), (1, 9)], [(-3, 2), (2, 10), (11, 12)]])
def test_components(spark, edges):
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    comp = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    for per_task in (1000, 3):
        rows = components(spark.createDataFrame(edges, "a long, b long"), per_task=per_task).collect()
        assert {r.node: r.component for r in rows} == comp and len(rows) == len(comp)


def test_pipeline(spark, sf_dir):
    """Each stage against a plain computation over its own input."""
    import glob

    import duckdb
    from test_documents import brute_fingerprint, check_packing, components_by_brute_force
    from tokenizers import Tokenizer

    from tessera.llm import langid, mixing, packing
    from tessera.llm.common import shared_folder
    from tessera.llm.queries import tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "mixing", "best_fit_packing"]
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held[-1], sf_dir).cache()
        assert name == "best_fit_packing" or out.columns == docs.columns, name
        held.append(out)
    start, spoken, single, mixed, packed = ([r.asDict() for r in d.collect()] for d in held)
    model = langid.learn(docs)
    p = [0.0 if not n else float(x.mean(0).max()) for n, x in langid.label([r["text"] for r in start], model)]
    assert sorted(r["doc_id"] for r in spoken) == sorted(r["doc_id"] for r, x in zip(start, p, strict=True) if x >= corpus_pipeline.LEAST_SCORE)
    fps = [brute_fingerprint(r["text"] or "") for r in spoken]
    least = {}
    for r, c in zip(spoken, components_by_brute_force(fps, lambda a, b: (a ^ b).bit_count() <= 2), strict=True):
        least[c] = min(least.get(c, 1 << 60), r["doc_id"])
    assert sorted(r["doc_id"] for r in single) == sorted(least.values()) and len(single) < len(spoken)
    con = duckdb.connect()
    con.register("documents", held[2].toPandas())
    taken = con.sql(mixing.ORACLE).df()
    copies = {int(r.doc_id): round(r.taken / r.size) for r in taken.itertuples() if r.taken}
    assert Counter(r["doc_id"] for r in mixed) == copies
    tok, texts = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), {r["doc_id"]: r["text"] for r in single}
    lengths = {i: len(tok.encode(texts[i], add_special_tokens=False).ids) + 1 for i in copies}
    total = Counter()
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert total == {i: n * lengths[i] for i, n in copies.items()}
    n = check_packing(held[-1].collect(), [copies[i] * lengths[i] for i in copies], packing.CAPACITY)
    assert n <= 1.02 * packing.lower_bound(np.bincount([r["length"] for r in packed], minlength=2049)) + 2
    again = corpus_pipeline.run(spark, sf_dir).collect()
    folders = glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-*/*")
    assert {f.rsplit("/", 1)[1] for f in folders} == {"best_fit_packing"}
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, again)) == Counter(map(key, packed))
    for d in held:
        d.unpersist()


def test_double_vectors_keep_their_digits(spark):
    """Pairs a hair under the threshold don't link, a hair over it they do; copies at the ends of the range link."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(200):
        a = rng.normal(size=16)
        b = rng.normal(size=16)
        a, b = a / np.linalg.norm(a), b - (b @ a) / (a @ a) * a
        c = 0.95 + (1e-9 if i % 2 else -1e-9)
        rows += [(2 * i, a * 3), (2 * i + 1, c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b))]
    ends = [(1000, [1e200, 1e199]), (1001, [1e200, 1e199]), (1002, [1e-60, 1e-60]), (1003, [1e-60, 1e-60]), (1004, [-1e-60, 1e-60])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows + ends], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == (1, 2 * i) if i % 2 else got[2 * i] == (0, 2 * i) for i in range(200))
    assert [got[i] for i in range(1000, 1005)] == [(1, 1000), (1, 1000), (1, 1002), (1, 1002), (0, 1004)]


def test_a_dense_component_is_sent_once(spark, monkeypatch):
    """Up to a block of classes it is one product: no rings, each vector once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=16) + rng.normal(size=(200, 16)) * 0.05
    members = spark.createDataFrame([(1, i, 1, v.tolist()) for i, v in enumerate(x)], "component long, cid long, n long, vec array<double>")
    monkeypatch.setattr(embed_dedup, "centres_of", lambda m: pytest.fail("a small component has rings"))
    got = {r.cid: r.linked for r in embed_dedup.count_in_blocks(members, 0.95).collect()}
    u = embed_dedup.unit(x)
    assert [got[i] for i in range(200)] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def plain_nearest(rows, queries, k):
    def product(q, v):
        with np.errstate(over="ignore", invalid="ignore"):
            s = float((np.array(q) * np.array(v)).sum())
        return -np.inf if np.isnan(s) else s

    out = []
    for i in queries:
        q = dict(rows)[i]
        found = sorted((-product(q, v), j) for j, v in rows if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return out


@pytest.mark.parametrize("kind", ["large", "both ways", "cancelling"])
def test_nearest_of_large_values(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "large":
        rows = [(i, [1e200, float(i)]) for i in range(30)]
    elif kind == "both ways":
        rows = [(i, [1e200 * (-1) ** i, 1e200 * (-1) ** (i // 2)]) for i in range(30)]
    else:  # long vectors whose products cancel: a winner by little is still the winner
        rows = [(i, [1e8, 1e8 * (1 if i == 0 else -1), float(x)]) for i, x in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, visits=1000).collect()
    assert sorted(map(tuple, got)) == plain_nearest(rows, [i for i, _ in rows if i % 10 == 0], 20)
