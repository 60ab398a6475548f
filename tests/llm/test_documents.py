"""Operators over texts: brute force, exact round trips, held-out accuracy, and edge cases."""

import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import assert_same, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import langid, licenses, mixing, packing, simhash, tokens
from tessera.llm.queries import QUERIES, SQL, tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, fp string, component string, words string"
LONG = "Das Wort und die Welt. " * 30_000


def docs(spark, rows):
    """(doc_id, text, lang, source), with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 1, "w", 2, "f", "c", "x") for r in rows], DOCS)


EDGES = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, "one", "en", "b"), (5, "one two", "en", "b"), (6, LONG, "de", "b"),
    (7, "All rights reserved. CC-BY and cc by! GNU General Public License, all RIGHTS reserved", "en", "a"), (7, "All rights reserved. CC-BY and cc by! GNU General Public License, all RIGHTS reserved", "en", "a"),
    (None, "no id here at all", "en", None), (None, None, None, None), (9, "日本語 テキスト ½ x²", "ja", "c"), (10, "a <|endoftext|> b  <s>\r\n</s> \x1c c", "en", "c"), (11, "1234 5678 !!", "en", "c"),
]


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_url_filters", "op6_chat_format", "op9_mixing"])
def test_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck(sf_dir), SQL[name])


# Licences


def test_licences_of_edges(spark):
    got = defaultdict(list)
    for r in licenses.scan_licenses(docs(spark, EDGES)).collect():
        got[r.doc_id].append(r)
    assert len(got[7]) == 2 and len(got[None]) == 2
    r = got[7][0]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (5, 0, 12, "cc-by,gpl,reserved", 1.0)
    assert (got[1][0].n_words, got[1][0].labels, got[1][0].first_word, got[1][0].score) == (0, "", None, 0.0)


def test_licence_index_misses_nothing():
    """All starts against those that the anchors find, on noisy copies of the templates."""
    rng = np.random.default_rng(1)
    ts = licenses.templates()
    df = {w: int(rng.integers(0, 99)) for t in ts for w in t.words}
    index = licenses.postings(ts, df)
    for t in ts * 3:
        words = [b"pad"] * int(rng.integers(0, 4)) + [w if rng.random() > 0.15 else b"zzz" for w in t.words] + [b"cc", b"by"]
        brute = set()
        for k, u in enumerate(ts):
            for s in range(-len(u.words), len(words)):
                hit = [0 <= s + p < len(words) and words[s + p] == w for p, w in enumerate(u.words)]
                if sum(hit) >= u.need and all(hit[p] for p in u.key):
                    brute.add((k, s))
        assert {(k, s) for k, s, _ in licenses.matches(words, ts, index)} == brute


# Tokens


@pytest.mark.parametrize("text", ["x▁ ▁ ▁y", "a▁ ▁b", "▂▁ ▁▂", "▁ ", " ▁ ", "a\n▁ ▁b\n ▁", "▁▁ ▁▁ " * 20])
def test_token_counts_of_literal_marks(spark, text):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    assert [r.n_tokens for r in tokens.count_tokens(docs(spark, [(1, text, "en", "s")]), path).collect()] == [want]


def test_table_of_counts_is_bounded():
    c = tokens.Counter(tokenizer("piece_bpe_32k.model"), most=20, longest=8)
    for k in range(100):
        text = f"word{k} and\n{'x' * 2000}{k} {'日本' * 500}\nand\nzzz{k}"
        assert c.count(text) == len(c.model.encode(text))
    assert all(len(t) <= 20 and max(map(len, t)) <= 8 for t in (c, c.old, c.inner))


def test_token_counts(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    extra = [(100 + i, t, "en", "s") for i, t in enumerate(["  lead", "trail  ", "a   b    c", "\n\nx\n y", "▁a▁▁b", "tab\tx", "　wide", " ", "\n", "x\n", "é" * 50, "a\x00b"])]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    given = EDGES + extra + rows
    got = tokens.count_tokens(docs(spark, given), tokenizer("piece_bpe_32k.model"), 500).collect()
    want = sorted(((i or -1), len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 500) for i, t, _, _ in given)
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


# SimHash


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_brute_force(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def test_simhash(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    given = [(i, t, x, s) for i, t, x, s in EDGES if i is None or i < 9] + [(i + 1000 if i is not None else None, t, x, s) for i, t, x, s in rows]
    got = simhash.near_duplicates(docs(spark, given)).collect()
    fps = {t: brute_fingerprint(t or "") for t in {t for _, t, _, _ in given}}
    each = sorted(set(fps.values()))
    comp = dict(zip(each, components_by_brute_force(each, lambda a, b: (a ^ b).bit_count() <= 2), strict=True))
    least = defaultdict(lambda: 1 << 62)
    for i, t, _, _ in given:
        if i is not None:
            least[comp[fps[t]]] = min(least[comp[fps[t]]], i)
    want = sorted((-1 if i is None else i, f"{fps[t]:016x}", least[comp[fps[t]]] if comp[fps[t]] in least else -1) for i, t, _, _ in given)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_simhash_fingerprint_is_sparks_hash(spark):
    r = spark.sql("SELECT lower(hex(xxhash64('only words'))) AS h").first()
    assert f"{simhash.fingerprint(b'ONLY  words'):016x}" == r.h.zfill(16)


def test_links_when_shards_overflow(spark):
    """Many fingerprints around a few centres, with shards of four: every level is used."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(6):
        c = int(rng.integers(0, 1 << 63))
        fps |= {c} | {c ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (30, 2))}
    fps = sorted(map(simhash.signed, fps))
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), shard=4).collect()
    want = components_by_brute_force(fps, lambda a, b: ((a ^ b) & simhash.FULL).bit_count() <= 2)
    pairs = {(r.a, r.b) for r in links}
    assert components_by_brute_force(fps, lambda a, b: (a, b) in pairs or (b, a) in pairs) == want
    assert all(((a ^ b) & simhash.FULL).bit_count() <= 64 for a, b in pairs)


def test_bk_tree_follows_the_radius():
    rng = np.random.default_rng(4)
    xs = list(dict.fromkeys(int(x) for x in rng.integers(0, 1 << 20, 400)))
    t = simhash.BKTree()
    for x in xs:
        t.add(x)
    for q in xs[:50]:
        assert sorted(t.near(q ^ 5, 3)) == [i for i, x in enumerate(xs) if (x ^ q ^ 5).bit_count() <= 3]


def test_one_of_each(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "completely different words stand in this text"
    given = [(5, a, "x", "s"), (3, a, "x", "s"), (3, a, "x", "s"), (9, b, "x", "s"), (None, a, "x", "s"), (None, "nameless text is here", "x", "s"), (None, "nameless text is here", "x", "s")]
    got = simhash.one_of_each(docs(spark, given))
    assert got.columns == docs(spark, given).columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "nameless text is here"), (3, a), (9, b)]


# Packing


def check_packing(rows, lengths, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert sum(r.length for r in rows) == sum(lengths)
    return len(seqs)


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    given = [(i, x, lang, s) for i, x, lang, s in EDGES if i not in (None, 7)] + [(i + 1000, x, lang, s) for i, x, lang, s in rows]
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, _, _ in given}
    got = packing.pack_documents(docs(spark, given), tokenizer("byte_bpe_50k.json"), per_task=50).collect()
    n = check_packing(got, [len(x) for x in ids.values()], packing.CAPACITY)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 2048 for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    histogram = np.bincount([r.length for r in got], minlength=2049)
    assert n <= 1.02 * packing.lower_bound(histogram) + 2


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abS 's\n\t.,1_éſ字²\x1c\u3000😀\0", max_size=14), min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    ids = packing.encoder(tokenizer("byte_bpe_50k.json"))
    assert ids.cut and [ids.encode(t) for t in texts] == [ids.whole(t) for t in texts]


def test_table_of_ids_is_bounded():
    ids = packing.Ids(tokenizer("byte_bpe_50k.json"), most=20, longest=8)
    for k in range(200):
        text = f"word{k} and {'x' * 20_000}{k} {'日本' * 500}, and"
        assert ids.encode(text) == ids.whole(text)
    assert len(ids) <= 20 and len(ids.old) <= 20 and max(map(len, {**ids, **ids.old})) <= 8


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole(spark, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    texts = ["Some  Words, and\n more <|endoftext|> it's 12", "", " x "]
    want = [zlib.crc32(np.asarray([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for x in texts]
    got = packing.pieces(docs(spark, [(i, x, "", "") for i, x in enumerate(texts)]), tokenizer(name)).orderBy("doc_id").collect()
    assert [r.ids_crc32 for r in got] == want and packing.encoder(tokenizer(name)).cut == name.startswith("byte")


def test_packing_repeats_and_nulls(spark):
    got = packing.pack_documents(docs(spark, [(1, "a", "", ""), (1, "a", "", ""), (None, None, "", "")]), tokenizer("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 2), (1, 2)] and len({r.sequence_id for r in got}) == 1


def test_bound_is_a_bound():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lengths = rng.integers(1, 65, int(rng.integers(1, 9)))
        best = brute_bins(sorted(map(int, lengths), reverse=True), 64)
        assert packing.lower_bound(np.bincount(lengths, minlength=65), 64) <= best
        _, _, fill = packing.best_fit_decreasing(lengths, 64)
        assert best <= len(fill) and fill.max() <= 64 and fill.sum() == lengths.sum()
    assert packing.lower_bound(np.bincount([40] * 5, minlength=65), 64) == 5  # sums alone say 4


def brute_bins(lengths, capacity):
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i, b in enumerate(bins):
            if b + lengths[k] <= capacity:
                place(k + 1, [*bins[:i], b + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_exchange_saves_bins(spark):
    """Partitions of three pieces leave gaps that the exchange closes."""
    rng = np.random.default_rng(6)
    rows = [(i, 0, 0, int(x), 0) for i, x in enumerate(rng.integers(300, 1000, 300))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    one = check_packing(packing.pack(df, per_task=20, rounds=1).collect(), [r[3] for r in rows], 2048)
    more = check_packing(packing.pack(df, per_task=20).collect(), [r[3] for r in rows], 2048)
    n, bound = packing.certificate(packing.pack(df, per_task=20))
    assert more < one and n == more and bound <= more


# Mixing


def test_mixing_meets_its_targets(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted(map(tuple, mixing.mix(d.repartition(n)).collect())) for n in (1, 5))
    assert a == b
    rows = mixing.mix(d).withColumn("rest", F.col("taken") % F.greatest("size", F.lit(1))).collect()
    assert all(r.rest == 0 and r.taken <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    by = d.join(spark.createDataFrame([(r.doc_id, r.size, r.target, r.taken) for r in rows], "doc_id long, size long, target double, taken long"), "doc_id").groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most"), F.sum("size").alias("words")).collect()
    assert abs(sum(r.target for r in by) - 1.5 * total) < 1e-6 * total and all(r.target <= 2 * r.words for r in by)
    assert all(abs(r.taken - r.target) <= r.most / 2 for r in by)
    assert abs(sum(r.taken for r in by) - 1.5 * total) < 0.02 * total


def test_mixing_meets_its_odds(spark):
    """12 sources of the same 2,400 documents: how often each length is taken, against its expected copies. Filling the last gap of a
    source looks at 64 documents, so it moves a length's share by a few hundredths."""
    kinds = np.asarray([1, 2, 3, 5, 8, 9, 20, 40, 70, 100, 130, 260])
    given = [(s * 10_000 + i, "w " * int(kinds[i % 12]), "en", f"s{s:03}") for s in range(12) for i in range(2400)]
    got = mixing.mix(docs(spark, given), weights=(1,), share=1.3).collect()
    words = 200 * int(kinds.sum())
    assert {r.source_size for r in got} == {words} and all(abs(r.target - 1.3 * words) < 1e-6 for r in got)
    digits = np.asarray([int(n).bit_length() for n in kinds])
    low, high = 0.0, 2.0
    for _ in range(80):
        factor = (low + high) / 2
        low, high = (factor, high) if (np.minimum(2, factor * digits) * kinds).sum() < 1.3 * kinds.sum() else (low, factor)
    want = np.minimum(2, factor * digits)
    copies = np.asarray([[r.doc_id % 10_000 % 12, r.copies] for r in got])
    mean = np.asarray([copies[copies[:, 0] == k, 1].mean() for k in range(12)])
    assert len(set(np.round(want, 6))) == 9 and np.abs(mean - want).max() < 0.06
    assert all(np.floor(want[k] + 1e-9) <= n <= np.floor(want[k] + 1e-9) + 1 for k, n in copies)
    taken = np.bincount([r.doc_id // 10_000 for r in got], [r.taken for r in got])
    assert np.abs(taken - 1.3 * words).max() < 5


def test_mixing_ranks_by_unequal_odds(spark):
    """The order of taken documents isn't that of their random numbers: short ones come later than long ones."""
    given = [(i, "w " * (1 if i % 2 else 300), "en", "s") for i in range(400)]
    got = mixing.mix(docs(spark, given), share=0.5).collect()
    share = [np.mean([r.copies for r in got if r.doc_id % 2 == k]) for k in (0, 1)]
    assert 0.45 < share[0] < 0.55 and 0.02 < share[1] < 0.12


@pytest.mark.parametrize("few", [0, 50_000])
def test_mixing_of_repeated_rows_and_many_sources(spark, monkeypatch, few):
    """Equal rows around the edge are split between taken and not; the same for dealt-out sources as for one window."""
    monkeypatch.setattr(mixing, "SOURCES", few)
    monkeypatch.setattr(mixing, "EQUAL", 7)
    given = [(1, "a b c", "en", "s")] * 500 + [(None, "one two three four", "en", None)] * 40 + [(i, "x " * (i % 9), "en", f"t{i % 37}") for i in range(300)]
    rows = mixing.mix(docs(spark, given)).collect()
    assert len(rows) == len(given) and all(r.taken == r.size * r.copies for r in rows)
    hot = [r for r in rows if r.doc_id == 1 and r.size == 3]
    assert len(hot) == 500 and abs(sum(r.taken for r in hot) - hot[0].target) <= 1.5
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t, s) for i, t, _, s in given], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    assert_same(mixing.mix(docs(spark, given)).drop("copies", "text_key"), con, SQL["op9_mixing"])


def test_mixing_edges(spark):
    rows = [(r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(docs(spark, EDGES)).collect()]
    assert len(rows) == len(EDGES) and all(taken <= 2 * size and (size or not taken) for _, size, _, taken in rows)
    blank = mixing.mix(docs(spark, [(1, None, "", "a"), (2, " ", "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_mix_applied(spark):
    given = [(i, f"word {i} " * (i % 7 + 1), "en", f"s{i % 3}") for i in range(60)] + [(1, "word 1 word 1 ", "en", "s1")]
    got = mixing.apply(docs(spark, given))
    assert got.columns == docs(spark, given).columns
    want = mixing.mix(docs(spark, given)).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == {r.doc_id: r.n for r in want}


# Languages


def test_language_accuracy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(d, langid.learn(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.93


def test_language_edges(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.learn(d)
    got = {r.doc_id: r for r in langid.identify(docs(spark, EDGES), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 11)) and got[6].lang_pred in model.langs
    assert got[4].held_out == (zlib.crc32(b"4") % 3 == 1) and not got[None].held_out
    none = langid.learn(docs(spark, []))
    assert none.langs == [] and {r.lang_pred for r in langid.identify(docs(spark, EDGES), none).collect()} == {"und"}
    kept = langid.keep(docs(spark, EDGES), model, 0.0)
    assert kept.columns == docs(spark, EDGES).columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, None, 9, 10}


@pytest.mark.parametrize("text", ["²", "½", "①", "Ⅷ 12 _", "٣", "²½①Ⅷ", "_", "\u0301"])
def test_numerals_and_marks_are_no_letters(spark, text):
    model = langid.train([("aa", ["plain", "text"]), ("bb", ["other", "words"])])
    got = langid.identify(docs(spark, [(1, text, None, None), (2, f"{text}plain{text}text", None, None)]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "und", 2: "aa"}
    assert langid.words_of(f"{text}plain{text}text") == ["plain", "text"]


def sample_of(monkeypatch, frame, **options):
    seen = []
    monkeypatch.setattr(langid, "train", lambda samples: seen.append(samples))
    langid.learn(frame, **options)
    return seen[0]


def test_sample_of_one_repeated_row_or_id(spark, monkeypatch):
    """Many rows of one id: equal ones are one, and different texts are sampled by their text."""
    free = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    same = spark.range(20_000).select(F.lit(free).alias("doc_id"), F.lit("the same words").alias("text"), F.lit("aa").alias("lang"))
    assert sample_of(monkeypatch, same) == [("aa", ["the", "same", "words"])]
    other = spark.range(20_000).select(F.lit(free).alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("aa").alias("lang"))
    assert 250 <= len(sample_of(monkeypatch, other)) <= 360
    few = same.unionByName(other.limit(3).withColumn("lang", F.lit("bb")))
    assert sorted(x for x, _ in sample_of(monkeypatch, few)) == ["aa", "bb", "bb", "bb"]


def test_sample_of_very_many_labels(spark, monkeypatch):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.concat(F.lit("l"), F.col("id") % 10_000).alias("lang"))
    got = sample_of(monkeypatch, many.unionByName(many.where("id < 300").withColumn("lang", F.lit("most"))), per_lang=5)
    assert len({x for x, _ in got}) == 200 and len(got) <= 200 * 6 and "most" in {x for x, _ in got}


def test_keep_without_a_model(spark):
    kept = langid.keep(docs(spark, EDGES), langid.train([]), 0.34)
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, None, 9, 10}


def test_learning_never_sees_held_out_documents(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    given = [(i, "secret words here" if i in held else "plain text there", "xx" if i in held else "aa", "s") for i in range(200)]
    assert langid.learn(docs(spark, given)).langs == ["aa"]


def test_segments_give_the_marginals_of_whole_chains():
    rng = np.random.default_rng(8)
    moves = langid.softmax(rng.normal(size=(3, 3)))
    lengths = np.asarray([1, 64, 65, 200, 3, 0, 129])
    e = np.exp(rng.normal(size=(lengths.sum(), 3)))
    got, at = langid.marginals(e, lengths, moves), 0
    for n in lengths:
        x, a = np.full(3, 1 / 3), []
        for t in range(n):
            x = (x @ moves) * e[at + t]
            a.append(x := x / x.sum())
        y, b = np.full(3, 1 / 3), [None] * n
        for t in range(n - 1, -1, -1):
            b[t] = y
            y = moves @ (e[at + t] * y)
            y /= y.sum()
        for t in range(n):
            p = a[t] * b[t]
            assert np.allclose(got[at + t], p / p.sum())
        at += n


def test_code_switched_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.learn(d)
    one, two = (d.where(F.col("lang") == x).orderBy(F.desc(F.length("text"))).first().text for x in ("en", "de"))
    a, b = langid.WORD.findall(one)[:40], langid.WORD.findall(two)[:40]
    spans = langid.label_spans(docs(spark, [(1, " ".join(a + b), None, None)]), model).collect()
    words = {w: s.lang for s in spans for w in range(s.first_word, s.last_word + 1)}
    assert len(words) == 80
    assert sum(words[i] == "en" for i in range(40)) > 34 and sum(words[i] == "de" for i in range(40, 80)) > 34


@pytest.mark.parametrize("f", [licenses.scan_licenses, simhash.near_duplicates, mixing.mix, lambda d: packing.pack_documents(d, tokenizer("byte_bpe_50k.json")), lambda d: tokens.count_tokens(d, tokenizer("piece_bpe_32k.model")), lambda d: langid.identify(d, langid.learn(d))])
def test_empty_tables(spark, f):
    assert f(docs(spark, [])).count() == 0


def test_capped_source_is_not_chosen_from(spark):
    given = [(i, "a b" if i % 2 else " ", "en", "s") for i in range(10)] + [(100 + i, "a b c", "en", s) for i in range(40) for s in "tu"]
    got = {r.doc_id: (r.target, r.copies) for r in mixing.mix(docs(spark, given)).where("doc_id < 100").collect()}
    assert got == {i: (20.0, 2 if i % 2 else 0) for i in range(10)}


def test_pieces_of_one_id_are_dealt_to_all_tasks(spark):
    """A third, or all, of the pieces may share an id or have none."""
    for one in (F.lit(7).cast("long"), F.lit(None).cast("long")):
        rows = spark.range(20_000).select(one.alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (1 + F.col("id") % 2048).alias("length"), F.lit(1).cast("long").alias("ids_crc32"), F.col("id").alias("row"))
        got = packing.pack_partitions(rows, 20, 0, 2048)
        sizes = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 32).alias("part")).count().collect()]
        assert sum(sizes) == 20_000 and len(sizes) == 20 and max(sizes) < 1500
        packed = packing.pack(rows.drop("row"), 2048, 1000)
        bins = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.sum("n")).first()
        assert bins[0] <= 2048 and bins[1] == sum(1 + i % 2048 for i in range(20_000))


def test_training_is_bounded_in_memory():
    """Sixty languages, really trained, in a process of its own."""
    import subprocess
    import sys

    code = """
import random, resource
from tessera.llm import langid
rnd = random.Random(1)
letters = "abcdefghijklmnopqrstuvwxyz"
langs = {f"l{k:02d}": ["".join(rnd.choices(letters, k=2)) for _ in range(12)] for k in range(60)}
samples = [(x, ["".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(48)]) for x, parts in langs.items() for _ in range(60)]
model = langid.train(samples, rounds=12)
right = sum(model.langs[int(p.mean(0).argmax())] == x for (x, _), (n, p) in zip(samples[::7], langid.label([" ".join(ws) for _, ws in samples[::7]], model)))
print(right / len(samples[::7]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert float(out[0]) > 0.95 and float(out[1]) < 2000


def test_messages_word_by_word_are_those_of_products(monkeypatch):
    rng = np.random.default_rng(9)
    moves, lengths = langid.softmax(rng.normal(size=(5, 5))), np.asarray([3, 700, 64, 0, 129, 65])
    e = np.exp(rng.normal(size=(lengths.sum(), 5)))
    by_products = langid.marginals(e, lengths, moves)
    monkeypatch.setattr(langid, "MESSAGES", 0)
    assert np.allclose(by_products, langid.marginals(e, lengths, moves), atol=1e-12)
