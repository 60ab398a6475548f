"""Suffix-array dedup against counting every string."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import suffix


def brute(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return out


def corpus(seed, passage):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    passages = [word(rnd.randint(5, passage)) for _ in range(12)]
    texts = [None, "", "short", "a" * 500, word(30) + "ab" * 300 + word(10), "\n" * 450 + word(40)]
    texts += ["".join(rnd.choice([rnd.choice(passages), word(rnd.randint(1, 80))]) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    return texts + [texts[10]] * 3


@pytest.mark.parametrize(("length", "seed", "most"), [(20, 4, 8192), (20, 4, 3), (21, 6, 2), (20, 4, 1), (200, 32, 5)])
def test_removed_bytes(spark, length, seed, most):
    """``most`` of a few splits anchors up to whole strings."""
    texts = corpus(length + most, 60 if length < 100 else 400)
    rows = [(i if i % 7 else None, t, 1, b"x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, kept binary, id string")
    want = brute(texts, length)
    got = suffix.digests(docs, length=length, seed=seed, most=most).collect()
    shown = lambda rows: sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in rows)
    assert shown(got) == shown([(r[0], *w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(rows, want, strict=True)])


def test_remove_repeats_keeps_rows_and_spans(spark):
    texts = corpus(5, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix.remove_repeats(docs, length=20, seed=4).collect()}
    for i, (n, gone, runs, left) in enumerate(brute(texts, 20)):
        assert bytes(got[i].text_left) == left and len(got[i].spans) == runs and got[i].text == texts[i]
        assert sum(s.stop - s.start for s in got[i].spans) == gone == n - len(left)


def test_empty_and_short(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.digests(empty).collect() == []
    none = hashlib.sha256(b"").hexdigest()
    got = suffix.digests(spark.createDataFrame([(1, "x" * 199), (2, None)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 199, 0, 0, hashlib.sha256(b"x" * 199).hexdigest()), (2, 0, 0, 0, none)]


def test_many_different_segments_of_one_anchor(spark):
    """A passage shorter than a string in many contexts repeats nothing; with one context twice it repeats that."""
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    line = word(60)
    texts = [word(150) + line + word(150) for _ in range(300)]
    texts += [word(10) + texts[7][100:320] + word(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts, 200)
    got = {r.doc_id: r for r in suffix.digests(docs, most=20).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(len(texts))] == [w[1:3] for w in want]
    assert got[7].n_removed == 220 == got[300].n_removed


def test_pieces_hold_every_string_once(monkeypatch):
    """Texts cut into small pieces have the same anchors for each string."""
    texts = [t or "" for t in corpus(9, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    def strings(piece):
        monkeypatch.setattr(suffix, "PIECE", piece)
        out = {}
        for data, ends, row, shift in suffix.pieces(batch, 20):
            for s, n, at, k in zip(*suffix.anchors(data, ends, 20, 4), strict=True):
                text = int(np.searchsorted(ends, s, "right")) - 1
                pos = int(s - ends[text] + (shift if text == 0 else 0))
                for i in range(n):
                    assert (row + text, pos + i) not in out
                    out[row + text, pos + i] = (int(at - s - i), int(k))
        return out

    whole = strings(1 << 20)
    assert whole == strings(64) == strings(1)
    assert len(whole) == sum(max(0, len(t.encode()) - 19) for t in texts)


def test_suffix_sort_is_verified(monkeypatch):
    rnd = np.random.default_rng(2)
    data = rnd.integers(0, 3, 4000).astype(np.uint8)
    start = np.sort(rnd.integers(0, 3900, 500))
    size = np.minimum(rnd.integers(0, 120, 500), 4000 - start)
    group = np.sort(rnd.integers(0, 9, 500))
    order, common = suffix.suffix_sort(data, start, size, group)
    want = sorted(range(500), key=lambda i: (group[i], data[start[i] : start[i] + size[i]].tobytes(), i))
    assert order.tolist() == want
    for i in range(1, 500):
        a, b = (data[start[j] : start[j] + size[j]].tobytes() for j in order[i - 1 : i + 1])
        same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert common[i] == (same if group[i] == group[i - 1] else 0)
    # by base 1 a hash is a sum, so "ab" and "ba" collide; it is found out and the next base used
    a, b = suffix.hash_sorted(data, start, size, group, 1)
    assert not suffix.verified(data, start, size, group, a, b)
    assert suffix.suffix_sort(data, start, size, group, (1, suffix.BASES[1]))[0].tolist() == want
    with pytest.raises(RuntimeError):
        suffix.suffix_sort(data, start, size, group, (1,))
