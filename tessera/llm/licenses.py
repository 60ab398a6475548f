"""Licence scans by a positional rare-token index.

Templates are word sequences. One pass over all texts counts in how many each template word occurs; a
template's highest-IDF words become its anchors. A text's anchor words are looked up, the postings of each
hit give the place where the template would start, and the words of the template are compared at their
positions from there. A template that needs ``need`` of its ``n`` words is anchored on its ``n - need + 1``
rarest, so that every match holds an anchor and none is lost. Mandatory key phrases must stand whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases that label a text wherever their words stand one after the other.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice, mandatory key phrase.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "any purpose with or without fee"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
SHARE = 0.75
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    need: int
    key: range
    base: bool

    @classmethod
    def of(cls, label: str, text: str, key: str, share: float, base: bool = False) -> Template:
        words, k = text.encode().split(), key.encode().split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        return cls(label, tuple(words), math.ceil(share * len(words)), range(at, at + len(k)), base)


def templates(share: float = SHARE) -> list[Template]:
    return [Template.of(label, p, p, 1.0, True) for p, label in BASE.items()] + [Template.of(label, t, k, share) for label, t, k in NOTICES]


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes: only A-Z change


def document_frequency(docs: DataFrame, words: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts of ``docs(text)`` each of ``words`` occurs. As many rows reach the driver as there are words."""

    def run(batches):
        n = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t:
                    n.update(words.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    rows = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows}


def postings(all_templates: list[Template], df: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """Anchor word -> (template, position): each template's rarest words, as many as make sure that no match lacks one."""
    index: dict[bytes, list[tuple[int, int]]] = {}
    for k, t in enumerate(all_templates):
        rarest = sorted(range(len(t.words)), key=lambda p: (df.get(t.words[p], 0), p))
        for p in rarest[: len(t.words) - t.need + 1]:
            index.setdefault(t.words[p], []).append((k, p))
    return index


def matches(words: list[bytes], all_templates: list[Template], index: dict[bytes, list[tuple[int, int]]]) -> list[tuple[int, int, float]]:
    """(template, start, share of its words that stand at their places) of each place that matches."""
    if index.keys().isdisjoint(words):
        return []
    starts = {(k, i - p) for i, w in enumerate(words) if w in index for k, p in index[w]}
    found = []
    for k, start in sorted(starts):
        t = all_templates[k]
        hit = [0 <= start + p < len(words) and words[start + p] == w for p, w in enumerate(t.words)]
        if sum(hit) >= t.need and all(hit[p] for p in t.key):
            found.append((k, start, sum(hit) / len(hit)))
    return found


def scan_licenses(docs: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start, or null), base_labels, labels (sorted, joined by commas),
    score (the largest share of a template's words found; 0 if none matches).

    Two narrow passes over whole texts; only the counts of the templates' words are shuffled. Null text is
    empty: no words, no labels. Repeated rows give repeated rows, a null id stays null, other columns are
    ignored, an empty table gives an empty one."""
    ts = templates(share)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    index = postings(ts, document_frequency(rows.select("text"), frozenset(w for t in ts for w in t.words)))

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(t or b"")
                found = matches(words, ts, index)
                base = [(s, ts[k].label) for k, s, _ in found if ts[k].base]
                labels = lambda xs: ",".join(sorted(set(xs)))
                out.append((i, len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, labels(x for _, x in base), labels(ts[k].label for k, _, _ in found), max((x for _, _, x in found), default=0.0)))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return rows.mapInArrow(run, SCHEMA)


def oracle(share: float = SHARE) -> str:
    """DuckDB SQL for the same rows: all words of all templates joined with all words of all texts."""
    ts = templates(share)
    words = ", ".join(f"({k}, {p}, '{w.decode()}')" for k, t in enumerate(ts) for p, w in enumerate(t.words))
    heads = ", ".join(f"({k}, '{t.label}', {len(t.words)}, {t.need}, {t.key.start}, {t.key.stop}, {str(t.base).lower()})" for k, t in enumerate(ts))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
tw(k, p, word) AS (VALUES {words}),
t(k, label, n, need, key_from, key_to, base) AS (VALUES {heads}),
m AS (SELECT r, k, i - p AS start, count(*) AS hit, list(p) AS ps FROM w JOIN tw USING (word) GROUP BY r, k, i - p),
f AS (SELECT r, label, base, start, hit / n AS share FROM m JOIN t USING (k)
      WHERE hit >= need AND len(list_filter(ps, lambda x: x >= key_from AND x < key_to)) = key_to - key_from),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)"""
