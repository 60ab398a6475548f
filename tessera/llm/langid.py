"""Language identification by a linear-chain conditional random field over words.

Each word's features are its affixes, its character n-grams, and whether the lexicon of the learned texts has it;
the transitions between the languages of neighbouring words are learned too, on sequences in which texts of several
languages meet. Forward-backward gives each word a probability for each language, so code-switched text is labelled
word by word; a document's language is the one with the largest sum over all its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
SEGMENT = 64
#: Numbers in the products of steps that segments hold at once.
MESSAGES = 1 << 22
#: Numbers in the messages of the training sequences that are worked on at once.
AT_ONCE = 1 << 21


def words_of(text: str) -> list[str]:
    """Runs of letters: of characters for which str.isalpha() holds. WORD alone takes numerals such as \u00b2 for letters."""
    words = WORD.findall(text)
    return words if not words or "".join(words).isalpha() else LETTERS.findall(text)


#: Features are rows of a table: hashed grams and affixes, the bias, then the lexicon's words.
TABLE = 1 << 16
PRIME = np.uint64(0x9E3779B97F4A7C15)


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case characters of all words, each between a start and an end mark; where each word starts, and where all end)."""
    text = ("\x01" + "\x02\x01".join(words) + "\x02").lower() if words else ""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    return codes, np.append(np.flatnonzero(codes == 1), len(codes))


def grams(codes: np.ndarray, at: np.ndarray, size: int, kind: int) -> np.ndarray:
    """A hash of the ``size`` characters from each place; grams of different kinds have different ones."""
    h = np.full(len(at), kind + 1, np.uint64) * PRIME
    for k in range(size):
        h = (h ^ codes[at + k]) * PRIME
        h ^= h >> np.uint64(29)
    return h


def whole_words(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    place = np.arange(len(codes)) - np.repeat(ends[:-1], np.diff(ends))
    return np.add.reduceat((codes * PRIME) ^ ((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * codes, ends[:-1])


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the table, number of its word) of each feature of each word: all 2- and 3-grams, marks included; prefixes of up
    to three and suffixes of up to four letters, with their mark; the bias; the word itself if the sorted ``lexicon`` has its hash."""
    codes, ends = word_codes(words)
    first, last = ends[:-1], ends[1:]
    owner = np.repeat(np.arange(len(words)), np.diff(ends))
    left = np.repeat(last, np.diff(ends)) - np.arange(len(codes))
    two, three = np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)
    four, five = np.flatnonzero(last - first >= 4), np.flatnonzero(last - first >= 5)
    parts = [(grams(codes, two, 2, 2), owner[two]), (grams(codes, three, 3, 3), owner[three]), (grams(codes, first[four], 4, 4), four), (grams(codes, last[four] - 4, 4, 5), four), (grams(codes, last[five] - 5, 5, 6), five)]
    rows = [(h >> np.uint64(24)).astype(np.int64) % TABLE for h, _ in parts]
    known = whole_words(codes, ends)
    at = np.minimum(np.searchsorted(lexicon, known), max(len(lexicon) - 1, 0))
    in_lexicon = np.flatnonzero(lexicon[at] == known) if len(lexicon) else np.empty(0, np.int64)
    return np.concatenate([*rows, np.full(len(words), TABLE), TABLE + 1 + at[in_lexicon]]), np.concatenate([*(w for _, w in parts), np.arange(len(words)), in_lexicon])


@dataclass
class Model:
    """langs: sorted; lexicon: sorted hashes of known words; weights: (features, languages); moves: (from, to). key: tells models apart."""

    langs: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    key: int = 0

    def score(self, words: list[str]) -> np.ndarray:
        """(words, languages)"""
        rows, owner = features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weights[rows, k], len(words)) for k in range(len(self.langs))], 1)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def steps(e: np.ndarray, mask: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages (S, L, K) of S sequences of up to L words. e: exp of the words' scores; first:
    the message into a sequence, last: the one that comes back from what follows; each scaled to sum to one."""
    s, n, k = e.shape
    a, b = np.empty_like(e), np.empty_like(e)
    x = first
    for t in range(n):
        y = (x @ moves) * e[:, t]
        x = np.where(mask[:, t, None], y / y.sum(1, keepdims=True), x)
        a[:, t] = x
    x = last
    for t in range(n - 1, -1, -1):
        b[:, t] = x
        y = (x * e[:, t]) @ moves.T
        x = np.where(mask[:, t, None], y / y.sum(1, keepdims=True), x)
    return a, b


def marginals(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probabilities (words, K) of each word's label. e: exp of the scores (words, K) of texts of ``lengths`` words one
    after the other. Texts are cut into segments that are worked on side by side; a segment's product of steps carries
    the messages from one to the next, so that the result is that of one pass over each whole text."""
    k = e.shape[1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.empty((0, k))
    n_seg = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(lengths)), n_seg)
    first_seg = np.cumsum(n_seg) - n_seg
    within = np.arange(len(doc)) - first_seg[doc]
    start = (np.cumsum(lengths) - lengths)[doc] + within * SEGMENT
    size = np.minimum(lengths[doc] - within * SEGMENT, SEGMENT)
    place = np.arange(SEGMENT)
    mask = place < size[:, None]
    at = np.where(mask, start[:, None] + place, start[:, None])
    es = e[at]
    into, back = np.full((len(doc), k), 1 / k), np.full((len(doc), k), 1 / k)
    if (n_seg > 1).any():
        many = np.flatnonzero(n_seg[doc] > 1)
        if len(many) * k * k <= MESSAGES:
            whole = np.repeat(np.eye(k)[None], len(doc), 0)
            m = whole[many]
            for t in range(SEGMENT):
                y = (m @ moves) * es[many, t, None]
                m = np.where(mask[many, t, None, None], y / y.sum((1, 2), keepdims=True), m)
            whole[many] = m
            ahead = lambda seg: np.einsum("sk,skl->sl", into[seg], whole[seg])
            behind = lambda seg: np.einsum("skl,sl->sk", whole[seg], back[seg])
        else:  # so many languages that a word at a time takes less

            def ahead(seg: np.ndarray) -> np.ndarray:
                x = into[seg]
                for t in range(SEGMENT):
                    y = (x @ moves) * es[seg, t]
                    x = y / y.sum(1, keepdims=True)
                return x

            def behind(seg: np.ndarray) -> np.ndarray:
                x = back[seg]
                for t in range(SEGMENT - 1, -1, -1):
                    y = (x * es[seg, t]) @ moves.T
                    x = np.where(mask[seg, t, None], y / y.sum(1, keepdims=True), x)
                return x

        for j in range(1, n_seg.max()):
            seg = first_seg[n_seg > j] + j
            x = ahead(seg - 1)
            into[seg] = x / x.sum(1, keepdims=True)
        for j in range(n_seg.max() - 1, 0, -1):
            seg = first_seg[n_seg > j] + j
            x = behind(seg)
            back[seg - 1] = x / x.sum(1, keepdims=True)
    a, b = steps(es, mask, moves, into, back)
    p = (a * b)[mask]
    return p / p.sum(1, keepdims=True)


def train(samples: list[tuple[str, list[str]]], rounds: int = 60, seed: int = 7, most_words: int = 20_000, length: int = 32) -> Model:
    """From (language, words) of texts. Words of up to three texts follow each other in a training sequence, so that
    the moves between languages are learned as well; Adam on the log-likelihood with a small penalty on weights."""
    langs = sorted({x for x, ws in samples if ws})
    rng = np.random.default_rng(seed)
    texts = sorted((x, ws) for x, ws in samples if ws)
    k = len(langs)
    often = [w for w, n in sorted(Counter(w.lower() for _, ws in texts for w in ws).items(), key=lambda x: (-x[1], x[0]))[:most_words] if n > 2]
    lexicon = np.unique(whole_words(*word_codes(often))) if often else np.empty(0, np.uint64)
    model = Model(langs, lexicon, np.zeros((TABLE + 1 + len(lexicon), k), np.float64), np.full((k, k), 1 / max(k, 1)))
    if k < 2:
        model.key = zlib.crc32(repr(langs).encode())
        return model
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
    words, gold = [], []
    for t in rng.permutation(np.repeat(np.arange(len(texts)), 3)):
        cuts, row, labels = sorted(rng.integers(0, length + 1, 2)), [], []
        for m, upto in enumerate([*cuts, length]):
            x, ws = texts[t] if m == 0 else texts[rng.integers(len(texts))]
            take = max(0, upto - len(row))
            at = int(rng.integers(max(1, len(ws) - take + 1)))
            part = ws[at : at + take]
            row += [vocabulary[w] for w in part]
            labels += [langs.index(x)] * len(part)
        words.append(row + [0] * (length - len(row)))
        gold.append(labels + [-1] * (length - len(labels)))
    words, gold = np.asarray(words), np.asarray(gold)
    mask = gold >= 0
    flat, owner = features(list(vocabulary), lexicon)
    scores, moves = model.weights, np.zeros((k, k))
    params = [scores, moves]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n_words = mask.sum()
    by_gold = np.zeros((len(vocabulary), k), np.float32)
    np.add.at(by_gold, (words[mask], gold[mask]), 1)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    part = max(1, AT_ONCE // (length * k))
    for r in range(1, rounds + 1):
        per_word = np.empty((len(vocabulary), k), np.float32)
        for j in range(k):
            per_word[:, j] = np.bincount(owner, scores[flat, j], len(vocabulary))
        go, expected, by_word = softmax(moves), np.zeros((k, k)), -by_gold
        for at in range(0, len(words), part):  # the gradient is a sum over sequences
            w, m = words[at : at + part], mask[at : at + part]
            x = per_word[w].astype(np.float64)
            e = np.exp(x - x.max(2, keepdims=True))
            first = np.full((len(w), k), 1 / k)
            a, b = steps(e, m, go, first, first)
            p = a * b
            p /= p.sum(2, keepdims=True)
            np.add.at(by_word, w[m], p[m].astype(np.float32))
            # of each move between neighbours: a's share, the move, what follows, over their sum
            after = (e * b)[:, 1:].reshape(-1, k)
            before = a[:, :-1].reshape(-1, k)
            total = ((before @ go) * after).sum(1)
            before = before * (m[:, 1:].ravel() / np.maximum(total, 1e-300))[:, None]
            expected += go * (before.T @ after)
        g_scores = 1e-7 * scores
        for j in range(k):
            g_scores[:, j] += np.bincount(flat, by_word[owner, j], len(scores)) / n_words
        g = (expected - seen) / n_words
        g_moves = g - go * g.sum(1, keepdims=True)
        for i, grad in enumerate((g_scores, g_moves)):
            m1[i] = 0.9 * m1[i] + 0.1 * grad
            m2[i] = 0.99 * m2[i] + 0.01 * grad**2
            params[i] -= 0.1 * (m1[i] / (1 - 0.9**r)) / (np.sqrt(m2[i] / (1 - 0.99**r)) + 1e-9)
    model.moves = softmax(moves)
    model.weights = model.weights.astype(np.float32)
    model.key = zlib.crc32(model.weights.tobytes() + model.moves.tobytes())
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, per_lang: int = 300, window: int = 48, most_langs: int = 200, most_docs: int = 12_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from a bounded sample: about ``per_lang`` different documents, never more than 1.2 times that, of each of the up to
    ``most_langs`` languages with most of them (ties by name), ``window`` words of each from a place that its id fixes. ``per_lang`` is less where
    languages have more than ``most_docs`` together. A language beyond ``most_langs`` is never predicted. A language that has a document has one in the sample. Documents that are held out, or have no id, language or text, are never looked at."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & ~is_held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A document is in the sample by a hash of its id and text, with the odds that its language needs; that of the smallest hash is always.
    span = 1_000_000_007
    rows = rows.withColumn("h", F.pmod(F.xxhash64("id", "text", F.lit("langid")), F.lit(span)))
    langs = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not langs:
        return train([])
    per_lang = max(1, min(per_lang, most_docs // len(langs)))
    edge = F.create_map(*(F.lit(x) for r in langs for x in (r.lang, max(r.least, int(1.1 * per_lang / max(r.n, 1) * span)))))
    picked = rows.where(F.col("h") <= F.try_element_at(edge, "lang"))

    def cut_out(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words_of(t)
                at = zlib.crc32(str(i).encode()) % max(1, len(ws) - window + 1)
                out.append(ws[at : at + window])
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(out, pa.list_(pa.string()))], names=["lang", "h", "words"])

    cut = picked.mapInArrow(cut_out, "lang string, h long, words array<string>").groupBy("lang", "h").agg(F.min("words").alias("words"))  # repeated rows are one
    some = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= 1.2 * per_lang)
    return train([(r.lang, r.words) for r in some.select("lang", "words").collect()])


class Scores:
    """exp of words' scores by a model, kept for up to ``most`` words."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, min(most, 8 * most // max(1, len(model.langs)))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.empty((1 << 12, len(self.model.langs)))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > self.most:
            self.clear()
        new = list(set(words).difference(self.place))
        need = len(self.place) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))])
        if new:
            x = self.model.score(new)
            self.rows[len(self.place) : need] = np.exp(np.maximum(x - x.max(1, keepdims=True), -30))
            self.place.update(zip(new, range(len(self.place), need), strict=True))
        return self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


_SCORES: dict[int, Scores] = {}


def scores(model: Model) -> Scores:
    """One for each Python worker and model."""
    if model.key not in _SCORES:
        _SCORES.clear()
        _SCORES[model.key] = Scores(model)
    return _SCORES[model.key]


def label(texts: list[str | None], model: Model, words_at_once: int = 150_000):
    """(number of words, probabilities (words, K)) of each text in turn."""
    if not model.langs:
        yield from ((0, np.empty((0, 0))) for _ in texts)
        return
    group, n = [], 0
    for k, t in enumerate([*texts, None]):
        words = words_of(t) if t else []
        group.append(words)
        n += len(words)
        if n >= words_at_once or k == len(texts):
            lengths = np.asarray([len(x) for x in group])
            p = marginals(scores(model).of([w for x in group for w in x]), lengths, model.moves) if n else np.empty((0, len(model.langs)))
            at = 0
            for m in lengths[: len(group) - (k == len(texts))]:
                yield int(m), p[at : at + m]
                at += m
            group, n = [], 0


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``. score: the mean probability, over all words of the
    whole text, of the language predicted. ``und`` with score 0 for a null text, one without letters, or a model
    without languages; ties go to the first language by name. Repeated rows give repeated rows; a null id isn't held
    out. Other columns are ignored; an empty table gives an empty one. A narrow map: nothing is shuffled."""
    names = ["doc_id", "held_out", "lang_pred", "score"]

    def run(batches):
        for b in batches:
            lang, score = [], []
            for n, p in label(b.column(2).to_pylist(), model):
                mean = p.mean(0) if n and model.langs else None
                lang.append("und" if mean is None else model.langs[int(mean.argmax())])
                score.append(0.0 if mean is None else min(1.0, float(mean.max())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), is_held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which a language has a mean probability of ``least_score`` or more over all
    words. Null texts and texts without letters go. A model without languages can't tell, so then all texts with letters stay; one with
    K languages can't give less than 1 / K. A narrow map."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            if model.langs:
                good = [bool(n and p.mean(0).max() >= least_score) for n, p in label(texts, model)]
            else:
                good = [bool(t and words_of(t)) for t in texts]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Code-switched text, word by word: (doc_id, first_word, last_word, lang, score) of each run of words with one language."""

    def run(batches):
        for b in batches:
            out = []
            for i, (n, p) in zip(b.column(0).to_pylist(), label(b.column(1).to_pylist(), model), strict=True):
                if not n or not model.langs:
                    continue
                best = p.argmax(1)
                edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), n]
                out += [(i, s, e - 1, model.langs[best[s]], float(p[s:e, best[s]].mean())) for s, e in zip(edges, edges[1:], strict=False)]
            cols = zip(*out, strict=True) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "first_word", "last_word", "lang", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, first_word long, last_word long, lang string, score double")
