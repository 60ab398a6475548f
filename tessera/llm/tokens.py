"""Token counts by the whole-token shortcut.

The vocabulary has no piece with a word mark behind another character, so merges never cross from a word into the
space after it, and a text's tokens are those of its pre-tokens: each word with the spaces before it. ``prove`` checks
that on the vocabulary itself, and finds which pieces encode alone as one token. A pre-token that is such a piece
counts one; only the rest are merged by the library, and tables bounded in entries and characters keep their counts. A text that holds the mark
itself goes to the library whole: there it is like a space, and marks in a row merge.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

RUNS = re.compile(" *[^ ]+| +")
MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def prove(model) -> tuple[frozenset[str], bool]:
    """(the pre-tokens, without their mark, that encode alone as one token; whether a line break never merges).
    Raises if the vocabulary or its normalisation lets a token cross a space."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece of this vocabulary crosses a word mark; texts can't be cut at spaces")
    if model.encode(" a  b ", out_type=str) != [MARK, f"{MARK}a", MARK, f"{MARK}b", MARK]:
        raise ValueError("this model changes white space; texts can't be cut at spaces")
    words = [p[1:] for p in pieces if p[:1] == MARK and MARK not in p[1:]]
    single = frozenset(w for w, ids in zip(words, model.encode(words), strict=True) if len(ids) == 1 and w)
    return single, not any("\n" in p for p in pieces) and len(model.encode("\n")) == 2


class Counter(dict):
    """Pre-token (without its first mark) -> its tokens; what isn't proven single is merged once and kept, if it has at most
    ``longest`` characters. After ``most`` entries they are the old ones, from which those in use come back, and what was old
    before goes; so two times ``most`` short strings are all that is held, and as many parts of pre-tokens behind line breaks."""

    def __init__(self, path: str, most: int = 200_000, longest: int = 48):
        import sentencepiece

        super().__init__()
        self.model, self.most, self.longest = sentencepiece.SentencePieceProcessor(model_file=path), most, longest
        self.old, self.inner = {}, {}
        self.single, self.lines = prove(self.model)

    def __missing__(self, word: str) -> int:
        if word in self.single:
            return 1
        n = self.old.get(word)
        if n is None:
            n = self.merge(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n

    def merge(self, word: str) -> int:
        if self.lines and "\n" in word:  # a line break is one token that merges with nothing
            first, *rest = word.split("\n")
            return self[first] + sum(1 + (self.unmarked(x) if x else 0) for x in rest)
        return len(self.model.encode(word)) if word else 1

    def unmarked(self, word: str) -> int:
        """Tokens of a word that follows a line break, so has no mark."""
        n = self.inner.get(word)
        if n is None:
            n = len(self.model.encode("\n" + word)) - 2
            if len(word) <= self.longest:
                if len(self.inner) >= self.most:
                    self.inner.clear()
                self.inner[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            return len(self.model.encode(text))
        if "  " in text or text[0] == " " or text[-1] == " ":  # spaces in a run may merge with each other
            return sum(self[x[1:]] for x in RUNS.findall(" " + text))
        return sum(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each Python worker, which keeps its table from task to task."""
    return Counter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``, counted as the library does without
    begin and end tokens. A narrow map: no shuffle, and memory bounded by a batch of rows and tables of so many short
    strings. Null and empty texts have no bytes and no tokens. Repeated rows give repeated rows; a null id stays
    null; other columns are ignored, whatever their names; an empty table gives an empty one."""

    def run(batches):
        c = counter(model_path)
        for b in batches:
            text = b.column(1).fill_null("")
            n = [c.count(t) for t in text.to_pylist()]
            size = [len(x) for x in text.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, SCHEMA)
