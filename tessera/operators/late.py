"""Late interaction: a question and a text are compared token by token, and each token of the question takes its best match."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64
TOKEN = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])|\w")
#: Tokens whose vectors a Python worker keeps, and rows of a text's matrix that are compared at once.
KEPT, ROWS = 100_000, 4096


class TokenEncoder:
    """A unit vector for each token, from its letters in threes, so that forms of a word are near each other. Tokens are parts of words: FHitResult is
    f, hit, result. Another encoder has the same two methods."""

    dim = DIM

    def tokens(self, text: str) -> list[str]:
        return [t.lower() for t in TOKEN.findall(text or "")]

    def vector(self, token: str) -> np.ndarray:
        out, marked = np.zeros(self.dim), f"<{token}>"
        for i in range(max(1, len(marked) - 2)):
            h = zlib.crc32(marked[i : i + 3].encode())
            out[h % self.dim] += 1.0 if h >> 31 else -1.0
        n = np.sqrt(out @ out)
        return out / n if n else np.eye(1, self.dim)[0]


class Scorer:
    """Mean over the question's distinct tokens of the largest product with a token of the text; 0 if either has none. Vectors of tokens are made once
    and kept, up to KEPT of them."""

    def __init__(self, encoder: TokenEncoder):
        self.encoder, self.kept = encoder, {}

    def matrix(self, text: str) -> np.ndarray:
        names = list(dict.fromkeys(self.encoder.tokens(text)))
        if len(self.kept) > KEPT:
            self.kept.clear()
        for t in names:
            if t not in self.kept:
                self.kept[t] = self.encoder.vector(t)
        return np.stack([self.kept[t] for t in names]) if names else np.empty((0, self.encoder.dim))

    def score(self, q: np.ndarray, text: str) -> float:
        t = self.matrix(text)
        if not len(q) or not len(t):
            return 0.0
        return float(np.maximum.reduce([(q @ t[i : i + ROWS].T).max(1) for i in range(0, len(t), ROWS)]).mean())


def scorer(encoder: TokenEncoder | None = None) -> Callable[[Column, Column], Column]:
    """For ``scoring.rerank``: a column of scores from those of question and text, in Arrow batches. A question's matrix is made once a batch."""
    enc = encoder or TokenEncoder()

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        s = Scorer(enc)
        for questions, texts in batches:
            asked = {q: s.matrix(q) for q in questions.dropna().unique()}
            none = np.empty((0, enc.dim))
            yield pd.Series([s.score(asked.get(q, none), t) for q, t in zip(questions, texts, strict=True)], dtype="float64")

    udf = F.pandas_udf(run, "double")
    return lambda question, text: udf(question, text)
