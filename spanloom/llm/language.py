"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; a binary classifier over hashed
letter n-grams predicts each bit, and the codeword with the least logistic loss
over the real-valued bits is chosen.  Codewords differ in several bits, so one
wrong classifier does not change the answer.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import kept

DIMENSIONS = 2048
_LETTER = re.compile(r"[^\W\d_]")
_VALUE = np.random.default_rng(11).integers(1, 2**31, (3, 256), dtype=np.uint32)
_SLICE = 1 << 21


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """Blocks of rows of scaled n-gram counts (UTF-8 bytes, orders 2 and 3) of whole lower-cased texts."""
    at = 0
    while at < len(texts):
        part, size, to = [], 0, at
        while to < len(texts) and to - at < 500 and (to == at or size < _SLICE):
            raw = b"  " + texts[to].lower().encode("utf-8", "surrogatepass")
            part.append(raw)
            size += len(raw)
            to += 1
        b = np.frombuffer(b"".join(part), dtype=np.uint8)
        lengths = np.array([len(x) for x in part])
        row = np.repeat(np.arange(len(part), dtype=np.int64), lengths) * DIMENSIONS
        two = _VALUE[0][b[1:]] + _VALUE[1][b[:-1]] * np.uint32(3)
        three = two[1:] * np.uint32(0x9E3779B1) + _VALUE[2][b[:-2]]
        count = np.zeros(len(part) * DIMENSIONS)
        for h, skip in ((two * np.uint32(0x85EBCA6B), 1), (three * np.uint32(0xC2B2AE35), 2)):
            same = row[skip:] == row[:-skip]  # no n-gram crosses texts
            count += np.bincount((row[skip:] + (h >> np.uint32(21)).astype(np.int64))[same], minlength=len(count))
        x = np.sqrt(count.reshape(len(part), DIMENSIONS))
        yield (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        at = to


def code_book(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of ``n`` languages: all splits for up to 5, else random ones chosen for distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.float64).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n)))
    best = (-1, None)
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (n, bits))
        apart = ((bits - m @ m.T) / 2 + np.eye(n) * bits).min()
        if apart > best[0]:
            best = (apart, m)
    return best[1]


def fit_bits(x: np.ndarray, y: np.ndarray, book: np.ndarray, steps: int = 300, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of one logistic classifier a bit; languages count alike whatever their number of rows."""
    target = book[y]
    weight = 1.0 / np.bincount(y, minlength=len(book))[y]
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], book.shape[1])), np.zeros(book.shape[1])
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        pull = -target * weight / (1 + np.exp(target * (x @ w + b)))
        gw, gb = x.T @ pull + ridge * w, pull.sum(axis=0)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w.astype(np.float32), b.astype(np.float32)


class Codes:
    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages, self.book = languages, code_book(len(languages))
        self.w, self.b = fit_bits(x.astype(np.float64), y, self.book) if len(languages) > 1 else (np.zeros((DIMENSIONS, 1), np.float32), np.zeros(1, np.float32))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, share of every language): shares fall with the summed loss of the bits."""
        bits = x @ self.w + self.b
        loss = np.logaddexp(0, -bits[:, None, :] * self.book[None]).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), share / share.sum(axis=1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        at = 0
        for x in features(pdf["text"].tolist()):
            yield pd.DataFrame({"lang": pdf["lang"].iloc[at : at + len(x)].to_numpy(), "x": [r.tobytes() for r in x]})
            at += len(x)


def learn(docs: DataFrame, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Codes:
    """Learn from rows whose ``crc32(id) mod 4`` is not 2, at most about ``sample_rows`` of them, alike for every language.

    Languages are the labels seen; a text without a letter is not learned from.
    Texts are turned into vectors of fixed size where they lie, and only those
    come to the driver.
    """
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # rates come from the rows that are learned from, and from no others
    counts = kept(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    langs = counts.count()
    rates = counts.select("lang", (F.lit(1 << 20) * F.least(F.lit(1.0), F.lit(sample_rows / max(1, langs)) / F.col("n"))).cast("long").alias("limit"))
    rows = rows.join(rates, "lang").filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < F.col("limit"))
    sample = rows.select("text", "lang").mapInPandas(_described, "lang string, x binary").toPandas()
    languages = sorted(sample["lang"].unique())
    place = {lang: i for i, lang in enumerate(languages)}
    x = np.stack([np.frombuffer(b, dtype=np.float32) for b in sample["x"]]) if len(sample) else np.zeros((0, DIMENSIONS), np.float32)
    return Codes(languages, x, np.array([place[lang] for lang in sample["lang"]], dtype=np.int64))


def prediction(codes: Codes, text: Column, ambiguous_below: float = 0.2) -> Column:
    """``struct(lang_pred, score, ambiguous)`` of a text column, by Arrow batches."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts = column.tolist()
            known = np.array([has_letter(t) for t in texts], dtype=bool)
            n = len(texts)
            pred, score, near = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
            if codes.languages and known.any():
                places, at = np.flatnonzero(known), 0
                for x in features([texts[i] for i in places]):
                    best, share = codes.decode(x)
                    here = places[at : at + len(x)]
                    pred[here] = np.array(codes.languages, dtype=object)[best]
                    top = np.sort(share, axis=1)
                    score[here] = top[:, -1]
                    near[here] = top[:, -1] - top[:, -2] < ambiguous_below if share.shape[1] > 1 else False
                    at += len(x)
            yield pd.DataFrame({"lang_pred": pred, "score": score, "ambiguous": near})

    return run(text)


def identify(docs: DataFrame, codes: Codes, ambiguous_below: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, held_out, lang_pred, score, ambiguous)`` of every row.

    ``score`` is the share of the chosen language; ``ambiguous`` is set when it
    is ahead of the next by less than ``ambiguous_below``.  A null text or one
    without a letter, or any text when no language was learned, is ``und`` with
    score 0.  A null id is not held out.  Only the text is read.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = docs.select(F.col(id_col), held.alias("held_out"), prediction(codes, F.col(text_col), ambiguous_below).alias("__op_found"))
    return found.select(id_col, "held_out", "__op_found.lang_pred", "__op_found.score", "__op_found.ambiguous")
