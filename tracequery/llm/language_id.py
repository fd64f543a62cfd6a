"""Language identification by error-correcting output codes.

Every language has a codeword of bits; each bit splits the languages in two and has its own linear
classifier over hashed character n-grams. A text's bit margins are decoded to the codeword of least
loss, each bit weighted by how well its classifier knows that language. A small lead over the second
codeword flags the answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_sample, crc32_of

BUCKETS = 1 << 13
UNKNOWN = "und"
PER_LANGUAGE = 400
SAMPLE_ROWS = 4000
LEAST_ROWS = 2
MAX_LANGUAGES = 2000
RIDGE = 0.3
AMBIGUOUS_LEAD = 0.15


def _letter_classes() -> np.ndarray:
    """Class of every UTF-16 unit: 0 for other than letters, a-z 1 to 26, other letters hashed to 27..63."""
    out = np.zeros(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if 97 <= c <= 122:
            out[c] = c - 96
        elif 0xD800 <= c < 0xE000 or chr(c).isalpha():
            out[c] = 27 + c * 40503 % 37
    return out


_CLASSES: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(_letter_classes())
    return _CLASSES[0]


def ngram_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 3-gram buckets of the whole text and their values: square roots of counts, scaled to length one."""
    units = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")
    c = np.concatenate([[0], letter_classes()[units], [0]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # a gap between words is one zero
    two = c[:-1] * np.uint32(64) + c[1:]
    three = two[:-1] * np.uint32(64) + c[2:]
    codes = np.concatenate([two + np.uint32(1 << 20), three]) * np.uint32(0x9E3779B1) >> np.uint32(19)
    counts = np.bincount(codes, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at]).astype(np.float32)
    return at, values / max(1e-12, float(np.linalg.norm(values)))


def codewords(n: int, most: int = 63, seed: int = 3) -> np.ndarray:
    """Codewords of n languages as rows of +1 and -1: all splits in two for up to 7 languages, else seeded random ones."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        rows = [np.zeros(len(splits), int), *(splits >> i & 1 for i in range(n - 1))]
        return (np.array(rows) * -2 + 1).astype(np.int8)
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, most))
        m = m[:, np.abs(m.sum(0)) < n]
        signs = m.astype(np.float32)
        d = (m.shape[1] - signs @ signs.T) / 2 + np.eye(n, dtype=np.float32) * most
        if best is None or d.min() > best[0]:
            best = d.min(), m
    return best[1]


@dataclass
class LanguageModel:
    """Languages, codewords, bit classifiers (a column each, last row the offset) and decoding weights."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        at, values = ngram_features(text)
        return values @ self.weights[at] + self.weights[-1]

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """The language of least weighted exponential loss, its share of confidence, and whether it is ambiguous."""
        loss = (self.trust * np.exp(-2.0 * self.codes * margins)).sum(1)
        p = np.exp(-4.0 * (loss - loss.min()))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        lead = p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0)
        return self.languages[order[0]], float(p[order[0]]), bool(lead < AMBIGUOUS_LEAD)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """``und`` for null texts and those without a letter, or if no language was learned."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        return self.decode(self.margins(text))


def fit(features: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> LanguageModel:
    """Bit classifiers by regularised least squares on +1/-1 targets, solved in the dual for all bits at once."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    if not languages:
        return LanguageModel([], codes, np.zeros((BUCKETS + 1, 1), np.float32), codes.astype(float))
    y = np.array([languages.index(x) for x in langs])
    x = np.zeros((len(features), BUCKETS + 1), dtype=np.float32)
    for i, (at, values) in enumerate(features):
        x[i, at] = values
    x[:, -1] = 1.0
    targets = codes[y].astype(np.float64)
    gram = (x @ x.T).astype(np.float64)
    dual = np.linalg.solve(gram + RIDGE * np.eye(len(y)), targets)
    # Leave-one-out margins tell how well each bit knows each language.
    inverse = np.linalg.inv(gram + RIDGE * np.eye(len(y)))
    held_out = targets - dual / np.diag(inverse)[:, None]
    right = (held_out * targets > 0).astype(float)
    trust = np.array([right[y == k].mean(0) for k in range(len(languages))]) + 1e-3
    weights = (x.T @ dual.astype(np.float32)).astype(np.float32)
    return LanguageModel(languages, codes, weights, trust / trust.sum(1, keepdims=True))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram buckets and values of whole texts, of a size that does not depend on the text's."""
    for batch in batches:
        got = [ngram_features(t.as_py()) for t in batch.column(2)]
        at = pa.array([a.astype("<u2").tobytes() for a, _ in got], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, pa.array([v.tobytes() for _, v in got], pa.binary())], ["h", "lang", "at", "values"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on a bounded sample: at most ``per_language`` documents of a language, fewer where there are so many
    languages that ``rows`` in all would not do, but ``LEAST_ROWS`` of each of the ``MAX_LANGUAGES`` most
    frequent. Features of the whole texts are made where the texts are."""
    sample = class_sample(docs, "lang", per_language, total=rows, least=LEAST_ROWS, max_classes=MAX_LANGUAGES)
    got = sample.select("h", "lang", "text").mapInArrow(_features, "h long, lang string, at binary, values binary").collect()
    got.sort(key=lambda r: (r.lang, r.h))
    return fit([(np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r["values"], np.float32)) for r in got], [r.lang for r in got])


def _predict(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(2)]
            arrays = [batch.column(0), batch.column(1)]
            arrays += [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def identify_languages(docs: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row of ``docs(doc_id, text, lang)``.

    Learned from documents whose CRC-32 of the id modulo ``folds`` is not ``held_fold``, on a bounded sample
    (see :func:`train`), texts of any length; predicted from the whole text alone. Null texts, texts without a letter and an
    input without labels give ``und`` with score 0, flagged ambiguous; a null ``doc_id`` is neither held out
    nor learned from; repeated rows come back each; an empty table gives an empty result; further columns
    are ignored.
    """
    fold = F.pmod(crc32_of(F.col("doc_id")), F.lit(folds))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "text", F.col("lang").cast("string").alias("lang"))
    model = train(cols.where("doc_id IS NOT NULL AND NOT held_out").select("doc_id", "lang", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return cols.select("doc_id", "held_out", "text").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
