"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A text is a sequence of items: words, runs of punctuation, word shapes and marks of immediate
repetition. Every item has a sparse random index vector; an item's word vector is its own index vector
plus those of its neighbours in the sample. A document is the mean and the spread of its items' vectors.
A network with one hidden layer is trained in numpy, and its logits are divided by a temperature
fitted on a part of the sample that the network did not see.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_sample, crc32_of, excerpt

DIM = 96
NONZERO = 6
WINDOW = 2
VOCABULARY = 20_000
LEAST_COUNT = 4
PER_CLASS = 1000
SAMPLE_CHARS = 20_000
HIDDEN = 32
REPEAT = "<rep>"
CACHED_TOKENS = 400_000

_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(word: str) -> str:
    if word.islower():
        return "<lower>"
    if word.isupper():
        return "<upper>" if len(word) > 1 else "<cap>"
    return "<title>" if word.istitle() else "<mixed>"


def items_of(token: str) -> list[str]:
    """Items of one white-space token: its words with their shapes, numbers and runs of punctuation."""
    out = []
    for part in _PARTS.findall(token):
        if part[0].isalpha():
            out += [shape(part), part.lower()]
        elif part[0].isdigit():
            out.append(f"<num{min(len(part), 9)}>")
        else:
            out.append(part[:4])
    return out


def index_vectors(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of each item's index vector, from its CRC-32."""
    pos, sign = np.empty((len(items), NONZERO), np.int64), np.empty((len(items), NONZERO))
    for i, item in enumerate(items):
        rng = np.random.default_rng(zlib.crc32(item.encode("utf-8", "surrogatepass")))
        pos[i] = rng.choice(DIM, NONZERO, replace=False)
        sign[i] = rng.choice([-1.0, 1.0], NONZERO)
    return pos, sign


def word_vectors(sequences: list[np.ndarray], pos: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Unit word vectors: own index vector plus the mean index vector of the neighbours within ``WINDOW``."""
    n = len(pos)
    flat, seen = np.zeros(n * DIM), np.zeros(n)
    items = np.concatenate(sequences)
    owner = np.repeat(np.arange(len(sequences)), [len(q) for q in sequences])
    for step in range(1, WINDOW + 1):
        near = np.flatnonzero(owner[:-step] == owner[step:])
        for i in range(0, len(near), 1 << 18):
            x, y = items[near[i : i + (1 << 18)]], items[near[i : i + (1 << 18)] + step]
            for a, b in ((x, y), (y, x)):
                flat += np.bincount((a[:, None] * DIM + pos[b]).ravel(), sign[b].ravel(), n * DIM)
                seen += np.bincount(a, minlength=n)
    vectors = flat.reshape(n, DIM) / np.maximum(seen, 1)[:, None]
    np.add.at(vectors, (np.arange(n)[:, None], pos), sign)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass
class QualityModel:
    """Item ids, word vectors, pooled-feature scaling, network layers and temperature."""

    ids: dict[str, int]
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    cache: dict[str, bytes] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def item_ids(self, text: str) -> np.ndarray:
        tokens = text.split()
        if len(self.cache) > CACHED_TOKENS:
            self.cache.clear()
        for t in [t for t in set(tokens) if t not in self.cache]:
            got = [self.ids[i] if i in self.ids else self.ids["<rare>"] for i in items_of(t)]
            self.cache[t] = np.array(got, dtype="<i4").tobytes()
        again = sum(map(operator.eq, tokens, tokens[1:]))
        known = np.frombuffer(b"".join(map(self.cache.__getitem__, tokens)), "<i4")
        return np.concatenate([known, np.full(again, self.ids[REPEAT], dtype=np.int32)])

    def pooled(self, text: str) -> np.ndarray:
        """Mean and standard deviation of the word vectors of a whole text; zeros if it has none."""
        counts = np.bincount(self.item_ids(text), minlength=len(self.vectors))
        at = np.flatnonzero(counts)
        if not len(at):
            return np.zeros(2 * DIM)
        share, v = counts[at] / counts.sum(), self.vectors[at]
        mean = share @ v
        return np.concatenate([mean, np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))])

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.center) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, pooled: list[np.ndarray]) -> np.ndarray:
        """Calibrated probabilities of a batch of pooled texts; 0.5 each from a model without layers."""
        if not self.layers or not pooled:
            return np.full(len(pooled), 0.5)
        z = self.logits(np.array(pooled)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 150) -> list[np.ndarray]:
    """Adam on the class-balanced logistic loss with a weight penalty."""
    rng = np.random.default_rng(seed)
    layers = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 128):
            at = order[i : i + 128]
            h = np.tanh(x[at] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3][0], -35, 35)))
            d = (p - y[at]) * weight[at] / len(at)
            dh = np.outer(d, layers[2]) * (1 - h * h)
            grads = [x[at].T @ dh + 1e-3 * layers[0], dh.sum(0), h.T @ d + 1e-3 * layers[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] -= 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on unseen logits, by a search over a fixed grid."""
    grid = np.geomspace(0.2, 8.0, 60)
    losses = [np.logaddexp(0, -(2 * y - 1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    """Word vectors, network and temperature from labelled texts; a fifth of them serves the temperature."""
    empty = QualityModel({"<rare>": 0, REPEAT: 1}, np.zeros((2, DIM), np.float32), np.zeros(2 * DIM), np.ones(2 * DIM), [], 1.0)
    if len(set(labels)) < 2:
        return empty
    counts: Counter[str] = Counter()
    token_items: dict[str, list[str]] = {}
    for t in texts:
        for token, n in Counter(t.split()).items():
            if token not in token_items:
                token_items[token] = items_of(token)
            for item in token_items[token]:
                counts[item] += n
    kept = sorted((i for i, n in counts.items() if n >= LEAST_COUNT), key=lambda i: (-counts[i], i))[:VOCABULARY]
    items = ["<rare>", REPEAT, *kept]
    ids = {item: i for i, item in enumerate(items)}
    model = QualityModel(ids, np.zeros((len(items), DIM), np.float32), empty.center, empty.scale, [], 1.0)
    sequences = [model.item_ids(t).astype(np.int64) for t in texts]
    model.vectors = word_vectors(sequences, *index_vectors(items))
    x, y = np.array([model.pooled(t) for t in texts]), np.array(labels)
    model.center, model.scale = x.mean(0), x.std(0) + 1e-3
    x = (x - model.center) / model.scale
    for_temperature = np.arange(len(y)) % 5 == 0
    layers = train_network(x[~for_temperature], y[~for_temperature])
    unseen = np.tanh(x[for_temperature] @ layers[0] + layers[1]) @ layers[2] + layers[3][0]
    model.layers, model.temperature = layers, fit_temperature(unseen, y[for_temperature])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``h, label, doc_id, text``: the bounded sample of :func:`.common.class_sample` of the labels 0 and 1."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    return class_sample(docs.select("doc_id", "text"), "label", per_class, known)


def _score(model, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = m.scores([m.pooled(t.as_py() or "") for t in batch.column(2)])
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Learned from ``labels(doc_id, quality)`` of documents whose CRC-32 of the id modulo ``folds`` is not
    ``held_fold``, on at most ``per_class`` rows of each label; of a text over ``SAMPLE_CHARS`` characters
    training sees windows from all over it. Scored from the whole text alone. Null and empty texts are
    scored as a text without items; without both labels every score is 0.5; a null ``doc_id`` is neither
    held out nor learned from; rows that repeat an id with unlike texts count as documents of their own;
    repeated rows come back each; an empty table gives an empty result; further columns are ignored.
    """
    def held():
        return F.coalesce(F.pmod(crc32_of(F.col("doc_id")), F.lit(folds)) == held_fold, F.lit(False))

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held().alias("held_out"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held())
    sample = labelled_sample(cols, known, "quality", per_class).select("h", "label", excerpt(F.col("text"), F.col("h"), SAMPLE_CHARS).alias("text"))
    rows = sorted(sample.collect(), key=lambda r: (r.h, r.label))
    model = docs.sparkSession.sparkContext.broadcast(fit([r.text for r in rows], [r.label for r in rows]))
    return cols.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
