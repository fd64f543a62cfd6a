"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Two strings are alike as far as they share subsequences of three characters, each weighted by a decay
to the power of the stretch it spans; gaps and inserted characters lower a match but do not lose it.
The strings of a sentence are its tokens and every two neighbouring words with the gap between them, so
insults cut by a space and phrases of ordinary words count too. Landmark strings, drawn from both classes,
give a finite feature map, on which a linear machine is trained with the squared hinge loss. Labels are of
documents: each toxic document is a bag whose strongest string is the positive example, chosen anew between
fits, and the strings of clean documents are negative ones. A document's score is a logistic function of
its strongest token and its strongest pair of words. Positive examples are also shown disguised, with a
character inserted, doubled or left out.

The kernel to a fixed set of landmarks is linear in a string's subsequences, so the trained machine
folds into one weight per subsequence; scoring a new string is a sum over its subsequences and a norm.
For pairs of words the sums come from running totals over the whole text, which bound the scores of all
pairs, and norms are taken only of pairs whose bound exceeds the best score found so far.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, materialize
from .language_id import letter_classes
from .quality import labelled_sample

DECAY = 0.6
REACH = 6
LONGEST = 24
LANDMARKS = 128
PER_CLASS = 1500
#: Token strings and word pairs of one document that training keeps at most, by a seeded hash where it has more.
BAG = (2000, 300)
ROUNDS = 3
DISGUISES = 3
#: Share of toxic documents that a score of one half assumes.
PRIOR, PAIR_PRIOR = 0.02, 0.02
NEGATIVES = 12_000
CACHED_TOKENS = 500_000
#: Units of text whose pairs of words are scored together.
UNITS = 1 << 16
LOWEST = -3.0
MARKS = ".,;:!?\"'()[]{}<>*#-"

_LETTERS = re.compile(r"[^\W_]+")
_WORDS = re.compile(r"[^\W\d_]+")
_CODES = 1 << 18


def strings_of(token: str) -> list[str]:
    """The strings of a lower-case token: its parts of letters and digits, and all of them joined (an insult
    with marks inserted). Long ones come as overlapping windows."""
    if token.isalpha() and len(token) <= LONGEST:
        return [token] if len(token) > 1 else []
    parts = _LETTERS.findall(token)
    if len(parts) > 1:
        parts.append("".join(parts))
    out = []
    for p in parts:
        if len(p) <= LONGEST:
            out.append(p)
        else:
            out += [p[i : i + LONGEST] for i in range(0, len(p) - LONGEST // 2, LONGEST // 2)]
    return [p for p in out if len(p) > 1 and not p.isdigit()]


def spaced_out(tokens: list[str]) -> list[str]:
    """Runs of four or more single-character tokens, joined: insults written with gaps."""
    if len(tokens) < 4:
        return []
    one = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
    if not (one[:-3] & one[1:-2] & one[2:-1] & one[3:]).any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], one.astype(np.int8), [0]])))
    return ["".join(tokens[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= 4]


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of three within ``REACH`` of each other, and their weights."""
    if length not in _TRIPLES:
        got = [(i, j, k) for i in range(length) for k in range(i + 2, min(length, i + REACH + 1)) for j in range(i + 1, k)]
        at = np.array(got, dtype=np.int64).reshape(-1, 3)
        _TRIPLES[length] = at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return _TRIPLES[length]


def _norms(codes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The norm of each row's subsequences, equal ones added up."""
    order = np.argsort(codes, axis=1, kind="stable")
    ranked = np.take_along_axis(codes, order, 1)
    new = np.ones(codes.shape, dtype=bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    starts = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(w[order].ravel(), starts)
    return np.sqrt(np.bincount(starts // codes.shape[1], sums * sums, len(codes)))


def _codes_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes (a row each) and weights of equally long rows of character classes."""
    at, w = triples(c.shape[1])
    return (c[:, at[:, 0]] << 12) | (c[:, at[:, 1]] << 6) | c[:, at[:, 2]], w


def subsequences(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For strings of equal length together: their places in the list, subsequence codes (rows), weights of the
    columns, and each string's norm under the kernel. Both ends of a string count as a character."""
    by: dict[int, list[int]] = {}
    coded = [s.encode("utf-16-le", "surrogatepass") for s in strings]
    for i, c in enumerate(coded):
        by.setdefault(len(c) // 2, []).append(i)
    classes = letter_classes()
    for length, every in by.items():
        for i in range(0, len(every), 4096):
            some = np.array(every[i : i + 4096])
            units = np.frombuffer(b"".join(coded[j] for j in some), "<u2").reshape(len(some), length)
            c = np.zeros((len(some), length + 2), dtype=np.int64)
            c[:, 1:-1] = classes[units]
            codes, w = _codes_of(c)
            yield some, codes, w, _norms(codes, w)


@dataclass
class Pairs:
    """The pairs of neighbouring words of some texts in one sequence of character classes, every run of other
    characters as one zero: where each pair starts and ends (its gaps included) and whose it is."""

    sequence: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Pairs:
        coded = [f" {t} ".lower().encode("utf-16-le", "surrogatepass") for t in texts]
        c = letter_classes()[np.frombuffer(b"".join(coded), "<u2")]
        ends = np.cumsum([len(x) // 2 for x in coded])
        kept = np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)]) if len(c) else np.zeros(0, bool)
        place, sequence = np.flatnonzero(kept), c[kept].astype(np.int64)
        word = np.flatnonzero((sequence[1:] != 0) & (sequence[:-1] == 0)) + 1
        stop = np.flatnonzero((sequence[1:] == 0) & (sequence[:-1] != 0)) + 1
        owner = np.searchsorted(ends, place[word], side="right")
        start, end = word[:-1] - 1, stop[1:] + 1
        fine = (owner[1:] == owner[:-1]) & (end - start <= 2 * LONGEST)
        return cls(sequence, start[fine], end[fine], owner[:-1][fine])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The weighted sum over each pair's subsequences, from running totals for every span."""
        n, out = len(self.sequence), np.zeros(len(self.start))
        # The first two classes of a subsequence by the distance between them, shared by all spans.
        heads = [None, *((self.sequence[: n - inner] << 12) | (self.sequence[inner:] << 6) for inner in range(1, min(REACH, n)))]
        for span in range(2, REACH + 1):
            if n <= span:
                break
            last = self.sequence[span:]
            total = weights.take(heads[1][: n - span] | last, mode="clip")
            for inner in range(2, span):
                total += weights.take(heads[inner][: n - span] | last, mode="clip")
            run = np.zeros(n - span + 1)
            np.cumsum(total, dtype=np.float64, out=run[1:])
            first = np.minimum(self.start, n - span)
            out += DECAY ** (span + 1.0) * (run[np.maximum(self.end - span, first)] - run[first])
        return out

    def exact(self, some: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sum by norm of the pairs ``some``."""
        out, sizes = np.empty(len(some)), (self.end - self.start)[some]
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for i in range(0, len(at), 4096):
                rows = at[i : i + 4096]
                c = self.sequence[self.start[some[rows]][:, None] + np.arange(size)]
                codes, w = _codes_of(c)
                out[rows] = (weights[codes] @ w) / _norms(codes, w)
        return out

    def best(self, weights: np.ndarray, n: int) -> np.ndarray:
        """The greatest sum by norm among each of n texts' pairs, zero at least.

        A pair's norm is not below that of as many subsequences that all differ, so its sum by that norm is
        a bound; norms are taken only where the bound exceeds what the text has already.
        """
        best = np.zeros(n)
        sizes = self.end - self.start
        least = np.ones(2 * LONGEST + 1)
        for size in np.unique(sizes).tolist():
            least[size] = np.sqrt((triples(size)[1] ** 2).sum()) or 1.0
        bound = self.sums(weights.astype(np.float32)) / least[sizes] + 1e-6
        left = np.flatnonzero(bound > 0)
        left = left[np.lexsort((-bound[left], self.owner[left]))]
        while len(left):
            who = self.owner[left]
            first = np.concatenate([[True], who[1:] != who[:-1]])
            rank = np.arange(len(left)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            now = rank < 4
            np.maximum.at(best, who[now], self.exact(left[now], weights))
            left = left[~now]
            left = left[bound[left] > best[self.owner[left]]]
        return best


def kernel(a: str, b: str) -> float:
    """The normalised gap-weighted subsequence kernel of two strings."""
    vectors = []
    for s in (a, b):
        (_, codes, w, norms), = subsequences([s])
        vectors.append(np.bincount(codes[0], w, _CODES) / norms[0])
    return float(vectors[0] @ vectors[1])


def landmark_features(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of every string with every landmark."""
    used: dict[int, int] = {}
    rows: list[dict[int, float]] = [{} for _ in landmarks]
    for some, codes, w, norms in subsequences(landmarks):
        for r, i in enumerate(some.tolist()):
            for c, x in zip(codes[r].tolist(), (w / norms[r]).tolist()):
                rows[i][c] = rows[i].get(c, 0.0) + x
                used.setdefault(c, len(used) + 1)
    table = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)
    for i, row in enumerate(rows):
        for c, x in row.items():
            table[used[c], i] = x
    place = np.zeros(_CODES, dtype=np.int64)
    place[list(used)] = list(used.values())
    out = np.zeros((len(strings), len(landmarks)), dtype=np.float32)
    for some, codes, w, norms in subsequences(strings):
        got = np.zeros((len(some), len(landmarks)), dtype=np.float32)
        at = place[codes]
        for j in range(codes.shape[1]):
            hit = np.flatnonzero(at[:, j])
            got[hit] += np.float32(w[j]) * table[at[hit, j]]
        out[some] = got / norms[:, None]
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Primal Newton steps on the weighted squared hinge loss; the last coefficient is the offset. Rows are taken a
    block at a time, so single precision is enough to hold them."""
    ridge = penalty * np.eye(x.shape[1] + 1)
    ridge[-1, -1] = 1e-6
    v = np.zeros(x.shape[1] + 1)
    active = None
    for _ in range(rounds):
        now = y * (x @ v[:-1].astype(x.dtype) + v[-1]) < 1
        if active is not None and np.array_equal(now, active):
            break
        active, left, right = now, ridge.copy(), np.zeros(len(v))
        for i in range(0, len(x), 4096):
            rows = i + np.flatnonzero(now[i : i + 4096])
            xa = np.hstack([x[rows], np.ones((len(rows), 1))]).astype(np.float64)
            left += xa.T @ (xa * weight[rows][:, None])
            right += xa.T @ (weight[rows] * y[rows])
        v = np.linalg.solve(left, right)
    return v


def logistic(x: np.ndarray, y: np.ndarray, prior: float = PRIOR, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, classes weighted as if ``prior`` of all were positive; the last
    coefficient is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    v = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * v
        hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty * np.eye(len(v))
        v -= np.linalg.solve(hess, grad)
    return v


def disguised(string: str, rng: np.random.Generator) -> str:
    """The string with one character inserted, doubled or left out, away from its ends."""
    at = int(rng.integers(1, len(string)))
    kind = int(rng.integers(3))
    if kind == 0:
        return string[:at] + "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(36))] + string[at:]
    if kind == 1 or len(string) < 6:
        return string[:at] + string[at - 1] + string[at:]
    return string[: at - 1] + string[at:] if at > 1 else string


def word_pairs(text: str) -> set[str]:
    """Every two neighbouring words of a lower-case text with a space between, as :class:`Pairs` sees them."""
    words = _WORDS.findall(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:]) if len(a) + len(b) + 3 <= 2 * LONGEST}


@dataclass
class ToxicityModel:
    """Weight of every subsequence, offset, and a logistic each over the strongest token and the strongest pair."""

    weights: np.ndarray
    offset: float
    token_link: np.ndarray = field(default_factory=lambda: np.zeros(2))
    pair_link: np.ndarray = field(default_factory=lambda: np.zeros(2))
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def string_scores(self, strings: list[str]) -> np.ndarray:
        out = np.empty(len(strings))
        for some, codes, w, norms in subsequences(strings):
            out[some] = (self.weights[codes] @ w) / norms + self.offset
        return out

    def learn_tokens(self, tokens: set[str]) -> None:
        """Put the best score of each new token's strings into the cache."""
        if len(self.cache) > CACHED_TOKENS:
            self.cache.clear()
        new = [t for t in tokens if t not in self.cache]
        owners, strings = [], []
        for i, t in enumerate(new):
            for s in strings_of(t):
                owners.append(i)
                strings.append(s)
        best = np.full(len(new), LOWEST)
        if strings:
            np.maximum.at(best, owners, self.string_scores(strings))
        self.cache.update(zip(new, best.tolist()))

    def features(self, texts: list[str]) -> np.ndarray:
        """The best score of each text's tokens and of its pairs of words, by whole text."""
        tokens = [t.lower().split() for t in texts]
        # Marks at the ends of a token are no part of its strings.
        sets = [{x.strip(MARKS) for x in set(t)}.union(spaced_out(t)) for t in tokens]
        self.learn_tokens(set().union(*sets))
        get = self.cache.__getitem__
        out = np.empty((len(texts), 2))
        out[:, 0] = [max(map(get, s), default=LOWEST) for s in sets]
        for i, j in _runs([len(t) for t in texts], UNITS):
            out[i:j, 1] = [self.best_pair(texts[i])] if len(texts[i]) > UNITS else self.offset + Pairs.of(texts[i:j]).best(self.weights, j - i)
        return out

    def best_pair(self, text: str) -> float:
        """That of a very long text, piece by piece; pieces overlap by more than a pair."""
        step = UNITS - 4 * LONGEST
        return max(self.offset + float(Pairs.of([text[i : i + UNITS]]).best(self.weights, 1)[0]) for i in range(0, len(text), step))

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.features(texts)
        z = np.maximum(x[:, 0] * self.token_link[0] + self.token_link[1], x[:, 1] * self.pair_link[0] + self.pair_link[1])
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of at most ``most`` together; a larger one is a run of its own."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes)


def bag_of(text: str, seed: int = 0) -> tuple[set[str], set[str]]:
    """Token strings and word pairs of a text, those of smallest seeded hash where there are over ``BAG``."""
    lower = text.lower()
    tokens = lower.split()
    strings = {s for t in set(tokens).union(spaced_out(tokens)) for s in strings_of(t)}
    return tuple(x if len(x) <= n else set(sorted(x, key=lambda v: (zlib.crc32(v.encode("utf-8", "surrogatepass"), seed), v))[:n]) for x, n in zip((strings, word_pairs(lower)), BAG))


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists one after another, and the list that each belongs to."""
    whole = column.combine_chunks()
    return whole.flatten(), np.repeat(np.arange(len(whole)), pc.list_value_length(whole).to_numpy(zero_copy_only=False))


def _counts(*values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    found = pc.value_counts(pa.concat_arrays(values))
    order = pc.sort_indices(found.field("values"))
    return found.field("values").take(order), found.field("counts").take(order).to_numpy()


def fit(bags: pa.Table) -> tuple[ToxicityModel, np.ndarray, np.ndarray]:
    """Multiple-instance training on bags ``(label, bag, tokens, pairs)``; rows of equal label and ``bag`` count once.
    Returns a model without links, and scores of disguised examples: of tokens, and of such cut in two by a space.

    Strings stay in Arrow but for the examples, so a sample of many strings takes little memory.
    """
    place: dict[tuple[int, int], int] = {}
    for i, key in enumerate(zip(bags.column("label").to_pylist(), bags.column("bag").to_pylist())):
        place.setdefault(key, i)
    bags = bags.take(pa.array(sorted(place.values()), pa.int64()))
    bags = bags.filter(pc.greater(pc.list_value_length(bags.column("tokens")), 0))
    toxic, clean = (bags.filter(pc.equal(bags.column("label"), y)) for y in (1, 0))
    if not len(toxic) or not len(clean):
        return ToxicityModel(np.zeros(_CODES), 0.0), np.empty(0), np.empty(0)
    (tokens, token_of), (pairs, pair_of) = (_lists(toxic.column(c)) for c in ("tokens", "pairs"))
    clean_tokens, clean_pairs = (_counts(_lists(clean.column(c))[0]) for c in ("tokens", "pairs"))

    def strength(values: pa.Array, others: tuple[pa.Array, np.ndarray], least: int, least_odds: float) -> tuple[pa.Array, np.ndarray]:
        """Strings of toxic bags by how much more often they occur in these than in clean ones."""
        known, n = _counts(values)
        at = pc.fill_null(pc.index_in(known, value_set=others[0]), -1).to_numpy(zero_copy_only=False)
        m = np.where(at >= 0, np.append(others[1], 0)[at], 0)
        odds = np.log((n + 0.5) / (len(toxic) + 1)) - np.log((m + 0.5) / (len(clean) + 1))
        kept = np.flatnonzero((n >= least) & (odds > least_odds))
        return known.take(pa.array(kept)), (odds * np.sqrt(n))[kept]

    strong = [strength(tokens, clean_tokens, 1, -np.inf), strength(pairs, clean_pairs, 2, 1.0)]
    every = [*strong[0][0].to_pylist(), *strong[1][0].to_pylist()]
    strengths = np.concatenate([strong[0][1], strong[1][1]])
    # Each bag's strings as places in ``every``.
    inside, first_pair = [], len(strong[0][0])
    for values, owner, known, start in ((tokens, token_of, strong[0][0], 0), (pairs, pair_of, strong[1][0], first_pair)):
        at = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False)
        inside.append(np.stack([owner[at >= 0], at[at >= 0] + start]))
    owner, member = np.concatenate(inside, axis=1)
    order = np.lexsort((member, owner))
    owner, member = owner[order], member[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner))

    def strongest(score: np.ndarray) -> Counter[str]:
        """Each bag's string of greatest score, the first of equal ones."""
        return Counter(every[member[a + int(np.argmax(score[member[a:b]]))]] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()))

    rng = np.random.default_rng(17)
    negatives = [known.take(pa.array(rng.permutation(len(known))[: 3 * NEGATIVES])).to_pylist() for known, _ in (clean_tokens, clean_pairs)]
    witnesses = strongest(strengths)
    # Landmarks are drawn from the examples of both classes without regard to strength.
    marks = [str(s) for s in rng.permutation(sorted(witnesses))[:LANDMARKS]]
    marks += [s for some, n in zip(negatives, (LANDMARKS, LANDMARKS // 2)) for s in some[:n] if s not in witnesses]
    own = landmark_features(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    mined, hard = [s for some in negatives for s in some], []
    for _ in range(ROUNDS):
        pos, neg = sorted(witnesses), list(dict.fromkeys([*negatives[0][:NEGATIVES], *negatives[1][: NEGATIVES // 2], *hard]))
        counts = np.sqrt([witnesses[s] for s in pos] * (1 + DISGUISES))
        pos += [disguised(s, rng) for _ in range(DISGUISES) for s in pos]
        x = landmark_features(pos + neg, marks) @ root.astype(np.float32)
        y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
        weight = np.concatenate([counts / counts.sum(), np.full(len(neg), 1 / len(neg))])
        v = linear_svm(x, y, weight, 1e-4)
        beta = root @ v[:-1]
        table = np.zeros(_CODES)
        for some, codes, w, norms in subsequences(marks):
            for r, i in enumerate(some.tolist()):
                np.add.at(table, codes[r], beta[i] * w / norms[r])
        model = ToxicityModel(table, float(v[-1]))
        witnesses = strongest(model.string_scores(every))
        hard = [mined[i] for i in np.argsort(-model.string_scores(mined), kind="stable")[:3000].tolist()]
    shown = sorted(witnesses.elements())
    cut = [f"{s[:k]} {s[k:]}" for s in shown if len(s) > 3 and " " not in s for k in (int(rng.integers(2, len(s) - 1)),)]
    return model, model.string_scores([disguised(s, rng) for s in shown]), model.string_scores(cut)


def link(model: ToxicityModel, features: np.ndarray, labels: np.ndarray, disguises: np.ndarray, cuts: np.ndarray) -> ToxicityModel:
    """Fit the two logistics on documents' features and the disguised examples; without both labels every score is 0.5."""
    if len(set(labels.tolist())) == 2 and model.weights.any():
        model.token_link = logistic(np.concatenate([features[:, 0], disguises])[:, None], np.concatenate([labels, np.ones(len(disguises))]))
        clean = features[labels == 0, 1]
        pairs = np.concatenate([features[labels == 1, 1], cuts])
        model.pair_link = logistic(np.concatenate([clean, pairs])[:, None], np.repeat([0.0, 1.0], [len(clean), len(pairs)]), PAIR_PRIOR)
    model.cache.clear()
    return model


def _score(model, texts_at_once: int = 256):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, texts_at_once):
                some = batch.slice(i, texts_at_once)
                scores = m.scores([t or "" for t in some.column(2).to_pylist()])
                arrays = [some.column(0), some.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    return run


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [bag_of(t, h & 0xFFFFFFFF) for h, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        lists = [pa.array([sorted(g[k]) for g in got], pa.list_(pa.string())) for k in (0, 1)]
        keys = [int.from_bytes(hashlib.blake2b("\n".join(sorted(g[0])).encode("utf-8", "surrogatepass"), digest_size=7).digest()) for g in got]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.int64()), *lists], ["h", "label", "bag", "tokens", "pairs"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on a bounded sample: at most ``per_class`` documents of each label, of whatever length; the driver
    gets at most ``BAG`` strings of each. The links are fitted on the same documents' whole texts."""
    sample = materialize(labelled_sample(docs, labels, "toxic", per_class).select("h", "label", "text"), "toxic_sample")
    rows = sample.mapInArrow(_bags, "h long, label int, bag long, tokens array<string>, pairs array<string>").toArrow()
    model, disguises, cuts = fit(rows.sort_by([("h", "ascending"), ("label", "ascending")]).select(["label", "bag", "tokens", "pairs"]))
    del rows
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.features(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x[:, 0]), pa.array(x[:, 1])], ["h", "label", "token", "pair"])

    got = sorted(map(tuple, sample.mapInArrow(features, "h long, label int, token double, pair double").collect()))
    return link(model, np.array([r[2:] for r in got]).reshape(-1, 2), np.array([r[1] for r in got], dtype=float), disguises, cuts)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Learned from ``labels(doc_id, toxic)`` of documents whose CRC-32 of the id modulo ``folds`` is not
    ``held_fold``; scored from the whole text alone. Null and empty texts are scored as a text without
    strings; without both labels every score is 0.5; a null ``doc_id`` is neither held out nor learned from;
    rows that repeat an id with unlike texts count as documents of their own; repeated rows come back each;
    an empty table gives an empty result; further columns are ignored.
    """
    def held():
        return F.coalesce(F.pmod(crc32_of(F.col("doc_id")), F.lit(folds)) == held_fold, F.lit(False))

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held().alias("held_out"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held())
    model = docs.sparkSession.sparkContext.broadcast(train(cols, known, per_class))
    return cols.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored toxic, all columns as they are, in one narrow pass without a join.

    The model is that of :func:`score_toxicity`, with its rules for awkward input: null and empty texts are
    clean and stay unless such texts are labelled toxic, without both labels every row stays, an empty table
    stays empty.
    """
    held = F.coalesce(F.pmod(crc32_of(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held)
    trained = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known)
    if not trained.token_link.any():
        return docs
    model = docs.sparkSession.sparkContext.broadcast(trained)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                scores = m.scores([t or "" for t in some.column(at).to_pylist()])
                yield some.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
