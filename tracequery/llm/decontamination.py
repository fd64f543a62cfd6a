"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Words are compared in lower case without marks at their ends. Seeds are n-grams of the test items that are rare
in the corpus, by a count over all its texts: 3-grams, and 2-grams, which survive where every third word is
edited. Of every ``SEED_RUN`` neighbouring 3-grams of an item the rarest is a
seed whatever its count, so any stretch of ``SEED_RUN + 2`` unchanged words holds one, however common a
leaked passage has become. Texts that contain seeds are aligned with their item around the place they point
to if enough 2-grams of the item stand there, and the alignment score, as a share of a perfect one, decides. Edited and paraphrased copies lose score
by their changed words only. A part of an item counts by itself if, with every changed word weighed as
``STRICT``, it is worth ``PASSAGE_WORDS`` unchanged words, however long the item is.

Test items are a small table; they are broadcast in blocks of a checked size, one pass over the texts a
block, so texts are never shuffled.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_WORDS = 3
SEED_RUN = 3
#: Grams of at most so many occurrences per word of the corpus are rare (3-grams, 2-grams), and such of at most so
#: many in all.
RARE, RARE_COUNT = (1e-4, 2e-5), 100.0
#: Items over so many words are aligned in pieces that overlap by twice ``PASSAGE_WORDS``.
PIECE_WORDS = 400
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Words of a part that counts by itself, and its score of a changed, missing or added word.
PASSAGE_WORDS, STRICT = 13, -8
SLACK = 12
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 50_000_000
CACHED_TOKENS = 1_000_000

_MARKS = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> list[str]:
    """Lower-case words without marks at their ends; tokens of marks only are left out."""
    return [w for w in (_MARKS.sub("", t) for t in text.lower().split()) if w]


class WordIds(dict):
    """White-space token to the id of its word: 1 and up in the vocabulary, 0 for others, -1 without a word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        word = token.lower()
        if not (word[0].isalnum() and word[-1].isalnum()):
            word = _MARKS.sub("", word)
        got = self.vocabulary.get(word, 0) if word else -1
        if len(self) > CACHED_TOKENS:
            # Frequent tokens come early; the cache keeps its older part.
            for late in list(islice(self, CACHED_TOKENS * 4 // 5, None)):
                del self[late]
        self[token] = got
        return got

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return ids[ids >= 0]


def vocabulary_of(texts: Iterable[str]) -> dict[str, int]:
    return {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in words_of(t)}))}


def align(item: np.ndarray, window: np.ndarray, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int]:
    """Best local alignment score and the end of the aligned part in the window (exclusive).

    A row per item word; within a row, gaps are resolved by a running maximum.
    """
    steps = np.arange(len(window) + 1) * -gap
    row = np.zeros(len(window) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        now = np.zeros_like(row)
        now[1:] = row[:-1] + np.where((window == word) & (word > 0), MATCH, mismatch)
        np.maximum(now, row + gap, out=now)
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Grams:
    """The 2- and 3-grams of some word sequences as sorted codes, and the search for them in other sequences. A
    bitmap of hashed 2-grams settles most places of a text with one look."""

    def __init__(self, items: list[np.ndarray], words: int):
        self.base = words + 1
        self.two = np.unique(np.concatenate([*(self.code(a) for a in items), np.empty(0, np.int64)]))
        self.three = np.unique(np.concatenate([*(self.code3(a) for a in items), np.empty(0, np.int64)]))
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.slot(self.two)] = True

    def code(self, a: np.ndarray) -> np.ndarray:
        return a[:-1] * self.base + a[1:]

    def code3(self, a: np.ndarray) -> np.ndarray:
        return (a[: max(0, len(a) - 2)] * self.base + a[1 : len(a) - 1]) * self.base + a[2:] if len(a) > 2 else np.empty(0, np.int64)

    @staticmethod
    def slot(code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    @staticmethod
    def among(known: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``code`` of known codes, and their places among the known ones."""
        if not len(known) or not len(code):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(known, code), len(known) - 1)
        at = np.flatnonzero(known[place] == code)
        return at, place[at]

    def found(self, a: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 3-grams and 2-grams: where in ``a`` they start, and their places among the codes."""
        known, code = a > 0, self.code(a)
        at = np.flatnonzero(known[:-1] & known[1:] & self.bits[self.slot(code)])
        some, place = self.among(self.two, code[at])
        pairs = at[some], place
        start = pairs[0][:-1][np.diff(pairs[0]) == 1]
        some, place = self.among(self.three, (a[start] * self.base + a[start + 1]) * self.base + a[start + 2])
        return [(start[some], place), pairs]


class Matcher:
    """Seeds of the test items and the search for them in word ids."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: dict[str, int], grams: Grams, counts: list[np.ndarray], total: int, least_score: float = LEAST_SCORE):
        """``counts`` are those of the 3-grams and 2-grams in a corpus of ``total`` words."""
        self.least_score, self.grams = least_score, grams
        self.words = WordIds(vocabulary)
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        self.first: list[int] = []
        for i, t in items:
            every = self.words.of(t)
            for at in range(0, max(1, len(every) - 2 * PASSAGE_WORDS), PIECE_WORDS - 2 * PASSAGE_WORDS):
                self.ids.append(i)
                self.items.append(every[at : at + PIECE_WORDS])
                self.first.append(at)
        self.sizes = np.array([len(a) for a in self.items], dtype=np.int64)
        self.lengths = {i: len(self.words.of(t)) for i, t in items}
        rare = [c <= max(RARE_COUNT, share * total) for c, share in zip(counts, RARE)]
        # Per kind of gram: the item pieces and places of each code, in runs.
        chosen: list[list[tuple[int, int, int]]] = [[], []]
        for k, a in enumerate(self.items):
            three = np.searchsorted(grams.three, grams.code3(a))
            keep = rare[0][three]
            for i in range(max(0, len(three) - SEED_RUN + 1)) or range(min(1, len(three))):
                keep[i + int(np.argmin(counts[0][three[i : i + SEED_RUN]]))] = True
            chosen[0] += [(int(three[i]), k, i) for i in np.flatnonzero(keep).tolist()]
            chosen[1] += [(int(c), k, i) for i, c in enumerate(np.searchsorted(grams.two, grams.code(a)).tolist()) if rare[1][c]]
        self.runs = []
        for kind, known in zip(chosen, (grams.three, grams.two)):
            rows = np.array(sorted(kind), dtype=np.int64).reshape(-1, 3)
            edges = np.searchsorted(rows[:, 0], np.arange(len(known) + 1))
            self.runs.append((edges, rows[:, 1], rows[:, 2]))

    def hits(self, a: np.ndarray) -> np.ndarray:
        """Rows ``(piece, place in the text less that in the piece, kind)`` of every seed in a text's word ids,
        sorted; kinds are 0 for 3-grams, else 1."""
        out = []
        for kind, ((at, place), (edges, item, where)) in enumerate(zip(self.grams.found(a), self.runs)):
            first, n = edges[place], edges[place + 1] - edges[place]
            if not n.any():
                continue
            rows = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out.append(np.stack([item[rows], np.repeat(at, n) - where[rows], np.full(len(rows), kind)], axis=1))
        if not out:
            return np.empty((0, 3), np.int64)
        rows = np.concatenate(out)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def passages(self, item: np.ndarray, window: np.ndarray, low: int) -> Iterator[tuple[int, int, int]]:
        """``(score, first, stop)`` of the best passage in a window and of those before and after it.

        With m of n words matched, half a perfect score leaves 2 m - n - 1 >= n / 3 - 1 pairs of neighbours whole where
        words are changed or left out, and a part that counts by itself leaves more than PASSAGE_WORDS - 4; a quarter of
        the pairs leaves room for words put in. Fewer settle it without an alignment.
        """
        pairs = self.grams.code(item)
        if len(window) < 2 or np.isin(pairs, self.grams.code(window)).sum() < min(max(1, len(item) // 4 - 1), PASSAGE_WORDS - 4):
            return
        costs = (MISMATCH, GAP)
        score, end = align(item, window)
        if score < self.least_score * MATCH * len(item):
            # Stricter costs never add score.
            if score < MATCH * PASSAGE_WORDS:
                return
            costs = (STRICT, STRICT)
            score, end = align(item, window, *costs)
            if score < MATCH * PASSAGE_WORDS:
                return
        _, back = align(item[::-1], window[:end][::-1], *costs)
        yield from self.passages(item, window[: end - back], low)
        yield score, low + end - back, low + end
        yield from self.passages(item, window[end:], low + end)

    def find(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """``(item_id, score, first word, last word exclusive, seeds)`` of every aligned passage."""
        a = self.words.of(text or "")
        if len(a) < 2:
            return []
        hits = self.hits(a)
        if not len(hits):
            return []
        found: list[tuple[int, int, float, int, int, int]] = []
        piece, shift, kind = hits.T
        # Seeds of one piece that point to about the same place are a group; groups are kept short, so that
        # copies in a row are looked at a few at a time.
        new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (np.diff(shift) > SLACK)])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(hits))
        # A passage of an item of 12 words or more holds several seeds; without a 3-gram among them it holds more.
        likely = ends - starts >= np.minimum(self.sizes[piece[starts]] // 6, 2 + np.minimum.reduceat(kind, starts))
        for x, y in zip(starts[likely].tolist(), ends[likely].tolist()):
            k = int(piece[x])
            item = self.items[k]
            reach, at = max(SLACK, len(item) // 2), x
            seen: list[tuple[int, int, int, int]] = []
            while at < y:
                to = at + int(np.searchsorted(shift[at:y], shift[at] + reach, side="right"))
                low, high = max(0, int(shift[at]) - SLACK), min(len(a), int(shift[to - 1]) + len(item) + SLACK)
                seen += [(-score, first, stop, to - at) for score, first, stop in self.passages(item, a[low:high], low)]
                at = to
            # Windows overlap and may cut a passage that the next one holds whole: the best of overlapping ones counts.
            taken: list[tuple[int, int]] = []
            for score, first, stop, seeds in sorted(set(seen)):
                i = bisect.bisect(taken, (first, stop))
                if (i and taken[i - 1][1] > first) or (i < len(taken) and taken[i][0] < stop):
                    continue
                taken.insert(i, (first, stop))
                found.append((self.ids[k], first, -score, stop, seeds, self.first[k]))
        return self.joined(found)

    def joined(self, found: list[tuple[int, int, float, int, int, int]]) -> list[tuple[int, float, int, int, int]]:
        """Passages by item and place. Those of neighbouring pieces of a long item that meet become one."""
        out: list[list] = []
        for i, first, score, stop, seeds, at in sorted(found):
            share = score / (MATCH * max(1, self.lengths[i]))
            if out and out[-1][0] == i and first < out[-1][3] + (SLACK if at > out[-1][5] else 0):
                if at > out[-1][5]:
                    out[-1] = [i, min(1.0, out[-1][1] + share), out[-1][2], max(stop, out[-1][3]), out[-1][4] + seeds, at]
                continue
            out.append([i, share, first, stop, seeds, at])
        return [tuple(r[:5]) for r in out]


def _count(vocabulary, grams):
    """Occurrences of each gram in a task's texts, and the number of words (kind 2)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, g = WordIds(vocabulary.value), grams.value
        counts = [np.zeros(len(k), dtype=np.int64) for k in (g.three, g.two)] + [np.zeros(1, dtype=np.int64)]
        for batch in batches:
            for t in batch.column(0):
                a = words.of(t.as_py() or "")
                counts[2][0] += len(a)
                for c, (_, place) in zip(counts, g.found(a) if len(a) > 1 else ()):
                    np.add.at(c, place, 1)
        for kind, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(c[at])], ["kind", "gram", "n"])

    return run


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Distinct test items in blocks of at most about ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND length(text) > 0").distinct()
    n, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length("text").cast("long"))).first()
    k = max(1, -(-n // BLOCK_ITEMS), -(-(chars or 0) // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(k))
    return [sorted(map(tuple, rows.where(part == i).collect())) for i in range(k)]


def matchers(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> list:
    """A broadcast matcher per block of test items, with gram counts over all of ``docs``."""
    out, sc = [], docs.sparkSession.sparkContext
    for items in _blocks(benchmark):
        vocabulary = vocabulary_of(t for _, t in items)
        words = WordIds(vocabulary)
        grams = Grams([words.of(t) for _, t in items], len(vocabulary))
        shared = sc.broadcast(vocabulary), sc.broadcast(grams)
        counted = docs.select("text").mapInArrow(_count(*shared), "kind int, gram long, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")).collect()
        counts = [np.zeros(len(k)) for k in (grams.three, grams.two)] + [np.zeros(1)]
        for kind, gram, n in counted:
            counts[kind][gram] = n
        out.append(sc.broadcast(Matcher(items, vocabulary, grams, counts[:2], int(counts[2][0]), least_score)))
    return out


def _find(matcher):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "score", "first_word", "end_word", "seeds"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [(d.as_py(), *hit) for d, t in zip(batch.column(0), batch.column(1)) for hit in matcher.value.find(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``doc_id, item_id, score, first_word, end_word, seeds``: a row per passage of ``docs(doc_id, text)`` that
    aligns with an item of ``benchmark(item_id, text)`` at ``least_score`` of a perfect alignment or more, or
    with a part of it that is worth ``PASSAGE_WORDS`` unchanged words; ``score`` is the share of the whole item.

    The places count words from 0, the end exclusive; passages that follow one another are rows of their
    own, of overlapping ones for one item the best counts. Items of fewer than two words, null ones and
    those with a null ``item_id`` match nothing; repeated rows of ``benchmark`` count once; null and empty texts
    have no passages; repeated rows of ``docs`` are reported each; empty tables give an empty result;
    further columns are ignored.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, first_word long, end_word long, seeds long"
    return reduce(DataFrame.unionByName, [cols.mapInArrow(_find(m), schema) for m in matchers(cols, benchmark, least_score)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows that hold an aligned passage (see :func:`contaminated`), all columns as they are,
    in narrow passes. Null and empty texts stay; empty tables are fine."""
    at = docs.columns.index("text")

    def keep(matcher):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not matcher.value.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return run

    for m in matchers(docs, benchmark, least_score):
        docs = docs.mapInArrow(keep(m), docs.schema)
    return docs
