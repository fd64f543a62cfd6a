"""Secret scanning: fixed patterns, and windows of high entropy in candidate strings.

A candidate is a long run of key-like characters. A window slides over each of its stretches of one
character class (hexadecimal, alphanumeric, base64); the window's Shannon entropy is kept up to date from
the counts of the character that comes in and the one that goes out. Windows above the class's threshold
are joined into spans. The allow-list (UUIDs, repeated text, paths of word-like segments) suppresses whole
candidates and whole spans that it matches; windows that touch a placeholder word, an alphabet, or what a
pattern has found already are left out, and the other windows of their candidate stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns, in the order in which spans that start together are listed; fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN_LEAST = 8

#: Words with a run of digits at most (``Chapter12``, ``x86``, ``HTTP2``), joined by hyphens and underscores.
_WORD = r"(?:[A-Z]++(?![a-z])|(?:[A-Z]?[a-z]{2,}+)++|[A-Za-z](?![A-Za-z]))?+[0-9]*+(?:[a-z]++|[A-Z]++)?+"
_SEGMENT = rf"(?:{_WORD}[_-]++)*+{_WORD}"


@dataclass(frozen=True)
class EntropyPolicy:
    """Window length, candidate length, thresholds in bits per character class, and the allow-list."""

    window: int = 20
    least: int = 20
    bits: tuple[tuple[str, str, float], ...] = (
        ("hex", r"[0-9a-fA-F]+", 2.9),
        ("alnum", r"[0-9A-Za-z]+", 3.5),
        ("base64", r"[0-9A-Za-z+/_=-]+", 3.7),
    )
    candidate: str = r"[0-9A-Za-z+/_=-]{20,}"
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
        r"(.{1,8}?)\1{2,}.{0,8}",
        rf"{_SEGMENT}(?:/{_SEGMENT})++",
        r"[-_=+/]+",
    )
    placeholder: str = r"(?i)example|placeholder|changeme|dummy|sample|xxxx|0123456789|abcdefgh"
    classes: tuple = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "classes", tuple((n, re.compile(p), b) for n, p, b in self.bits))


class SlidingEntropy:
    """Shannon entropy of a window from incremental counts: H = log2 W - (1/W) sum c log2 c."""

    def __init__(self, window: int):
        self.window = window
        self.terms = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]

    def values(self, text: str) -> Iterator[float]:
        """The entropy of every window of ``text``, left to right."""
        counts: dict[str, int] = {}
        total, w, terms = 0.0, self.window, self.terms
        for i, c in enumerate(text):
            if i >= w:
                old = text[i - w]
                n = counts[old]
                total += terms[n - 1] - terms[n]
                counts[old] = n - 1
            n = counts.get(c, 0)
            total += terms[n + 1] - terms[n]
            counts[c] = n + 1
            if i >= w - 1:
                yield math.log2(w) - total / w


class SecretScanner:
    """Spans ``(start, end, kind)`` of one text, in code points, end exclusive."""

    def __init__(self, policy: EntropyPolicy | None = None):
        self.policy = policy or EntropyPolicy()
        self.candidate = re.compile(self.policy.candidate)
        self.allow = [re.compile(p) for p in self.policy.allow]
        self.placeholder = re.compile(self.policy.placeholder)
        self.entropy = SlidingEntropy(self.policy.window)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """Spans of the fixed patterns. A match that is too short is dropped but still uses up its text.

        The minimum lengths of the access and hex patterns are in the patterns: their matches are whole runs,
        so a longer minimum inside cannot start a match that the plain pattern would have used up.
        """
        out = [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
        out += [(*m.span(), 2) for m in HEX.finditer(text)]
        return out

    def allowed(self, string: str) -> bool:
        return any(a.fullmatch(string) for a in self.allow)

    def windows(self, text: str, taken: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """Joined windows of high entropy outside the spans ``taken``, allow-list applied."""
        out = []
        w = self.policy.window
        for m in self.candidate.finditer(text):
            s, start = m.group(), m.start()
            if not any(c.isdigit() for c in s) or s.isdigit() or self.allowed(s):
                continue
            # A window from place i touches [x, y) if x - w < i < y.
            closed = [p.span() for p in self.placeholder.finditer(s)]
            closed += [(x - start, y - start) for x, y in taken if x < m.end() and start < y]
            hot: set[int] = set()
            for _, pattern, bits in self.policy.classes:
                for run in pattern.finditer(s):
                    piece = run.group()
                    if len(piece) < w:
                        continue
                    for i, h in enumerate(self.entropy.values(piece)):
                        if h >= bits and not piece[i : i + w].isalpha():
                            hot.add(run.start() + i)
            if hot and closed:
                for x, y in closed:
                    hot.difference_update(range(x - w + 1, y))
            joined: list[list[int]] = []
            for i in sorted(hot):
                if joined and i <= joined[-1][1]:
                    joined[-1][1] = i + w
                else:
                    joined.append([i, i + w])
            out += [(start + a, start + b) for a, b in joined if b - a == len(s) or not self.allowed(s[a:b])]
        return out

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans and all spans, each sorted by start, then kind."""
        text = text or ""
        base = sorted(self.base(text), key=lambda s: (s[0], s[2]))
        extra = [(a, b, 3) for a, b in self.windows(text, [(x, y) for x, y, _ in base])]
        return base, sorted(base + extra, key=lambda s: (s[0], s[2]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scan(policy: EntropyPolicy | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(policy)
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in batch.column(1):
                base, every = scanner.scan(text.as_py())
                for k in range(4):
                    counts[k].append(sum(s[2] == k for s in every))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def secret_spans(docs: DataFrame, policy: EntropyPolicy | None = None) -> DataFrame:
    """Secrets of every row of ``docs(doc_id, text)``, by whole text, in one narrow pass.

    Returns ``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans``. Null and empty texts have
    no spans (the digest is that of an empty text); repeated rows come back each; an empty table gives an
    empty result; further columns are ignored.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return cols.mapInArrow(_scan(policy), schema)


def redact(text: str, spans: Iterable[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with the spans replaced; overlapping spans are replaced together."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out.append(text[at:a] + mark)
        at = max(at, b)
    return "".join(out) + text[at:]
