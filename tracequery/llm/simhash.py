"""SimHash near-duplicates found with BK-trees.

Fingerprints are collapsed to distinct values first, so copies cost nothing further. Two 64-bit values
that differ in at most r bits agree on at least m - r of m blocks of bits (pigeonhole), so the values
are dealt into shards by every choice of m - r blocks; each shard's tree is built and searched where the
shard is. A tree's children are keyed by their integer Hamming distance to the parent, and a search for
radius r follows only the edges d - r .. d + r. No link is lost, and a shard emits a spanning star per
group, not its pairs.

The pipeline drops near copies by the similarity of their shingles (:func:`drop_near_duplicates`): hits of the
same trees, over fingerprints of its own shingles, are compared exactly, and bands of smallest hashes add the
pairs whose fingerprints lie further apart than trees can search.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, iter_groups, materialize, split_hot, star_forest

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
SHARD_BLOCK = 4096
TARGET_SHARD = 256

#: Near copies that the pipeline drops: shingles of five words, Jaccard similarity of 0.8 and more.
COPY_WORDS = 5
LEAST_SIMILARITY = 0.8
COPY_RADIUS = 5
BAND_ROWS = 5
MISS = 1e-6
TEXT_BLOCK = 512
FEW_TEXTS = 1_000_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text: a bit is set if over half of the shingles' hashes set it.

    A-Z are lower-cased, words are cut at ASCII white space, and shingles are space-joined runs of
    ``words`` words, repeats included; a shorter text is one shingle, one without words gives zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(ends), 8192):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + 8192], ends[i : i + 8192])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(ends), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` of every row, the fingerprint as a signed 64-bit integer. One narrow pass."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return cols.mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


class BKTree:
    """Distinct integers in a metric tree under the Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Hang a new value below the last node reached by following exact distances."""
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        if not new:
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all values at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo.extend(i for e, i in self.children[at].items() if d - radius <= e <= d + radius)
        return found


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` of the equal blocks of 64 bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int, target: int = TARGET_SHARD) -> int:
    """Number of blocks at which n evenly spread values give shards of about ``target`` at most."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > target and blocks < 4 * (radius + 1):
        blocks += 1
    return blocks


def _shard_links(radius: int):
    keys = ["c", "k", "__a", "__b"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0
        for group in iter_groups(batches, keys):
            values = group["fp"].view(np.uint64).tolist()
            ids, own = group["fp"], group["__s"]
            first, second = group["__a"][0], group["__b"][0]
            tree, at, links = BKTree(), [], []
            inside = first == second
            for i, v in enumerate(values):
                if own[i] == first:
                    if inside:
                        links.extend((i, at[j]) for j in tree.within(v, radius))
                    tree.add(v)
                    at.append(i)
            if not inside:
                links = [(i, at[j]) for i, v in enumerate(values) if own[i] == second for j in tree.within(v, radius)]
            if links:
                pairs = np.array(links)
                label = star_forest(len(values), pairs[:, 0], pairs[:, 1])
                far = np.flatnonzero(label != np.arange(len(values)))
                left.append(ids[far])
                right.append(ids[label[far]])
                held += len(far)
            if held > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["src", "dst"])
                left, right, held = [], [], 0
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["src", "dst"])

    return run


def linked_values(distinct: DataFrame, radius: int = RADIUS, block: int = SHARD_BLOCK) -> DataFrame:
    """Edges ``(src, dst)`` that connect the values of ``distinct(fp)`` exactly as links of at most
    ``radius`` differing bits do. Shards with over ``block`` values are searched as pairs of blocks."""
    blocks = blocks_for(distinct.count(), radius)
    shard_keys = [F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks(radius, blocks))]
    dealt = distinct.withColumn("__shard", F.explode(F.array(*shard_keys))).select("__shard.c", "__shard.k", "fp")
    pairs = split_hot(dealt, ["c", "k"], "fp", block)
    keys = ["c", "k", "__a", "__b"]
    pairs = pairs.repartition(*keys).sortWithinPartitions(*keys)
    return pairs.select(*keys, "__s", "fp").mapInArrow(_shard_links(radius), "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` of the rows reachable over links of fingerprints that differ in
    at most ``radius`` bits. Null and empty texts have fingerprint zero and link like any other; rows link by
    their fingerprints alone, so two of one ``doc_id`` with unlike texts are no link between their classes;
    repeated rows come back each; a row with a null ``doc_id`` links like others and gets null only where its
    class has no ``doc_id``; an empty table gives an empty result; further columns are ignored.
    """
    fps = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    found = components(linked_values(distinct.select("fp"), radius), "src", "dst")
    nodes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    classes = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = nodes.select("fp", "component").join(classes, "component").drop("component")
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    """A signed 64-bit integer column as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingles(text: str | None, words: int = COPY_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, words cut and lower-cased as in :func:`fingerprint`.

    A text of at most ``words`` words is one shingle; so is one without words.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype=np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of a set of hashes: a bit is set if over half of them set it."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def bands_for(least: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Number of bands at which two sets of similarity ``least`` share none with probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(least**rows)))) if least < 1 else 1


class Bands:
    """Keys of a set's bands of smallest hashes: two sets agree on a band with probability similarity ** rows."""

    def __init__(self, bands: int, rows: int = BAND_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.shape = (bands, rows)
        self.mul = rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64)
        self.start = rng.integers(0, 1 << 64, bands, dtype=np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.mul), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(hashes), 128):
            np.minimum(low, (hashes[i : i + 128, None] * self.mul + self.add).min(0), out=low)
        keys = self.start.copy()
        for column in low.reshape(self.shape).T:
            keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
        return keys.view(np.int64)


def _sketches(words: int, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(bands_for(least))
        for batch in batches:
            fps, flat = [], []
            for t in batch.column(1):
                own = shingles(t.as_py(), words)
                fps.append(set_fingerprint(own))
                flat.append(bands.of(own))
            ends = np.arange(len(flat) + 1, dtype=np.int32) * bands.shape[0]
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), keys], ["node", "fp", "keys"])

    return run


def similar_sets(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Smallest index of each set's class, linked by Jaccard similarities of ``least`` and more; exact.

    Similar sets share one of the first ``size - ceil(least * size) + 1`` elements in any common order;
    here rare elements come first. Sets are first compared with the leaders of the classes so far, and then
    with all candidates outside their own class, if there is one.
    """
    n = len(sets)
    label = list(range(n))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = [len(s) for s in sets]
    heads, at = [], 0
    for size in sizes:
        own = codes[at : at + size]
        at += size
        first = size - math.ceil(least * size - 1e-9) + 1
        heads.append(own[np.lexsort((own, counts[own]))[:first]].tolist())
    plain = [set(s.tolist()) for s in sets]

    def similar(i: int, j: int) -> bool:
        small, large = sorted((sizes[i], sizes[j]))
        if small < least * large - 1e-9:
            return False
        common = len(plain[i] & plain[j])
        return common >= least * (small + large - common) - 1e-9

    for leaders in (True, False):
        posted: dict[int, list[int]] = {}
        for i in range(n):
            seen: set[int] = set()
            linked = False
            for c in heads[i]:
                for j in posted.get(c, ()):
                    if j not in seen:
                        seen.add(j)
                        a, b = root(i), root(j)
                        if a != b and similar(i, j):
                            label[max(a, b)] = min(a, b)
                            linked = True
            if not (leaders and linked):
                for c in heads[i]:
                    posted.setdefault(c, []).append(i)
        if len({root(i) for i in range(n)}) == 1:
            break
    return np.array([root(i) for i in range(n)])


def _similar_links(words: int, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in iter_groups(batches, ["component", "__a", "__b"]):
            label = similar_sets([shingles(t, words) for t in group["text"]], least)
            far = np.flatnonzero(label != np.arange(len(label)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(group["node"][far]), pa.array(group["node"][label[far]])], ["src", "dst"])

    return run


def tree_hits(sketches: DataFrame, radius: int = COPY_RADIUS) -> DataFrame:
    """Links ``(src, dst)`` that connect the texts of ``sketches(node, fp)`` exactly as fingerprints of at most ``radius``
    differing bits do, found in the same trees as op10's."""
    distinct = materialize(sketches.groupBy("fp").agg(F.min("node").alias("low")), "distinct")
    near = linked_values(distinct.select("fp"), radius)
    near = near.join(distinct.toDF("src", "a"), "src").join(distinct.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    same = sketches.select("node", "fp").join(distinct, "fp").where("node != low")
    return near.unionByName(same.select(F.col("node").alias("src"), F.col("low").alias("dst")))


def band_hits(sketches: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` of the texts of ``sketches(node, keys)`` that share a band of smallest hashes."""
    first = F.first("node").over(Window.partitionBy("key").orderBy("node"))
    dealt = sketches.select("node", F.explode("keys").alias("key"))
    return dealt.select(F.col("node").alias("src"), first.alias("dst")).where("src != dst")


def compared(texts: DataFrame, near: DataFrame, words: int, least: float, block: int) -> DataFrame:
    """Links ``(src, dst)`` that connect the texts of every component of ``near(node, component)`` exactly as similarities of
    ``least`` and more do. Up to ``FEW_TEXTS`` rows of ``near`` are broadcast, so only their texts move."""
    if near.count() <= FEW_TEXTS:
        members = texts.join(F.broadcast(near), "node").groupBy("node").agg(F.first("text").alias("text"), F.first("component").alias("component"))
    else:
        members = texts.groupBy("node").agg(F.first("text").alias("text")).join(near, "node")
    group = ["component", "__a", "__b"]
    pairs = split_hot(materialize(members, "members"), ["component"], "node", block)
    pairs = pairs.repartition(*group).sortWithinPartitions(*group, "node").select(*group, "node", "text")
    return pairs.mapInArrow(_similar_links(words, least), "src long, dst long")


def similar_texts(docs: DataFrame, words: int = COPY_WORDS, least: float = LEAST_SIMILARITY, block: int = TEXT_BLOCK, radius: int = COPY_RADIUS) -> DataFrame:
    """``(node, component)`` of the texts of ``docs(text)`` that have a near copy; ``node`` is ``xxhash64(text)``.

    Texts are linked if their sets of ``words``-word shingles have a Jaccard similarity of ``least`` or more.
    Fingerprints of these sets are searched in BK-trees, where no hit within ``radius`` bits is missed. Similar texts can
    differ in more bits than trees can search, so texts that share a band of smallest hashes are candidates
    too (a link is missed with probability ``MISS`` at most). Whole candidate groups are then compared exactly, those over
    ``block`` texts as pairs of blocks.
    """
    texts = docs.select(F.xxhash64("text").alias("node"), "text")
    sketches = texts.mapInArrow(_sketches(words, least), "node long, fp long, keys array<long>")
    sketches = materialize(sketches.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sketches")
    near = materialize(components(tree_hits(sketches, radius).unionByName(band_hits(sketches)), "src", "dst"), "candidates")
    return components(compared(texts, near, words, least, block), "src", "dst")


def drop_near_duplicates(docs: DataFrame, words: int = COPY_WORDS, least: float = LEAST_SIMILARITY) -> DataFrame:
    """``docs`` with one row of every class of near copies, that of smallest ``doc_id``; all columns stay as they are.

    Classes are those of :func:`similar_texts`: hits in the trees of fingerprints and pairs beyond their radius, both
    compared exactly. Classes follow from texts alone, so unlike texts of one ``doc_id`` all stay, and copies without a
    ``doc_id`` are dropped like others; a row with one is kept before them. Only ids and text hashes are
    joined back, so texts move only if the rows to drop exceed the broadcast threshold.
    """
    row, taken = ["__id", "__node"], set(map(str.lower, docs.columns))
    while taken & set(row):
        row = [f"{k}_" for k in row]
    same = F.col("doc_id").eqNullSafe(F.col(row[0])) & (F.xxhash64("text") == F.col(row[1]))
    ids = docs.select("doc_id", F.xxhash64("text").alias("node"))
    classes = ids.join(materialize(similar_texts(docs, words, least), "similar"), "node", "left")
    classes = materialize(classes.select("doc_id", "node", F.coalesce("component", "node").alias("class")), "classes")
    low = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("low"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("node") == F.col("low.node")))
    names = [F.col(c).alias(k) for c, k in zip(("doc_id", "node"), row)]
    drop = classes.join(low, "class").where(other).select(*names).distinct()
    again = classes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*row)
    if not again.isEmpty():
        again = materialize(again, "repeated")
        one = docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        docs = docs.join(again, same, "left_anti").unionByName(one)
    return docs.join(drop, same, "left_anti")
