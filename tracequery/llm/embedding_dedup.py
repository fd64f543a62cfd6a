"""Embedding near-duplicates by randomised-rotation binary codes.

A vector is normalised, turned by seeded random rotations and stored as the signs of its coordinates (one
bit each) with a correction factor, its inner product with its own code. From the code of one vector and
the rotated other one, <code, q> / factor estimates their inner product without bias, with a confidence
bound that follows from the factor. Pairs whose bound stays below the threshold are dropped; every other
pair is computed again exactly in double precision.

Candidates come from the same signs: bands of them are bucket keys, and vectors that agree on a band meet.
The number of bands follows from the angle at the threshold and the miss rate. Only codes move to the
buckets, once a band; a bucket's pairs whose codes differ in more bits than the threshold's angle explains
settle there, and only vectors with a pair left are fetched and estimated. Equal vectors are collapsed first.
A bucket emits one star per group and per-vector counts, never its pairs; every pair is counted in the
first band on which it agrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, iter_groups, materialize, split_blocks, star_forest

THRESHOLD = 0.98
MISS_RATE = 1e-6
BUCKET = 512
BLOCK = 4096
#: Standard deviations of the estimate's error that the confidence bounds allow.
SIGMAS = 6.0
BAND_BITS = 8


def usable(vec: Column, label: Column, key: Column) -> Column:
    """True for vectors that may link: label and id present, components present and finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & key.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


@cache
def rotations(dim: int, bits: int, seed: int) -> np.ndarray:
    """At least ``bits`` directions as columns: whole random orthogonal bases one after another."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))], axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; the first scaling avoids overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plan_bands(n: int, threshold: float, miss_rate: float = MISS_RATE) -> tuple[int, int]:
    """Bits per band for buckets of about ``BUCKET`` unrelated vectors, and the bands that miss a pair at
    the threshold with at most ``miss_rate``."""
    bits = min(31, max(4, math.ceil(math.log2(max(2, n) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss_rate) / math.log1p(-agree)))


def most_differing(bits: int, threshold: float) -> int:
    """Bits of ``bits`` in which codes of a pair at the threshold differ at most, up to ``SIGMAS``."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p)) + 1)


def rows_of(column: pa.Array, dtype: str) -> np.ndarray:
    """Equally long binary values as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def unit_vectors(column: pa.Array, dim: int) -> np.ndarray:
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _codes(bits: int, seed: int):
    """Adds to ``(gid, kind, dim, vec)`` the sign code and its correction factor, that of the first rotation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                turned = unit_vectors(rows.column("vec"), dim) @ rotations(dim, bits, seed)
                code = np.packbits(turned > 0, axis=1)
                factor = np.abs(turned[:, :dim]).sum(1) / math.sqrt(dim)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(factor)], [*rows.schema.names, "code", "factor"])

    return run


def band_keys(code: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The key of each band from packed codes (rows)."""
    signs = np.unpackbits(code, axis=1, count=bits * bands).reshape(len(code), bands, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def _deal(bits: int, bands: int):
    """A row ``(bucket, gid, code)`` for every band of every ``(gid, kind, code)``; the band is the bucket's last byte."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                lengths = np.array([len(c.as_py()) for c in some.column("code")])
                for n in np.unique(lengths).tolist():
                    rows = some.filter(pa.array(lengths == n))
                    keys = band_keys(rows_of(rows.column("code"), "u1"), bits, bands).astype(np.uint64)
                    mixed = (rows.column("kind").to_numpy().view(np.uint64)[:, None] ^ (keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(bands, dtype=np.uint64))) * np.uint64(0xD6E8FEB86659FD93)
                    mixed ^= mixed >> np.uint64(32)
                    bucket = (mixed << np.uint64(BAND_BITS)) | np.arange(bands, dtype=np.uint64)
                    owner = pa.array(np.repeat(np.arange(len(rows)), bands))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), rows.column("gid").take(owner), rows.column("code").take(owner)], ["bucket", "gid", "code"])

    return run


def pairs_within(codes: np.ndarray, lefts: np.ndarray, rights: np.ndarray, most: int, bits: int, band: int, rows_at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose codes differ in at most ``most`` bits and that agree on no band before ``band``."""
    words = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    words[:, : codes.shape[1]] = codes
    words = words.view(np.uint64)
    keys = band_keys(codes, bits, band) if band else None
    for at in range(0, len(lefts), rows_at_once):
        rows = lefts[at : at + rows_at_once]
        far = np.zeros((len(rows), len(rights)), np.uint16)
        for k in range(words.shape[1]):
            far += np.bitwise_count(words[rows, k][:, None] ^ words[rights, k])
        a, b = np.nonzero(far <= most)
        a, b = rows[a], rights[b]
        if lefts is rights:
            a, b = a[a < b], b[a < b]
        if band:
            new = ~(keys[a] == keys[b]).any(1)
            a, b = a[new], b[new]
        yield a, b


def _sides(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a pair of blocks: those of the one and those of the other, the same array for one block alone."""
    left = np.flatnonzero(group["__s"] == group["__a"][0])
    return left, left if group["__a"][0] == group["__b"][0] else np.flatnonzero(group["__s"] == group["__b"][0])


def _groups(batches: Iterable[pa.RecordBatch], codes: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, int]]:
    """Bucket groups of over one row with their codes and their band, rows of unlike code lengths apart."""
    for group in iter_groups(batches, ["bucket", "__a", "__b"]):
        lengths = np.fromiter(map(len, group["code"]), np.int64, len(group["code"]))
        for n in np.unique(lengths).tolist():
            some = {c: v[lengths == n] for c, v in group.items()}
            if len(some["gid"]) > 1:
                yield some, np.frombuffer(b"".join(some["code"]), np.uint8).reshape(-1, n), int(some["bucket"][0]) & ((1 << BAND_BITS) - 1)


def _candidates(threshold: float, bits: int):
    """The members of each bucket's pairs that codes cannot tell apart."""
    names = ["bucket", "__a", "__b", "__s", "gid"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, codes, band in _groups(batches, bits):
            marked = np.zeros(len(codes), dtype=bool)
            for a, b in pairs_within(codes, *_sides(group), most_differing(codes.shape[1] * 8, threshold), bits, band):
                marked[a] = marked[b] = True
            if marked.any():
                yield pa.RecordBatch.from_arrays([pa.array(group[c][marked]) for c in names], names)

    return run


def estimate(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded vectors with rotated unit vectors, row by row, and the standard
    deviation of each estimate over the random rotation. The first rotation's part of a code is used."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    est = np.einsum("ij,ij->i", signs, queries) / (math.sqrt(dim) * factors)
    spread = np.sqrt(np.maximum(0.0, 1 - factors**2)) / factors / math.sqrt(max(1, dim - 1))
    return est, spread


def _links(threshold: float, seed: int, bits: int):
    """Per bucket, each vector's links that are new in its band, and a star per group of linked vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, codes, band in _groups(batches, bits):
            gid, copies, factors = group["gid"], group["n"], group["factor"]
            dim = len(group["vec"][0])
            unit = unit_rows(np.stack(group["vec"]).astype(np.float64))
            turned = unit @ rotations(dim, dim, seed)
            li, ri = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in pairs_within(codes, *_sides(group), most_differing(codes.shape[1] * 8, threshold), bits, band):
                for at in range(0, len(a), 1 << 16):
                    x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                    est, spread = estimate(codes[x], factors[x], turned[y])
                    open_ = (est + SIGMAS * spread + 1e-5 >= threshold) & (group["kind"][x] == group["kind"][y])
                    x, y = x[open_], y[open_]
                    linked = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    li.append(x[linked])
                    ri.append(y[linked])
            left, right = np.concatenate(li), np.concatenate(ri)
            if not len(left):
                continue
            links = np.bincount(left, copies[right], len(gid)) + np.bincount(right, copies[left], len(gid))
            label = star_forest(len(gid), left, right)
            keep = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(gid[keep]), pa.array(links[keep].astype(np.int64)), pa.array(gid[label[keep]])], ["gid", "links", "root"])

    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, miss_rate: float = MISS_RATE, seed: int = 20) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``.

    Vectors of one non-null label and equal length whose cosine is at least ``threshold`` are linked.
    ``n_links`` counts the other rows linked directly (copies each), ``component_id`` is the smallest
    ``vec_id`` reachable, ``kept`` marks the row that bears it. A null, zero or non-finite vector, or one
    with a null label or ``vec_id``, links with nothing: no links, its own ``vec_id`` as component. Rows
    that repeat a ``vec_id`` are rows of their own. An empty table gives an empty result; further columns
    are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    vec = F.col("embedding") if element == "float" else F.col("embedding").cast("array<double>")
    cols = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"), F.col("label").cast("string").alias("label"))
    ok = usable(F.col("vec"), F.col("label"), F.col("vec_id"))
    # Zero of either sign is one value, to Spark's grouping as to the hashes. Two of them stand for a vector.
    zero = F.lit(0.0).cast("float" if element == "float" else "double")
    cols = cols.withColumn("vec", F.when(ok, F.transform("vec", lambda x: x + zero)))
    cols = cols.withColumns({"h": F.when(ok, F.xxhash64("vec")), "h2": F.when(ok, F.xxhash64(F.lit(seed), "vec"))})
    # Buckets never span labels, so the largest label settles how fine they must be.
    largest = cols.where("h IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan_bands(largest, threshold, miss_rate)
    groups = cols.where("h IS NOT NULL").groupBy("label", "h", "h2", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    groups = groups.select(F.monotonically_increasing_id().alias("gid"), F.xxhash64("label", F.size("vec")).alias("kind"), F.size("vec").alias("dim"), "n", "rep", "label", "h", "h2", "vec")
    schema = f"gid long, kind long, dim int, n long, rep long, label string, h long, h2 long, vec array<{'float' if element == 'float' else 'double'}>, code binary, factor double"
    groups = materialize(groups.mapInArrow(_codes(bits * bands, seed), schema), "vectors")
    dealt = groups.select("gid", "kind", "code").mapInArrow(_deal(bits, bands), "bucket long, gid long, code binary")
    keys = ["bucket", "__a", "__b"]
    pairs = split_blocks(dealt, "bucket", "gid", BLOCK).repartition(*keys).sortWithinPartitions(*keys).select(*keys, "__s", "gid", "code")
    members = materialize(pairs.mapInArrow(_candidates(threshold, bits), "bucket long, __a int, __b int, __s int, gid long"), "members")
    fetched = members.join(groups.select("gid", "kind", "n", "vec", "code", "factor"), "gid").repartition(*keys).sortWithinPartitions(*keys)
    found = fetched.select(*keys, "__s", "gid", "kind", "n", "vec", "code", "factor").mapInArrow(_links(threshold, seed, bits), "gid long, links long, root long")
    found = materialize(found, "links")
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    classes = components(found, "gid", "root")
    known = groups.select("label", "h", "h2", "rep", "n", "gid").join(links, "gid", "left")
    known = known.join(classes.withColumnRenamed("node", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    lowest = known.groupBy("component").agg(F.min("rep").alias("low"))
    known = known.join(lowest, "component").select("label", "h", "h2", F.col("low"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    rows = cols.select("vec_id", "label", "h", "h2").join(known, ["label", "h", "h2"], "left")
    component = F.coalesce("low", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
