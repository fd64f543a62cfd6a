"""Shared plumbing of the training-data operators.

* :func:`materialize` cuts lineage with a Parquet table in the shared checkpoint folder (see ``scratch``), so a
  lost executor costs at most one stage.
* :func:`components` is a distributed connected-components operator (alternating large and small stars).
* :func:`class_sample` draws the bounded, documented sample a classifier may be fitted on.
* :func:`split_hot` splits over-full join buckets into pairs of blocks, so no task gets an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, scratch_path  # noqa: F401  for the operators beside this module

def crc32_of(col: Column) -> Column:
    """Unsigned CRC-32 of a column's text form (null: null)."""
    return F.crc32(col.cast("string").cast("binary"))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def class_sample(docs: DataFrame, cls: str, per_class: int, known: DataFrame | None = None, total: int | None = None, least: int = 2, max_classes: int = 2000, seed: int = 7) -> DataFrame:
    """A bounded sample of ``docs(doc_id, text)`` with a class each: ``h``, ``cls``, ``doc_id``, ``text``.

    The class is a column of ``docs``, or comes from ``known(doc_id, cls)``. Rows without a ``doc_id``, a class
    or a text of one character at least are left out; rows alike in class, ``doc_id`` and text count as one,
    and an id with two classes counts for both. Every class gives its ``per_class`` rows of smallest hash
    ``h``, a seeded hash of ``doc_id`` and text, so no class of the input is without rows, one id on many rows
    fills no class, and a rerun returns the same rows. With ``total`` a class gives fewer rows where there
    are many classes, but ``least`` of them. At most ``max_classes`` classes take part, the largest first,
    which bounds the sample whatever the input size. How long a text is plays no part.

    Two passes: the first moves hashes only, of which about ``per_class`` and six standard deviations a
    class reach the driver; the second fetches the chosen rows' texts by a broadcast of their hashes.
    """
    rows = docs.where("doc_id IS NOT NULL AND length(text) > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    keys = rows.select("doc_id", "h").distinct().join(known.select("doc_id", cls).distinct(), "doc_id") if known is not None else rows
    keys = keys.where(F.col(cls).isNotNull()).select(cls, "h").distinct()
    counts = keys.groupBy(cls).count().orderBy(F.desc("count"), cls).limit(max_classes).collect()
    if total is not None:
        per_class = max(least, min(per_class, total // max(1, len(counts))))
    spark, kind = docs.sparkSession, keys.schema[cls].dataType.simpleString()
    shares = spark.createDataFrame([(v, min(1.0, (per_class + 6 * per_class**0.5) / n)) for v, n in counts], f"`{cls}` {kind}, __share double")
    unit = F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn: dict = {}
    for v, h in keys.join(F.broadcast(shares), cls).where(unit < F.col("__share")).select(cls, "h").collect():
        drawn.setdefault(v, []).append(h)
    chosen = [(v, h) for v, hs in drawn.items() for h in sorted(hs, key=lambda h: (h % (1 << 40), h))[:per_class]]
    # Rows that repeat a chosen one are reduced where they are read.
    own = rows.select("h", F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    found = own.join(F.broadcast(spark.createDataFrame(chosen, f"`{cls}` {kind}, h long")), "h")
    return found.groupBy("h", cls).agg(F.first("__id").alias("doc_id"), F.first("__text").alias("text"))


def excerpt(text: Column, key: Column, chars: int, parts: int = 8) -> Column:
    """A text of at most ``chars`` characters as it is; of a longer one as many windows as ``parts``, one from
    each equal part of the whole text, at a place that a hash of ``key`` chooses."""
    size, part = chars // parts, F.floor(F.length(text) / parts)
    room = F.greatest(part - size, F.lit(0)) + 1
    windows = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, (i * part + F.pmod(F.xxhash64(key, i), room) + 1).cast("int"), F.lit(size)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(windows, " "))


def split_hot(df: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Attach block pairs to the members of join buckets; drop buckets of one member.

    ``keys`` name the bucket, ``member`` is a stable column that identifies the row. Buckets of at most
    ``block`` members become the single pair ``(0, 0)``. A larger bucket of c members is cut into
    k = ceil(c / block) blocks by a hash of ``member``, and each row goes to the k pairs of blocks that
    hold its own, so every two members still meet in exactly one group ``(keys, __a, __b)`` and no group
    holds much more than two blocks. ``__s`` is the member's own block. Sizes come from a partially
    aggregated count joined back on the keys.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    out = df.join(sizes, keys).withColumn("__k", blocks)
    out = out.withColumn("__s", F.pmod(F.xxhash64(F.lit(11), F.col(member)), F.col("__k").cast("long")).cast("int"))
    out = out.withColumn("__t", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    out = out.withColumn("__a", F.least("__s", "__t")).withColumn("__b", F.greatest("__s", "__t"))
    return out.drop("__n", "__k", "__t")


def split_blocks(df: DataFrame, key: str, member: str, block: int, few: int = 1_000_000) -> DataFrame:
    """Like :func:`split_hot` for buckets of which few are over-full: rows move once, to their group.

    Only buckets of over ``block`` members are looked up, by a broadcast if they are at most ``few`` and by a
    shuffled join beyond; all others are the pair ``(0, 0)``, those of one member included.
    """
    sizes = materialize(df.groupBy(key).count().where(F.col("count") > block), "hot")
    n = sizes.count()
    if not n:
        zero = F.lit(0)
        return df.withColumns({"__a": zero, "__b": zero, "__s": zero})
    sizes = sizes.select(key, F.ceil(F.col("count") / F.lit(block)).cast("int").alias("__k"))
    out = df.join(F.broadcast(sizes) if n <= few else sizes, key, "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
    out = out.withColumn("__s", F.pmod(F.xxhash64(F.lit(11), F.col(member)), F.col("__k").cast("long")).cast("int"))
    out = out.withColumn("__t", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    return out.withColumns({"__a": F.least("__s", "__t"), "__b": F.greatest("__s", "__t")}).drop("__k", "__t")


def iter_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal integer keys in a sorted stream of batches, as dicts of numpy arrays.

    Only the run that is still open is carried from batch to batch.
    """
    carry: dict[str, np.ndarray] | None = None
    for batch in batches:
        cols = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        if carry is not None:
            cols = {c: np.concatenate([carry[c], v]) for c, v in cols.items()}
        n = len(cols[keys[0]])
        new = np.zeros(n, dtype=bool)
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.concatenate([[0], np.flatnonzero(new)])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield {c: v[a:b] for c, v in cols.items()}
        carry = {c: v[starts[-1] :] for c, v in cols.items()}
    if carry is not None:
        yield carry


def star_forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n local nodes and undirected links, the smallest local index of each node's component."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def components(edges: DataFrame, src: str, dst: str, label: str = "cc") -> DataFrame:
    """Connected components of an undirected edge list, as ``(node, component)`` for every node of an edge.

    ``component`` is the smallest node of the component. Each round connects every node's larger
    neighbours to its smallest neighbour (large star), then its smaller neighbours likewise (small
    star); the edge list shrinks to one star per component in a number of rounds that is logarithmic in
    practice. Every round is two partially aggregated minima joined back to the edges, and its result is
    written to the scratch folder; nothing but two numbers per round reaches the driver.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, label)
    state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
