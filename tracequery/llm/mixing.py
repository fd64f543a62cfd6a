"""Mixing sources to target weights by capped water-filling.

Targets share out a budget of words by weight. A source never gets more than its words times the
maximum number of epochs; what it cannot take is shared again among the others by weight until no
target is above its cap. Every document of a source is then taken a whole number of times, and a seeded
draw of documents adds one more repetition until the source's target is met to half a document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 1_000_000
BIN_DIGITS = 3
BROADCAST_BYTES = 64 << 20


def water_fill(caps: Sequence[float], weights: Sequence[float], total: float) -> list[float]:
    """Targets of sources with the given caps and weights. Caps that add up to less than ``total`` are all met.

    Sources meet their caps in the order of cap by weight, so one pass over that order finds the level at
    which the rest share what is left.
    """
    cap, weight = np.asarray(caps, dtype=np.float64), np.asarray(weights, dtype=np.float64)
    out = np.zeros(len(cap))
    some = np.flatnonzero(weight > 0)
    some = some[np.argsort(cap[some] / weight[some], kind="stable")]
    c, w = cap[some], weight[some]
    left = float(total) - np.concatenate([[0.0], np.cumsum(c)[:-1]]) if len(c) else c
    share = np.cumsum(w[::-1])[::-1]
    full = left * w > c * share
    k = int(np.argmin(full)) if not full.all() else len(c)
    out[some[:k]] = c[:k]
    if k < len(c):
        out[some[k:]] = np.minimum(left[k] * w[k:] / share[k], c[k:])
    return out.tolist()


def word_count(text: Column) -> Column:
    """Number of words, cut at ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(doc_id: Column, text: Column, seed: int) -> Column:
    """The place of a document in the seeded order: an MD5 of its id, the seed and its text (nulls: empty)."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(text, F.lit(""))).cast("binary"))


def small(rows: DataFrame, size: int) -> DataFrame:
    """A hint to broadcast rows of at most ``BROADCAST_BYTES`` bytes in all; larger ones are joined by a shuffle."""
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def source_plan(docs: DataFrame, weights: Sequence[float], budget: float, max_epochs: float, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """The sized documents, and per source its words, target, whole repetitions, the last draw that gets one
    more, and how many of that draw's equal rows do where not all (``psource, source_size, target, whole,
    cut, ties``); and the plan's size in bytes."""
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), draw_of(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    sized = materialize(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(((s, n) for s, n in totals), key=lambda x: (x[0] is None, x[0] or ""))
    per = [weights[i % len(weights)] for i in range(len(totals))]
    targets = water_fill([max_epochs * n for _, n in totals], per, budget * sum(n for _, n in totals))
    rows, weight = [], 0
    for (source, n), target in zip(totals, targets):
        whole = int(target // n) if n else 0
        rows.append((source, n, target, whole, target - whole * n))
        weight += len((source or "").encode("utf-8", "surrogatepass")) + 160
    plan = small(spark.createDataFrame(rows, "psource string, source_size long, target double, whole int, rest double"), weight)
    same = F.col("source").eqNullSafe(F.col("psource"))
    # Words per bin of the hash, then the bin in which each source's remaining target ends.
    bin_of = F.substring("draw", 1, BIN_DIGITS)
    bins = sized.groupBy("source", bin_of.alias("bin")).agg(F.sum("size").alias("words"))
    bins = bins.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")).join(plan, same)
    last = bins.where("before < rest").groupBy("psource").agg(F.max_by(F.struct("bin", "before", "rest"), "bin").alias("at"))
    last = small(last.select("psource", "at.*"), weight)  # a row per source at most
    # Only that bin's documents are put in order, equal rows as one with their number.
    edge = sized.join(last, same & (bin_of == F.col("bin"))).groupBy("psource", "draw", "before", "rest", "size").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("psource").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("first", F.col("before") + F.sum(F.col("size") * F.col("c")).over(order) - F.col("size") * F.col("c"))
    # Of c equal rows as many are drawn as have the middle of their words within the remaining target.
    drawn = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("first")) / F.col("size") + 0.5)).otherwise(F.when(F.col("first") <= F.col("rest"), F.col("c")).otherwise(0))
    edge = edge.withColumn("k", F.least(F.col("c"), drawn)).where("k > 0")
    cut = edge.groupBy("psource").agg(F.max_by(F.struct(F.col("draw").alias("drawn"), F.when(F.col("k") < F.col("c"), F.col("k")).alias("ties")), "draw").alias("at"))
    cut = last.join(small(cut.select(F.col("psource").alias("csource"), "at.*"), weight), F.col("psource").eqNullSafe(F.col("csource")), "left")
    # Without a document of its own the bin still closes all bins before it.
    cut = cut.select(F.col("psource").alias("csource"), F.coalesce("drawn", "bin").alias("cut"), "ties")
    plan = plan.join(small(cut, weight), F.col("psource").eqNullSafe(F.col("csource")), "left").drop("csource", "rest")
    return sized, materialize(plan, "plan"), weight


def with_repeats(rows: DataFrame, draw: Column) -> DataFrame:
    """Adds ``__n``, how often a row joined with its source's plan is taken.

    Only where some of several equal rows are drawn and others are not, these rows are written out and numbered;
    the numbers of a task's rows follow on those of the tasks before it, so no group meets in one task.
    """
    plain = F.col("whole") + F.coalesce(draw <= F.col("cut"), F.lit(False)).cast("int")
    partial = F.coalesce((draw == F.col("cut")) & F.col("ties").isNotNull(), F.lit(False))
    out = rows.where(~partial).withColumn("__n", plain)
    ties = materialize(rows.where(partial).withColumn("__m", F.monotonically_increasing_id()), "ties")
    if ties.isEmpty():
        return out
    ties = ties.withColumn("__p", F.shiftright("__m", 33))
    counts = ties.groupBy("psource", "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("psource").orderBy("__p")) - F.col("__c")
    counts = counts.select(F.col("psource").alias("__s"), F.col("__p").alias("__q"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("psource", "__p").orderBy("__m")) + F.col("__before")
    ties = ties.join(counts, F.col("psource").eqNullSafe(F.col("__s")) & (F.col("__p") == F.col("__q")))
    ties = ties.withColumn("__n", F.col("whole") + (place <= F.col("ties")).cast("int"))
    return out.unionByName(ties.select(*out.columns))


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, repeats`` of every row of ``docs(doc_id, text, source)``.

    Sources stand in code point order, null last, and take ``weights`` in turn; ``budget`` times all words
    are shared out, at most ``max_epochs`` times a source's own. With q = target / source size, every
    document is taken floor(q) times, and once more if it is drawn: documents stand in the order of an MD5
    of their id, the seed and their text, and are drawn while the middle of their words lies within the
    remaining target. So a source's words meet its target to half a document, and no document exceeds
    ``max_epochs`` times its size when that is a whole number.

    The draw needs no sort of a source: words are summed in bins of the hash, the bin where the target
    ends is found from these sums, and only its documents are put in order. What a source needs is then
    one row: whole repetitions and the last hash drawn. At most ``MAX_SOURCES`` sources are allowed, more
    are an error; that bounds the driver's table, and what is broadcast is bounded by ``BROADCAST_BYTES``.

    Null and empty texts have size 0; a source of size 0 has target 0; a null ``doc_id`` is hashed as an
    empty text; rows alike in id and text are drawn one by one, so a source of repeated rows meets its target
    too (which of them is drawn makes no difference); an empty table gives an empty result; further
    columns are ignored.
    """
    sized, plan, weight = source_plan(docs, weights, budget, max_epochs, seed)
    rows = sized.join(small(plan, weight), F.col("source").eqNullSafe(F.col("psource")))
    out = with_repeats(rows, F.col("draw"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("__n")).alias("taken"), F.col("__n").alias("repeats"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """``docs`` with every row repeated as :func:`mixture` says; rows taken zero times go, columns stay.

    Each row is judged where it stands, from its source's one row of the plan, so no text is shuffled but of
    rows that are alike. Awkward input is treated as there: texts without words are size 0 and repeated like
    others of their source, an empty table stays empty.
    """
    _, plan, weight = source_plan(docs, weights, budget, max_epochs, seed)
    plan = plan.select("psource", "whole", "cut", "ties")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("__d")).join(small(plan, weight), F.col("__d.source").cast("string").eqNullSafe(F.col("psource")))
    out = with_repeats(rows, draw_of(F.col("__d.doc_id").cast("long"), F.col("__d.text"), seed))
    out = out.where("__n > 0").select("__d", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i"))
    return out.select(*[F.col(f"__d.`{c}`").alias(c) for c in docs.columns])
