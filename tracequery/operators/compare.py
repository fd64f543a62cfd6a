"""Paired runs, significance tests, comparison tables and merged summaries."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..schemas import SUMMARY_FIELDS
from .state import latest_state

EXACT_BELOW = 25


def paired(a: DataFrame, b: DataFrame, key: str = "problem_id", order: str = "event_seq", flag: str = "is_correct") -> DataFrame:
    """``key, a_correct, b_correct`` for the ids that both runs have, by the latest record of each."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return latest_state(df, key, order).select(key, F.coalesce(flag, F.lit(False)).alias(name))

    return side(a, "a_correct").join(side(b, "b_correct"), key)


def contingency(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a_correct"), F.col("b_correct")
    return pairs.agg(
        F.count_if(a & b).alias("both_correct"), F.count_if(~a & ~b).alias("both_wrong"), F.count_if(a & ~b).alias("only_a_correct"), F.count_if(~a & b).alias("only_b_correct")
    )


def overlap_of(a: DataFrame, b: DataFrame, key: str = "problem_id") -> DataFrame:
    """``n_records_a, n_records_b, shared_n, overlap_warning`` of two runs: distinct ids of each, those that both have,
    and whether either has ids that the other lacks, so that a paired test leaves them out."""
    ids = a.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("a")).join(b.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("b")), key, "full_outer")
    out = ids.agg(F.count("a").alias("n_records_a"), F.count("b").alias("n_records_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared_n"))
    return out.withColumn("overlap_warning", F.col("shared_n") < F.least("n_records_a", "n_records_b"))


def transition(a: Column, b: Column) -> Column:
    return F.when(~a & b, "improvement").when(a & ~b, "regression").when(a, "same_correct").otherwise("same_wrong")


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else math.erfc(v))


def binomial_two_sided(n: Column, k: Column) -> Column:
    """Exact two-sided p of k successes in n fair trials: the mass of all outcomes at most as likely."""
    def mass(i: Column) -> Column:
        picks = F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(1.0), lambda acc, j: acc * (n - i + j) / j)
        return F.when(i == 0, F.lit(1.0)).otherwise(picks) * F.pow(F.lit(0.5), n.cast("double"))

    here = mass(k)
    total = F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda acc, i: acc + F.when(mass(i) <= here + 1e-12, mass(i)).otherwise(0.0))
    return F.least(total, F.lit(1.0))


def mcnemar(table: DataFrame) -> DataFrame:
    """Adds discordant, method, statistic, p_value and significant to a contingency row.

    No discordant pair: p is 1. Fewer than 25: the exact binomial test. Else chi-square with continuity
    correction; its tail needs erfc, which SQL lacks, so one number goes through Arrow.
    """
    a, b = F.col("only_a_correct").cast("int"), F.col("only_b_correct").cast("int")
    n = a + b
    out = table.withColumn("discordant", n).withColumn("method", F.when(n < EXACT_BELOW, "exact_binomial").otherwise("chi_square_continuity"))
    chi = F.when(n >= EXACT_BELOW, F.pow(F.abs(a - b) - 1.0, F.lit(2.0)) / n)
    out = out.withColumn("statistic", chi)
    exact = F.when(n == 0, F.lit(1.0)).when(n < EXACT_BELOW, binomial_two_sided(F.least(n, F.lit(EXACT_BELOW)), F.least(a, b, F.lit(EXACT_BELOW))))
    out = out.withColumn("p_value", F.coalesce(exact, _erfc(F.sqrt(F.col("statistic") / 2))))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def bootstrap_interval(df: DataFrame, flag: str = "is_correct", order: str = "source_index", resamples: int = 2000, confidence: float = 0.95, seed: int = 42, most: int = 2_000_000) -> DataFrame:
    """Percentile bootstrap interval of a mean with Python's own generator, exact to the draw.

    Resampling 0/1 outcomes needs them in order in one place; ``most`` bounds that. For larger inputs use
    :func:`bootstrap_large`, which needs the two counts only.
    """
    rows = df.select(F.coalesce(F.col(flag), F.lit(False)).cast("int").alias("y"), F.col(order).alias("o")).limit(most + 1)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError("too many rows for an exact bootstrap")
        y, n = pdf.sort_values("o")["y"].tolist(), len(pdf)
        rng = random.Random(seed)
        means = sorted(sum(y[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
        alpha = (1 - confidence) / 2
        return pd.DataFrame({"ci_lower": [means[int(alpha * resamples)]], "ci_upper": [means[int((1 - alpha) * resamples) - 1]]})

    return rows.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "ci_lower double, ci_upper double")


def bootstrap_large(df: DataFrame, flag: str = "is_correct", resamples: int = 2000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """The same interval for any size: a resample's count of n draws is binomial, so the counts suffice."""
    counts = df.agg(F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("k"), F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            for k, n in zip(pdf["k"], pdf["n"]):
                if n:
                    means = np.sort(np.random.default_rng(seed).binomial(n, k / n, resamples) / n)
                    alpha = (1 - confidence) / 2
                    yield pd.DataFrame({"ci_lower": [means[int(alpha * resamples)]], "ci_upper": [means[int((1 - alpha) * resamples) - 1]]})

    return counts.mapInPandas(run, "ci_lower double, ci_upper double")


def improvement(before: Column, after: Column, teacher: Column | None = None) -> dict[str, Column]:
    """Absolute and relative improvement, and the gap to the teacher; null where undefined."""
    gain = after - before
    return {
        "absolute_improvement": gain,
        "relative_improvement": F.when(before > 0, gain / F.when(before > 0, before)),
        "gap_to_teacher_accuracy": teacher - after if teacher is not None else F.lit(None).cast("double"),
    }


def summary_rows(metrics: DataFrame) -> DataFrame:
    """Metric rows as the 18 columns of a summary; missing ones are null, memory is in GiB."""
    have = set(metrics.columns)
    renamed = {"mean_inference_seconds": "average_inference_seconds"}

    def pick(name: str) -> Column:
        source = renamed.get(name, name)
        if name == "peak_cuda_memory_gb" and "peak_memory_bytes" in have:
            return F.col("peak_memory_bytes") / (1024**3)
        return F.col(source) if source in have else F.lit(None).cast("string" if name in SUMMARY_FIELDS[:3] else "double")

    return metrics.select(*[pick(f).alias(f) for f in SUMMARY_FIELDS])


def merge_summaries(files: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of many summaries in file and row order with ``source_file``; only the first teacher row stays.

    Each input needs ``row_no``. The inputs are summaries: a few rows each.
    """
    out = None
    for i, (name, df) in enumerate(files):
        cols = [F.col(f).cast("string").alias(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in SUMMARY_FIELDS]
        rows = df.select(F.lit(name).alias("source_file"), F.lit(i).alias("__file"), F.col("row_no").alias("__row"), *cols)
        out = rows if out is None else out.unionByName(rows)
    first = out.where(F.col("condition") == "teacher").agg(F.min(F.struct("__file", "__row")).alias("__first"))
    out = out.crossJoin(F.broadcast(first)).where((F.col("condition") != "teacher") | F.col("condition").isNull() | (F.struct("__file", "__row") == F.col("__first")))
    return out.orderBy("__file", "__row").drop("__file", "__row", "__first")


def error_table(before: DataFrame, after: DataFrame) -> DataFrame:
    """``reason, before, after`` over the reasons of either run, zero where none, most frequent first."""
    sides = [df.select(F.explode("validation_errors").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias(n)) for df, n in ((before, "before"), (after, "after"))]
    out = sides[0].join(sides[1], "reason", "full_outer").select("reason", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("before", "after")])
    return out.orderBy(F.desc(F.col("before") + F.col("after")), "reason")
