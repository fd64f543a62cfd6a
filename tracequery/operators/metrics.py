"""Aggregates over graded outputs and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rate
from ..policies import FAILURE_REASONS


def flag(name: str) -> Column:
    """A boolean column whose null counts as false."""
    return F.coalesce(F.col(name), F.lit(False))


def rates(df: DataFrame, *by: str) -> DataFrame:
    """Counts and zero-safe rates of the grading flags."""
    total = F.count(F.lit(1))
    names = {"exact_match_accuracy": "is_correct", "valid_format_rate": "is_valid_format", "answer_extraction_success_rate": "answer_extracted", "correct_and_valid_rate": "is_correct_and_valid", "truncation_rate": "is_truncated"}
    return df.groupBy(*by).agg(total.alias("total_examples"), *[rate(F.count_if(flag(c)), total).alias(n) for n, c in names.items()])


def seconds_of(seconds: str = "elapsed_seconds", errors: str = "validation_errors") -> Column:
    """Inference seconds that count: not negative and not of a failed generation."""
    failed = F.coalesce(F.array_contains(errors, "generation_error"), F.lit(False))
    return F.when((F.col(seconds) >= 0) & ~failed, F.col(seconds))


def timing(df: DataFrame, seconds: Column, tokens: Column, *by: str) -> DataFrame:
    """Mean, median and interpolated 95th percentile of seconds, and tokens per second; null where empty."""
    s, t = df.withColumn("__s", seconds).withColumn("__t", tokens), F.sum("__s")
    return s.groupBy(*by).agg(
        F.avg("__s").alias("average_inference_seconds"),
        F.median("__s").alias("median_inference_seconds"),
        F.percentile("__s", 0.95).alias("p95_inference_seconds"),
        F.when(t > 0, F.sum("__t") / t).alias("completion_tokens_per_second"),
    )


def tag_histogram(df: DataFrame, tags: str = "validation_errors", known: tuple[str, ...] = FAILURE_REASONS) -> DataFrame:
    """``reason, n`` for every known tag, zero where none."""
    counts = df.select(F.explode(tags).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(k,) for k in known], "reason string")
    return names.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def top_tags(df: DataFrame, tags: str = "validation_errors", order: str = "event_seq", k: int = 10) -> DataFrame:
    """The ``k`` most frequent tags; of equal counts the one met first."""
    seen = df.select(F.struct(F.col(order), F.col("pos")).alias("at"), "reason") if "pos" in df.columns else df.select(F.col(order).alias("o"), F.posexplode(tags).alias("p", "reason")).select(F.struct("o", "p").alias("at"), "reason")
    counts = seen.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    return counts.orderBy(F.desc("n"), "at").limit(k).select("reason", "n")


def failure_map(df: DataFrame, tags: str = "validation_errors", known: tuple[str, ...] = FAILURE_REASONS) -> list[Column]:
    """Aggregates that count each known tag, to be zipped into one map."""
    return [F.count_if(F.array_contains(tags, k)).alias(k) for k in known]


def metrics_document(df: DataFrame, *by: str) -> DataFrame:
    """One row per group with all rates, timing, totals and the failure counts as a map, in a single aggregation."""
    total = F.count(F.lit(1))
    df = df.withColumn("__s", seconds_of())
    t = F.sum("__s")
    out = df.groupBy(*by).agg(
        total.alias("total_examples"),
        rate(F.count_if(flag("is_correct")), total).alias("exact_match_accuracy"),
        rate(F.count_if(flag("is_valid_format")), total).alias("valid_format_rate"),
        rate(F.count_if(flag("answer_extracted")), total).alias("answer_extraction_success_rate"),
        rate(F.count_if(flag("is_correct_and_valid")), total).alias("correct_and_valid_rate"),
        rate(F.count_if(flag("is_truncated")), total).alias("truncation_rate"),
        rate(F.count_if(F.array_contains("validation_errors", "generation_error")), total).alias("generation_error_rate"),
        F.avg("completion_tokens").alias("average_completion_tokens"),
        F.avg("__s").alias("average_inference_seconds"),
        F.median("__s").alias("median_inference_seconds"),
        F.percentile("__s", 0.95).alias("p95_inference_seconds"),
        F.when(t > 0, F.coalesce(F.sum("completion_tokens"), F.lit(0)) / t).alias("completion_tokens_per_second"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("completion_tokens").alias("total_completion_tokens"),
        t.alias("total_inference_seconds"),
        F.max("peak_memory_bytes").alias("peak_memory_bytes"),
        *failure_map(df),
    )
    counts = F.map_from_arrays(F.array(*map(F.lit, FAILURE_REASONS)), F.array(*FAILURE_REASONS))
    return out.withColumn("failure_reason_counts", counts).drop(*FAILURE_REASONS)


def distinct_tags(df: DataFrame, tags: str = "validation_errors") -> DataFrame:
    """``reason`` of every tag that some row has."""
    return df.select(F.explode(tags).alias("reason")).distinct()


def distinct_ids(df: DataFrame, key: str = "problem_id") -> DataFrame:
    """``ids, n``: distinct ids and rows."""
    return df.agg(F.countDistinct(key).alias("ids"), F.count(F.lit(1)).alias("n"))


def subset_metrics(state: DataFrame, candidates: int, *by: str) -> DataFrame:
    """Accepted and rejected rows, lifetime totals, throughput and acceptance of an event log's latest state."""
    seconds, tokens = F.sum("lifetime_elapsed_seconds"), F.coalesce(F.sum("lifetime_completion_tokens"), F.lit(0))
    accepted, prompt = F.count_if(F.col("status") == "accepted"), F.coalesce(F.sum("lifetime_prompt_tokens"), F.lit(0))
    return state.groupBy(*by).agg(
        accepted.alias("accepted"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.coalesce(F.sum("lifetime_attempts"), F.lit(0)).alias("total_attempts"),
        F.round(F.coalesce(seconds, F.lit(0.0)), 3).alias("total_elapsed_seconds"),
        prompt.alias("total_prompt_tokens"),
        tokens.alias("total_completion_tokens"),
        (prompt + tokens).alias("total_tokens"),
        F.when(seconds != 0, F.round(tokens / seconds, 3)).alias("completion_tokens_per_second"),
        F.when(F.lit(candidates) > 0, F.round(accepted / F.lit(max(candidates, 1)), 3)).alias("acceptance_rate"),
    )


def progress(records: DataFrame, total: int, key: str = "problem_id", error: str = "generation_error") -> DataFrame:
    """Records, distinct ids, ids without and with an error, share done and what remains."""
    ids = F.countDistinct(key)
    return records.agg(
        F.count(F.lit(1)).alias("records"),
        ids.alias("unique_ids"),
        F.countDistinct(F.when(F.col(error).isNull(), F.col(key))).alias("error_free_ids"),
        F.count_if(F.col(error).isNotNull()).alias("errors"),
        rate(ids * 100.0, F.lit(total)).alias("percent_done"),
        F.greatest(F.lit(total) - ids, F.lit(0)).alias("remaining"),
    )
