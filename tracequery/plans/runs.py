"""Whole runs: dataset production, evaluation and two-condition comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, state
from ..operators.generate import Backend, generate
from ..operators.grading import grade
from ..operators.metrics import metrics_document
from ..operators.validation import student_target, validate
from ..policies import GENERATOR_PREFIX, GENERATOR_PROMPT, SYSTEM_PROMPT, ValidationPolicy
from ..scratch import materialize


def evaluate_run(problems: DataFrame, done: DataFrame | None, make: Callable[[], Backend], seed: int = 42) -> DataFrame:
    """Graded predictions of all problems that have none without a generation error yet."""
    todo = state.pending(problems, done, F.col("generation_error").isNull()) if done is not None else problems
    out = generate(todo, make, SYSTEM_PROMPT, seed).drop("attempt").withColumnRenamed("text", "raw_output")
    rows = todo.join(out, "problem_id").withColumn("cut", F.coalesce(F.col("finish_reason") == "length", F.lit(False)))
    return grade(rows, truncated="cut", error="generation_error").drop("cut")


def produce_run(
    problems: DataFrame, events: DataFrame | None, make: Callable[[], Backend], policy: ValidationPolicy = ValidationPolicy(), attempts: int = 3, seed: int = 42,
    forbidden: DataFrame | None = None, system: str = GENERATOR_PROMPT, prefix: str = GENERATOR_PREFIX, wait: float = 0.0,
) -> DataFrame:
    """Accepted and rejected events for the problems that are not accepted yet.

    Attempts are made in rounds. A round asks the backend once for every problem still open, and its outputs
    are written before they are judged, so no call is made twice. A problem is settled by its first valid
    output whose reasoning none has that was accepted before (in ``events``, ``forbidden(reasoning_hash)`` or an earlier
    round), nor a problem of the same round with a smaller index. What is open after the last round is
    rejected with its last output. Usage is summed over the attempts; lifetime totals carry over.
    """
    prior = state.latest_state(events) if events is not None else None
    todo = state.pending(problems, prior, state.is_done()) if prior is not None else problems
    left = materialize(todo.select("problem_id", "source_index", "question", "gold_answer"), "open")
    known = [forbidden.select("reasoning_hash")] if forbidden is not None else []
    if prior is not None:
        known.append(prior.where(state.is_accepted()).select("reasoning_hash"))
    made = []
    for n in range(1, attempts + 1):
        tries = materialize(generate(left, make, system, seed, 1, wait=wait if n > 1 else 0.0, first=n, prefix=prefix).withColumnRenamed("text", "raw_output"), "attempts")
        judged = validate(tries.join(left, "problem_id"), policy, finish="finish_reason")
        failed = F.col("generation_error").isNotNull()
        judged = judged.withColumn("is_valid", F.col("is_valid") & ~failed).withColumn("validation_errors", F.when(failed, F.array(F.lit("server_or_client_error"))).otherwise(F.col("validation_errors")))
        judged = state.flag_duplicates(materialize(judged.withColumn("__own", F.when(F.col("is_valid"), F.col("reasoning_hash"))), "judged"), "__own", "source_index")
        twice = F.col("is_duplicate")
        if known:
            every = reduce(DataFrame.union, known).where("reasoning_hash IS NOT NULL").select(F.col("reasoning_hash").alias("__f")).distinct()
            judged = judged.join(every, F.col("__own") == F.col("__f"), "left")
            twice = twice | F.col("__f").isNotNull()
        errors = F.when(F.col("is_valid") & twice, F.array(F.lit("duplicate_reasoning_output"))).otherwise(F.col("validation_errors"))
        judged = judged.withColumn("validation_errors", errors).drop("__own", "__f", "is_duplicate")
        judged = materialize(judged.withColumn("is_valid", F.size("validation_errors") == 0), "round")
        made.append(judged)
        good = judged.where("is_valid")
        known.append(good.select("reasoning_hash"))
        left = left.join(good.select("problem_id"), "problem_id", "left_anti")
        if n < attempts and left.isEmpty():
            break
    best = state.chosen_attempt(reduce(DataFrame.unionByName, made)).drop("elapsed_seconds", "prompt_tokens", "completion_tokens", "total_tokens", "attempt")
    for c in ("elapsed_seconds", "prompt_tokens", "completion_tokens"):
        best = best.withColumnRenamed(f"total_{c}", c)
    best = best.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    best = best.withColumn("status", F.when(F.col("is_valid"), "accepted").otherwise("rejected"))
    best = best.withColumn("student_target", F.when(F.col("is_valid"), student_target(F.col("teacher_reasoning"), F.col("teacher_final_answer"))))
    return state.with_lifetime(best, best.limit(0) if prior is None else prior)


def compare_conditions(before: DataFrame, after: DataFrame, teacher_accuracy: float | None = None) -> DataFrame:
    """Summary rows of two graded runs, with the improvement on the second."""
    def row(df: DataFrame, name: str) -> DataFrame:
        return metrics_document(df).drop("failure_reason_counts").withColumn("condition", F.lit(name))

    a, b = row(before, "before"), row(after, "after")
    base = a.select(F.col("exact_match_accuracy").alias("__before"))
    gains = compare.improvement(F.col("__before"), F.col("exact_match_accuracy"), F.lit(teacher_accuracy) if teacher_accuracy is not None else None)
    b = b.crossJoin(F.broadcast(base)).withColumns({"absolute_improvement_over_before": gains["absolute_improvement"], "relative_improvement_over_before": gains["relative_improvement"], "gap_to_teacher_accuracy": gains["gap_to_teacher_accuracy"]}).drop("__before")
    return compare.summary_rows(a).unionByName(compare.summary_rows(b))
