"""Quality rules for generated answers, and the rescue of rows that a stricter rule rejected."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..policies import RESCUE_CALCULATION, STRICT_CALCULATION, ValidationPolicy


def validate(df: DataFrame, policy: ValidationPolicy = ValidationPolicy(), raw: str = "raw_output", gold: str = "gold_answer", finish: str | None = None, thoughts: str | None = None, arrow: bool = True) -> DataFrame:
    """Adds is_valid, validation_errors, format_warnings, the parsed reasoning and answer, and their counts.

    Errors and warnings stand in the order of the rules; a row is valid if it has no error. The rules that
    look at the reasoning apply only if there is any.
    """
    out = df.withColumn("__raw", F.coalesce(F.col(raw), F.lit("")))
    out = T.staged(out, {"__t": T.tag_structure(F.col("__raw")), "__r": T.tag(F.col("__raw"), "reasoning"), "__f": T.tag(F.col("__raw"), "final_answer"), "__out": T.outside_tags(F.col("__raw"))})
    tagged = F.col("__f").isNotNull()
    answer = F.when(tagged, N.first_number(F.col("__f"), N.GENERATOR_SIGNS)).otherwise(N.loose_answer(F.col("__raw")))
    out = T.staged(out, {"teacher_reasoning": F.coalesce("__r", F.lit("")), "teacher_final_answer": answer})
    reasoning, given = F.col("teacher_reasoning"), F.col("teacher_reasoning") != ""
    out = T.staged(out, {
        "reasoning_character_count": F.length(reasoning),
        "reasoning_word_count": T.word_count(reasoning),
        "__lines": T.lines(reasoning),
        "numbered_step_count": T.numbered_steps(reasoning),
        "is_correct": answer.isNotNull() & N.same_number(F.col("teacher_final_answer"), F.col(gold), arrow),
    })
    out = out.withColumn("reasoning_line_count", F.size("__lines"))
    outside, steps = F.length("__out") > 0, F.col("numbered_step_count")
    errors = [
        ("truncated_output", F.col(finish) == "length" if finish else F.lit(False)),
        ("duplicate_or_malformed_reasoning_tags", F.col("__t.reasoning_malformed")),
        ("duplicate_or_malformed_final_answer_tags", F.col("__t.final_malformed")),
        ("non_numeric_text_inside_final_answer_tag", tagged & ~N.is_strict(N.normalized(F.col("__f"), N.GENERATOR_SIGNS))),
        ("missing_tagged_final_answer", ~tagged),
        ("missing_or_invalid_numeric_answer", F.col("teacher_final_answer").isNull()),
        ("missing_tagged_reasoning", ~given),
        ("reasoning_too_long", F.col("reasoning_character_count") > policy.most_characters),
        ("reasoning_too_short", given & ((F.col("reasoning_character_count") < policy.least_characters) | (F.col("reasoning_word_count") < policy.least_words))),
        ("reasoning_lacks_calculation_detail", given & ~reasoning.rlike(policy.calculation) & F.lit(policy.require_calculation)),
        ("too_many_reasoning_lines", F.col("reasoning_line_count") > policy.most_lines),
        ("repetitive_reasoning_lines", T.repeated_more_than(F.col("__lines"), policy.most_repeated_lines)),
        ("repetitive_reasoning_sentences", T.repeated_more_than(T.sentences(reasoning, policy.least_sentence), policy.most_repeated_sentences)),
        ("significant_text_outside_required_tags", F.col("__r").isNotNull() & tagged & (F.length("__out") > policy.outside_limit) & F.lit(policy.reject_outside)),
        ("wrong_answer", F.col("teacher_final_answer").isNotNull() & ~F.col("is_correct")),
    ]
    warnings = [
        ("raw_reasoning_content_present_but_not_used", ~given & T.present(T.strip(F.col(thoughts))) if thoughts else F.lit(False)),
        ("step_count_outside_recommended_range", (steps > 0) & ~steps.between(policy.least_steps, policy.most_steps)),
        ("no_numbered_steps_detected", steps == 0),
        ("text_outside_required_tags", outside),
    ]
    out = T.staged(out, {
        "validation_errors": T.tags_in_order(errors),
        "format_warnings": T.tags_in_order(warnings),
        "answer_source": F.when(tagged, "final_answer_tag").otherwise("fallback"),
        "reasoning_source": F.when(given, "reasoning_tag").otherwise("missing"),
        "reasoning_hash": F.when(given, T.reasoning_hash(reasoning)),
    })
    out = out.withColumn("is_valid", F.size("validation_errors") == 0)
    return out.drop("__raw", "__t", "__r", "__f", "__out", "__lines")


def student_target(reasoning: Column, answer: Column) -> Column:
    return F.concat(F.lit("<reasoning>\n"), T.strip(reasoning), F.lit("\n</reasoning>\n<final_answer>"), answer, F.lit("</final_answer>"))


def falsely_rejected(strict: str = STRICT_CALCULATION, loose: str = RESCUE_CALCULATION) -> Column:
    """Correct rows that were rejected for lack of a calculation which only the looser pattern sees."""
    errors = F.coalesce("validation_errors", F.array().cast("array<string>"))
    text = F.coalesce("teacher_reasoning", F.lit(""))
    has = F.array_contains(errors, "reasoning_lacks_calculation_detail") & ~F.array_contains(errors, "wrong_answer")
    return F.coalesce(F.col("is_correct"), F.lit(False)) & has & ~text.rlike(strict) & text.rlike(loose)


def rescue(rejected: DataFrame, strict: str = STRICT_CALCULATION, loose: str = RESCUE_CALCULATION, raw: str = "raw_output", gold: str = "gold_answer", arrow: bool = True) -> DataFrame:
    """Rejected rows that pass under the looser pattern, as accepted ones with their training target.

    Both rule sets are applied in one pass; rows that pass the strict one now, or still fail the loose
    one, are left out.
    """
    keep = [c for c in rejected.columns if c not in ("is_valid", "validation_errors", "format_warnings", "teacher_reasoning", "teacher_final_answer", "is_correct")]
    found = rejected.where(falsely_rejected(strict, loose)).select(*keep)
    once = validate(found, replace(ValidationPolicy(), calculation=strict), raw, gold, arrow=arrow).withColumnRenamed("is_valid", "__strict").select(*keep, "__strict")
    again = validate(once, replace(ValidationPolicy(), calculation=loose), raw, gold, arrow=arrow)
    out = again.where(~F.col("__strict") & F.col("is_valid")).drop("__strict")
    target = student_target(F.col("teacher_reasoning"), F.col("teacher_final_answer"))
    return out.withColumns({"status": F.lit("accepted"), "student_target": target, "rescued_from": F.lit("dollar_calc_regex")})
