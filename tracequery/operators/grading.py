"""Grading of model outputs: tags, answer, failure reasons, format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..policies import FAILURE_REASONS, FORMAT_FAILURES


def grade(df: DataFrame, raw: str = "raw_output", gold: str = "gold_answer", truncated: str | None = None, error: str | None = None, arrow: bool = True) -> DataFrame:
    """Adds reasoning, predicted_answer, answer_source, the five flags and ``validation_errors``.

    A tagged answer wins over the rest of the text, even where the tags are malformed. More than one number
    in the answer is ambiguous. A null output counts as empty. Reasons stand in the order of
    ``FAILURE_REASONS``. All but unusual number forms is expressions; see :func:`numeric.same_number`.
    """
    out = df.withColumn("__raw", F.coalesce(F.col(raw), F.lit("")))
    out = T.staged(out, {"__tags": T.tag_structure(F.col("__raw")), "__r": T.tag(F.col("__raw"), "reasoning"), "__f": T.tag(F.col("__raw"), "final_answer")})
    tagged = F.col("__f").isNotNull()
    out = T.staged(out, {"__c": F.when(tagged, N.candidates(F.col("__f"))), "__fall": F.when(~tagged, N.committed_answer(F.col("__raw")))})
    many = F.coalesce(F.size("__c") > 1, F.lit(False))
    answer = F.when(tagged, F.when(~many, N.tidy(F.try_element_at("__c", F.lit(1))))).otherwise(F.col("__fall.answer"))
    out = T.staged(out, {"predicted_answer": answer, "__amb": F.when(tagged, many).otherwise(F.col("__fall.ambiguous"))})
    found = F.col("predicted_answer").isNotNull()
    out = T.staged(out, {"__a": N.normalized(F.col("predicted_answer")), "__g": N.normalized(F.col(gold))})
    out = T.staged(out, {"is_correct": found & N.same_number(F.col("__a"), F.col("__g"), arrow, stripped=True)})
    cut = F.coalesce(F.col(truncated), F.lit(False)) if truncated else F.lit(False)
    failed = F.col(error).isNotNull() if error else F.lit(False)
    flags = {
        "wrong_answer": found & ~F.col("is_correct"),
        "missing_reasoning_tag": F.col("__tags.reasoning_missing"),
        "missing_final_answer_tag": F.col("__tags.final_missing"),
        "malformed_reasoning_tag": F.col("__tags.reasoning_malformed"),
        "empty_reasoning": F.col("__r") == "",
        "malformed_final_answer_tag": F.col("__tags.final_malformed"),
        "non_numeric_final_answer": tagged & ~N.is_strict(F.col("__f")),
        "ambiguous_final_answer": F.col("__amb"),
        "no_extractable_answer": ~found & ~F.col("__amb"),
        "truncated_output": cut,
        "generation_error": failed,
    }
    out = T.staged(out, {"validation_errors": T.tags_in_order([(r, flags[r]) for r in FAILURE_REASONS])})
    valid = ~F.arrays_overlap("validation_errors", F.array(*map(F.lit, FORMAT_FAILURES)))
    out = out.withColumns({
        "reasoning": F.coalesce("__r", F.lit("")),
        "answer_source": F.when(tagged, "final_answer_tag").when(found, "fallback").otherwise("missing"),
        "answer_extracted": found,
        "is_valid_format": valid,
        "is_correct_and_valid": F.col("is_correct") & valid,
        "is_truncated": cut,
    })
    return out.drop("__raw", "__tags", "__r", "__f", "__c", "__fall", "__amb", "__a", "__g")


def training_score(text: Column, gold: Column, answer_only: bool = False) -> Column:
    """Struct (correct, valid) of a completion seen during training: tags by plain presence, answer within 1e-6."""
    def both(name: str) -> Column:
        return F.contains(text, F.lit(f"<{name}>")) & F.contains(text, F.lit(f"</{name}>"))

    valid = both("final_answer") if answer_only else both("final_answer") & both("reasoning")
    predicted = N.lenient_float(T.tag(text, "final_answer"))
    return F.struct(N.close_to(predicted, F.regexp_replace(gold, ",", "").try_cast("double")).alias("correct"), valid.alias("valid"))
