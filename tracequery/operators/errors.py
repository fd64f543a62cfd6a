"""Rule-based classes of wrong but valid outputs; the first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as T
from ..policies import ERROR_CLASSES


def wrong_but_valid(df: DataFrame) -> DataFrame:
    """Rows with a valid, complete, wrong output; null flags count as false."""
    def flag(name: str):
        return F.coalesce(F.col(name), F.lit(False))

    return df.where(~flag("is_correct") & flag("is_valid_format") & ~flag("is_truncated"))


def classify(df: DataFrame, target: str | None = None) -> DataFrame:
    """Adds ``label`` and ``evidence``, what the rule saw, from question, reasoning, gold_answer and
    predicted_answer; ``target`` names a column with the training target, without which the overlap rule never matches."""
    q, r = F.coalesce("question", F.lit("")), F.coalesce("reasoning", F.lit(""))
    out = T.staged(df, {
        "__gold": N.lenient_float(F.col("gold_answer")),
        "__pred": N.lenient_float(F.col("predicted_answer")),
        "__eq": N.equations(r),
        "__wrong": N.wrong_equations(r),
        "__steps": T.named_steps(r),
        "__qn": N.numbers(q),
        "__rn": N.numbers(r),
        "__ql": F.lower(q),
    })
    gold, pred, steps, asked = F.col("__gold"), F.col("__pred"), F.col("__steps"), F.col("__ql")
    no = F.lit(False)
    both = gold.isNotNull() & pred.isNotNull()
    ratio = F.when(both & (gold != 0), F.try_divide(pred, gold))
    values = F.transform("__qn", lambda x: F.regexp_replace(x, ",", "").cast("double"))
    last = F.try_element_at(F.col("__eq"), F.lit(-1))["c"]
    extraction = (F.abs(last - gold) < 1e-6) & (pred.isNull() | (F.abs(pred - gold) > 1e-6))
    scaled = F.coalesce(*[F.when(F.abs(ratio - s) < 0.02, F.lit(True)) for s in (10, 100, 1000, 0.1, 0.01, 0.001)], no)
    tip = F.contains(asked, F.lit("tip")) & F.contains(asked, F.lit("total")) & both & (pred < gold) & F.exists(values, lambda v: F.abs(pred - v) < 1e-6)
    each = asked.rlike(r"\beach\b") & both & ((F.abs(pred - 2 * gold) < 1e-6) | F.coalesce(F.abs(ratio - 2) < 0.05, no))
    left = asked.rlike("left|remain|still need|how much more") & both & (gold != 0) & (F.try_divide(F.abs(pred - gold), F.abs(gold)) > 0.5)
    unused = F.size(F.array_except(F.array_except("__qn", "__rn"), F.array(F.lit("1"), F.lit("2")))) >= 2
    misread = F.coalesce(tip, no) | F.coalesce(each, no) | F.coalesce(left, no) | unused
    operation = (F.abs(ratio - 2) < 0.05) | (F.abs(ratio - 0.5) < 0.05)

    def invented(n):
        v = F.regexp_replace(n, ",", "").cast("double")
        return (F.abs(v) >= 10) & F.forall(values, lambda x: F.abs(v - F.round(x, 6)) > 1e-6)

    hallucinated = (F.size("__qn") > 0) & (F.size(F.array_distinct(F.filter("__rn", invented))) >= 3) & (steps >= 4)
    dropped = (F.regexp_count(asked, F.lit(r"\b(then|after|next|finally|remaining|left)\b")) >= 2) & (F.size("__eq") <= 1) & (steps <= 3)
    def number(c):
        """A double as short as it goes: whole numbers without a point."""
        return F.when(c == F.floor(c), F.format_string("%.0f", c)).otherwise(F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", ""))

    def of(text, *parts):
        return F.format_string(text, *[F.coalesce(p.cast("string"), F.lit("none")) for p in parts])

    unused_numbers = F.array_sort(F.array_except(F.array_except("__qn", "__rn"), F.array(F.lit("1"), F.lit("2"))))
    hints = F.filter(F.array(
        F.when(tip, F.lit("tip alone for the total")), F.when(each, F.lit("twice the amount of each")), F.when(left, F.lit("far from what remains")),
        F.when(unused, F.concat(F.lit("numbers of the question not used: "), F.array_join(F.slice(unused_numbers, 1, 5), ", "))),
    ), lambda x: x.isNotNull())
    mistakes = F.transform(F.slice("__wrong", 1, 3), lambda e: F.concat(e["a"], e["op"], e["b"], F.lit("="), number(e["c"]), F.lit(" (gives "), number(e["value"]), F.lit(")")))
    made_up = F.slice(F.array_sort(F.array_distinct(F.filter("__rn", invented))), 1, 6)
    rules = [
        ("correct_reasoning_wrong_extraction", extraction, of("last equation gives %s, as asked; answered %s", number(last), F.col("predicted_answer"))),
        ("off_by_one", F.abs(F.abs(pred - gold) - 1) < 1e-6, of("answered %s for %s", number(pred), number(gold))),
        ("unit_error", scaled, of("answer is %s times the right one", number(ratio))),
        ("arithmetic_mistake", F.size("__wrong") > 0, F.array_join(mistakes, "; ")),
        ("premature_answer", (steps <= 2) & both, of("%s steps only", steps)),
        ("misunderstood_question", misread, F.array_join(F.slice(hints, 1, 3), "; ")),
        ("wrong_operation", operation, of("answer is %s times the right one", number(ratio))),
        ("hallucinated_reasoning", hallucinated, F.concat(F.lit("numbers from nowhere: "), F.array_join(made_up, ", "))),
        ("dropped_intermediate_step", dropped, of("a question of many parts, but %s equations and %s steps", F.size("__eq"), steps)),
    ]
    if target:
        shared = T.overlap(F.col(target), r)
        rules.append(("copied_irrelevant_teacher_pattern", (shared < 0.05) & (steps >= 6), of("shares %s of the target's words", number(shared))))
    # One struct a rule, so that each is looked at once.
    found = F.coalesce(*[F.when(F.coalesce(on, no), F.struct(F.lit(name).alias("label"), why.alias("evidence"))) for name, on, why in rules], F.struct(F.lit("other").alias("label"), F.lit("no rule matches").alias("evidence")))
    out = T.staged(out, {"__found": found}).withColumns({"label": F.col("__found.label"), "evidence": F.col("__found.evidence")})
    return out.drop("__found", "__gold", "__pred", "__eq", "__wrong", "__steps", "__qn", "__rn", "__ql")


def class_counts(labelled: DataFrame) -> DataFrame:
    """``label, n`` for every class, zero where none."""
    known = labelled.sparkSession.createDataFrame([(c,) for c in ERROR_CLASSES], "label string")
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def first_examples(labelled: DataFrame, order: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows of each class in the given order. The smallest rows are found by a partially
    aggregated top-k where a class may be large: rank limits are pushed below the shuffle by the planner."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order))
    return labelled.withColumn("rank", rank).where(F.col("rank") <= k)
